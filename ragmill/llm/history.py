"""Problem 5: checking new batches against all history without reading it again.

A prefix-tree hash forest. A text's label in a tree is the sequence of the first tokens it has in the tree's order of all
tokens. The forest keeps the labels of everything accepted in runs on the shared file system, cut into buckets and sorted;
beside them, sorted by key, ids and texts. A batch adds a run and ``merge_runs`` makes one of many.

A batch's labels go to their buckets, and each bucket's task opens the sorted runs itself: from the first and last label of
every block it sees which blocks it needs, reads only those, and finds by range search what shares a prefix with each entry. The
prefix is widened from the whole label down to the longest one whose expected recall at the threshold reaches the target for
the text's size. What is found passes sizes and sketches, then parities, and is verified on whole texts, for which only the
row groups that hold candidates are read. Neither texts nor labels of the history are scanned, whatever its length.

Defined results: a null or blank id, and a null or blank text, match nothing; ids compare without case and surrounding white
space; a text without any word matches equal texts only; of rows that repeat each other the first by batch, then by row
number stays (a null batch comes before all others); no history or no batch gives no matches; keys are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm import neardup, prefixes, words
from ragmill.llm.neardup import LABELS, LOCAL, PAIRS, Parts, Unit, entry_parts, met_rows, parities, shuffle_rows, verified
from ragmill.llm.prefixes import Entries, cross_pairs, distinct_pairs, integer_key, packed, self_pairs
from ragmill.session import materialise, qualified, released, scratch_path
from ragmill.sources.shared import parquet_files, row_groups_with

#: Trees, tokens of a label, and the expected share of the texts at the threshold that a search finds.
TREES, DEEPEST, RECALL = 40, 6, 0.999
#: Entries per block, blocks per row group and texts per row group of a run: what a lookup reads at the least.
BLOCK, BLOCKS_TOGETHER, TEXTS_TOGETHER = 4_096, 4, 500
#: Records per bucket and per slot of texts that their numbers aim at when a forest is made.
PER_BUCKET, PER_SLOT = 40_000, 40_000
#: Rounds after which rows that are still open are settled by component, and marks of a component that a task takes at most.
ROUNDS, MOST_TOGETHER = 6, 500_000
# Kinds of rows beside those of problem 1: marks are hashes of word multisets and of ids.
PRINTS, IDS, HELD, HELD_IDS, READ = range(20, 25)
WINDOWS = "bucket int, kind tinyint, first bigint, last bigint, base bigint, blob binary"


def plain_id(column: Column) -> Column:
    """An id without case and surrounding white space; null if nothing is left."""
    space = r"[\s\p{Z}\u200B\uFEFF\x1c-\x1f\x85]"
    return F.nullif(F.lower(F.regexp_replace(column, f"^{space}+|{space}+$", "")), F.lit(""))


def as_rows(df: DataFrame, key: str, id_: str, text: str) -> DataFrame:
    """(key, id, text): ids in their plain form."""
    integer_key(df.schema, key)
    return df.select(F.col(key).cast("bigint").alias("key"), plain_id(F.col(id_)).alias("id"), F.col(text).alias("text"))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _marks(label: np.ndarray, keys: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    zero = np.zeros(len(keys), np.uint64)
    return packed(label >> np.uint64(16), keys, n, zero, zero.astype(np.uint32), zero.astype(np.uint16), (label % np.uint64(buckets)).astype(np.int32))


def mark_rows(rows: DataFrame, forest: prefixes.Forest, buckets: int, asks: bool) -> DataFrame:
    """What the tasks hand out of rows (key, id, text), packed by bucket: labels and hashes of the different texts, hashes of
    ids; if they ask, also copies and parities."""

    def handed(unit: Unit) -> Iterator[pa.RecordBatch]:
        keys, prints, tokens, row, counts, local, copy = unit.collapsed()
        out = [(b, LABELS, base, blob) for b, base, blob in entry_parts(forest, keys, prints, tokens, counts, buckets)]
        sizes = np.minimum(counts, prefixes.MOST_SIZE).astype(np.uint16)
        out += [(b, PRINTS, base, blob) for b, base, blob in _marks(prints[:, 0], keys, sizes, buckets)]
        if asks:
            out += neardup.shared_rows(keys, prints, tokens, row, counts, local, copy, buckets)
        for i in range(0, len(out), 2_000):
            yield shuffle_rows(out[i : i + 2_000])

    def run(batches):
        import xxhash

        hashes, unit = words.WordHashes(), Unit()
        for batch in batches:
            known = [(k, i) for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i is not None and k is not None]
            if known:
                hashed = np.fromiter((xxhash.xxh3_64_intdigest(i.encode("utf-8", "surrogatepass")) for _, i in known), np.uint64, len(known))
                keys = np.fromiter((k for k, _ in known), np.int64, len(known))
                yield shuffle_rows([(b, IDS, base, blob) for b, base, blob in _marks(hashed, keys, np.ones(len(keys), np.uint16), buckets)])
            blank = pa.array([""] * batch.num_rows)
            part = pa.RecordBatch.from_arrays([batch.column(0), blank, batch.column(2)], names=["key", "within", "text"])
            for keys, texts, salts in neardup.sliced([part]):
                unit.add(keys, texts, salts, hashes)
                if unit.full():
                    yield from handed(unit)
                    unit = Unit()
        if unit.records:
            yield from handed(unit)

    return rows.select("key", "id", "text").mapInArrow(run, neardup.SHUFFLED)


def sorted_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of each bucket as sorted blocks; of equal entries one stays."""

    def run(group: pa.Table) -> pa.Table:
        parts, out = Parts(group), []
        bucket = group.column("bucket")[0].as_py()
        for kind in (LABELS, PRINTS, IDS):
            entries = parts.entries(kind)
            for i in range(0, len(entries), block):
                part = entries.take(slice(i, i + block))
                out.append((bucket, kind, int(part.label[0]), int(part.label[-1]), *part.blob()))
        columns = list(zip(*out)) or [()] * 6
        types = [pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "kind", "first", "last", "base", "blob"])

    return rows.groupBy("bucket").applyInArrow(run, WINDOWS)


class Window:
    """Reads what is needed of one bucket of the runs; counts the bytes."""

    def __init__(self, runs: list[str], bucket: int):
        self.files = list(parquet_files([f"{run}/labels/bucket={bucket}" for run in runs]))
        self.read = 0
        self.blocks = []
        for file in self.files:
            for group in range(file.num_row_groups):
                seen = file.read_row_group(group, columns=["kind", "first", "last"])
                self.blocks.append((file, group, *(seen.column(c).to_numpy() for c in ("kind", "first", "last"))))

    def entries(self, kind: int, low: np.ndarray, high: np.ndarray) -> Entries:
        """The entries of the blocks that the ranges [low, high) touch."""
        bases, blobs = [], []
        order = np.argsort(low)
        low, most = low[order].astype(np.int64), np.maximum.accumulate(high[order].astype(np.int64)) if len(low) else high
        for file, group, kinds, first, last in self.blocks:
            at = np.searchsorted(low, last, side="right")
            touched = (kinds == kind) & (at > 0) & (np.append(0, most)[at] > first)
            if touched.any():
                meta = file.metadata.row_group(group)
                self.read += sum(meta.column(c).total_compressed_size for c in range(meta.num_columns))
                table = file.read_row_group(group, columns=["base", "blob"])
                base, blob = table.column("base").to_pylist(), table.column("blob")
                for i in np.flatnonzero(touched):
                    bases.append(base[i])
                    blobs.append(blob[int(i)].as_py())
        return prefixes.unpacked(bases, blobs)


def equal_marks(asked: Entries, held: Entries) -> tuple[np.ndarray, np.ndarray]:
    """(keys asked, keys held) of entries with the same mark."""
    first, last = np.searchsorted(held.label, asked.label), np.searchsorted(held.label, asked.label, side="right")
    pairs = [(asked.key[i], held.key[j]) for i, j in prefixes.runs(first, last)]
    return tuple(np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2


def lookups(rows: DataFrame, forest: prefixes.Forest, runs: list[str]) -> DataFrame:
    """What a batch's entries meet: in the runs (held), and among themselves."""

    def run(group: pa.Table) -> pa.Table:
        parts, hot = Parts(group), []
        asked, prints, ids = parts.entries(LABELS), parts.entries(PRINTS), parts.entries(IDS)
        window = Window(runs, group.column("bucket")[0].as_py())
        width = np.uint64(1) << (np.uint64(forest.bits) * (forest.deepest - forest.depth(asked.n)).astype(np.uint64))
        low = asked.label // width * width
        held = window.entries(LABELS, low, low + width)
        near = [(a, b) for a, b in cross_pairs(asked, held, forest) if len(a)]
        one = np.uint64(1)
        near.append(equal_marks(prints, window.entries(PRINTS, prints.label, prints.label + one)))
        a, b = (np.concatenate(x) for x in zip(*near))
        a, b = prefixes.unique_pairs(a, b)
        same = equal_marks(ids, window.entries(IDS, ids.label, ids.label + one))
        own = distinct_pairs(self_pairs(asked, forest, hot))
        tables = [met_rows(HELD, a, b), met_rows(HELD_IDS, *same), met_rows(PAIRS, *own), met_rows(READ, [window.read])]
        return pa.concat_tables([*tables, *parts.passed_on(), *neardup.hot_rows(hot)])

    return rows.groupBy("bucket").applyInArrow(run, neardup.MET)


def texts_held(pairs: DataFrame, runs: list[str], threshold: float) -> DataFrame:
    """(a, b, tb, read) of pairs (slot, a, b, id, n, parity) that stay: with an id, those where the row held has it (tb is null);
    without, those that sizes and parities leave, with the text held. Only row groups with such rows are read."""

    def run(group: pa.Table) -> pa.Table:
        slot, key = group.column("slot")[0].as_py(), group.column("b").to_numpy()
        wanted, read, rows = np.unique(key), 0, []
        for file in parquet_files([f"{run}/items/slot={slot}" for run in runs]):
            for g in row_groups_with(file, "key", wanted.tolist()):
                meta = file.metadata.row_group(g)
                keys = file.read_row_group(g, columns=["key"]).column("key").to_numpy()
                hit = np.flatnonzero(words.in_sorted(keys, wanted))
                if len(hit):
                    read += sum(meta.column(c).total_compressed_size for c in range(meta.num_columns))
                    table = file.read_row_group(g, columns=["key", "id", "text"]).take(pa.array(hit))
                    rows.append(table)
        held = pa.concat_tables(rows) if rows else pa.table({"key": pa.array([], pa.int64()), "id": pa.array([], pa.string()), "text": pa.array([], pa.string())})
        place = {}
        for i, k in enumerate(held.column("key").to_pylist()):
            place.setdefault(k, []).append(i)
        ids, texts = held.column("id").to_pylist(), held.column("text").to_pylist()
        tokens, row, counts = words.multiset([t or "" for t in texts], np.full(len(texts), neardup.salt_of(""), np.uint64), words.WordHashes())
        bits = parities(tokens, row, counts)
        out = []
        most = (1 - threshold) / (1 + threshold)
        for a, b, id_, n, parity in zip(*(group.column(c).to_pylist() if c != "parity" else group.column(c) for c in ("a", "b", "id", "n", "parity"))):
            for i in place.get(b, ()):
                if id_ is not None:
                    if ids[i] == id_:
                        out.append((a, b, None, 0))
                elif texts[i] and min(n, counts[i]) >= max(n, counts[i]) * threshold - 1e-6:
                    if neardup.parity_apart(np.asarray(parity.as_py(), np.int64), bits[i]) <= (n + int(counts[i])) * most + 1e-6:
                        out.append((a, b, texts[i], 0))
        out.append((None, None, None, read))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["a", "b", "tb", "read"])

    return pairs.groupBy("slot").applyInArrow(run, "a bigint, b bigint, tb string, read bigint")


class Forest:
    """The persisted labels, ids and texts of everything accepted, under a folder of the shared file system.

    A run is a folder ``run-<first>-<last>`` that counts once its marker file is there, and as long as no other run covers its
    numbers; so appending and merging may break off anywhere without harm.
    """

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK, texts_together: int = TEXTS_TOGETHER):
        self.spark, self.path, self.block, self.texts_together = spark, qualified(spark, path), block, texts_together
        self.plan = prefixes.Forest(TREES, DEEPEST, 1 - RECALL)
        name = next((n for n in self._names() if n.startswith("forest-")), None)
        if name is None:
            raise ValueError(f"no forest in {path}")
        self.buckets, self.slots = (int(x) for x in name.split("-")[1:])

    @classmethod
    def create(cls, path: str, history: DataFrame, key: str, text: str, id_: str = "id", buckets: int | None = None, slots: int | None = None, **layout) -> Forest:
        """A forest over ``history``. The numbers of buckets and slots stay; choose them for the size the forest will have."""
        spark, n = history.sparkSession, history.count()
        buckets, slots = buckets or neardup.bucket_count(spark, n, PER_BUCKET), slots or neardup.bucket_count(spark, n, PER_SLOT)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/forest-{buckets}-{slots}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
        forest = cls(spark, path, **layout)
        forest.append(history, key, text, id_)
        return forest

    def _names(self, path: str | None = None) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []

    def _complete(self) -> list[tuple[int, int]]:
        names = [n for n in self._names() if n.startswith("run-")]
        return [tuple(int(x) for x in n.split("-")[1:]) for n in names if "_DONE" in self._names(f"{self.path}/{n}")]

    def runs(self) -> list[str]:
        """The folders of the runs that count."""
        done = self._complete()
        live = [(a, b) for a, b in done if not any((c, d) != (a, b) and c <= a and b <= d for c, d in done)]
        return [f"{self.path}/run-{a:06d}-{b:06d}" for a, b in sorted(live)]

    def _write(self, first: int, last: int, labels: DataFrame, items: DataFrame) -> None:
        path = f"{self.path}/run-{first:06d}-{last:06d}"
        blocks = lambda w, n: w.option("parquet.block.row.count.limit", n).option("compression", "zstd").mode("overwrite")
        blocks(labels.write.partitionBy("bucket"), BLOCKS_TOGETHER).parquet(f"{path}/labels")
        items = items.select("slot", "key", "id", "text").repartition("slot").sortWithinPartitions("slot", "key")
        blocks(items.write.partitionBy("slot"), self.texts_together).parquet(f"{path}/items")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_DONE")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True).close()

    def slot(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.slots)).cast("int").alias("slot")

    def append(self, df: DataFrame, key: str, text: str, id_: str = "id") -> None:
        """Add a run with the rows of ``df``."""
        self.add(as_rows(df, key, id_, text))

    def add(self, rows: DataFrame) -> None:
        number = max((b for _, b in self._complete()), default=-1) + 1
        with released(self.spark):
            self._write(number, number, sorted_blocks(mark_rows(rows, self.plan, self.buckets, asks=False), self.block), rows.where("id is not null or text is not null").select("*", self.slot("key")))

    def merge_runs(self) -> None:
        """One sorted run of all. The old runs go after the new one counts."""
        old = self.runs()
        if len(old) < 2:
            return
        done = self._complete()
        parts = [self.spark.read.parquet(f"{run}/labels").select("bucket", "kind", "base", "blob") for run in old]
        items = [self.spark.read.parquet(f"{run}/items").select("slot", "key", "id", "text") for run in old]
        for more in (parts, items):
            while len(more) > 1:
                more[:2] = [more[0].unionByName(more[1])]
        with released(self.spark):
            self._write(min(a for a, _ in done), max(b for _, b in done), sorted_blocks(parts[0], self.block), items[0])
        for run in old:
            _remove(self.spark, run)

    def entries(self) -> DataFrame:
        """(bucket, kind, first, last, base, blob): the blocks of all runs."""
        out = [self.spark.read.parquet(f"{run}/labels").select("bucket", "kind", "first", "last", "base", "blob") for run in self.runs()]
        for more in out[1:]:
            out[0] = out[0].unionByName(more)
        return out[0]

    def meet(self, rows: DataFrame) -> DataFrame:
        """What rows (key, id, text) meet in the forest and among themselves."""
        marked = mark_rows(rows, self.plan, self.buckets, asks=True)
        return materialise(lookups(marked, self.plan, self.runs()), "met")

    def held(self, rows: DataFrame, met: DataFrame) -> DataFrame:
        """(a, b, tb, read): pairs of a row and a row held that ids, or sizes and parities, leave."""
        table = neardup.records_met(met).select(F.col("key").alias("a"), F.col("n").cast("int").alias("n"), "parity")
        near = met.where(F.col("kind") == HELD).select("a", "b").distinct().join(table.dropDuplicates(["a"]), "a")
        near = near.select(self.slot("b"), "a", "b", F.lit(None).cast("string").alias("id"), "n", "parity")
        same = met.where(F.col("kind") == HELD_IDS).select("a", "b").distinct().join(rows.select(F.col("key").alias("a"), "id"), "a")
        same = same.select(self.slot("b"), "a", "b", "id", F.lit(0).alias("n"), F.lit(None).cast("array<bigint>").alias("parity"))
        return materialise(texts_held(near.unionByName(same), self.runs(), self.plan.threshold), "held")

    def find(self, batch: DataFrame, key: str, text: str, id_: str = "id") -> DataFrame:
        """(a, b, how): rows of the batch and rows held that have the same id or whose texts are near."""
        rows = materialise(as_rows(batch, key, id_, text), "batch")
        return self._found(rows, self.held(rows, self.meet(rows)))

    def _found(self, rows: DataFrame, held: DataFrame) -> DataFrame:
        by_id = held.where("a is not null and tb is null").select("a", "b", F.lit("id").alias("how"))
        both = held.where("tb is not null").join(rows.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
        return by_id.unionByName(verified(both, self.plan.threshold).select("a", "b", F.lit("text").alias("how")))

    def repeats(self, incoming: DataFrame, key: str, batch: str, id_: str = "id", text: str = "text") -> DataFrame:
        """(key, batch): incoming rows that repeat, by id or text, a row held or an earlier incoming row that is accepted
        itself. All batches given are searched for at once and settled in their order afterwards."""
        kinds = incoming.schema[key].dataType.simpleString()
        integer_key(incoming.schema, key)
        order = F.struct(F.col(batch).alias("batch"), F.col(key).cast("bigint").alias("key")).alias("ord")
        rows = incoming.select(order, F.col(key).cast("bigint").alias("key"), plain_id(F.col(id_)).alias("id"), F.col(text).alias("text"))
        rows = materialise(rows, "incoming")
        met = self.meet(rows)
        found = materialise(self._found(rows, self.held(rows, met)), "found")
        copies = materialise(neardup.copies_met(met), "copies")
        table = neardup.records_met(met)
        locals_ = met.where(F.col("kind") == LOCAL).select(F.col("b").alias("key"))
        of = table.select("key").unionByName(locals_).distinct().join(copies.select("key", "rep"), "key", "left")
        of = materialise(of.select("key", F.coalesce("rep", "key").alias("rep")), "incoming-reps")
        texts = rows.select("key", "text")

        by_text = of.join(found.where("how = 'text'").select(F.col("a").alias("rep")).distinct(), "rep", "left_semi").select("key")
        ids = rows.join(found.where("how = 'id'").select(F.col("a").alias("key")).distinct(), "key", "left_semi").select("id").distinct()
        hits = materialise(by_text.unionByName(rows.join(ids, "id", "left_semi").select("key")).distinct(), "hits")

        pairs = materialise(neardup.near(neardup.pairs_met(met, self.plan), table, self.plan.threshold), "near")
        both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        new = materialise(verified(both, self.plan.threshold).select("a", "b"), "new-links")
        both = new.unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        left = rows.join(hits, "key", "left_anti").select("ord", "key", "id")
        own_text = left.join(of, "key").select("ord", "rep")
        # What a row is (own) and what it must not come after: its id, its word multiset, multisets near it.
        name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("mark")
        marks = left.where("id is not null").select("ord", name("i", "id"), F.lit(True).alias("own"))
        marks = marks.unionByName(own_text.select("ord", name("t", "rep"), F.lit(True).alias("own")))
        marks = marks.unionByName(own_text.join(both.select(F.col("a").alias("rep"), "b"), "rep").select("ord", name("t", "b"), F.lit(False).alias("own")))
        late = settle(materialise(marks, "marks"))
        cases = rows.join(hits, "key", "left_semi").select("ord").unionByName(late)
        return cases.select(F.col("ord.key").cast(kinds).alias(key), F.col("ord.batch").alias(batch))

    def take(self, incoming: DataFrame, key: str, batch: str, id_: str = "id", text: str = "text") -> DataFrame:
        """``repeats``, after which the accepted rows are a run of the forest."""
        cases = materialise(self.repeats(incoming, key, batch, id_, text), "cases")
        self.append(incoming.join(cases.select(key), key, "left_anti"), key, text, id_)
        return cases


def repeats(history: DataFrame, incoming: DataFrame, history_key: str, key: str, batch: str, id_: str = "id", text: str = "text", forest: Forest | None = None) -> DataFrame:
    """``Forest.repeats`` against ``history``; with a forest given, the history is in it and isn't read."""
    forest = forest or Forest.create(scratch_path(incoming.sparkSession, "forest"), history, history_key, text, id_)
    return forest.repeats(incoming, key, batch, id_, text)


def settle(marks: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(ord): rows that come after an accepted row with one of their marks. ``marks``: (ord, mark, own).

    A row is accepted once no row before it that has one of its marks as its own is open or accepted. Every round settles at
    least the first open row of every mark, on minima per mark that are aggregated before they meet the rows. What is still
    open after some rounds, such as long chains, is settled component by component, each in its order by one task, as long as
    no component is larger than ``MOST_TOGETHER``; larger ones go on in rounds.
    """
    # Marks of one row only, and rows with no other marks, are settled at once.
    shared = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("own"), F.col("ord"))).alias("first")).where("n > 1 and first is not null").select("mark")
    marks = materialise(marks.join(shared, "mark", "left_semi"), "shared-marks")
    state = materialise(marks.select("ord").distinct().withColumn("status", F.lit(0)), "state")  # 0 open, 1 accepted, 2 repeats
    done = 0
    while not state.where("status = 0").isEmpty():
        alive = marks.where("own").join(state.where("status < 2"), "ord")
        first = alive.groupBy("mark").agg(F.min("ord").alias("any"), F.min(F.when(F.col("status") == 1, F.col("ord"))).alias("accepted"))
        seen = marks.join(state.where("status = 0").select("ord"), "ord", "left_semi").join(first, "mark", "left")
        if done >= rounds and (rest := _together(seen)) is not None:
            judged = rest
        else:
            yes = lambda c: F.coalesce(F.max(F.col(c) < F.col("ord")), F.lit(False))
            judged = seen.groupBy("ord").agg(yes("accepted").alias("after"), yes("any").alias("waits"))
            judged = judged.select("ord", F.when(F.col("after"), 2).when(F.col("waits"), 0).otherwise(1).alias("now"))
        state = materialise(state.join(judged, "ord", "left").select("ord", F.coalesce("now", "status").alias("status")), "state")
        done += 1
    return state.where("status = 2").select("ord")


def _together(seen: DataFrame) -> DataFrame | None:
    """(ord, now) of all open rows, settled in their order within each component of rows that share marks; None if a component
    is too large for a task. ``seen``: (ord, mark, own, accepted), the last the first accepted row with the mark."""
    seen = materialise(seen.select("ord", "mark", "own", "accepted"), "open-marks")
    hubs = seen.groupBy("mark").agg(F.min("ord").alias("hub"))
    links = seen.select("ord", "mark").join(hubs, "mark").where("ord <> hub").select(F.col("hub").alias("a"), F.col("ord").alias("b")).distinct()
    roots = neardup.components(links)
    grouped = seen.join(roots.withColumnRenamed("node", "ord"), "ord", "left").withColumn("root", F.coalesce("root", "ord"))
    if not grouped.groupBy("root").count().where(F.col("count") > MOST_TOGETHER).isEmpty():
        return None

    def run(group: pa.Table) -> pa.Table:
        place = lambda o: None if o is None else (o["batch"] is not None, o["batch"] or 0, o["key"])
        rows: dict = {}
        accepted: dict = {}
        for o, mark, own, first in zip(*(group.column(c).to_pylist() for c in ("ord", "mark", "own", "accepted"))):
            rows.setdefault(place(o), (o, []))[1].append((mark, own))
            if first is not None:
                accepted[mark] = place(first)
        out = []
        for at in sorted(rows):
            o, own_marks = rows[at]
            late = any(m in accepted and accepted[m] < at for m, _ in own_marks)
            if not late:
                for m, own in own_marks:
                    if own:
                        accepted[m] = min(accepted.get(m, at), at)
            out.append((o, 2 if late else 1))
        return pa.table([pa.array([o for o, _ in out], group.schema.field("ord").type), pa.array([n for _, n in out], pa.int32())], names=["ord", "now"])

    return grouped.select("root", "ord", "mark", "own", "accepted").groupBy("root").applyInArrow(run, f"ord {grouped.schema['ord'].dataType.simpleString()}, now int")
