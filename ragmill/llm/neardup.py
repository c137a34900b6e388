"""Problem 1: groups of records that repeat one another apart from small edits, insertions or changed order.

Token-combination prefixes. Words (with their occurrence number) are tokens; the tasks hand out, for each distinct word multiset,

* rare tokens (in at most ``RARE`` different texts) singly;
* for tokens of any frequency the combination of the k tokens that come first under a global order, in each of ``TREES``
  orders. A prefix starts at three tokens and is extended to seven by the record's size band (``prefixes.depths``): as far
  as a pair at the threshold still meets in one of the orders but for a probability of ``MISS``.

No token is left out of the combinations however many records hold it: what is indexed is as similar as the whole texts are.
The number of index entries per record is the same for any number of records.

Records with equal word multisets (copies, changed order) collapse to one representative, within a task before anything moves and
among tasks where their entries meet. Candidates pass sizes and sketches where entries meet, then an exact lower bound on
their distance (parities of their tokens), and are verified on their whole texts. Groups of entries with one combination that
are too large for a task are cut into blocks that other tasks compare. The candidate step is probabilistic: at a similarity of
exactly 0.75 a link is missed with a probability of about 2e-4 (``MISS`` and the sketch's 5e-5).

Defined results: null and blank texts take no part; a text without any word is only like equal texts; rows are compared
within their own ``within`` value; repeated keys count as one row if their texts are equal; no rows give no rows; keys are
whole numbers, any other type raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm import words
from ragmill.llm.prefixes import THRESHOLD, Entries, Forest, block_pairs, distinct_pairs, integer_key, long_array, packed, runs, self_pairs, sketches_near, unpacked
from ragmill.session import materialise

#: Orders, and the probability that a pair at the threshold shares a combination in none of them.
TREES, DEEPEST, MISS = 76, 7, 1.2e-4
RARE = 8
#: Records per bucket that the number of buckets aims at: some 90 MB of entries.
PER_BUCKET = 40_000
#: Records and tokens that a task gathers before it hands their entries out.
UNIT_RECORDS, UNIT_TOKENS = 20_000, 4_000_000
#: 64-bit words of a record's parities, and the record size from which it also has parities of that width.
PARITY_LEVELS = ((8, 0), (32, 400), (128, 1_600), (512, 6_400))
#: What a row of the shuffle holds, and a row of what comes of it.
LABELS, SINGLES, COPIES, RECORDS, LOCAL, PAIRS, BLOCKS = range(7)


def visible(texts: pa.Array) -> np.ndarray:
    """Which texts have anything but white space."""
    return np.fromiter((bool(t) and not t.isspace() for t in texts.to_pylist()), dtype=bool, count=len(texts))


def salt_of(within: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(repr(within))


def _salts(within: list) -> np.ndarray:
    known = {w: salt_of(w) for w in set(within)}
    return np.fromiter((known[w] for w in within), dtype=np.uint64, count=len(within))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Slices of rows with a key and visible text: (keys, texts, salts); columns are key, within, text."""
    for batch in batches:
        batch = batch.filter(pa.array(visible(batch.column(2)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)))
        texts, keys = batch.column(2).to_pylist(), batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        salts = _salts(batch.column(1).to_pylist())
        for i, j in words.slices(texts):
            yield keys[i:j], texts[i:j], salts[i:j]


def fingerprints(texts: list[str], tokens: np.ndarray, row: np.ndarray, counts: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """(rows, 2): 128 bits that equal word multisets of one scope share; texts without words have those of their characters."""
    import xxhash

    out = np.zeros((len(texts), 2), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(2):
            np.add.at(out[:, i], row, words.mix(tokens + np.uint64(i + 1)))
            out[:, i] ^= salts
    for r in np.flatnonzero(counts == 0):
        for i, end in enumerate(("", ".")):
            out[r, i] ^= np.uint64(xxhash.xxh3_64_intdigest((texts[r] + end).encode("utf-8", "surrogatepass")))
    return out


class Unit:
    """Different texts gathered by a task: their keys, fingerprints and tokens."""

    def __init__(self):
        self.keys, self.prints, self.tokens, self.counts, self.records, self.held = [], [], [], [], 0, 0

    def add(self, keys: np.ndarray, texts: list[str], salts: np.ndarray, hashes: words.WordHashes) -> None:
        tokens, row, counts = words.multiset(texts, salts, hashes)
        self.keys.append(keys)
        self.prints.append(fingerprints(texts, tokens, row, counts, salts))
        self.tokens.append(tokens)
        self.counts.append(counts)
        self.records += len(keys)
        self.held += len(tokens)

    def full(self) -> bool:
        return self.records >= UNIT_RECORDS or self.held >= UNIT_TOKENS

    def collapsed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, prints, tokens, row of each token, counts) of the different texts, the smallest key standing for its copies,
        and (representative, key) of the copies."""
        keys, prints, tokens, counts = (np.concatenate(x) for x in (self.keys, self.prints, self.tokens, self.counts))
        order = np.lexsort((keys, prints[:, 1], prints[:, 0]))
        first = np.append(True, (prints[order][1:] != prints[order][:-1]).any(axis=1))
        rep = keys[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        keep = np.zeros(len(keys), dtype=bool)
        keep[order[first]] = True
        row = np.repeat(np.arange(len(keys)), counts)
        stays = keep[row]
        counts = counts[keep]
        return keys[keep], prints[keep], tokens[stays], np.repeat(np.arange(len(counts)), counts), counts, rep[~first], keys[order][~first]


def entry_parts(forest: Forest, keys, prints, tokens, counts, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, base, blob) of the labels of texts that are large enough to have near ones that are not equal, and their
    sketches; last come (s, t, n, fp) of all texts as the generator's value."""
    label, head, s, t = forest.labels(tokens, counts)
    n, fp = np.minimum(counts, 65_535).astype(np.uint16), (prints[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
    rows = np.flatnonzero(forest.depth(counts) > 0)
    trees = forest.trees
    wide = lambda x: np.repeat(x[rows], trees)
    yield from packed(label[rows].reshape(-1), wide(keys), wide(n), wide(s), wide(t), wide(fp), (head[rows].reshape(-1) % np.uint64(buckets)).astype(np.int32))
    return s, t, n, fp


def shuffle_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, base, blob = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int8()), pa.array(base, pa.int64()), pa.array(blob, pa.binary())], names=["bucket", "kind", "base", "blob"])


def shared_rows(keys, prints, tokens, row, counts, local, copy, buckets: int) -> list[tuple[int, int, int, bytes]]:
    """Rows of different texts' fingerprints and parities, and of the copies found in the task."""
    out = []
    for b, at in _by_bucket((prints[:, 1] % np.uint64(buckets)).astype(np.int32)):
        out.append((b, COPIES, 0, np.concatenate([prints[at].view(np.int64), keys[at, None]], axis=1).tobytes()))
    bits = parities(tokens, row, counts)
    for b, at in _by_bucket((words.mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)):
        out.append((b, RECORDS, len(at), np.concatenate([keys[at], counts[at], *(bits[i] for i in at)]).tobytes()))
    if len(local):
        out.append((int(local[0] % buckets), LOCAL, 0, np.stack([local, copy], axis=1).tobytes()))
    return out


SHUFFLED = "bucket int, kind tinyint, base bigint, blob binary"


def index_rows(records: DataFrame, forest: Forest, buckets: int, rare: int = RARE) -> DataFrame:
    """What the tasks hand out of records (key, within, text), packed by bucket."""

    def handed(unit: Unit) -> Iterator[pa.RecordBatch]:
        keys, prints, tokens, row, counts, local, copy = unit.collapsed()
        out = []
        parts = entry_parts(forest, keys, prints, tokens, counts, buckets)
        while True:
            try:
                bucket, base, blob = next(parts)
            except StopIteration as end:
                s, t, n, fp = end.value
                break
            out.append((bucket, LABELS, base, blob))
        # Tokens that are rare here, with their records; of the others that they aren't, as an entry of size 0.
        token, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
        single = np.flatnonzero((times <= rare)[at])
        common = token[times > rare]
        who = row[single]
        label = np.concatenate([tokens[single], common])
        zero = lambda x: np.concatenate([x[who], np.zeros(len(common), x.dtype)])
        mixed = words.mix(label)
        out += [(b, SINGLES, base, blob) for b, base, blob in packed(mixed >> np.uint64(16), np.concatenate([keys[who], np.full(len(common), keys.min())]), zero(n), zero(s), zero(t), zero(fp), (label % np.uint64(buckets)).astype(np.int32))]
        out += shared_rows(keys, prints, tokens, row, counts, local, copy, buckets)
        for i in range(0, len(out), 2_000):
            yield shuffle_rows(out[i : i + 2_000])

    def run(batches):
        hashes, unit = words.WordHashes(), Unit()
        for keys, texts, salts in sliced(batches):
            unit.add(keys, texts, salts, hashes)
            if unit.full():
                yield from handed(unit)
                unit = Unit()
        if unit.records:
            yield from handed(unit)

    return records.mapInArrow(run, SHUFFLED)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])), len(order)) if len(order) else [0]
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[order[i]]), order[i:j]


def parity_words(counts: np.ndarray) -> np.ndarray:
    """How many words of parities records of these sizes have."""
    return sum((np.where(counts >= least, width, 0) for width, least in PARITY_LEVELS), np.zeros(len(counts), np.int64))


#: Blocks of hot groups have the prefix's length as ``a`` and their entries' bases and blobs as ``parity``, ``one``, ``two``.
MET = "kind tinyint, a bigint, b bigint, parity array<bigint>, one binary, two binary"


def met_rows(kind: int, a, b=None, parity=None, one=None, two=None) -> pa.Table:
    column = lambda x, kind: pa.nulls(len(a), kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind)
    values = [pa.array(np.full(len(a), kind, np.int8)), column(a, pa.int64()), column(b, pa.int64()), column(parity, pa.list_(pa.int64())), column(one, pa.binary()), column(two, pa.binary())]
    return pa.table(values, names=["kind", "a", "b", "parity", "one", "two"])


def single_pairs(entries: Entries, rare: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one token that few texts hold; a token that a task found common has an entry of size 0."""
    if not len(entries):
        return
    starts = np.flatnonzero(np.append(True, entries.label[1:] != entries.label[:-1]))
    sizes = np.diff(np.append(starts, len(entries)))
    ok = (entries.n[starts] > 0) & (sizes > 1) & (sizes <= rare)
    ends = np.repeat(np.where(ok, starts + sizes, 0), sizes)
    for i, j in runs(np.arange(1, len(entries) + 1), ends):
        near = (entries.n[i] >= entries.n[j] * threshold - 1e-6) & sketches_near(entries, i, entries, j)
        yield entries.key[i[near]], entries.key[j[near]]


class Parts:
    """The rows of one bucket by their kind."""

    def __init__(self, group: pa.Table):
        self.kinds, self.bases, self.blobs = group.column("kind").to_numpy(), group.column("base").to_numpy(), group.column("blob").combine_chunks()

    def of(self, kind: int) -> tuple[list[int], list[bytes]]:
        at = np.flatnonzero(self.kinds == kind)
        return self.bases[at].tolist(), [self.blobs[int(i)].as_py() for i in at]

    def entries(self, kind: int) -> Entries:
        return unpacked(*self.of(kind))

    def passed_on(self) -> Iterator[pa.Table]:
        """Copies (representative, key), those found within tasks, and records with their sizes and parities."""
        copies = [np.frombuffer(b, np.int64).reshape(-1, 3) for b in self.of(COPIES)[1]]
        if copies:
            x = np.concatenate(copies)
            x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
            new = np.append(True, (x[1:, :2] != x[:-1, :2]).any(axis=1))
            rep = x[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0)), 2]
            several = ~new | np.append(~new[1:], False)
            yield met_rows(COPIES, rep[several], x[several, 2])
        for blob in self.of(LOCAL)[1]:
            x = np.frombuffer(blob, np.int64).reshape(-1, 2)
            yield met_rows(LOCAL, x[:, 0], x[:, 1])
        for n, blob in zip(*self.of(RECORDS)):
            x = np.frombuffer(blob, np.int64)
            ends = np.append(0, np.cumsum(parity_words(x[n : 2 * n]))).astype(np.int32)
            yield met_rows(RECORDS, x[:n], x[n : 2 * n], pa.ListArray.from_arrays(pa.array(ends), pa.array(x[2 * n :])))


def hot_rows(hot: list) -> Iterator[pa.Table]:
    if hot:
        yield met_rows(BLOCKS, [d for d, _, _ in hot], parity=[[x[0], y[0]] for _, x, y in hot], one=[x[1] for _, x, _ in hot], two=[y[1] for _, _, y in hot])


def meetings(rows: DataFrame, forest: Forest, rare: int = RARE) -> DataFrame:
    """What meets in the buckets: candidate pairs, copies (representative, key), records with their parities, blocks of hot
    groups that are still to be compared."""

    def run(group: pa.Table) -> pa.Table:
        parts = Parts(group)
        entries, singles, hot = parts.entries(LABELS), parts.entries(SINGLES), []
        pairs = distinct_pairs(chain(self_pairs(entries, forest, hot), single_pairs(singles, rare, forest.threshold)))
        return pa.concat_tables([met_rows(PAIRS, *pairs), *parts.passed_on(), *hot_rows(hot)])

    return rows.groupBy("bucket").applyInArrow(run, MET)


def parities(tokens: np.ndarray, row: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Per record its parities at every level that its size reaches, the narrowest first."""
    out = [np.zeros(0, np.int64)] * len(counts)
    for width, least in PARITY_LEVELS:
        big = np.flatnonzero(counts >= least)
        if not len(big):
            break
        place = np.full(len(counts), -1)
        place[big] = np.arange(len(big))
        at = place[row]
        bits = words.parity(tokens[at >= 0], at[at >= 0], len(big), width * 64)
        for i, b in zip(big, bits):
            out[i] = np.concatenate([out[i], b])
    return out


def parity_apart(a: np.ndarray, b: np.ndarray) -> int:
    """The same bound as ``apart`` for two records."""
    m, start, bound = min(len(a), len(b)), 0, 0
    for width, _ in PARITY_LEVELS:
        if start + width <= m:
            bound = int(np.bitwise_count((a[start : start + width] ^ b[start : start + width]).view(np.uint64)).sum())
        start += width
    return bound


def apart(pa_, pb_) -> F.Column:
    """A lower bound on how many tokens two records differ by, from the widest parities both have."""
    xor = lambda i: F.bit_count(pa_[i].bitwiseXOR(pb_[i]))
    narrow = PARITY_LEVELS[0][0]
    bound, start = sum((xor(i) for i in range(narrow)), F.lit(0)), narrow
    for width, _ in PARITY_LEVELS[1:]:
        a, b = F.slice(pa_, start + 1, width), F.slice(pb_, start + 1, width)
        wide = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        start += width
        bound = F.when((F.size(pa_) >= start) & (F.size(pb_) >= start), wide).otherwise(bound)
    return bound


class Index:
    """Where records met, and what comes of it: candidate pairs, copies and the records' parities."""

    def __init__(self, df: DataFrame, key: str, text: str, within: str | None = None, threshold: float = THRESHOLD):
        integer_key(df.schema, key)
        spark, self.threshold = df.sparkSession, threshold
        self.forest = Forest(TREES, DEEPEST, MISS, threshold)
        scope = F.col(within).cast("string") if within else F.lit("")
        self.records = df.select(F.col(key).alias("key"), F.coalesce(scope, F.lit("\0")).alias("within"), F.col(text).alias("text"))
        buckets = bucket_count(spark, self.records.where("text is not null").count())
        self.met = materialise(meetings(index_rows(self.records, self.forest, buckets), self.forest), "met")
        self.table = records_met(self.met)
        self.copies = materialise(copies_met(self.met), "copies")
        local = self.met.where(F.col("kind") == LOCAL).select(F.col("b").alias("key"))
        self.keys = self.table.select("key").unionByName(local).distinct()

    def candidates(self) -> DataFrame:
        """(a, b): pairs of representatives that share a combination or a rare token, a < b, each once."""
        return pairs_met(self.met, self.forest)

    def links(self) -> DataFrame:
        """(a, b, similarity): verified pairs of representatives; pairs of copies of one record are not among them."""
        pairs = materialise(near(self.candidates(), self.table, self.threshold), "candidates")
        texts = self.records.select("key", "text")
        both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        return verified(both, self.threshold)


def pairs_met(met: DataFrame, forest: Forest) -> DataFrame:
    """(a, b): the distinct pairs that met, those of hot groups among them, which are compared block by block here."""

    def run(batches):
        for batch in batches:
            for d, bases, one, two in zip(*(batch.column(i).to_pylist() for i in range(4))):
                a, b = distinct_pairs(block_pairs(d, (bases[0], one), (bases[1], two), forest))
                yield pa.RecordBatch.from_arrays([long_array(a), long_array(b)], names=["a", "b"])

    pairs = met.where(F.col("kind") == PAIRS).select("a", "b")
    hot = met.where(F.col("kind") == BLOCKS).select("a", "parity", "one", "two")
    if not hot.isEmpty():
        pairs = pairs.unionByName(hot.repartition(F.xxhash64("one", "two")).mapInArrow(run, "a bigint, b bigint"))
    return pairs.distinct()


def copies_met(met: DataFrame) -> DataFrame:
    """(rep, key): every record that has copies, with the representative of its copies, which is one of them."""
    local = met.where(F.col("kind") == LOCAL).select(F.col("a").alias("of"), F.col("b").alias("key"))
    among = met.where(F.col("kind") == COPIES).select(F.col("a").alias("rep"), F.col("b").alias("key"))
    found = local.join(among.withColumnRenamed("key", "of"), "of", "left").select(F.coalesce("rep", "of").alias("rep"), "key", "of")
    own = found.select("rep", F.col("of").alias("key"))
    return among.unionByName(found.select("rep", "key")).unionByName(own).distinct()


def records_met(met: DataFrame) -> DataFrame:
    """(key, n, parity): what different texts are compared by, and the key that stands for each of them in a task."""
    return met.where(F.col("kind") == RECORDS).select(F.col("a").alias("key"), F.col("b").alias("n"), "parity")


def near(pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """Keep pairs that the parities do not rule out: |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|)."""
    one = table.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    two = table.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    most = (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-6
    return pairs.join(one, "a").join(two, "b").where(sizes & (apart(F.col("pa"), F.col("pb")) <= most)).select("a", "b")


def bucket_count(spark: SparkSession, records: int, per_bucket: int = PER_BUCKET) -> int:
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records // per_bucket))


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ta, tb) -> (a, b, similarity) where the texts' similarity reaches the threshold."""
    kind_a, kind_b = (pairs.schema[c].dataType.simpleString() for c in ("a", "b"))

    def run(batches):
        for batch in batches:
            score = pa.array([words.similarity(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.float64())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score], names=["a", "b", "similarity"])
            yield out.filter(pc.greater_equal(score, threshold))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind_a}, b {kind_b}, similarity double")


def near_pairs(df: DataFrame, key: str, text: str, within: str, threshold: float = THRESHOLD) -> DataFrame:
    """(within, key_a, key_b): every pair of rows of one scope that is near enough, copies expanded, smaller key first."""
    index = Index(df, key, text, within, threshold)
    links = materialise(index.links(), "links").select("a", "b")
    copies = index.copies.select("rep", "key")
    same = copies.select("rep", F.col("key").alias("key_a")).join(copies.select("rep", F.col("key").alias("key_b")), "rep").where("key_a < key_b").select("key_a", "key_b")
    a = links.join(copies.select(F.col("rep").alias("a"), F.col("key").alias("ka")), "a", "left")
    b = a.join(copies.select(F.col("rep").alias("b"), F.col("key").alias("kb")), "b", "left")
    x, y = F.coalesce("ka", "a"), F.coalesce("kb", "b")
    pairs = b.select(F.least(x, y).alias("key_a"), F.greatest(x, y).alias("key_b")).unionByName(same)
    kind = df.schema[key].dataType.simpleString()
    scopes = index.records.select(F.col("key").alias("key_a"), "within").distinct()
    out = pairs.join(scopes, "key_a").select("within", "key_a", "key_b")
    return out.select("within", F.col("key_a").cast(kind), F.col("key_b").cast(kind))


def groups(df: DataFrame, key: str, text: str, within: str, threshold: float = THRESHOLD) -> DataFrame:
    """(within, key, group_key, links): one row per row with visible text. ``group_key`` is the smallest key of the rows that
    links connect it with (its own if none), ``links`` the number of different texts it is linked with."""
    index = Index(df, key, text, within, threshold)
    links = materialise(index.links(), "links").select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    member = components(links)
    scopes = index.records.select("key", "within").distinct()
    rep = index.keys.join(index.copies.select("key", "rep"), "key", "left").join(scopes, "key").select("within", "key", F.coalesce("rep", "key").alias("rep"))
    out = rep.join(member.select(F.col("node").alias("rep"), "root"), "rep", "left").join(degree.select(F.col("a").alias("rep"), "links"), "rep", "left")
    return out.select("within", "key", F.coalesce("root", "rep").alias("group_key"), F.coalesce("links", F.lit(0)).alias("links"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``links`` is connected with. Every round hooks each node's root to the
    smallest neighbouring root and then halves the paths, so the number of rounds is logarithmic in a component's length."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "roots")
    while True:
        edges = both.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        hooks = edges.where("rb < ra").groupBy("ra").agg(F.min("rb").alias("to"))
        hooks = materialise(hooks.select(F.col("ra").alias("root"), "to"), "hooks")
        if hooks.isEmpty():
            return roots
        lower = roots.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        lower = materialise(lower, "lower")
        above = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = materialise(lower.join(above, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root")), "roots")
