"""Problem 3: lines that recur in much of one site's content.

Every task keeps a mergeable heavy-hitter summary per site (Misra-Gries counters: when there are too many, all lose the same
count, and the loss is kept as the summary's error). Merged, a counter plus the error bounds a line's count from above, so
the candidates hold every line that can recur enough; where the error alone reaches the bar, the summaries are made again
with more counters. A second pass counts the candidates exactly, and the confirmed lines of its site travel with every
record (Spark broadcasts that small table while it is small, and joins it by site beyond).

Lines are the same if equal without regard to case, digits and white space. Defined results: lines with nothing else never
count; a record counts a line once however often it has it; records with null or blank content count as records of their
site; names without a host belong to no site; content of records without a site comes out as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.session import materialise

SHARE, LEAST = 0.2, 8
#: Counters per site and task to begin with, and sites and counters that a task holds before it hands its summaries out.
COUNTERS, MOST_SITES, MOST_COUNTERS = 4_096, 20_000, 1_000_000
IGNORED = re.compile(r"[\d\s]+")


def site_of(name: Column) -> Column:
    """The host at the head of a file name, or null. A bare name such as ``scan_1.pdf`` has none: what follows a host is a
    slash of either kind, or nothing after a scheme or a port."""
    plain = F.lower(F.regexp_replace(name, r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$", ""))
    host = r"(?:www\.)?([\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+)\.?"
    found = F.coalesce(
        F.nullif(F.regexp_extract(plain, r"^[a-z][a-z0-9+.-]*:[/\\]{2}" + host + r"(?::\d*)?(?=[/\\?#]|$)", 1), F.lit("")),
        F.nullif(F.regexp_extract(plain, "^" + host + r":\d+(?=[/\\?#]|$)", 1), F.lit("")),
        F.nullif(F.regexp_extract(plain, "^" + host + r"(?=[/\\])", 1), F.lit("")),
    )
    return found


def line_key(line: str) -> str:
    return IGNORED.sub("", line).lower()


class LineHashes(dict):
    """line -> hash of its key, 0 for lines that never count; remembered up to a bound."""

    MOST = 300_000

    def __missing__(self, line: str) -> int:
        import xxhash

        key = line_key(line)
        found = 0
        if key:
            found = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) or 1
            found = found - (1 << 64) if found >> 63 else found
        if len(line) <= 300:
            if len(self) >= self.MOST:
                self.clear()
            self[line] = found
        return found


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


class Summary:
    """Misra-Gries counters with the count that each of them may be short of."""

    def __init__(self, counters: int):
        self.counters, self.count, self.error = counters, {}, 0

    def add(self, lines) -> None:
        get = self.count.get
        for line in lines:
            self.count[line] = get(line, 0) + 1
        if len(self.count) > 2 * self.counters:
            self.shrink()

    def shrink(self) -> None:
        counts = np.fromiter(self.count.values(), np.int64, len(self.count))
        loss = int(np.partition(counts, len(counts) - self.counters - 1)[len(counts) - self.counters - 1])
        self.count = {k: c - loss for k, c in self.count.items() if c > loss}
        self.error += loss


def summaries(rows: DataFrame, counters: int) -> DataFrame:
    """(site, line, n, error): the tasks' summaries merged; line 0 stands for the site itself, with its number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept, records = LineHashes(), {}, {}

        def flush():
            out = [(site, 0, n, kept[site].error if site in kept else 0) for site, n in records.items()]
            out += [(site, line, n, 0) for site, s in kept.items() for line, n in s.count.items()]
            kept.clear()
            records.clear()
            for i in range(0, len(out), 100_000):
                yield _batch(out[i : i + 100_000], ["site", "line", "n", "error"], [pa.string(), pa.int64(), pa.int64(), pa.int64()])

        for batch in batches:
            for site, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                records[site] = records.get(site, 0) + 1
                if content:
                    lines = set(map(hashes.__getitem__, content.split("\n")))
                    lines.discard(0)
                    if site not in kept:
                        kept[site] = Summary(counters)
                    kept[site].add(lines)
            # Summaries merge, so a task that meets many sites may hand out several of one.
            if len(records) > MOST_SITES or (len(kept) > 1 and sum(len(s.count) for s in kept.values()) > max(MOST_COUNTERS, 4 * counters)):
                yield from flush()
        yield from flush()

    partial = rows.select("site", "content").mapInArrow(run, "site string, line bigint, n bigint, error bigint")
    return partial.groupBy("site", "line").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))


def _bar(records: Column, share: float, least: int) -> Column:
    # n >= share * records, without an error from the product: 0.2 * 15 is a little more than 3.
    return F.greatest(F.lit(least).cast("bigint"), F.ceil(records * share - 1e-9))


def candidates(rows: DataFrame, share: float, least: int, counters: int) -> DataFrame:
    """(site, line, bar): every line that can recur often enough, and perhaps others."""
    while True:
        merged = materialise(summaries(rows, counters), "lines")
        sites = merged.where("line = 0").select("site", _bar(F.col("n"), share, least).alias("bar"), "error")
        if sites.where("error >= bar").isEmpty():
            lines = merged.where("line <> 0").select("site", "line", "n")
            return lines.join(sites, "site").where(F.col("n") + F.col("error") >= F.col("bar")).select("site", "line", "bar")
        counters *= 4


def _with_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Each row with its site's lines. A site has at most mean lines per record / share of them."""
    return rows.join(lines.groupBy("site").agg(F.collect_list("line").alias("lines")), "site", "left")


def confirmed(rows: DataFrame, share: float = SHARE, least: int = LEAST, counters: int = COUNTERS) -> DataFrame:
    """(site, line): hashes of the lines that recur in at least ``share`` and at least ``least`` of their site's records."""
    maybe = materialise(candidates(rows, share, least, counters), "candidate-lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = LineHashes(), {}
        sets: dict[str, frozenset] = {}

        def flush():
            out = [(*k, n) for k, n in counts.items()]
            counts.clear()
            yield _batch(out, ["site", "line", "n"], [pa.string(), pa.int64(), pa.int64()])

        for batch in batches:
            if len(sets) > MOST_SITES:
                sets.clear()
            for site, content, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if site not in sets:
                    sets[site] = frozenset(lines.as_py() or ())
                if content:
                    for line in sets[site].intersection(map(hashes.__getitem__, content.split("\n"))):
                        counts[site, line] = counts.get((site, line), 0) + 1
            if len(counts) > MOST_COUNTERS:
                yield from flush()
        yield from flush()

    counted = _with_lines(rows, maybe).select("site", "content", "lines").where("lines is not null").mapInArrow(run, "site string, line bigint, n bigint")
    exact = counted.groupBy("site", "line").agg(F.sum("n").alias("n"))
    return exact.join(maybe, ["site", "line"]).where("n >= bar").select("site", "line")


def site_rows(records: DataFrame, files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, site, content); records that belong to no site have a null one."""
    sites = files.select("file_no", site_of(F.col("originalname")).alias("site")).where("site is not null").dropDuplicates(["file_no"])
    return records.select("file_no", F.col(key).alias("key"), F.col(content).alias("content")).join(sites, "file_no", "left").select("key", "site", "content")


def _with_confirmed(rows: DataFrame, share: float, least: int) -> DataFrame:
    """(key, site, content, lines): the rows with their sites' confirmed lines, null where there are none."""
    inside = rows.where("site is not null")
    lines = materialise(confirmed(inside, share, least), "confirmed-lines")
    return _with_lines(rows, lines).select("key", "site", "content", "lines")


class Sets(dict):
    """site -> its lines, of some sites at a time."""

    def of(self, site: str, lines) -> frozenset:
        if site not in self:
            if len(self) > MOST_SITES:
                self.clear()
            self[site] = frozenset(lines.as_py())
        return self[site]


def found_lines(records: DataFrame, files: DataFrame, key: str, content: str, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(key, line_no): the recurring lines of each record, numbered from 1."""
    rows = materialise(site_rows(records, files, key, content).where("site is not null"), "site-rows")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        hashes, sets = LineHashes(), Sets()
        for batch in batches:
            out = []
            for k, site, text, known in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                hit = sets.of(site, known)
                out += [(k, i) for i, h in enumerate(map(hashes.__getitem__, text.split("\n")), 1) if h in hit]
            yield _batch(out, ["key", "line_no"], [batch.schema.field(0).type, pa.int32()])

    return _with_confirmed(rows, share, least).where("lines is not null and content is not null").mapInArrow(run, f"key {kind}, line_no int")


def cleaned(records: DataFrame, files: DataFrame, key: str, content: str, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(key, content): every record, without the recurring lines of its site, which go in the pass that finds them."""
    rows = materialise(site_rows(records, files, key, content), "site-rows")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        hashes, sets = LineHashes(), Sets()
        for batch in batches:
            out = []
            for site, text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if text is not None and known.is_valid:
                    hit, lines = sets.of(site, known), text.split("\n")
                    kept = [line for line in lines if hashes[line] not in hit]
                    text = text if len(kept) == len(lines) else "\n".join(kept)
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "content"])

    return _with_confirmed(rows, share, least).mapInArrow(run, f"key {kind}, content string")
