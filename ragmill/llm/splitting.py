"""Problem 4: splitting oversized items at natural boundaries.

Agglomerative merging. A text is cut into atomic segments; a boundary between neighbours is as strong as the break it stands
for (nothing, word, clause, sentence, line, paragraph). A heap yields the weakest boundary, among equals the one whose two
sides are shortest together, and the sides are merged while they and the overlap fit the limit. What is left are pieces
whose ends are the strongest breaks. Sentences that fit start whole, as their inner boundaries would merge first anyway.

Pieces are ``text[start - overlap : end]``; the cores ``text[start:end]`` put together give the text back exactly. Defined
results: null texts have no pieces; texts within the limit, the empty one too, are one piece; invalid options (size below 1,
overlap negative or not below the size) give no pieces; a stretch without white space that is longer than a piece can hold is
cut where it is full.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1_000, 0
BREAKS = ("forced", "word", "clause", "sentence", "line", "paragraph")
FORCED, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

# A break of a level lies behind a match.
_STOPS = re.compile(r"\s*\n\s*|[.!?…]+[\"'”’)\]]*\s+|[。！？]+\s*")
_CLAUSES = re.compile(r"[,;:–—]+\s+|[，；：、]+\s*|\s[-–—]\s+")
_WORDS = re.compile(r"\s+")


def _cut(text: str, start: int, end: int, pattern: re.Pattern, strength) -> list[tuple[int, int]]:
    """(end, strength) of the segments of text[start:end]; the last has strength -1, as its break is another level's."""
    out = [(m.end(), strength(m.group())) for m in pattern.finditer(text, start, end) if m.end() < end]
    out.append((end, -1))
    return out


def _stop_strength(match: str) -> int:
    lines = match.count("\n")
    return PARAGRAPH if lines > 1 else LINE if lines else SENTENCE


def atoms(text: str, limit: int) -> list[tuple[int, int]]:
    """(end, strength of the break behind it) of segments that are no longer than ``limit``, as long as they can be."""
    out: list[tuple[int, int]] = []
    levels = ((_STOPS, _stop_strength), (_CLAUSES, lambda _: CLAUSE), (_WORDS, lambda _: WORD))

    def descend(start: int, end: int, strength: int, level: int) -> None:
        if end - start <= limit:
            out.append((end, strength))
        elif level == len(levels):
            # A word with the white space behind it: white space alone needs no cut inside the word.
            out.extend((at, FORCED) for at in range(start + limit, end, limit))
            out.append((end, strength))
        else:
            at = start
            for stop, own in _cut(text, start, end, *levels[level]):
                descend(at, stop, strength if own < 0 else own, level + 1)
                at = stop

    descend(0, len(text), PARAGRAPH, 0)
    return out


def merge(segments: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Merge neighbours across the weakest boundary first while the two fit the limit; (end, strength) of what is left."""
    n = len(segments)
    ends, strength = [e for e, _ in segments], [s for _, s in segments]
    starts = [0, *ends[:-1]]
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(strength[i], ends[i + 1] - starts[i], i) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i = heapq.heappop(heap)
        if not alive[i] or size > limit:
            continue
        j = right[i]
        if j >= n or ends[j] - starts[i] != size or strength[i] != s:
            continue
        # i takes j over, with the boundary behind j.
        ends[i], strength[i], right[i], alive[j] = ends[j], strength[j], right[j], False
        if right[j] < n:
            left[right[j]] = i
            if (grown := ends[right[i]] - starts[i]) <= limit:
                heapq.heappush(heap, (strength[i], grown, i))
        if left[i] >= 0 and (grown := ends[i] - starts[left[i]]) <= limit:
            heapq.heappush(heap, (strength[left[i]], grown, left[i]))
    return [(ends[i], strength[i]) for i in range(n) if alive[i]]


def split(text: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the break at its end) of each piece's core."""
    if len(text) <= size:
        return [(0, len(text), PARAGRAPH)]
    limit, out, start = size - overlap, [], 0
    for end, strength in merge(atoms(text, limit), limit):
        out.append((start, end, strength))
        start = end
    return out


def longest_run(text: str, more_than: int) -> bool:
    """Whether a stretch without white space is longer than this."""
    return any(len(w) > more_than for w in text.split())


def split_records(records: DataFrame, options: DataFrame, key: str, text: str, only_oversized: bool = False) -> DataFrame:
    """(key, piece_no, start, end, overlap, ends_at, kind, text): the pieces of each record under its own options.

    ``kind`` is null for records within their limit, else 'forced' where white space alone can't bring the text under the
    limit, else 'natural'. ``options`` are the few option pairs (opt_no, chunkSize, overlap) that records refer to; Spark
    broadcasts them by their measured size. No shuffle of the texts.
    """
    kind = records.schema[key].dataType.simpleString()
    size = F.coalesce("chunkSize", F.lit(SIZE))
    overlap = F.coalesce("overlap", F.lit(OVERLAP))
    rows = records.select("opt_no", F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    rows = rows.join(options.select("opt_no", "chunkSize", "overlap"), "opt_no", "left").select("key", "text", size.alias("size"), overlap.alias("overlap"))
    rows = rows.where("size >= 1 and overlap >= 0 and overlap < size")
    if only_oversized:
        rows = rows.where(F.char_length("text") > F.col("size"))
    names = ["key", "piece_no", "start", "end", "overlap", "ends_at", "kind", "text"]
    types = [None, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types[0], out = batch.schema.field(0).type, [[] for _ in names]
            for i in range(0, batch.num_rows, 256):
                out = [[] for _ in names]
                for k, t, size_, overlap_ in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    pieces = split(t, size_, overlap_)
                    # A piece that no natural break ends shows a run that is too long for the limit less the overlap; the exact check
                    # is whether it is for the limit itself.
                    cut = any(strength == FORCED for _, _, strength in pieces)
                    how = None if len(t) <= size_ else "forced" if cut and longest_run(t, size_) else "natural"
                    for n, (start, end, strength) in enumerate(pieces):
                        shared = min(overlap_, start) if n else 0
                        for column, value in zip(out, (k, n, start, end, shared, BREAKS[strength], how, t[start - shared : end])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, types)], names=names)

    return rows.mapInArrow(run, f"key {kind}, piece_no int, start int, end int, overlap int, ends_at string, kind string, text string")
