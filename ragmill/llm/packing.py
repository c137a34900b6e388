"""Problem 8: filling containers of fixed capacity.

Bounded-space online best-fit. Every task packs its own rows with at most ``open_bins`` open containers; a bitset keyed by
free space finds the tightest container that still takes an item with two integer operations, and where all are open the
fullest closes first. What is still open when a task ends is packed again, whole, by fewer tasks, so that the room lost to
the cut into tasks does not grow with their number.

Defined results: an item larger than the capacity is divided into full pieces and a rest (nothing else is divided); an item
of size 0 or null needs no room, it has piece 0 and no bin; repeated keys are separate items; ties go to the container
opened last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.tokens import TOKENIZER_DIR, VOCABULARY, shipped
from ragmill.session import materialise

CAPACITY = 2048
OPEN_BINS = 512
#: A second packing takes the leftovers of this many tasks together.
TASKS_TOGETHER = 16


class BestFit:
    """Open containers by free space. ``put`` gives the container's number and, where one had to close, the closed one."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.bits, self.at, self.n = 0, {}, 0

    def _push(self, number: int, free: int) -> None:
        self.at.setdefault(free, []).append(number)
        self.bits |= 1 << free
        self.n += 1

    def _pop(self, free: int) -> int:
        stack = self.at[free]
        number = stack.pop()
        if not stack:
            del self.at[free]
            self.bits &= ~(1 << free)
        self.n -= 1
        return number

    def put(self, size: int) -> tuple[int, tuple[int, int] | None, bool]:
        """(container, (closed container, its free space) or None, whether the container itself is full and closed)."""
        fitting, closed = self.bits >> size, None
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._pop(free)
        else:
            if self.n >= self.open_bins:
                least = (self.bits & -self.bits).bit_length() - 1
                closed = (self._pop(least), least)
            number, free, self.next = self.next, self.capacity, self.next + 1
        free -= size
        if free:
            self._push(number, free)
        return number, closed, not free

    def left(self) -> Iterator[tuple[int, int]]:
        for free, stack in self.at.items():
            for number in stack:
                yield number, free


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, sizes=None) -> DataFrame:
    """(key, piece_no, size, bin_no): where each item, or piece of an oversized item, goes.

    ``size`` is a column of sizes; with ``sizes`` given (a maker of a function from its values to their sizes) it may hold
    anything, so that measuring and packing are one pass. No shuffle of the items; only the few open containers move.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be at least 1")
    kind = items.schema[key].dataType.simpleString()
    names = ["key", "piece_no", "size", "bin_no", "fill", "closed"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = sizes() if sizes else (lambda values: values)
        bins, held, out = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 36), {}, []

        def close(number: int, free: int, closed: bool = True) -> None:
            out.extend((*x, number, capacity - free, closed) for x in held.pop(number))

        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            for k, n in zip(batch.column(0).to_pylist(), measure(batch.column(1).to_pylist())):
                if not n or n < 0:
                    out.append((k, 0, 0, None, None, True))
                    continue
                piece = 0
                while n > 0:
                    part = min(n, capacity)
                    number, closed, full = bins.put(part)
                    held.setdefault(number, []).append((k, piece, part))
                    if closed:
                        close(*closed)
                    if full:
                        close(number, 0)
                    n, piece = n - part, piece + 1
            yield _columns(out, names, types)
            out = []
        for number, free in list(bins.left()):
            close(number, free, False)
        if out:
            yield _columns(out, names, types)

    packed = materialise(
        items.select(F.col(key).alias("key"), F.col(size).alias("size")).mapInArrow(first, f"key {kind}, piece_no int, size bigint, bin_no bigint, fill bigint, closed boolean"),
        "bins",
    )
    again = f"bin_no bigint, to_no bigint"

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins, (1 << 62) | (TaskContext.get().partitionId() << 36))
        for batch in batches:
            pairs = [(b, bins.put(n)[0]) for b, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield _columns(pairs, ["bin_no", "to_no"], [pa.int64(), pa.int64()])

    task = F.shiftright("bin_no", 36)
    tasks = packed.where(~F.col("closed")).agg(F.countDistinct(task)).first()[0]
    together = (
        packed.where(~F.col("closed"))
        .groupBy("bin_no")
        .agg(F.first("fill").alias("fill"))
        .repartition(max(1, -(-tasks // TASKS_TOGETHER)), F.shiftright("bin_no", 36))
        .sortWithinPartitions(F.desc("fill"), "bin_no")
        .mapInArrow(second, again)
    )
    together = materialise(together, "bins-left")
    # Only what was left open is looked up; closed containers and items without one stay where they are.
    moved = packed.where(~F.col("closed")).join(together, "bin_no", "left").select("key", "piece_no", "size", F.coalesce("to_no", "bin_no").alias("bin_no"))
    out = packed.where("closed").select("key", "piece_no", "size", "bin_no").unionByName(moved)
    return out.withColumnRenamed("key", key)


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` with the texts' token counts as sizes; null and empty texts have size 0."""

    ready = shipped(df.sparkSession, tokenizer_dir, vocabulary)

    def sizes():
        enc = ready()
        return lambda texts: [len(enc.encode(t)) // 4 for t in texts]

    return pack(df, key, text, capacity, open_bins, sizes)
