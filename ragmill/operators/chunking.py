"""Chunkers: the recursive character splitter, and a sliding window as an extension."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ragmill.functions.text import WS
from ragmill.messages import OVERLAP
from ragmill.session import extended

# Fixed value: the separators, from the strongest break to none.
SEPARATORS = ("\n\n", "\n", " ", "")
_TRIM = re.compile(f"^[{WS}]+|[{WS}]+$")
#: A chunker: text -> chunks.
Chunker = Callable[[str], list[str]]


@dataclass(frozen=True)
class ChunkingOptions:
    """``chunk_size`` in code points (or UTF-16 units), ``overlap`` shared by neighbouring chunks; no overlap is 0."""

    chunk_size: int = 1000
    overlap: int | None = None
    utf16: bool = False

    def __post_init__(self) -> None:
        if self.overlap is not None and self.overlap >= self.chunk_size:
            raise ValueError(OVERLAP)
        if self.chunk_size < 1:
            raise ValueError("chunk_size must be at least 1")
        if self.overlap is not None and self.overlap < 0:
            raise ValueError("overlap must not be negative")


class RecursiveChunker:
    """Splits at the strongest separator a text has; parts that fit are packed greedily, others are split further. Chunks
    are trimmed, and those left empty are dropped; an empty text has none."""

    def __init__(self, options: ChunkingOptions):
        self.options = options
        self.size, self.overlap = options.chunk_size, options.overlap or 0

    def length(self, text: str) -> int:
        return len(text) + sum(c > "\uffff" for c in text) if self.options.utf16 else len(text)

    def __call__(self, text: str) -> list[str]:
        if not self.overlap and not self.options.utf16 and "\n" not in text:
            return self._words(text)
        return self._split(text, SEPARATORS)

    def _words(self, text: str) -> list[str]:
        """The same for the common case, a text of one line without overlap, without recursion."""
        size, out = self.size, []
        if " " not in text:
            out = [text[i : i + size] for i in range(0, len(text), size)]
            return self._trimmed(out)
        start = end = 0  # the open chunk is text[start:end]
        at = 0
        while at < len(text):
            stop = text.find(" ", at + 1)
            stop = len(text) if stop < 0 else stop
            if stop - at >= size:
                if end > start:
                    out.append(text[start:end])
                out.extend(text[i : min(i + size, stop)] for i in range(at, stop, size))
                start = end = stop
            elif stop - start > size:
                out.append(text[start:end])
                start, end = at, stop
            else:
                end = stop
            at = stop
        if end > start:
            out.append(text[start:end])
        return self._trimmed(out)

    def _split(self, text: str, separators: tuple[str, ...]) -> list[str]:
        at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
        finer = separators[at + 1 :]
        out: list[str] = []
        fitting: list[str] = []
        for part in self._parts(text, separators[at]):
            if self.length(part) < self.size:
                fitting.append(part)
                continue
            out += self._pack(fitting)
            fitting = []
            out += self._split(part, finer) if finer else [part]
        return out + self._pack(fitting)

    @staticmethod
    def _parts(text: str, separator: str) -> list[str]:
        """The parts between separators, each with the separator before it."""
        if not separator:
            return list(text)
        return [p for p in re.split(f"(?={re.escape(separator)})", text) if p]

    def _pack(self, parts: list[str]) -> list[str]:
        out: list[str] = []
        window: list[tuple[str, int]] = []
        total = 0
        for part in parts:
            n = self.length(part)
            if window and total + n > self.size:
                out.append("".join(p for p, _ in window))
                drop = 0
                while total > self.overlap or (total + n > self.size and total > 0):
                    total -= window[drop][1]
                    drop += 1
                del window[:drop]
            window.append((part, n))
            total += n
        if window:
            out.append("".join(p for p, _ in window))
        return self._trimmed(out)

    @staticmethod
    def _trimmed(chunks: list[str]) -> list[str]:
        return [t for c in chunks if (t := _TRIM.sub("", c))]


class SlidingWindowChunker:
    """An extension: windows of ``chunk_size`` that start every ``chunk_size - overlap`` characters."""

    def __init__(self, options: ChunkingOptions):
        self.size, self.step = options.chunk_size, options.chunk_size - (options.overlap or 0)

    def __call__(self, text: str) -> list[str]:
        last = max(1, len(text) - (self.size - self.step))
        return [text[i : i + self.size] for i in range(0, last, self.step)] if text else []


def chunk_rows(df: DataFrame, text: str, chunker: Chunker) -> DataFrame:
    """``df`` without ``text``, a row per chunk: chunk (from 0 in every row), totalChunks, content. Null texts have none."""
    rest = [c for c in df.columns if c != text]
    schema = extended(df.select(*rest).schema, chunk=IntegerType(), totalChunks=IntegerType(), content=StringType())
    plain = chunker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, total, content = [], [], [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                chunks = plain(value) if value else []
                at += [i] * len(chunks)
                number += range(len(chunks))
                total += [len(chunks)] * len(chunks)
                content += chunks
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(number, pa.int32()), pa.array(total, pa.int32()), pa.array(content, pa.string())], names=[*rest, "chunk", "totalChunks", "content"])

    return df.select(*rest, text).mapInArrow(run, schema)


def chunk_id(*parts: Column, mode: str = "random") -> Column:
    """``chunk-`` and a random UUID, or with mode "content" a hash of what makes the chunk, which runs repeat. A random id
    is made anew whenever its row is, so write rows before using them twice."""
    if mode == "random":
        return F.concat(F.lit("chunk-"), F.uuid())
    if mode == "content":
        text = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts))
        return F.concat(F.lit("chunk-"), F.sha2(text, 256))
    raise ValueError("mode must be random or content")
