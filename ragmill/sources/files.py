"""Uploaded files: readers, handlers by MIME type, and their registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ragmill.functions import text as cleaning
from ragmill.messages import HANDLER_NOT_SET, NO_HANDLER
from ragmill.operators.rows import METADATA, metadata
from ragmill.session import extended

FILES = "originalname string, size bigint, mimetype string, encoding string, buffer binary"
#: MIME types by the ending of a path, for files that come from a folder.
ENDINGS = {"txt": "text/plain", "text": "text/plain", "pdf": "application/pdf"}


def read_folder(spark: SparkSession, path: str, mimetype: str | None = None) -> DataFrame:
    """Files of a folder in the schema of uploads; the MIME type is given, or that of the path's ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return from_binary(files, mimetype)


def from_binary(files: DataFrame, mimetype: str | None = None) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    known = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
    kind = F.lit(mimetype) if mimetype else F.coalesce(known[ending], F.lit("application/octet-stream"))
    return files.select(name.alias("originalname"), F.col("length").alias("size"), kind.alias("mimetype"), F.lit("7bit").alias("encoding"), F.col("content").alias("buffer"))


def from_uploads(spark: SparkSession, files: list[tuple[str, str, bytes]]) -> DataFrame:
    """Files held in memory: (name, MIME type, bytes)."""
    return spark.createDataFrame([(n, len(b), m, "7bit", bytearray(b)) for n, m, b in files], FILES)


class FileHandler(Protocol):
    """Turns files into documents: rows of ``files`` in, the same rows with ``content`` and ``metadata`` (its own part) out,
    one or many per file, without ``buffer``."""

    def handle(self, files: DataFrame) -> DataFrame: ...


class TextFileHandler:
    """Bytes as UTF-8, cleaned."""

    def __init__(self, cleaner: Callable[[Column], Column] = cleaning.clean):
        self.cleaner = cleaner

    def handle(self, files: DataFrame) -> DataFrame:
        content = self.cleaner(cleaning.decode_utf8(F.col("buffer")))
        return files.withColumn("content", content).withColumn("metadata", metadata(mimeType=F.lit("text"))).drop("buffer")


class NoopFileHandler:
    """Empty content and no metadata, whatever the file."""

    def handle(self, files: DataFrame) -> DataFrame:
        return files.withColumn("content", F.lit("")).withColumn("metadata", F.lit(None).cast(METADATA)).drop("buffer")


#: A PDF parser: bytes -> the pages' texts.
PdfParser = Callable[[bytes], list[str]]


class PdfHandler:
    """A PDF's pages as documents, each cleaned on its own ("page"), or all as one text cleaned once ("file")."""

    #: What stands between pages in the text of a whole file.
    JOINER = "\n\n"

    def __init__(self, parser: PdfParser | None = None, mode: str = "page", cleaner: Callable[[Column], Column] = cleaning.clean):
        from ragmill.sources.pdf import extract_pages

        if mode not in ("page", "file"):
            raise ValueError("mode must be page or file")
        self.parser, self.mode, self.cleaner = parser or extract_pages, mode, cleaner

    def handle(self, files: DataFrame) -> DataFrame:
        rest = [c for c in files.columns if c != "buffer"]
        schema = extended(files.select(*rest).schema, content=StringType(), page=IntegerType(), totalPages=IntegerType())
        parser, whole, joiner = self.parser, self.mode == "file", self.JOINER

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    pages = parser(batch.column("buffer")[i].as_py() or b"")
                    texts = [joiner.join(pages)] if whole else pages
                    kept = [batch.column(c).take(pa.array([i] * len(texts), pa.int64())) for c in rest]
                    number = pa.array([None] * len(texts) if whole else list(range(1, len(texts) + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), number, pa.array([len(pages)] * len(texts), pa.int32())], names=[*rest, "content", "page", "totalPages"])

        read = files.select(*rest, "buffer").mapInArrow(run, schema)
        own = metadata(page=F.col("page"), totalPages=F.col("totalPages"))
        return read.withColumn("content", self.cleaner(F.col("content"))).withColumn("metadata", own).drop("page", "totalPages")


Handler = FileHandler | Callable[[Mapping[str, str]], FileHandler]


class HandlerRegistry:
    """Handlers by exact MIME type. A registered function is called with the request's parameters and makes the handler;
    registering a type again replaces its handler."""

    def __init__(self, handlers: Mapping[str, Handler] | None = None):
        self.handlers: dict[str, Handler] = {}
        self.register(handlers or {})

    def register(self, handlers: Mapping[str, Handler]) -> HandlerRegistry:
        self.handlers.update(handlers)
        return self

    def resolve(self, mimetype: str, params: Mapping[str, str] | None = None) -> FileHandler:
        handler = self.handlers.get(mimetype)
        if handler is None:
            raise ValueError(NO_HANDLER.format(mimetype))
        return handler if hasattr(handler, "handle") else handler(dict(params or {}))

    def unsupported(self, files: DataFrame) -> DataFrame:
        """(mimetype): the types among the files that no handler is registered for; null is such a type."""
        known = files.sparkSession.createDataFrame([(m,) for m in self.handlers], "mimetype string")
        return files.select("mimetype").distinct().join(known, "mimetype", "left_anti")

    def handle(self, files: DataFrame, params: Mapping[str, str] | None = None) -> DataFrame:
        """Every file through its type's handler. A type without handler raises before any file is read."""
        missing = self.unsupported(files).head(1)
        if missing:
            raise ValueError(NO_HANDLER.format(missing[0]["mimetype"]))
        parts = [self.resolve(m, params).handle(files.where(F.col("mimetype") == m)) for m in self.handlers]
        if not parts:
            raise ValueError(HANDLER_NOT_SET)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def create_text_file_handler(_: Mapping[str, str] | None = None) -> TextFileHandler:
    return TextFileHandler()


def create_pdf_file_handler(_: Mapping[str, str] | None = None) -> PdfHandler:
    return PdfHandler(mode="file")


def create_pdf_page_file_handler(_: Mapping[str, str] | None = None) -> PdfHandler:
    return PdfHandler(mode="page")


def default_registry() -> HandlerRegistry:
    return HandlerRegistry({"text/plain": create_text_file_handler, "application/pdf": create_pdf_page_file_handler})
