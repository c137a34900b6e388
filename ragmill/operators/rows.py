"""Row-level pieces of both pipelines: guards, metadata, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.messages import NO_FILES

#: The metadata of documents and chunks; a key that is absent is a null field.
METADATA = "struct<source:string,mimeType:string,page:int,totalPages:int,chunk:int,totalChunks:int,extra:map<string,string>>"
FIELDS = ("source", "mimeType", "page", "totalPages", "chunk", "totalChunks", "extra")
_KINDS = {"source": "string", "mimeType": "string", "extra": "map<string,string>"}


def metadata(**values: Column) -> Column:
    """A metadata struct of the given fields."""
    return F.struct(*(values.get(f, F.lit(None)).cast(_KINDS.get(f, "int")).alias(f) for f in FIELDS))


def merge_metadata(source: Column, mime_type: Column, own: Column) -> Column:
    """What is known of the file, overridden by what the handler set itself."""
    base = {"source": source, "mimeType": mime_type}
    return F.struct(*(F.coalesce(own[f], base[f]) if f in base else own[f] for f in FIELDS)).cast(METADATA)


def require_rows(df: DataFrame, message: str = NO_FILES) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def is_asked(query: Column) -> Column:
    """Whether a question may be asked: null and empty are refused, blanks pass."""
    return query.isNotNull() & (query != "")


def item_id(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))
