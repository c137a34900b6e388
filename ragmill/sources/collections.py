"""Collections of items, kept as Parquet folders: a base and the upserts since. A write never touches what readers have open."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragmill.operators import search
from ragmill.operators.rows import METADATA
from ragmill.session import materialise

ITEMS = f"id string, embedding array<float>, text string, metadata {METADATA}"
log = logging.getLogger("ragmill")


#: Upserts that may wait before the collection is written anew.
MOST_DELTAS = 8
#: Hits up to which they are sent to where the texts are.
FEW_HITS = 100_000


class VectorStore:
    """Named collections under one folder.

    A collection is a base and the upserts since, each a folder that counts once its write has ended. An upsert writes its own
    rows and reads nothing; reading puts the newest row of each id in place of older ones; ``compact`` makes a new base, and a
    note in it says which folders it holds, so upserts that run meanwhile are kept.
    """

    def __init__(self, spark: SparkSession, root: str, collection: str = "docs"):
        if not collection or "/" in collection:
            raise ValueError("a collection's name must be a single path segment")
        self.spark, self.path = spark, f"{root.rstrip('/')}/{collection}"

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _folders(self) -> list[str]:
        """Folders whose write has ended, by number: ``base-<n>-<unique>`` and ``delta-<n>-<unique>``."""
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
        names = [n for n in names if n.startswith(("base-", "delta-"))]
        done = [n for n in names if fs.exists(self._at(f"{n}/_SUCCESS")) and (n[0] == "d" or fs.exists(self._at(f"{n}.holds")))]
        return sorted(done, key=lambda n: (int(n.split("-")[1]), n))

    def _live(self) -> tuple[str | None, list[str]]:
        """The newest base, and the upserts it doesn't hold, oldest first."""
        folders = self._folders()
        base = next((n for n in reversed(folders) if n[0] == "b"), None)
        held = set(self._note(base)) if base else set()
        return base, [n for n in folders if n[0] == "d" and n not in held]

    def _note(self, base: str) -> list[str]:
        fs, _ = self._fs()
        stream = fs.open(self._at(f"{base}.holds"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def get(self) -> DataFrame:
        """The collection's rows; a collection that doesn't exist is empty."""
        try:
            return self._rows(*self._live())
        except Exception:
            log.exception("collection %s cannot be read", self.path)
            raise

    def _rows(self, base: str | None, deltas: list[str]) -> DataFrame:
        read = lambda n: self.spark.read.schema(ITEMS).parquet(f"{self.path}/{n}")
        if not deltas:
            return read(base) if base else self.spark.createDataFrame([], ITEMS)
        new = read(deltas[0]).withColumn("_order", F.lit(0))
        for i, name in enumerate(deltas[1:], 1):
            new = new.unionByName(read(name).withColumn("_order", F.lit(i)))
        if len(deltas) > 1:
            new = latest(new, "_order")
        new = new.drop("_order")
        return read(base).join(new.select("id"), "id", "left_anti").unionByName(new) if base else new

    def _number(self) -> int:
        fs, at = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n.split("-")[1]) for n in names if n.startswith(("base-", "delta-"))), default=-1) + 1

    def upsert(self, items: DataFrame) -> None:
        """Insert or replace by id; what is there is neither read nor moved. A missing id is the empty one; of several rows of one
        id the one with the greatest text stays. No rows, no folder."""
        new = as_items(items)
        if new.isEmpty():
            return
        latest(new).write.parquet(f"{self.path}/delta-{self._number():08d}-{uuid.uuid4().hex[:8]}")
        if len(self._live()[1]) > MOST_DELTAS:
            self.compact()

    def compact(self) -> None:
        """Write the collection anew as one base; folders it replaces go, except those of the base before, which may be in use."""
        base, deltas = self._live()
        if not deltas:
            return
        name = f"base-{self._number():08d}-{uuid.uuid4().hex[:8]}"
        self._rows(base, deltas).write.parquet(f"{self.path}/{name}")
        fs, _ = self._fs()
        held = [*deltas, *(self._note(base) if base else [])]
        stream = fs.create(self._at(f"{name}.holds"), True)
        stream.writeBytes("\n".join(held))
        stream.close()
        if base:
            for old in [n for n in self._folders() if n in self._note(base) or (n[0] == "b" and n not in (base, name))]:
                fs.delete(self._at(old), True)

    def search(self, query: list[float], k: int, metric: str = "sqeuclidean") -> DataFrame:
        """(id, content, metadata, score, rank). The k hits, and no more, go to where the texts are."""
        rows = self.get()
        top = search.similar(rows, query, k, metric)
        found = rows.select("id", F.col("text").alias("content"), "metadata").join(F.broadcast(top), "id")
        return search.as_results(found).select("id", "content", "metadata", "score", "rank")

    def search_batch(self, questions: DataFrame, k: int, metric: str = "sqeuclidean") -> DataFrame:
        """(qid, id, content, metadata, score, rank) for every row (qid, embedding) of ``questions``."""
        rows = self.get()
        top = materialise(search.similar_batch(rows, questions, k, metric), "hits")
        texts = rows.select("id", F.col("text").alias("content"), "metadata")
        # Few hits go to the texts; of many, the texts' ids are cut down to theirs before anything else moves.
        few = top.count() <= FEW_HITS
        found = texts.join(F.broadcast(top), "id") if few else top.join(texts.join(top.select("id").distinct(), "id", "left_semi"), "id")
        return search.as_results(found).select("qid", "id", "content", "metadata", "score", "rank")


def as_items(items: DataFrame) -> DataFrame:
    """Items in the table's schema: a missing id is '', a missing embedding or metadata is empty."""
    columns = items.columns
    embedding = F.col("embedding").cast("array<float>") if "embedding" in columns else F.lit(None).cast("array<float>")
    metadata = F.col("metadata").cast(METADATA) if "metadata" in columns else F.lit(None).cast(METADATA)
    empty = F.struct(*(F.lit(None) for _ in range(7))).cast(METADATA)
    return items.select(F.coalesce("id", F.lit("")).alias("id"), F.coalesce(embedding, F.array().cast("array<float>")).alias("embedding"), "text", F.coalesce(metadata, empty).alias("metadata"))


def latest(items: DataFrame, order: str | None = None) -> DataFrame:
    """One row per id: the last by ``order``, or the greatest text. Each task keeps one row per id before any move."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last(order or "text")))
    return items.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of both, those of ``new`` in place of rows of ``old`` with their id."""
    new = latest(new)
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)
