"""Top-K search over a collection: one question, or any number of them in blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragmill.functions.vectors import METRICS, distances, exact_distances
from ragmill.session import materialise, scratch_path
from ragmill.sources.shared import parquet_files

#: Questions per block and per scan of the collection, and rows that meet a block at once.
BLOCK, PER_SCAN, ROWS = 2_048, 1_048_576, 32_768
#: Bytes of question blocks that a task keeps rather than reads again for its next rows.
KEPT = 64 << 20


def similar(collection: DataFrame, query: list[float], k: int, metric: str = "sqeuclidean", id_: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, score, rank): the k nearest rows to one vector, nearest first, ties by id. Every task keeps k rows before any are
    moved. Rows whose vector is null, of another length or without a distance are no hits."""
    kind = collection.schema[id_].dataType
    q = np.asarray([float(x) for x in query], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            at = np.flatnonzero(batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == len(q))
            ids, vectors = batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)).flatten()
            x = vectors.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, len(q))
            score = exact_distances(q, x, metric)
            good = np.flatnonzero(~np.isnan(score))
            if len(good) > k:  # the k best and what ties with the last of them
                good = good[score[good] <= np.partition(score[good], k - 1)[k - 1]]
            found = zip(score[good].tolist(), ids.take(pa.array(good)).to_pylist())
            best = heapq.nsmallest(k, [*best, *((s, i) for s, i in found)], key=lambda r: (r[0], r[1] is not None, r[1]))
        yield pa.RecordBatch.from_arrays([pa.array([i for _, i in best], to_arrow_type(kind)), pa.array([s for s, _ in best], pa.float64())], names=["id", "score"])

    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = collection.select(F.col(id_).alias("id"), F.col(vector).alias("v")).where("v is not null")
    top = rows.mapInArrow(run, f"id {kind.simpleString()}, score double").orderBy("score", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))


def similar_batch(collection: DataFrame, questions: DataFrame, k: int, metric: str = "sqeuclidean", id_: str = "id", vector: str = "embedding", qid: str = "qid", qvector: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): the k nearest rows for every question.

    The questions are written in blocks to the shared folder; every task scores its rows against block after block as
    matrices and keeps k per question, so k rows a task and question are moved. No question passes through the driver, and
    one scan serves up to ``PER_SCAN`` of them.
    """
    spark = collection.sparkSession
    kinds = {"qid": questions.schema[qid].dataType.simpleString(), "id": collection.schema[id_].dataType.simpleString()}
    rows = collection.select(F.col(id_).alias("id"), F.col(vector).alias("v")).where("v is not null")
    asked = questions.select(F.col(qid).alias("qid"), F.col(qvector).cast("array<double>").alias("v")).where("v is not null")
    asked = materialise(asked, "questions")
    number = asked.count()
    scans = max(1, -(-number // PER_SCAN))
    found = None
    for scan in range(scans):
        part = asked if scans == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(scans)) == scan)
        path = scratch_path(spark, "question-blocks")
        blocks = part.repartition(max(1, -(-number // scans // BLOCK))).mapInArrow(_packed, f"dim int, qids array<{kinds['qid']}>, v binary")
        blocks.write.option("parquet.block.row.count.limit", 1).parquet(path)
        one = _scan(rows, path, k, metric, f"qid {kinds['qid']}, id {kinds['id']}, score double", to_arrow_type(asked.schema["qid"].dataType))
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions as blocks of one length of vectors each."""
    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            for i in range(0, len(at), BLOCK):
                part = batch.take(pa.array(at[i : i + BLOCK]))
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                good = np.isfinite(vectors).all(axis=1)
                ids = part.column(0).filter(pa.array(good))
                if len(ids) and dim:
                    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), lists, pa.array([vectors[good].tobytes()], pa.binary())], names=["dim", "qids", "v"])


class _Blocks:
    """The blocks of questions of one length, kept while they are few."""

    def __init__(self, path: str):
        self.path, self.held, self.bytes = path, None, 0

    def _read(self) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
        number = 0
        for file in parquet_files([self.path]):
            for group in range(file.num_row_groups):
                table = file.read_row_group(group).to_pylist()
                for row in table:
                    yield number, row["dim"], row["qids"], np.frombuffer(row["v"], np.float64).reshape(-1, row["dim"])
                    number += 1

    def __iter__(self) -> Iterator[tuple[int, int, list, np.ndarray]]:
        if self.held is None:
            held, total = [], 0
            for block in self._read():
                total += block[3].nbytes
                if total <= KEPT:
                    held.append(block)
                yield block
            self.held = held if total <= KEPT else None
        else:
            yield from self.held


def _scan(rows: DataFrame, path: str, k: int, metric: str, schema: str, qtype: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(path)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        asking: dict[int, list] = {}
        kind, waiting, held = None, [], 0

        def meet() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            ids, vectors = (table.column(i).combine_chunks() for i in range(2))
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            sides = {}
            for number, dim, qids, q in blocks:
                if dim not in sides:
                    at = np.flatnonzero(lengths == dim)
                    x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    good = np.isfinite(x).all(axis=1)
                    sides[dim] = x[good], np.array(ids.take(pa.array(at[good])).to_pylist(), dtype=object)
                x, names = sides[dim]
                asking[number] = qids
                for i in range(0, len(x), 4_096):
                    part = x[i : i + 4_096]
                    best[number] = _merge(best.get(number), distances(q, part, metric), names[i : i + 4_096], k, q, part, metric)

        for batch in batches:
            kind = batch.schema.field(0).type
            waiting.append(batch)
            held += batch.num_rows
            if held >= ROWS:
                meet()
                waiting, held = [], 0
        if held:
            meet()
        for number, (score, names) in best.items():
            ok = np.isfinite(score)
            qids = np.repeat(np.array(asking[number], dtype=object), ok.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(qids.tolist(), qtype), pa.array(names[ok].tolist(), kind), pa.array(score[ok])], names=["qid", "id", "score"])

    return rows.mapInArrow(run, schema)


def _merge(held, score: np.ndarray, names: np.ndarray, k: int, q: np.ndarray, x: np.ndarray, metric: str):
    """The k smallest of what is held and a block, and what ties with the last of them up to rounding."""
    most = min(k + 2, score.shape[1])
    at = np.argpartition(score, most - 1, axis=1)[:, :most] if most < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
    near = np.take_along_axis(score, at, axis=1)
    if metric == "sqeuclidean":  # exact, where the expansion of the square loses digits
        near = ((q[:, None, :] - x[at]) ** 2).sum(axis=2)
    found = names[at]
    if held is not None:
        near, found = np.concatenate([held[0], near], axis=1), np.concatenate([held[1], found], axis=1)
    near = np.where(np.isnan(near), np.inf, near)
    order = np.argsort(near, axis=1, kind="stable")[:, : k + 2]
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(found, order, axis=1)


def at_least(threshold: float | Column | None, score: str = "score", mode: str = "reference") -> Column:
    """The filter behind the top-K. The score is a distance, yet by default, mode "reference", rows pass whose score reaches
    the threshold, so the nearest may fail; null and NaN thresholds are 0. Mode "similarity" keeps rows no farther than it."""
    if mode not in ("reference", "similarity"):
        raise ValueError("mode must be reference or similarity")
    if isinstance(threshold, Column):
        bound = F.coalesce(F.nanvl(threshold, F.lit(0.0)), F.lit(0.0))
    else:
        number = 0.0 if threshold is None or math.isnan(threshold) else float(threshold)
        if mode == "reference" and number > 0:
            # A missing score is 0 and fails: said so plainly, the scan can skip rows.
            return (F.col(score) >= number) & ~F.isnan(score)
        bound = F.lit(number)
    value = F.coalesce(F.nanvl(F.col(score), F.lit(0.0)), F.lit(0.0))
    return value >= bound if mode == "reference" else value <= bound


def as_results(hits: DataFrame) -> DataFrame:
    """Hits with the defaults of missing values: empty content, empty metadata, score 0."""
    out = hits.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("score", F.coalesce("score", F.lit(0.0)))
    if "metadata" in out.columns:
        kind = out.schema["metadata"].dataType.simpleString()
        names = ", ".join(f"'{f.name}', CAST(NULL AS {f.dataType.simpleString()})" for f in out.schema["metadata"].dataType.fields)
        out = out.withColumn("metadata", F.coalesce("metadata", F.expr(f"named_struct({names})").cast(kind)))
    return out
