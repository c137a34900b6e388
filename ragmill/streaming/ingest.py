"""Continuous ingest of files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragmill.plans.pipelines import Engine
from ragmill.sources.files import from_binary

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_folder(engine: Engine, folder: str, checkpoint: str, once: bool = True, files_per_batch: int = 1_000, random_ids: bool = False) -> StreamingQuery:
    """Ingest a folder's files, new ones as they come; files of types without handler are left out. Ids come from the content, so a
    batch that is run again after a failure replaces its own rows; ``random_ids`` keeps the engine's own way."""
    stream = engine.spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def write(batch: DataFrame, _: int) -> None:
        files = from_binary(batch).where(F.col("mimetype").isin(list(engine.registry.handlers)))
        if not files.isEmpty():
            engine.ingest(files, id_mode=engine.id_mode if random_ids else "content")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
