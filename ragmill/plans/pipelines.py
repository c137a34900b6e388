"""The two pipelines, ingest and answer, and the engine that wires them."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.config import EngineConfig
from ragmill.functions.embedding import Embedder, HashingEmbedder, document_embedder, embed_column, server_embedder
from ragmill.functions.generation import EchoGenerator, Generator, generate_column, server_generator
from ragmill.messages import NO_QUERY
from ragmill.operators import prompting, rows, search
from ragmill.operators.chunking import Chunker, ChunkingOptions, RecursiveChunker, chunk_id, chunk_rows
from ragmill.session import materialise
from ragmill.sources.collections import VectorStore
from ragmill.sources.files import HandlerRegistry, default_registry

log = logging.getLogger("ragmill")


def chunk_documents(documents: DataFrame, chunker: Chunker, id_mode: str = "random") -> DataFrame:
    """(id, content, metadata): the chunks of documents (originalname, mimetype, content, metadata). What the document's
    handler knew overrides what is known of the file; chunk numbers start again with every document."""
    merged = documents.select(rows.merge_metadata(F.col("originalname"), F.col("mimetype"), F.col("metadata")).alias("m"), "content")
    chunks = chunk_rows(merged.withColumnRenamed("content", "text"), "text", chunker)
    own = [F.col("m")[f].alias(f) for f in ("source", "mimeType", "page", "totalPages")]
    metadata = F.struct(*own, F.col("chunk"), F.col("totalChunks"), F.col("m")["extra"].alias("extra")).cast(rows.METADATA)
    parts = (F.col("m.source"), F.col("m.page"), F.col("chunk"), F.col("content"))
    return chunks.select(chunk_id(*parts, mode=id_mode).alias("id"), "content", metadata.alias("metadata"))


class Engine:
    """Handlers, chunker, embedder, store and generator, each replaceable. Without an embedder or a generator it has the offline
    stand-ins; ``create_engine`` takes those that the settings name."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        config: EngineConfig | None = None,
        registry: HandlerRegistry | None = None,
        chunker: Chunker | None = None,
        embedder: Embedder | None = None,
        generator: Generator | None = None,
        score_mode: str = "reference",
        id_mode: str = "random",
    ):
        self.spark, self.config = spark, config or EngineConfig.from_env()
        self.registry = registry or default_registry()
        self.chunker = chunker or RecursiveChunker(ChunkingOptions(self.config.chunk_size, self.config.chunk_overlap))
        self.embedder, self.generator = embedder or HashingEmbedder(), generator or EchoGenerator()
        self.store = VectorStore(spark, root, self.config.collection)
        self.score_mode, self.id_mode = score_mode, id_mode

    def ingest(self, files: DataFrame, params: Mapping[str, str] | None = None, id_mode: str | None = None) -> DataFrame:
        """Files into the collection; returns the items written. All files are read, cut and embedded before the one write,
        so that a file that fails leaves the collection as it was."""
        rows.require_rows(files)
        chunks = chunk_documents(self.registry.handle(files, params), self.chunker, id_mode or self.id_mode)
        embedded = embed_column(chunks, "content", self.embedder)
        # Written before use: a random id would change if its row were computed again.
        items = materialise(embedded.select("id", F.col("content").alias("text"), "metadata", "embedding"), "items")
        made = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        log.info("embedded %d chunks, dimension %d", made["n"], made["dim"] or 0)
        self.store.upsert(items)
        return items

    def retrieve(self, questions: DataFrame, top_k: int | None = None, threshold: float | None = None) -> DataFrame:
        """(qid, id, content, metadata, score, rank): the hits of each question (qid, query) that pass the threshold."""
        asked = embed_column(questions.where(rows.is_asked(F.col("query"))).select("qid", "query"), "query", self.embedder)
        hits = self.store.search_batch(asked, top_k or self.config.top_k)
        return hits.where(search.at_least(self.config.threshold if threshold is None else threshold, mode=self.score_mode))

    def answer(self, questions: DataFrame, top_k: int | None = None, threshold: float | None = None, max_tokens: int | None = None) -> DataFrame:
        """(qid, response) for each question that may be asked; '' where no hit passes, without calling the model. The limit of
        tokens is part of the prompt's context; no model is sent it."""
        asked = questions.where(rows.is_asked(F.col("query"))).select("qid", "query")
        context = prompting.build_context(self.retrieve(questions, top_k, threshold))
        limit = F.lit(self.config.max_tokens if max_tokens is None else max_tokens)
        known = asked.join(context, "qid", "left").select("qid", prompting.prompt_context(F.col("query"), F.col("context"), limit).alias("c"))
        prompt = prompting.build_prompt(prompting.build_content(F.col("c.sources"), F.col("c.question")), self.config.generation_model)
        joined = known.select("qid", F.when(F.col("c.sources").isNotNull(), prompt).alias("prompt"))
        called = generate_column(joined, "prompt", self.generator)
        return called.select("qid", F.coalesce("response", F.lit("")).alias("response"))

    def query(self, question: str | None, top_k: int | None = None, threshold: float | None = None, max_tokens: int | None = None) -> str:
        """The answer to one question; a missing or empty one raises."""
        if not question:
            raise ValueError(NO_QUERY)
        asked = self.spark.createDataFrame([(0, question)], "qid bigint, query string")
        return self.answer(asked, top_k, threshold, max_tokens).first()["response"]


def create_engine(spark: SparkSession, root: str, env: Mapping[str, str] | None = None, stand_ins: bool = False, **parts) -> Engine:
    """An engine wired from the environment's settings: models by name from the model server, or with a key from the service
    that embeds documents. A model that is neither named nor given as a part raises; with ``stand_ins`` the offline ones are
    used instead, which hash and echo."""
    config = EngineConfig.from_env(env)
    if "embedder" not in parts:
        if config.document_key:
            parts["embedder"] = document_embedder(config.document_key, config.embedding_model)
        elif config.embedding_model:
            parts["embedder"] = server_embedder(config.model_host, config.embedding_model)
        elif not stand_ins:
            raise ValueError("set EMBEDDING_MODEL, pass an embedder, or ask for stand-ins")
    if "generator" not in parts:
        if config.generation_model:
            parts["generator"] = server_generator(config.model_host)
        elif not stand_ins:
            raise ValueError("set GENERATION_MODEL, pass a generator, or ask for stand-ins")
    return Engine(spark, root, config, **parts)
