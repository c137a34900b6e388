import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragmill.config import EngineConfig
from ragmill.functions.embedding import HashingEmbedder, embed_column
from ragmill.functions.vectors import distance
from ragmill.operators import prompting, search
from ragmill.operators.rows import METADATA
from ragmill.plans.pipelines import Engine, create_engine
from ragmill.sources.collections import VectorStore
from ragmill.sources.files import HandlerRegistry, NoopFileHandler, PdfHandler, TextFileHandler, default_registry, from_uploads, read_folder
from ragmill.sources.pdf import extract_pages
from ragmill.streaming.ingest import stream_folder


def pdf(*pages: bytes, deflate=False) -> bytes:
    out, kids = b"%PDF-1.4\n", []
    for i, text in enumerate(pages):
        body = b"BT /F1 12 Tf 72 720 Td (" + text.replace(b"\n", b") Tj 0 -14 Td (") + b") Tj ET"
        head = b"/Filter /FlateDecode " if deflate else b""
        body = zlib.compress(body) if deflate else body
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n" % (10 + 2 * i, 11 + 2 * i)
        out += b"%d 0 obj << %s/Length %d >> stream\n%s\nendstream endobj\n" % (11 + 2 * i, head, len(body), body)
        kids.append(10 + 2 * i)
    return out + b"1 0 obj << /Type /Pages /Count %d >> endobj\n%%%%EOF" % len(kids)


def test_config():
    got = EngineConfig.from_env({"CHUNK_SIZE": "300", "RAG_TOP_K": "5", "RETRIEVAL_THRESHOLD": "0.5"})
    assert (got.chunk_size, got.chunk_overlap, got.top_k, got.threshold, got.collection) == (300, 0, 5, 0.5, "docs")
    for env in ({"CHUNK_SIZE": "x"}, {"CHUNK_SIZE": "10", "CHUNK_OVERLAP": "10"}, {"RETRIEVAL_THRESHOLD": "nan"}, {"RAG_TOP_K": "0"}):
        with pytest.raises(ValueError):
            EngineConfig.from_env(env)


def test_pdf_pages():
    assert extract_pages(pdf(b"first page\nline two", b"a \\(b\\) c")) == ["first page\nline two", "a (b) c"]
    assert extract_pages(pdf(b"packed", deflate=True)) == ["packed"]
    with pytest.raises(ValueError):
        extract_pages(b"hello")


def test_handlers(spark, tmp_path):
    files = from_uploads(spark, [("a.txt", "text/plain", b"Line one\nPage 2\nline\xff two."), ("b.pdf", "application/pdf", pdf(b"Page one text", b"second\n2"))])
    docs = default_registry().handle(files).orderBy("originalname", "metadata.page").collect()
    assert [d.content for d in docs] == ["Line one line� two.", "Page one text", "second"]
    assert [(d.metadata.mimeType, d.metadata.page, d.metadata.totalPages) for d in docs] == [("text", None, None), (None, 1, 2), (None, 2, 2)]
    whole = PdfHandler(mode="file").handle(files.where("mimetype = 'application/pdf'")).collect()
    assert [(d.content, d.metadata.totalPages, d.metadata.page) for d in whole] == [("Page one text second", 2, None)]
    assert [(d.content, d.metadata) for d in NoopFileHandler().handle(files).collect()] == [("", None)] * 2
    (tmp_path / "x.TXT").write_bytes(b"hi")
    assert read_folder(spark, str(tmp_path)).first().mimetype == "text/plain"


def test_registry(spark):
    seen = {}
    registry = HandlerRegistry({"text/plain": NoopFileHandler()})
    registry.register({"text/plain": lambda params: seen.update(params) or TextFileHandler()})
    files = from_uploads(spark, [("a", "text/plain", b"x")])
    assert registry.handle(files, {"k": "v"}).first().content == "x" and seen == {"k": "v"}
    with pytest.raises(ValueError, match="No file handler found for MIME type: Text/Plain"):
        registry.handle(from_uploads(spark, [("a", "Text/Plain", b"x")]))
    with pytest.raises(ValueError, match="No file handler found"):
        registry.handle(files.withColumn("mimetype", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        HandlerRegistry().handle(files.where("false"))


def items(spark, *rows):
    return spark.createDataFrame([(i, v, t, None) for i, v, t in rows], f"id string, embedding array<float>, text string, metadata {METADATA}")


def test_store(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}")
    assert store.get().count() == 0
    store.upsert(items(spark, ("a", [0.0, 0.0], "old"), ("b", [1.0, 0.0], "b"), (None, [5.0, 5.0], None)))
    store.upsert(items(spark, ("a", [0.0, 2.0], "new"), ("a", [0.0, 2.0], "new"), ("c", None, "no vector")))
    store.upsert(items(spark).where("false"))
    assert sorted((r.id, r.text) for r in store.get().collect()) == [("", None), ("a", "new"), ("b", "b"), ("c", "no vector")]
    hits = store.search([0.0, 0.0], 2).orderBy("rank").collect()
    assert [(h.id, h.content, h.score, h["rank"]) for h in hits] == [("b", "b", 1.0, 1), ("a", "new", 4.0, 2)]
    assert hits[0].metadata is not None
    asked = spark.createDataFrame([(1, [5.0, 5.0]), (2, None), (3, [1.0])], "qid int, embedding array<float>")
    got = store.search_batch(asked, 1).collect()
    assert [(h.qid, h.id, h.content, h.score) for h in got] == [(1, "", "", 0.0)]
    (tmp_path / "docs" / "delta-00000009-x").mkdir()  # a write that did not end
    assert store.get().count() == 4
    store.upsert(items(spark, ("d", [1.0, 1.0], "d")))
    assert store.get().count() == 5
    with pytest.raises(ValueError):
        VectorStore(spark, str(tmp_path), "a/b")


def test_upserts_read_nothing_and_compaction_keeps_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    store = VectorStore(spark, f"file://{tmp_path}")
    for i in range(3):
        store.upsert(items(spark, ("a", [float(i)], f"a{i}"), (f"b{i}", [0.0], "b")))
    base, deltas = store._live()
    assert base is None and len(deltas) == 3
    assert sum(1 for _ in spark.read.parquet(f"{tmp_path}/docs/{deltas[-1]}").collect()) == 2  # its own rows only
    want = [("a", "a2"), ("b0", "b"), ("b1", "b"), ("b2", "b")]
    rows = lambda: sorted((r.id, r.text) for r in store.get().collect())
    assert rows() == want
    real = store._number
    # An upsert that took its number before the compaction, and ends after it.
    monkeypatch.setattr(store, "_number", lambda: 1)
    store.compact()
    store.upsert(items(spark, ("z", [1.0], "meanwhile")))
    monkeypatch.setattr(store, "_number", real)
    assert rows() == sorted([*want, ("z", "meanwhile")])
    store.compact()
    assert store._live()[1] == [] and rows() == sorted([*want, ("z", "meanwhile")])
    for i in range(10):
        store.upsert(items(spark, ("a", [float(i)], f"n{i}")))
    assert len(store._live()[1]) <= 8 and ("a", "n9") in rows()


@pytest.mark.parametrize("metric", ["sqeuclidean", "cosine", "ip"])
def test_batch_equals_single(spark, metric, monkeypatch):
    monkeypatch.setattr(search, "PER_SCAN", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)] + [(200, None), (201, [1.0]), (202, [float("nan")] * 6)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]  # ties
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    asked = df.where("id < 7").select(F.col("id").alias("qid"), "embedding")
    got = {(r.qid, r["rank"]): (r.id, round(r.score, 9)) for r in search.similar_batch(df, asked, 4, metric).collect()}
    for q, v in rows[:7]:
        for r in search.similar(df, v, 4, metric).collect():
            assert got[q, r["rank"]] == (r.id, round(r.score, 9))
    assert len(got) == 28
    assert search.similar_batch(df, asked.where("false"), 4).count() == 0
    with pytest.raises(ValueError):
        distance(F.col("a"), F.col("b"), "other")


def test_threshold(spark):
    df = spark.createDataFrame([(0.0,), (0.35,), (0.2,), (None,)], "score double")
    keep = lambda *a, **k: sorted(df.where(search.at_least(*a, **k)).toPandas().score.fillna(-1))
    assert keep(0.35) == [0.35]
    assert len(keep(None)) == len(keep(float("nan"))) == 4
    assert keep(0.2, mode="similarity") == [-1, 0.0, 0.2]


def test_prompts(spark):
    hits = spark.createDataFrame([(1, 2, "B"), (1, 1, "A"), (2, 1, None)], "qid int, rank int, content string")
    got = {r.qid: r.context for r in prompting.build_context(hits).collect()}
    assert got == {1: "[1] A\n\n[2] B", 2: "[1] "}
    df = spark.createDataFrame([("C", "Q"), ("", "Q"), (None, "Q")], "c string, q string")
    said = [r[0] for r in df.select(prompting.build_content(F.col("c"), F.col("q"))).collect()]
    assert said[0] == "Context: C\n\nQuestion: Q\n\nAnswer:" and said[1] == said[2] and said[1].startswith("Question: Q\n\nYou don't have")
    limits = spark.createDataFrame([(None,), (0,), (7,)], "n int").select(prompting.max_tokens(F.col("n"))).collect()
    assert [r[0] for r in limits] == [512, 512, 7]


def test_hashing_embedder(spark):
    e = HashingEmbedder(16)
    a, b, c = e.embed(["Red apple", "apple red!", ""])
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1) and not c.any()
    df = spark.createDataFrame([(1, "x y"), (2, None)], "id int, t string")
    assert [len(r.embedding) for r in embed_column(df, "t", e).collect()] == [16, 16]


def test_ingest_and_answer(spark, tmp_path):
    engine = create_engine(spark, f"file://{tmp_path}/s", {"CHUNK_SIZE": "40", "RETRIEVAL_THRESHOLD": "0"}, stand_ins=True, id_mode="content")
    files = from_uploads(spark, [("a.txt", "text/plain", b"The boiler runs at night. The gasket is replaced yearly."), ("b.pdf", "application/pdf", pdf(b"Harbour rules", b"Second page here"))])
    engine.ingest(files)
    rows = engine.store.get().orderBy("metadata.source", "metadata.page", "metadata.chunk").collect()
    assert [(r.metadata.source, r.metadata.mimeType, r.metadata.page, r.metadata.chunk, r.metadata.totalChunks) for r in rows] == [("a.txt", "text", None, 0, 2), ("a.txt", "text", None, 1, 2), ("b.pdf", "application/pdf", 1, 0, 1), ("b.pdf", "application/pdf", 2, 0, 1)]
    engine.ingest(files)
    assert engine.store.get().count() == 4  # content ids repeat
    answer = engine.query("Harbour rules", top_k=1)
    assert "[1] Harbour rules" in answer and "Question: Harbour rules" in answer
    assert engine.query("Harbour rules", top_k=1, threshold=99.0) == ""
    for missing in (None, ""):
        with pytest.raises(ValueError):
            engine.query(missing)
    asked = spark.createDataFrame([(1, "gasket"), (2, ""), (3, None), (4, "  ")], "qid int, query string")
    assert {r.qid for r in engine.answer(asked).collect()} == {1, 4}


def test_failed_ingest_writes_nothing(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/s", EngineConfig())
    with pytest.raises(ValueError, match="No files provided for ingestion"):
        engine.ingest(from_uploads(spark, [("a", "text/plain", b"x")]).where("false"))
    with pytest.raises(ValueError, match="No file handler found"):
        engine.ingest(from_uploads(spark, [("a", "text/plain", b"x"), ("b", "text/html", b"<p>")]))
    assert engine.store.get().count() == 0
    engine.ingest(from_uploads(spark, [("a", "text/plain", b"")]))  # no chunks, no version
    assert engine.store.get().count() == 0
    engine.ingest(from_uploads(spark, [("a", "text/plain", b"x y")]))
    engine.ingest(from_uploads(spark, [("a", "text/plain", b"x y")]))
    assert engine.store.get().count() == 2  # random ids never collide


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello there")
    (tmp_path / "in" / "skip.html").write_text("<p>")
    engine = Engine(spark, f"file://{tmp_path}/s", EngineConfig())
    for text in ("", "second file"):
        if text:
            (tmp_path / "in" / "b.txt").write_text(text)
        stream_folder(engine, f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination(60)
    assert sorted(r.text for r in engine.store.get().collect()) == ["hello there", "second file"]


def test_scratch_tables_are_removed(spark):
    from ragmill.session import clear_scratch, materialise, scratch_path

    clear_scratch(spark)
    df = materialise(spark.range(3), "numbers")
    assert df.count() == 3 and clear_scratch(spark) == 1 and clear_scratch(spark) == 0
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_paths_mean_the_same_to_spark_and_to_tasks(spark, tmp_path, monkeypatch):
    from ragmill.session import qualified, shared_dir
    from ragmill.sources.shared import parquet_files

    assert qualified(spark, str(tmp_path) + "/") == qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"
    assert shared_dir(spark).startswith("file:///")
    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert sum(f.metadata.num_rows for f in parquet_files([f"file://{tmp_path}/t"])) == 3
    assert list(parquet_files([f"file://{tmp_path}/none"])) == []
    with pytest.raises(FileNotFoundError):
        list(parquet_files([f"file://{tmp_path}/no/none"]))
