import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ragmill.functions.embedding import HttpEmbedder, document_request, document_vectors, embed_column
from ragmill.functions.generation import HttpGenerator, generate_column
from ragmill.operators.prompting import build_content, build_prompt


@pytest.fixture(scope="module")
def server():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/embed":
                reply = {"embeddings": [[float(len(t)), 1.0] for t in body["input"]]}
            elif self.path == "/documents":
                reply = {"embeddings": [{"values": [float(len(r["content"]["parts"][0]["text"]))]} for r in body["requests"]]}
            elif self.path == "/api/embed":
                reply = {"embeddings": [[float(len(t)), 1.0] for t in body["input"]]}
            elif self.path == "/late":
                calls.append(self.path)
                if len(calls) < 3:
                    self.send_response(503)
                    self.send_header("Content-Length", "0")
                    self.end_headers()
                    return
                reply = {"embeddings": [[1.0] for _ in body["input"]]}
            elif self.path == "/v1/m:batch":
                reply = {"embeddings": [{"values": [1.0 if self.headers["x-goog-api-key"] == "k" and r["model"] == "models/m" else 0.0]} for r in body["requests"]]}
            elif self.path == "/broken":
                reply = {}
            else:
                reply = {"message": {"content": f"{body['model']} read {len(body['messages'])} messages"}}
            data = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_embedding(spark, server):
    df = spark.createDataFrame([(1, "abc"), (2, "")], "id int, t string")
    got = {r.id: list(r.embedding) for r in embed_column(df, "t", HttpEmbedder(f"{server}/embed", "m")).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}
    assert HttpEmbedder(f"{server}/documents", "m", document_request, document_vectors).embed(["four"]) == [[4.0]]
    with pytest.raises(RuntimeError, match="Failed to generate embeddings"):
        HttpEmbedder(f"{server}/broken", "m").embed(["x"])


def test_generation(spark, server):
    df = spark.createDataFrame([(1, "C", "Q"), (2, None, None)], "id int, c string, q string")
    prompts = df.select("id", F.when(F.col("q").isNotNull(), build_prompt(build_content(F.col("c"), F.col("q")), "tiny")).alias("p"))
    got = {r.id: r.response for r in generate_column(prompts, "p", HttpGenerator(f"{server}/chat")).collect()}
    assert got == {1: "tiny read 2 messages", 2: None}


def test_calls_are_tried_again_and_keys_are_sent(server):
    from ragmill.functions.embedding import document_embedder, post

    assert HttpEmbedder(f"{server}/late", "m").embed(["a"]) == [[1.0]]
    assert document_embedder("k", "m", server + "/v1/{model}:batch").embed(["a"]) == [[1.0]]
    assert document_embedder("k").url.endswith("gemini-1.5-embed-text-001:batchEmbedContents")
    with pytest.raises(ValueError):
        document_embedder("")
    with pytest.raises(OSError):
        post("http://127.0.0.1:9/x", {}, 1, attempts=2, pause=0.01)


def test_engine_from_settings(spark, server, tmp_path):
    from ragmill.plans.pipelines import create_engine
    from ragmill.sources.files import from_uploads

    root = f"file://{tmp_path}/s"
    for env in ({}, {"EMBEDDING_MODEL": "m"}, {"GENERATION_MODEL": "g"}):
        with pytest.raises(ValueError, match="stand-ins"):
            create_engine(spark, root, env)
    assert create_engine(spark, root, {"GEMINI_API_KEY": "k", "GENERATION_MODEL": "g"}).embedder.model == "models/gemini-1.5-embed-text-001"
    engine = create_engine(spark, root, {"EMBEDDING_MODEL": "m", "GENERATION_MODEL": "g", "OLLAMA_HOST": server, "RETRIEVAL_THRESHOLD": "0"})
    engine.ingest(from_uploads(spark, [("a", "text/plain", b"five!")]))
    assert [list(r.embedding) for r in engine.store.get().collect()] == [[5.0, 1.0]]
    assert engine.query("what?", max_tokens=5) == "g read 2 messages"
