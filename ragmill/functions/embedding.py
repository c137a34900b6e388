"""Embedding providers: a deterministic offline one, and one that calls a model server."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ragmill.messages import NO_EMBEDDINGS
from ragmill.session import extended


class Embedder(Protocol):
    """Turns texts into vectors, in their order. Instances travel to the executors, so they are picklable."""

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class HashingEmbedder:
    """Feature hashing: each token adds +1 or -1 to the component its MD5 names; the sum is scaled to length 1. A text
    without tokens has the zero vector."""

    TOKEN = re.compile(r"[a-z0-9]+")

    def __init__(self, dim: int = 64):
        if dim < 1:
            raise ValueError("dim must be at least 1")
        self.dim = dim
        self._places: dict[str, tuple[int, float]] = {}

    def place(self, token: str) -> tuple[int, float]:
        found = self._places.get(token)
        if found is None:
            if len(self._places) > 500_000:
                self._places.clear()
            digest = hashlib.md5(token.encode()).hexdigest()
            found = self._places[token] = int(digest[:8], 16) % self.dim, 1.0 if int(digest[8], 16) % 2 == 0 else -1.0
        return found

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for token in self.TOKEN.findall(text.lower()):
                at, sign = self.place(token)
                out[i, at] += sign
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def post(url: str, body: dict, timeout: float, headers: dict | None = None, attempts: int = 3, pause: float = 0.5) -> dict:
    """A JSON reply to a JSON body. Failed connections and replies that say to come again later are tried anew, after longer
    and longer pauses; other errors raise at once."""
    call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    for attempt in range(attempts):
        try:
            with urllib.request.urlopen(call, timeout=timeout) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            if attempt == attempts - 1 or e.code not in (408, 429, 500, 502, 503, 504):
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == attempts - 1:
                raise
        time.sleep(pause * 2**attempt)
    raise AssertionError("unreachable")


class HttpEmbedder:
    """Calls a model server once per batch. ``request`` makes the body from model and texts, ``vectors`` reads the reply; a
    reply without a vector for every text raises."""

    def __init__(self, url: str, model: str, request: Callable[[str, Sequence[str]], dict] | None = None, vectors: Callable[[dict], Sequence] | None = None, timeout: float = 120, headers: dict | None = None, attempts: int = 3):
        self.url, self.model, self.timeout, self.headers, self.attempts = url, model, timeout, headers or {}, attempts
        self.request = request or _batch_request
        self.vectors = vectors or _batch_vectors

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        found = self.vectors(post(self.url, self.request(self.model, list(texts)), self.timeout, self.headers, self.attempts))
        if not found or len(found) != len(texts) or any(v is None for v in found):
            raise RuntimeError(NO_EMBEDDINGS)
        return found


# The model that embeds documents for retrieval where none is named, and the
# addresses of a model server's and of the retrieval service's calls.
DOCUMENT_MODEL = "gemini-1.5-embed-text-001"
EMBED_PATH = "/api/embed"
DOCUMENT_URL = "https://generativelanguage.googleapis.com/v1beta/models/{model}:batchEmbedContents"


def server_embedder(host: str, model: str, **more) -> HttpEmbedder:
    """Embeddings from a model server."""
    return HttpEmbedder(host.rstrip("/") + EMBED_PATH, model, **more)


def document_embedder(key: str, model: str = "", url: str = DOCUMENT_URL, **more) -> HttpEmbedder:
    """Embeddings of documents for retrieval, from a service that wants a key."""
    if not key:
        raise ValueError("a key is needed to embed documents for retrieval")
    model = model or DOCUMENT_MODEL
    return HttpEmbedder(url.format(model=model), f"models/{model}", document_request, document_vectors, headers={"x-goog-api-key": key}, **more)


def _batch_request(model: str, texts: Sequence[str]) -> dict:
    return {"model": model, "input": list(texts)}


def _batch_vectors(reply: dict) -> Sequence:
    return reply.get("embeddings") or []


def document_request(model: str, texts: Sequence[str]) -> dict:
    """The body for servers that embed documents for retrieval one content at a time."""
    return {"requests": [{"model": model, "content": {"parts": [{"text": t}]}, "taskType": "RETRIEVAL_DOCUMENT"} for t in texts]}


def document_vectors(reply: dict) -> Sequence:
    return [x.get("values") for x in reply.get("embeddings") or []]


def embed_column(df: DataFrame, text: str, embedder: Embedder, column: str = "embedding", batch: int = 512) -> DataFrame:
    """``df`` with a vector per row, computed in the row's own task: texts and vectors never need to be matched up. A null
    text is embedded as the empty text."""
    schema = extended(df.schema, **{column: ArrayType(FloatType())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                texts = [t or "" for t in part.column(text).to_pylist()]
                vectors = np.asarray(embedder.embed(texts), dtype=np.float32)
                n, dim = vectors.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(vectors.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, column])

    return df.mapInArrow(run, schema)


def tokens(text: Column) -> Column:
    """The hashing embedder's tokens and perhaps empty strings, to be exploded."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def token_place(token: Column, dim: int = 64) -> tuple[Column, Column]:
    """(component, sign) that the hashing embedder gives a token, in generated code."""
    digest = F.md5(token)
    at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim
    even = F.substring(digest, 9, 1).isin(*"02468ace")
    return at.cast("int"), F.when(even, 1.0).otherwise(-1.0)
