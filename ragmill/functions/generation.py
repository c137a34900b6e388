"""Chat providers: a deterministic stub, and one that calls a model server."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from ragmill.functions.embedding import post
from ragmill.session import extended

Message = dict[str, str]


class Generator(Protocol):
    """Answers one prompt: a model name and its messages."""

    def generate(self, model: str, messages: list[Message]) -> str: ...


class EchoGenerator:
    """Answers with a digest of the prompt, so that tests see what the model was asked."""

    def generate(self, model: str, messages: list[Message]) -> str:
        return f"{model}: {messages[-1]['content']}"


class HttpGenerator:
    """One chat call per prompt, ``workers`` at a time in a task; the answer is the reply's message content."""

    def __init__(self, url: str, timeout: float = 300, attempts: int = 3, workers: int = 4):
        self.url, self.timeout, self.attempts, self.workers = url, timeout, attempts, workers

    def generate(self, model: str, messages: list[Message]) -> str:
        body = {"model": model, "messages": messages, "stream": False}
        return post(self.url, body, self.timeout, attempts=self.attempts)["message"]["content"]


# Fixed value: where a model server answers chats.
CHAT_PATH = "/api/chat"


def server_generator(host: str, **more) -> HttpGenerator:
    """Answers from a model server."""
    return HttpGenerator(host.rstrip("/") + CHAT_PATH, **more)


def generate_column(df: DataFrame, prompt: str, generator: Generator, column: str = "response") -> DataFrame:
    """``df`` with the answer to each row's prompt, a struct of model and messages; a null prompt has a null answer and
    calls no model."""
    schema = extended(df.schema, **{column: StringType()})

    def answer(asked: dict | None) -> str | None:
        return None if asked is None else generator.generate(asked["model"], asked["messages"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers = getattr(generator, "workers", 1)
        for rows in batches:
            asked = rows.column(prompt).to_pylist()
            if workers > 1:
                with ThreadPoolExecutor(workers) as pool:
                    answers = list(pool.map(answer, asked))
            else:
                answers = [answer(a) for a in asked]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(answers, pa.string())], names=[*rows.schema.names, column])

    return df.mapInArrow(run, schema)
