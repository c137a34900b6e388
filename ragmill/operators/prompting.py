"""Prompt assembly: numbered context, user message, chat request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts of a chat request.
SYSTEM = "You are a helpful assistant. Use the following context to answer the question. If the context doesn't contain relevant information, say so politely."
NO_CONTEXT = "\n\nYou don't have any relevant information to answer this question. Please say so politely."
DEFAULT_MAX_TOKENS = 512


def build_context(hits: DataFrame, qid: str = "qid", rank: str = "rank", content: str = "content") -> DataFrame:
    """(qid, context): each question's hits in their order, numbered from 1. A question has at most top-K hits, so its list is
    bounded."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.coalesce(content, F.lit("")).alias("c"))))
    parts = F.transform(ordered, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["c"]))
    return hits.groupBy(qid).agg(F.array_join(parts, "\n\n").alias("context"))


def build_content(context: Column, question: Column) -> Column:
    """The user message; without context the model is told that there is none."""
    question = F.concat(F.lit("Question: "), question)
    found = F.concat(F.lit("Context: "), context, F.lit("\n\n"), question, F.lit("\n\nAnswer:"))
    return F.when(F.coalesce(context, F.lit("")) == "", F.concat(question, F.lit(NO_CONTEXT))).otherwise(found)


def build_prompt(content: Column, model: str) -> Column:
    """struct<model, messages array<struct<role, content>>>: the instruction, then the user message."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(SYSTEM)), message("user", content)).alias("messages"))


def prompt_context(question: Column, context: Column, limit: Column) -> Column:
    """struct<question, sources, maxTokens>: what a prompt is made of."""
    return F.struct(question.alias("question"), context.alias("sources"), max_tokens(limit).alias("maxTokens"))


def max_tokens(column: Column) -> Column:
    """The context's token limit; missing and 0 are the default. No model is sent it."""
    return F.when(F.coalesce(column, F.lit(0)) == 0, F.lit(DEFAULT_MAX_TOKENS)).otherwise(column)
