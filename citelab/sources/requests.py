"""Requests to answer engines: one JSON body per engine, query and run, and the stamp of a capture.

What an engine answers is read by the adapter of the same name; a forced variant asks otherwise and is read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tools by which engines search, and bounds of their answers.
SEARCH, CLAUDE_SEARCH, KIMI_SEARCH, MOST_TOKENS = "web_search", "web_search_20250305", "$web_search", 4096


def _user(question: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), question.alias("content")))


def _tool(kind: str) -> Column:
    return F.struct(F.lit(kind).alias("type"))


def _chatgpt(model: Column, question: Column) -> list[Column]:
    return [model.alias("model"), question.alias("input"), F.array(_tool(SEARCH)).alias("tools")]


def _claude(model: Column, question: Column) -> list[Column]:
    tool = F.struct(F.lit(CLAUDE_SEARCH).alias("type"), F.lit(SEARCH).alias("name"))
    return [model.alias("model"), F.lit(MOST_TOKENS).alias("max_tokens"), F.array(tool).alias("tools"), _user(question).alias("messages")]


def _gemini(model: Column, question: Column) -> list[Column]:
    return [model.alias("model"), question.alias("contents"), F.array(F.lit("google_search")).alias("tools")]


def _perplexity(model: Column, question: Column) -> list[Column]:
    return [model.alias("model"), _user(question).alias("messages")]


def _kimi(model: Column, question: Column) -> list[Column]:
    tool = F.struct(F.lit("builtin_function").alias("type"), F.struct(F.lit(KIMI_SEARCH).alias("name")).alias("function"))
    return [model.alias("model"), _user(question).alias("messages"), F.lit(MOST_TOKENS).alias("max_tokens"), F.array(tool).alias("tools")]


def _mistral(model: Column, question: Column) -> list[Column]:
    return [model.alias("model"), question.alias("inputs"), F.array(_tool(SEARCH)).alias("tools")]


BUILDERS: dict[str, Callable[[Column, Column], list[Column]]] = {"chatgpt": _chatgpt, "claude": _claude, "gemini": _gemini, "perplexity": _perplexity, "kimi": _kimi, "mistral": _mistral}


def forced(builder: Callable[[Column, Column], list[Column]], kind: str = SEARCH) -> Callable[[Column, Column], list[Column]]:
    """The same request, but the engine must search."""
    return lambda model, question: [*builder(model, question), _tool(kind).alias("tool_choice")]


def bodies(wanted: DataFrame, models: dict[str, str]) -> DataFrame:
    """wanted (engine, question and others) with model_requested and body. `_forced` after an engine's name asks for the forced
    form. Engines without a model give null."""
    model, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, version in models.items():
        base = name.removesuffix("_forced")
        build = BUILDERS[base] if base == name else forced(BUILDERS[base])
        own = F.col("engine") == name
        model = F.when(own, F.lit(version)).otherwise(model)
        body = F.when(own, F.to_json(F.struct(*build(F.lit(version), F.col("question"))))).otherwise(body)
    return wanted.withColumns({"model_requested": model, "body": body})


def utc_stamp(at: Column) -> Column:
    """ISO form of an instant in UTC, with microseconds; the session's time zone doesn't matter."""
    micros = F.unix_micros(at)
    whole = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))
    return F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
