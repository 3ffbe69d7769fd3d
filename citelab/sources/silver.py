"""Silver tables: one row per response, and one per citation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelab.functions import text, urls


def responses(canonical: DataFrame) -> DataFrame:
    cited = F.col("cited_sources")
    domains = F.array_distinct(F.filter(F.transform(cited, lambda c: c["domain"]), lambda d: d.isNotNull()))
    provenance = F.array_join(F.array_sort(F.array_distinct(F.transform(cited, lambda c: c["provenance"]))), ";")
    return canonical.select(
        "query_id", "engine", "run_index", "model_served", "timestamp_utc", "run_profile", "answer_text",
        F.length(F.coalesce("answer_text", F.lit(""))).cast("long").alias("answer_char_len"),
        text.word_count(F.col("answer_text")).alias("answer_word_count"),
        F.size(cited).cast("long").alias("n_cited_sources"),
        F.size(domains).cast("long").alias("n_unique_domains"),
        (F.size(cited) > 0).alias("has_citations"),
        provenance.alias("citation_provenance"),
    )


def citations(canonical: DataFrame) -> DataFrame:
    each = canonical.select("query_id", "engine", "run_index", F.inline("cited_sources"))
    return each.select("query_id", "engine", "run_index", "position", "url", urls.canonical(F.col("url")).alias("url_canonical"), "domain", "title", "provenance")


#: Names under which providers report tokens, in the order in which they are tried.
TOKENS_IN, TOKENS_OUT = ("prompt_tokens", "input_tokens", "prompt_token_count"), ("completion_tokens", "output_tokens", "candidates_token_count")


def token_ledger(records: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and dollars per engine. prices: engine, tokens_in, tokens_out (dollars a million), per_call."""

    def first(names) -> F.Column:
        return F.coalesce(*[F.nullif(F.get_json_object("usage", f"$.{n}").cast("long"), F.lit(0)) for n in names], F.lit(0))

    t = records.select("engine", first(TOKENS_IN).alias("i"), first(TOKENS_OUT).alias("o")).groupBy("engine").agg(F.count("*").alias("calls"), F.sum("i").alias("tok_in"), F.sum("o").alias("tok_out"))
    price = lambda c: F.coalesce(c, F.lit(0.0))
    dollars = F.col("tok_in") / 1e6 * price("tokens_in") + F.col("tok_out") / 1e6 * price("tokens_out") + F.col("calls") * price("per_call")
    return t.join(F.broadcast(prices), "engine", "left").select("engine", "calls", "tok_in", "tok_out", dollars.alias("dollars"))
