"""Accuracy and prominence of citations: AIS, PAWC, their cleaned and normalised forms, coverage, bands.

All are aggregates of three tables: sentences (one row each), citations, and scores (sentence x fetched
source). Nothing is nested, and every function takes and returns DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citelab.config import TAU, TAU_GRID


def survivors(sents: DataFrame) -> DataFrame:
    """Sentences that aren't artifacts, counted anew: k, n_star, w_star."""
    by = W.partitionBy("doc_id")
    kept = sents.where(~F.col("is_artifact"))
    out = kept.withColumns({"k": F.row_number().over(by.orderBy("sentence_idx")).cast("long"), "n_star": F.count("*").over(by)})
    return out.withColumn("w_star", (F.col("n_star") - F.col("k") + 1).cast("double") / F.col("n_star"))


def supporters(scores: DataFrame, tau: float | Column = TAU) -> DataFrame:
    """(doc_id, sentence_idx, n_supporting): for each scored sentence, how many sources reach tau."""
    return scores.groupBy("doc_id", "sentence_idx").agg(F.sum((F.col("entail_score") >= tau).cast("long")).alias("n_supporting"))


def fetched(cits: DataFrame) -> DataFrame:
    """(doc_id, n_cited, n_fetched)."""
    return cits.groupBy("doc_id").agg(F.count("*").alias("n_cited"), F.sum((F.col("fetch_status") == "ok").cast("long")).alias("n_fetched"))


def raw_metrics(docs: DataFrame, sents: DataFrame, scores: DataFrame, tau: float = TAU) -> DataFrame:
    """Per response n_sentences, n_supported, ais_rate, pawc_total before cleaning. docs: doc_id."""
    m = sents.join(supporters(scores, tau), ["doc_id", "sentence_idx"], "left")
    n = F.coalesce("n_supporting", F.lit(0))
    agg = m.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum((n > 0).cast("long")).alias("n_supported"), F.sum(n * F.col("word_count") * F.col("position_weight")).alias("pawc_total"))
    out = docs.select("doc_id").join(agg, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), F.coalesce("n_supported", F.lit(0)).alias("n_supported"), (F.col("n_supported") / F.col("n_sentences")).alias("ais_rate"), F.coalesce("pawc_total", F.lit(0.0)).alias("pawc_total"))


def cleaned_metrics(docs: DataFrame, sents: DataFrame, cits: DataFrame, scores: DataFrame, tau: float = TAU) -> DataFrame:
    """Per response n_artifacts, cleaned_n, cleaned_ais, cleaned_pawc_total, omega, pawc_norm, coverage."""
    s = survivors(sents).join(supporters(scores, tau), ["doc_id", "sentence_idx"], "left")
    n = F.coalesce("n_supporting", F.lit(0))
    mass = F.col("word_count") * F.col("w_star")
    agg = s.groupBy("doc_id").agg(
        F.count("*").alias("cleaned_n"),
        F.avg((n > 0).cast("double")).alias("cleaned_ais"),
        F.sum(n * mass).alias("cleaned_pawc_total"),
        F.sum(mass).alias("omega"),
        (F.sum(F.when(n > 0, F.col("w_star")).otherwise(0.0)) / F.sum("w_star")).alias("coverage"),
    )
    dropped = sents.groupBy("doc_id").agg(F.sum(F.col("is_artifact").cast("long")).alias("n_artifacts"), F.count("*").alias("n_sentences"))
    out = docs.select("doc_id").join(dropped, "doc_id", "left").join(agg, "doc_id", "left").join(fetched(cits), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", zero("n_sentences"), zero("n_artifacts"), zero("cleaned_n"), zero("n_cited"), zero("n_fetched"), "cleaned_ais", F.coalesce("cleaned_pawc_total", F.lit(0.0)).alias("cleaned_pawc_total"), F.coalesce("omega", F.lit(0.0)).alias("omega"), "coverage").withColumn("pawc_norm", norm(F.col("cleaned_pawc_total"), F.col("n_fetched"), F.col("omega")))


def norm(total: Column, m: Column, omega: Column) -> Column:
    """total / (m x omega); null without sources or without mass."""
    return F.when((m > 0) & (omega > 0), total / (m * omega))


def pawc_by_source(sents: DataFrame, scores: DataFrame, tau: float = TAU) -> DataFrame:
    """(doc_id, citation_position, pawc) over surviving sentences. All weights of a response have one denominator, so whole numbers are
    summed and divided once: the same value in every order of the rows, ties of a later rounding included."""
    hit = scores.where(F.col("entail_score") >= tau).join(survivors(sents).select("doc_id", "sentence_idx", "word_count", "k", "n_star"), ["doc_id", "sentence_idx"])
    return hit.groupBy("doc_id", "citation_position").agg((F.sum(F.col("word_count") * (F.col("n_star") - F.col("k") + 1)).cast("double") / F.first("n_star")).alias("pawc"))


def tau_sweep(docs: DataFrame, sents: DataFrame, cits: DataFrame, scores: DataFrame, taus: Sequence[float] = TAU_GRID) -> DataFrame:
    """(doc_id, tau, cleaned_ais, pawc_norm). Survivors and omega don't depend on tau, so each is computed once;
    the thresholds are conditional sums of one aggregate, not copies of the rows."""
    n = len(taus)
    per = scores.groupBy("doc_id", "sentence_idx").agg(*[F.sum((F.col("entail_score") >= t).cast("long")).alias(f"n{i}") for i, t in enumerate(taus)])
    s = survivors(sents).join(per, ["doc_id", "sentence_idx"], "left")
    mass = F.col("word_count") * F.col("w_star")
    cols = [F.sum(mass).alias("omega")]
    for i in range(n):
        c = F.coalesce(f"n{i}", F.lit(0))
        cols += [F.avg((c > 0).cast("double")).alias(f"a{i}"), F.sum(c * mass).alias(f"p{i}")]
    wide = docs.select("doc_id").join(s.groupBy("doc_id").agg(*cols), "doc_id", "left").join(fetched(cits), "doc_id", "left")
    rows = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.col(f"a{i}").alias("cleaned_ais"), norm(F.coalesce(f"p{i}", F.lit(0.0)), F.col("n_fetched"), F.col("omega")).alias("pawc_norm")) for i, t in enumerate(taus)])
    return wide.select("doc_id", F.inline(rows))


def norm_variants(docs: DataFrame, sents: DataFrame, cits: DataFrame, scores: DataFrame, tau: float = TAU) -> DataFrame:
    """The norm before cleaning (literal: fetched sources x mass of all sentences; alternative: all cited sources), and
    the parts of the denominators' difference: fewer sources, less mass, both."""
    all_mass = sents.groupBy("doc_id").agg(F.sum(F.col("word_count") * F.col("position_weight")).alias("omega_all"))
    raw = raw_metrics(docs, sents, scores, tau).select("doc_id", "pawc_total")
    clean = cleaned_metrics(docs, sents, cits, scores, tau).select("doc_id", "n_cited", "n_fetched", "omega", "pawc_norm")
    m = raw.join(clean, "doc_id").join(all_mass, "doc_id", "left")
    o = F.coalesce("omega_all", F.lit(0.0))
    return m.select(
        "doc_id",
        norm(F.col("pawc_total"), F.col("n_fetched"), o).alias("literal_norm"),
        norm(F.col("pawc_total"), F.col("n_cited"), o).alias("alternative_norm"),
        "pawc_norm",
        ((F.col("n_cited") - F.col("n_fetched")) * F.col("omega")).alias("part_sources"),
        (F.col("n_fetched") * (o - F.col("omega"))).alias("part_mass"),
        ((F.col("n_cited") - F.col("n_fetched")) * (o - F.col("omega"))).alias("part_both"),
        (F.col("n_cited") * o - F.col("n_fetched") * F.col("omega")).alias("difference"),
    )


def bands(score: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """names[i] for scores below edges[i], the last name beyond all."""
    out = None
    for e, n in zip(edges, names, strict=False):
        out = F.when(score < e, n) if out is None else out.when(score < e, n)
    return out.otherwise(names[-1])


def cv(x: str) -> Column:
    """Sample standard deviation over mean; null if the mean is null or 0."""
    m = F.avg(x)
    return F.when(m != 0, F.stddev_samp(x) / m)


def cell_aggregates(cells: DataFrame) -> DataFrame:
    """Repeats of an engine and query as one row. cells: engine, query_id, cleaned_pawc_total, cleaned_ais, pawc_norm, n_cited."""
    stats = [f(c).alias(f"{n}_{s}") for n, c in (("pawc", "cleaned_pawc_total"), ("ais", "cleaned_ais"), ("pawc_norm", "pawc_norm")) for s, f in (("mean", F.avg), ("sd", F.stddev_samp), ("cv", cv))]
    return cells.groupBy("engine", "query_id").agg(
        *stats,
        F.count("cleaned_pawc_total").alias("n_runs"),
        F.count("cleaned_ais").alias("n_runs_ais"),
        F.avg((F.col("n_cited") > 0).cast("double")).alias("did_search_rate"),
        (F.count_distinct("n_cited") == 1).alias("citations_consistent"),
        F.avg("n_cited").alias("n_cited_mean"),
    )


def citation_events(docs: DataFrame, sents: DataFrame, cits: DataFrame, scores: DataFrame, tau: float = TAU, low: float = 0.3) -> DataFrame:
    """One row per citation: its place, and the outcomes of its pairs with sentences that aren't artifacts."""
    pairs = scores.join(sents.where(~F.col("is_artifact")).select("doc_id", "sentence_idx"), ["doc_id", "sentence_idx"])
    e = F.col("entail_score")
    per = pairs.groupBy("doc_id", "citation_position").agg(F.count("*").alias("pairs_n"), F.avg(e).alias("mean_entail"), F.avg((e >= tau).cast("double")).alias("supported_share"), F.avg((e < low).cast("double")).alias("contradiction_share"))
    n = F.count("*").over(W.partitionBy("doc_id"))
    pos = F.col("citation_position")
    ev = cits.withColumn("n_cited_in_response", n).join(per, ["doc_id", "citation_position"], "left").join(docs, "doc_id")
    return ev.withColumns({"is_first": (pos == 1).cast("long"), "is_early3": (pos <= 3).cast("long"), "rel_position": (pos - 1).cast("double") / F.greatest(F.col("n_cited_in_response") - 1, F.lit(1)), "fetch_ok": (F.col("fetch_status") == "ok").cast("long")})
