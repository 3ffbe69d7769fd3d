"""Queries over answers, sentences, citations and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citelab.config import TAU_GRID
from citelab.operators import metrics as M
from citelab.operators import relational as R
from citelab.sources import driver_tables as D

with_sql = D.with_sql


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


class Star:
    """The four tables of one folder."""

    def __init__(self, spark, sf_dir: str) -> None:
        self.keys, self.sents, self.cits, self.scores = D.keys(spark, sf_dir), D.sentences(spark, sf_dir), D.citations(spark, sf_dir), D.scores(spark, sf_dir)


def cells(s: Star) -> DataFrame:
    return s.keys.join(M.cleaned_metrics(s.keys, s.sents, s.cits, s.scores), "doc_id")


#: Cleaned metrics of each response, in SQL, on top of the named parts.
CLEAN = """surv AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_idx) AS k, count(*) OVER (PARTITION BY doc_id) AS n_star FROM sent WHERE NOT is_artifact),
sup AS (SELECT doc_id, sentence_idx, sum(CASE WHEN entail_score >= 0.5 THEN 1 ELSE 0 END) AS n FROM score GROUP BY ALL),
agg AS (SELECT surv.doc_id, count(*) AS cleaned_n, avg(CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END) AS cleaned_ais,
  sum(coalesce(n, 0) * word_count * ((n_star - k + 1) / n_star)) AS cleaned_pawc_total, sum(word_count * ((n_star - k + 1) / n_star)) AS omega,
  sum(CASE WHEN coalesce(n, 0) > 0 THEN (n_star - k + 1) / n_star ELSE 0.0 END) / sum((n_star - k + 1) / n_star) AS coverage
  FROM surv LEFT JOIN sup ON surv.doc_id = sup.doc_id AND surv.sentence_idx = sup.sentence_idx GROUP BY surv.doc_id),
art AS (SELECT doc_id, sum(CASE WHEN is_artifact THEN 1 ELSE 0 END) AS n_artifacts, count(*) AS n_sentences FROM sent GROUP BY doc_id),
fet AS (SELECT doc_id, count(*) AS n_cited, sum(CASE WHEN fetch_status = 'ok' THEN 1 ELSE 0 END) AS n_fetched FROM cit GROUP BY doc_id),
cell AS (SELECT resp.doc_id, engine, query_id, run_index, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_artifacts, 0) AS n_artifacts, coalesce(cleaned_n, 0) AS cleaned_n, coalesce(n_cited, 0) AS n_cited, coalesce(n_fetched, 0) AS n_fetched,
  cleaned_ais, coalesce(cleaned_pawc_total, 0.0) AS cleaned_pawc_total, coalesce(omega, 0.0) AS omega, coverage,
  CASE WHEN n_fetched > 0 AND omega > 0 THEN coalesce(cleaned_pawc_total, 0.0) / (n_fetched * omega) END AS pawc_norm
  FROM resp LEFT JOIN agg ON resp.doc_id = agg.doc_id LEFT JOIN art ON resp.doc_id = art.doc_id LEFT JOIN fet ON resp.doc_id = fet.doc_id)"""
CELL = with_sql("resp sent cit score", CLEAN)
MART = CELL.rstrip() + """,
mart AS (SELECT engine, query_id, avg(cleaned_pawc_total) AS pawc_mean, stddev_samp(cleaned_pawc_total) AS pawc_sd, CASE WHEN avg(cleaned_pawc_total) <> 0 THEN stddev_samp(cleaned_pawc_total) / avg(cleaned_pawc_total) END AS pawc_cv,
  avg(cleaned_ais) AS ais_mean, stddev_samp(cleaned_ais) AS ais_sd, CASE WHEN avg(cleaned_ais) <> 0 THEN stddev_samp(cleaned_ais) / avg(cleaned_ais) END AS ais_cv,
  avg(pawc_norm) AS pawc_norm_mean, stddev_samp(pawc_norm) AS pawc_norm_sd, CASE WHEN avg(pawc_norm) <> 0 THEN stddev_samp(pawc_norm) / avg(pawc_norm) END AS pawc_norm_cv,
  count(cleaned_pawc_total) AS n_runs, count(cleaned_ais) AS n_runs_ais, avg(CASE WHEN n_cited > 0 THEN 1.0 ELSE 0.0 END) AS did_search_rate,
  count(DISTINCT n_cited) = 1 AS citations_consistent, avg(n_cited) AS n_cited_mean FROM cell GROUP BY ALL)
"""


def ais_pawc_by_engine(spark, sf_dir):
    c = cells(Star(spark, sf_dir))
    return c.groupBy("engine").agg(F.count("*").alias("n_responses"), F.round(F.avg("cleaned_ais"), 6).alias("mean_ais"), F.round(F.avg("pawc_norm"), 6).alias("mean_pawc_norm"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


def raw_cell_metrics(spark, sf_dir):
    s = Star(spark, sf_dir)
    return M.raw_metrics(s.keys, s.sents, s.scores).select("doc_id", "n_sentences", "n_supported", r6("ais_rate"), r6("pawc_total"))


def cleaned_cell_metrics(spark, sf_dir):
    c = cells(Star(spark, sf_dir))
    return c.select("doc_id", "engine", "query_id", "run_index", "n_sentences", "n_artifacts", "cleaned_n", "n_cited", "n_fetched", r6("cleaned_ais"), r6("cleaned_pawc_total"), r6("omega"), r6("coverage"), r6("pawc_norm"))


def pawc_by_source(spark, sf_dir):
    s = Star(spark, sf_dir)
    return M.pawc_by_source(s.sents, s.scores).select("doc_id", "citation_position", r6("pawc"))


def pawc_map_export(spark, sf_dir):
    """One row per response with a map from position to its prominence, and its JSON form."""
    s = Star(spark, sf_dir)
    per = M.pawc_by_source(s.sents, s.scores).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("citation_position").cast("int"), F.round("pawc", 4))))).alias("m"))
    return per.select("doc_id", F.size("m").cast("long").alias("n_sources"), F.to_json("m").alias("pawc_json"))


def tau_rows(spark, sf_dir):
    s = Star(spark, sf_dir)
    return s.keys.join(M.tau_sweep(s.keys, s.sents, s.cits, s.scores), "doc_id")


def tau_sweep(spark, sf_dir):
    t = tau_rows(spark, sf_dir)
    return t.groupBy("engine", "tau").agg(F.round(F.avg("cleaned_ais"), 6).alias("mean_ais"), F.round(F.avg("pawc_norm"), 6).alias("mean_pawc_norm"), F.count("pawc_norm").alias("n_norm"))


def tau_ranking(spark, sf_dir):
    """Engines from best to worst at each threshold, and their average ranks' sum as a check on ties."""
    m = tau_rows(spark, sf_dir).groupBy("engine", "tau").agg(F.round(F.avg("cleaned_ais"), 6).alias("m"))
    by = W.partitionBy("tau").orderBy(F.desc("m"))
    m = m.withColumn("rank", F.rank().over(by) + (F.count("*").over(W.partitionBy("tau", "m")) - 1) / 2)
    order = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "engine")))
    return m.groupBy("tau").agg(F.array_join(F.transform(order, lambda x: x["engine"]), " > ").alias("ranking"), F.sum("rank").alias("rank_sum"))


TAUS = ", ".join(f"({t})" for t in TAU_GRID)
TAU_SQL = with_sql("resp sent cit score", CLEAN.split(",\nsup AS")[0], f"""taus(tau) AS (VALUES {TAUS}),
supt AS (SELECT doc_id, sentence_idx, tau, sum(CASE WHEN entail_score >= tau THEN 1 ELSE 0 END) AS n FROM score, taus GROUP BY ALL),
st AS (SELECT surv.*, tau FROM surv, taus),
aggt AS (SELECT st.doc_id, st.tau, avg(CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END) AS cleaned_ais, sum(coalesce(n, 0) * word_count * ((n_star - k + 1) / n_star)) AS p, sum(word_count * ((n_star - k + 1) / n_star)) AS omega
  FROM st LEFT JOIN supt ON st.doc_id = supt.doc_id AND st.sentence_idx = supt.sentence_idx AND st.tau = supt.tau GROUP BY ALL),
fet AS (SELECT doc_id, sum(CASE WHEN fetch_status = 'ok' THEN 1 ELSE 0 END) AS n_fetched FROM cit GROUP BY doc_id),
tau_rows AS (SELECT engine, aggt.tau, cleaned_ais, CASE WHEN n_fetched > 0 AND omega > 0 THEN p / (n_fetched * omega) END AS pawc_norm
  FROM aggt JOIN resp ON resp.doc_id = aggt.doc_id LEFT JOIN fet ON fet.doc_id = aggt.doc_id)""")


def norm_variants(spark, sf_dir):
    s = Star(spark, sf_dir)
    v = M.norm_variants(s.keys, s.sents, s.cits, s.scores)
    return v.select("doc_id", *[F.round(F.col(c) + 0.0, 6).alias(c) for c in v.columns[1:]])


def entailment_bands(spark, sf_dir):
    s = Star(spark, sf_dir)
    pairs = s.scores.join(s.sents.where(~F.col("is_artifact")).select("doc_id", "sentence_idx"), ["doc_id", "sentence_idx"]).join(s.keys, "doc_id")
    e = F.col("entail_score")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return pairs.groupBy("engine").agg(F.count("*").alias("n_pairs"), share(e < 0.3).alias("contradiction"), share((e >= 0.3) & (e < 0.5)).alias("neutral"), share(e >= 0.5).alias("supported"), share(e >= 0.7).alias("strong"))


def entailment_band_counts(spark, sf_dir):
    s = D.scores(spark, sf_dir)
    return s.groupBy(M.bands(F.col("entail_score"), (0.3, 0.5, 0.7), ("low", "middle", "high", "top")).alias("band")).agg(F.count("*").alias("n"))


def cell_aggregates(spark, sf_dir):
    m = M.cell_aggregates(cells(Star(spark, sf_dir)))
    exact = {"engine", "query_id", "n_runs", "n_runs_ais", "citations_consistent"}
    return m.select(*[F.col(c) if c in exact else r6(c) for c in m.columns])


def cv_stability(spark, sf_dir):
    """Stability bands of the cells, how many reach the ceiling of the square root of their repeats, how many show nothing."""
    m = M.cell_aggregates(cells(Star(spark, sf_dir)))
    band = F.when(F.col("pawc_cv").isNull(), "undefined").when(F.col("pawc_cv") < 0.5, "stable").otherwise("unstable")
    rate = F.when(F.col("did_search_rate") <= 0.25, "low").when(F.col("did_search_rate") <= 0.75, "middle").otherwise("high")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return m.groupBy("engine", band.alias("cv_band"), rate.alias("search_band")).agg(F.count("*").alias("n_cells"), share(F.abs(F.col("pawc_cv") - F.sqrt("n_runs")) < 1e-6).alias("at_ceiling"), share(F.coalesce(F.col("pawc_mean"), F.lit(0.0)) == 0).alias("no_prominence"))


def score_histogram(spark, sf_dir):
    """20 equal bins of [0, 1], the last one closed."""
    s = D.scores(spark, sf_dir)
    b = F.least(F.floor(F.col("entail_score") * 20), F.lit(19)).cast("long")
    return s.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def score_quantiles(spark, sf_dir):
    s = D.scores(spark, sf_dir).join(D.keys(spark, sf_dir), "doc_id")
    ps = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
    q = R.exact_quantiles(s, "entail_score", ps, "engine")
    return q.select("engine", *[F.round(F.col("q")[i], 6).alias(f"p{int(p * 100)}") for i, p in enumerate(ps)])


def flat_responses(spark, sf_dir):
    c = cells(Star(spark, sf_dir))
    rid = F.concat_ws("__", "engine", "query_id", F.concat(F.lit("r"), F.col("run_index").cast("string")))
    return c.select(rid.alias("response_id"), "query_id", "engine", "run_index", "n_sentences", "n_artifacts", "cleaned_n", F.col("n_cited").alias("n_sources_cited"), F.col("n_fetched").alias("n_sources_fetched_ok"))


def flat_sentences(spark, sf_dir):
    s = Star(spark, sf_dir)
    n = M.supporters(s.scores)
    return s.sents.join(n, ["doc_id", "sentence_idx"], "left").select("doc_id", "sentence_idx", F.sha2("sentence_text", 256).alias("text_hash"), "word_count", r6("position_weight"), (F.coalesce("n_supporting", F.lit(0)) > 0).alias("is_supported"), "is_artifact", F.coalesce("n_supporting", F.lit(0)).alias("n_supporting_sources"))


def flat_citations(spark, sf_dir):
    from citelab.functions import urls

    pages = D.table(spark, sf_dir, "pages").select("page_id", "url")
    c = D.citations(spark, sf_dir).join(pages, "page_id")
    return c.select("doc_id", "citation_position", urls.canonical(F.col("url")).alias("url_canonical"), urls.domain_of(F.col("url")).alias("domain"), "fetch_status")


def flat_scores(spark, sf_dir):
    return D.scores(spark, sf_dir).select("doc_id", "sentence_idx", "citation_position", r6("entail_score"))


def nested_round_trip(spark, sf_dir):
    """Sentences with their scores nested in one row per response, and unnested again: the rows come back."""
    s = D.scores(spark, sf_dir)
    per = s.groupBy("doc_id", "sentence_idx").agg(F.collect_list(F.struct(F.col("citation_position").alias("pos"), F.col("entail_score").alias("score"))).alias("source_scores"))
    nested = per.groupBy("doc_id").agg(F.collect_list(F.struct("sentence_idx", "source_scores")).alias("sentence_detail"))
    flat = nested.select("doc_id", F.inline("sentence_detail")).select("doc_id", "sentence_idx", F.inline("source_scores"))
    return flat.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.round(F.sum("score"), 6).alias("score_sum"))


def citation_events(spark, sf_dir):
    s = Star(spark, sf_dir)
    e = M.citation_events(s.keys, s.sents, s.cits, s.scores)
    return e.select("doc_id", "citation_position", "engine", "query_id", "run_index", "pairs_n", r6("mean_entail"), r6("supported_share"), r6("contradiction_share"), "n_cited_in_response", "is_first", "is_early3", r6("rel_position"), "fetch_ok")


def page_engine_aggregate(spark, sf_dir):
    s = Star(spark, sf_dir)
    e = M.citation_events(s.keys, s.sents, s.cits, s.scores)
    return e.groupBy("page_id", "engine").agg(F.count("*").alias("n_events"), F.count_distinct("query_id").alias("n_queries"), F.round(F.avg("citation_position"), 6).alias("mean_position"), F.round(F.avg("rel_position"), 6).alias("mean_rel_position"), F.round(F.avg("is_first"), 6).alias("first_share"), F.round(F.avg("mean_entail"), 6).alias("mean_entail"))


def first_run(spark, sf_dir):
    """Run 1 of each cell, or the first there is."""
    return first_of(D.keys(spark, sf_dir))


def first_of(k: DataFrame) -> DataFrame:
    by = W.partitionBy("engine", "query_id").orderBy(F.col("run_index") != 1, "run_index")
    return k.withColumn("n", F.row_number().over(by)).where("n = 1").select("engine", "query_id", "run_index", "doc_id")


def prominence_by_position(spark, sf_dir):
    """Share of all prominence by source position, cumulated, and where it first reaches one half."""
    s = Star(spark, sf_dir)
    per = s.keys.join(M.pawc_by_source(s.sents, s.scores), "doc_id").groupBy("engine", "citation_position").agg(F.sum("pawc").alias("p"))
    by = W.partitionBy("engine")
    per = per.withColumn("share", F.col("p") / F.sum("p").over(by))
    per = per.withColumn("cum", F.sum("share").over(by.orderBy("citation_position").rowsBetween(W.unboundedPreceding, W.currentRow)))
    half = F.min(F.when(F.col("cum") >= 0.5 - 1e-12, F.col("citation_position"))).over(by)
    return per.select("engine", "citation_position", r6("share"), r6("cum"), half.alias("half_at"))


def fetch_failures(spark, sf_dir):
    """Responses without a norm: those that cite nothing and those whose fetches all failed."""
    c = cells(Star(spark, sf_dir))
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    return c.groupBy("engine").agg(F.count("*").alias("n"), n(F.col("n_cited") == 0).alias("no_citation"), n((F.col("n_cited") > 0) & (F.col("n_fetched") == 0)).alias("all_failed"), n(F.col("pawc_norm").isNull()).alias("no_norm"), F.round(F.sum("n_fetched") / F.sum("n_cited"), 6).alias("fetch_rate"))


def artifact_rates(spark, sf_dir):
    s = D.sentences(spark, sf_dir).join(D.keys(spark, sf_dir), "doc_id")
    rate = F.avg(F.col("is_artifact").cast("double"))
    expected = 0.4
    return s.groupBy("engine").agg(F.count("*").alias("n"), F.round(rate, 6).alias("rate"), (F.abs(rate - expected) <= 0.1).alias("as_expected"))


def search_composition(spark, sf_dir):
    """How many cells had 0, 1, 2 ... repeats that cited anything: a row for every number that occurs."""
    k = D.keys(spark, sf_dir)
    cell = k.groupBy("engine", "query_id").agg(F.sum((F.col("doc_id") % 6 > 0).cast("long")).alias("searched"))
    return cell.groupBy("engine", "searched").agg(F.count("*").alias("n_cells"))


def honest_unit(spark, sf_dir):
    """Repeats are collapsed to cells before cells are averaged; the mean over responses beside it, and standard errors."""
    c = cells(Star(spark, sf_dir))
    cell = c.groupBy("engine", "query_id").agg(F.avg("cleaned_ais").alias("m"), F.sum("cleaned_ais").alias("s"), F.count("cleaned_ais").alias("n"))
    se = F.stddev_samp("m") / F.sqrt(F.count("m"))
    return cell.groupBy("engine").agg(F.round(F.avg("m"), 6).alias("macro"), F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(se, 6).alias("sem"), F.round(F.avg("m") - 1.96 * se, 6).alias("lo"), F.round(F.avg("m") + 1.96 * se, 6).alias("hi"))


def zero_filled_prominence(spark, sf_dir):
    """Responses that never searched counted as 0, and left out."""
    c = cells(Star(spark, sf_dir))
    return c.groupBy("engine").agg(F.round(F.avg(F.coalesce("pawc_norm", F.lit(0.0))), 6).alias("unconditional"), F.round(F.avg("pawc_norm"), 6).alias("conditional"), F.round(F.avg(F.when(F.col("n_cited") > 0, F.col("cleaned_ais"))), 6).alias("ais_if_cited"))


def expected_cells(spark, sf_dir):
    """Cells with fewer repeats than the most that any has, by engine."""
    k = D.keys(spark, sf_dir).groupBy("engine", "query_id").agg(F.count("*").alias("n"))
    most = F.max("n").over(W.partitionBy("engine"))
    return k.withColumn("most", most).groupBy("engine").agg(F.count("*").alias("n_cells"), F.sum((F.col("n") < F.col("most")).cast("long")).alias("incomplete"), F.sum(F.col("most") - F.col("n")).alias("missing"))


def source_tokens(spark, sf_dir):
    """Share of the distinct fetched sources of more than 40 words, and their median length."""
    from citelab.functions import text

    ok = D.citations(spark, sf_dir).where("fetch_status = 'ok'").select("item_id").distinct()
    n = D.table(spark, sf_dir, "benchmark").join(ok, "item_id").select(text.word_count(F.col("text")).alias("n"))
    return n.agg(F.count("*").alias("n_sources"), F.round(F.avg((F.col("n") > 40).cast("double")), 6).alias("long_share"), F.median("n").alias("median_words"))


def best_window(spark, sf_dir):
    """Of the overlapping windows of a text, the one that shares most tokens with the opening sentence."""
    from citelab.functions import text

    d = D.table(spark, sf_dir, "documents").where("text is not null")
    first = F.element_at(text.sentences(F.col("text")), 1)
    d = d.select("doc_id", text.tokens(F.coalesce(F.try_element_at(text.sentences(F.col("text")), F.lit(1)), F.lit(""))).alias("q"), F.posexplode(text.windows(F.col("text"))).alias("i", "w"))
    d = d.select("doc_id", F.col("i").cast("long").alias("i"), text.overlap(F.col("q"), text.tokens(F.col("w"))).alias("n"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.max("n").alias("best"), F.max_by("i", F.struct("n", -F.col("i"))).alias("best_window"))


from citelab.plans.features import QUERIES as FEATURES  # noqa: E402

S, C = with_sql, CELL
QUERIES = {
    "ais_pawc_by_engine": (ais_pawc_by_engine, C + "SELECT engine, count(*) AS n_responses, round(avg(cleaned_ais), 6) AS mean_ais, round(avg(pawc_norm), 6) AS mean_pawc_norm, round(avg(coverage), 6) AS mean_coverage FROM cell GROUP BY engine"),
    "raw_cell_metrics": (raw_cell_metrics, S("sent cit score", "sup AS (SELECT doc_id, sentence_idx, sum(CASE WHEN entail_score >= 0.5 THEN 1 ELSE 0 END) AS n FROM score GROUP BY ALL)", "a AS (SELECT sent.doc_id, count(*) AS ns, sum(CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END) AS sp, sum(coalesce(n, 0) * word_count * position_weight) AS p FROM sent LEFT JOIN sup ON sent.doc_id = sup.doc_id AND sent.sentence_idx = sup.sentence_idx GROUP BY sent.doc_id)") + "SELECT d.doc_id, coalesce(ns, 0) AS n_sentences, CAST(coalesce(sp, 0) AS BIGINT) AS n_supported, round(sp / ns, 6) AS ais_rate, round(coalesce(p, 0.0), 6) AS pawc_total FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"),
    "cleaned_cell_metrics": (cleaned_cell_metrics, C + "SELECT doc_id, engine, query_id, run_index, n_sentences, CAST(n_artifacts AS BIGINT) AS n_artifacts, cleaned_n, n_cited, CAST(n_fetched AS BIGINT) AS n_fetched, round(cleaned_ais, 6) AS cleaned_ais, round(cleaned_pawc_total, 6) AS cleaned_pawc_total, round(omega, 6) AS omega, round(coverage, 6) AS coverage, round(pawc_norm, 6) AS pawc_norm FROM cell"),
    "pawc_by_source": (pawc_by_source, C + "SELECT score.doc_id, citation_position, round(sum(word_count * ((n_star - k + 1) / n_star)), 6) AS pawc FROM score JOIN surv ON score.doc_id = surv.doc_id AND score.sentence_idx = surv.sentence_idx WHERE entail_score >= 0.5 GROUP BY ALL"),
    "pawc_map_export": (pawc_map_export, C.rstrip() + """, per AS (SELECT score.doc_id, citation_position AS c, round(sum(word_count * ((n_star - k + 1) / n_star)), 4) AS p FROM score JOIN surv ON score.doc_id = surv.doc_id AND score.sentence_idx = surv.sentence_idx WHERE entail_score >= 0.5 GROUP BY ALL)
SELECT doc_id, count(*) AS n_sources, '{' || string_agg('"' || c || '":' || CAST(p AS VARCHAR), ',' ORDER BY c) || '}' AS pawc_json FROM per GROUP BY doc_id"""),
    "tau_sweep": (tau_sweep, TAU_SQL + "SELECT engine, CAST(tau AS DOUBLE) AS tau, round(avg(cleaned_ais), 6) AS mean_ais, round(avg(pawc_norm), 6) AS mean_pawc_norm, count(pawc_norm) AS n_norm FROM tau_rows GROUP BY ALL"),
    "tau_ranking": (tau_ranking, TAU_SQL.rstrip() + ", m AS (SELECT engine, CAST(tau AS DOUBLE) AS tau, round(avg(cleaned_ais), 6) AS m FROM tau_rows GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY tau ORDER BY m DESC) + (count(*) OVER (PARTITION BY tau, m) - 1) / 2 AS rk FROM m) SELECT tau, string_agg(engine, ' > ' ORDER BY m DESC, engine) AS ranking, sum(rk) AS rank_sum FROM r GROUP BY tau"),
    "norm_variants": (norm_variants, C.rstrip() + """, raw AS (SELECT sent.doc_id, sum(coalesce(n, 0) * word_count * position_weight) AS p, sum(word_count * position_weight) AS o FROM sent LEFT JOIN sup ON sent.doc_id = sup.doc_id AND sent.sentence_idx = sup.sentence_idx GROUP BY sent.doc_id),
v AS (SELECT cell.*, coalesce(p, 0.0) AS p, coalesce(o, 0.0) AS o FROM cell LEFT JOIN raw ON cell.doc_id = raw.doc_id)
SELECT doc_id, round(CASE WHEN n_fetched > 0 AND o > 0 THEN p / (n_fetched * o) END, 6) AS literal_norm, round(CASE WHEN n_cited > 0 AND o > 0 THEN p / (n_cited * o) END, 6) AS alternative_norm, round(pawc_norm, 6) AS pawc_norm,
  round((n_cited - n_fetched) * omega + 0.0, 6) AS part_sources, round(n_fetched * (o - omega) + 0.0, 6) AS part_mass, round((n_cited - n_fetched) * (o - omega) + 0.0, 6) AS part_both, round(n_cited * o - n_fetched * omega + 0.0, 6) AS difference FROM v"""),
    "entailment_bands": (entailment_bands, S("resp sent cit score") + "SELECT engine, count(*) AS n_pairs, round(avg(CASE WHEN entail_score < 0.3 THEN 1.0 ELSE 0.0 END), 6) AS contradiction, round(avg(CASE WHEN entail_score >= 0.3 AND entail_score < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS neutral, round(avg(CASE WHEN entail_score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS supported, round(avg(CASE WHEN entail_score >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS strong FROM score JOIN sent ON score.doc_id = sent.doc_id AND score.sentence_idx = sent.sentence_idx JOIN resp ON resp.doc_id = score.doc_id WHERE NOT is_artifact GROUP BY engine"),
    "entailment_band_counts": (entailment_band_counts, S("sent cit score") + "SELECT CASE WHEN entail_score < 0.3 THEN 'low' WHEN entail_score < 0.5 THEN 'middle' WHEN entail_score < 0.7 THEN 'high' ELSE 'top' END AS band, count(*) AS n FROM score GROUP BY ALL"),
    "cell_aggregates": (cell_aggregates, MART + "SELECT engine, query_id, round(pawc_mean, 6) AS pawc_mean, round(pawc_sd, 6) AS pawc_sd, round(pawc_cv, 6) AS pawc_cv, round(ais_mean, 6) AS ais_mean, round(ais_sd, 6) AS ais_sd, round(ais_cv, 6) AS ais_cv, round(pawc_norm_mean, 6) AS pawc_norm_mean, round(pawc_norm_sd, 6) AS pawc_norm_sd, round(pawc_norm_cv, 6) AS pawc_norm_cv, n_runs, n_runs_ais, round(did_search_rate, 6) AS did_search_rate, citations_consistent, round(n_cited_mean, 6) AS n_cited_mean FROM mart"),
    "cv_stability": (cv_stability, MART + "SELECT engine, CASE WHEN pawc_cv IS NULL THEN 'undefined' WHEN pawc_cv < 0.5 THEN 'stable' ELSE 'unstable' END AS cv_band, CASE WHEN did_search_rate <= 0.25 THEN 'low' WHEN did_search_rate <= 0.75 THEN 'middle' ELSE 'high' END AS search_band, count(*) AS n_cells, round(avg(CASE WHEN abs(pawc_cv - sqrt(n_runs)) < 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS at_ceiling, round(avg(CASE WHEN coalesce(pawc_mean, 0.0) = 0 THEN 1.0 ELSE 0.0 END), 6) AS no_prominence FROM mart GROUP BY ALL"),
    "score_histogram": (score_histogram, S("sent cit score") + "SELECT CAST(least(floor(entail_score * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM score GROUP BY ALL"),
    "score_quantiles": (score_quantiles, S("resp sent cit score") + "SELECT engine, " + ", ".join(f"round(quantile_cont(entail_score, {p}), 6) AS p{int(p * 100)}" for p in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) + " FROM score JOIN resp ON resp.doc_id = score.doc_id GROUP BY engine"),
    "flat_responses": (flat_responses, C + "SELECT engine || '__' || query_id || '__r' || run_index AS response_id, query_id, engine, run_index, n_sentences, CAST(n_artifacts AS BIGINT) AS n_artifacts, cleaned_n, n_cited AS n_sources_cited, CAST(n_fetched AS BIGINT) AS n_sources_fetched_ok FROM cell"),
    "flat_sentences": (flat_sentences, C + "SELECT sent.doc_id, sent.sentence_idx, sha256(sentence_text) AS text_hash, word_count, round(position_weight, 6) AS position_weight, coalesce(n, 0) > 0 AS is_supported, is_artifact, CAST(coalesce(n, 0) AS BIGINT) AS n_supporting_sources FROM sent LEFT JOIN sup ON sent.doc_id = sup.doc_id AND sent.sentence_idx = sup.sentence_idx"),
    "flat_citations": (flat_citations, S("cit", FEATURES["canonical_urls"][1].strip().removeprefix("WITH ").rpartition("\nSELECT page_id")[0]) + "SELECT doc_id, citation_position, u AS url_canonical, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS domain, fetch_status FROM cit JOIN c ON c.page_id = cit.page_id"),
    "flat_scores": (flat_scores, S("sent cit score") + "SELECT doc_id, sentence_idx, citation_position, round(entail_score, 6) AS entail_score FROM score"),
    "nested_round_trip": (nested_round_trip, S("sent cit score") + "SELECT doc_id, count(*) AS n_pairs, round(sum(entail_score), 6) AS score_sum FROM score GROUP BY doc_id"),
    "citation_events": (citation_events, S("resp sent cit score", "per AS (SELECT score.doc_id, citation_position, count(*) AS pairs_n, avg(entail_score) AS mean_entail, avg(CASE WHEN entail_score >= 0.5 THEN 1.0 ELSE 0.0 END) AS supported_share, avg(CASE WHEN entail_score < 0.3 THEN 1.0 ELSE 0.0 END) AS contradiction_share FROM score JOIN sent ON score.doc_id = sent.doc_id AND score.sentence_idx = sent.sentence_idx WHERE NOT is_artifact GROUP BY ALL)", "c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM cit)") + "SELECT c.doc_id, c.citation_position, engine, query_id, run_index, pairs_n, round(mean_entail, 6) AS mean_entail, round(supported_share, 6) AS supported_share, round(contradiction_share, 6) AS contradiction_share, n AS n_cited_in_response, CAST(c.citation_position = 1 AS BIGINT) AS is_first, CAST(c.citation_position <= 3 AS BIGINT) AS is_early3, round((c.citation_position - 1) / greatest(n - 1, 1), 6) AS rel_position, CAST(fetch_status = 'ok' AS BIGINT) AS fetch_ok FROM c JOIN resp ON resp.doc_id = c.doc_id LEFT JOIN per ON per.doc_id = c.doc_id AND per.citation_position = c.citation_position"),
    "page_engine_aggregate": (page_engine_aggregate, S("resp sent cit score", "per AS (SELECT score.doc_id, citation_position, avg(entail_score) AS mean_entail FROM score JOIN sent ON score.doc_id = sent.doc_id AND score.sentence_idx = sent.sentence_idx WHERE NOT is_artifact GROUP BY ALL)", "c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM cit)") + "SELECT page_id, engine, count(*) AS n_events, count(DISTINCT query_id) AS n_queries, round(avg(c.citation_position), 6) AS mean_position, round(avg((c.citation_position - 1) / greatest(n - 1, 1)), 6) AS mean_rel_position, round(avg(CASE WHEN c.citation_position = 1 THEN 1.0 ELSE 0.0 END), 6) AS first_share, round(avg(mean_entail), 6) AS mean_entail FROM c JOIN resp ON resp.doc_id = c.doc_id LEFT JOIN per ON per.doc_id = c.doc_id AND per.citation_position = c.citation_position GROUP BY ALL"),
    "first_run": (first_run, S("resp") + "SELECT engine, query_id, run_index, doc_id FROM resp QUALIFY row_number() OVER (PARTITION BY engine, query_id ORDER BY run_index <> 1, run_index) = 1"),
    "prominence_by_position": (prominence_by_position, C.rstrip() + ", per AS (SELECT engine, citation_position, sum(word_count * ((n_star - k + 1) / n_star)) AS p FROM score JOIN surv ON score.doc_id = surv.doc_id AND score.sentence_idx = surv.sentence_idx JOIN resp ON resp.doc_id = score.doc_id WHERE entail_score >= 0.5 GROUP BY ALL), sh AS (SELECT *, p / sum(p) OVER (PARTITION BY engine) AS share FROM per), cu AS (SELECT *, sum(share) OVER (PARTITION BY engine ORDER BY citation_position) AS cum FROM sh) SELECT engine, citation_position, round(share, 6) AS share, round(cum, 6) AS cum, min(CASE WHEN cum >= 0.5 - 1e-12 THEN citation_position END) OVER (PARTITION BY engine) AS half_at FROM cu"),
    "fetch_failures": (fetch_failures, C + "SELECT engine, count(*) AS n, CAST(sum(CASE WHEN n_cited = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_citation, CAST(sum(CASE WHEN n_cited > 0 AND n_fetched = 0 THEN 1 ELSE 0 END) AS BIGINT) AS all_failed, CAST(sum(CASE WHEN pawc_norm IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_norm, round(sum(n_fetched) / sum(n_cited), 6) AS fetch_rate FROM cell GROUP BY engine"),
    "artifact_rates": (artifact_rates, S("resp sent") + "SELECT engine, count(*) AS n, round(avg(CASE WHEN is_artifact THEN 1.0 ELSE 0.0 END), 6) AS rate, abs(avg(CASE WHEN is_artifact THEN 1.0 ELSE 0.0 END) - 0.4) <= 0.1 AS as_expected FROM sent JOIN resp ON sent.doc_id = resp.doc_id GROUP BY engine"),
    "search_composition": (search_composition, S("resp") + "SELECT engine, CAST(s AS BIGINT) AS searched, count(*) AS n_cells FROM (SELECT engine, query_id, sum(CASE WHEN doc_id % 6 > 0 THEN 1 ELSE 0 END) AS s FROM resp GROUP BY ALL) GROUP BY ALL"),
    "honest_unit": (honest_unit, C.rstrip() + ", q AS (SELECT engine, query_id, avg(cleaned_ais) AS m, sum(cleaned_ais) AS s, count(cleaned_ais) AS n FROM cell GROUP BY ALL) SELECT engine, round(avg(m), 6) AS macro, round(sum(s) / sum(n), 6) AS micro, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem, round(avg(m) - 1.96 * (stddev_samp(m) / sqrt(count(m))), 6) AS lo, round(avg(m) + 1.96 * (stddev_samp(m) / sqrt(count(m))), 6) AS hi FROM q GROUP BY engine"),
    "zero_filled_prominence": (zero_filled_prominence, C + "SELECT engine, round(avg(coalesce(pawc_norm, 0.0)), 6) AS unconditional, round(avg(pawc_norm), 6) AS conditional, round(avg(CASE WHEN n_cited > 0 THEN cleaned_ais END), 6) AS ais_if_cited FROM cell GROUP BY engine"),
    "expected_cells": (expected_cells, S("resp") + "SELECT engine, count(*) AS n_cells, CAST(sum(CASE WHEN n < most THEN 1 ELSE 0 END) AS BIGINT) AS incomplete, CAST(sum(most - n) AS BIGINT) AS missing FROM (SELECT *, max(n) OVER (PARTITION BY engine) AS most FROM (SELECT engine, query_id, count(*) AS n FROM resp GROUP BY ALL)) GROUP BY engine"),
    "source_tokens": (source_tokens, S("cit") + r"SELECT count(*) AS n_sources, round(avg(CASE WHEN n > 40 THEN 1.0 ELSE 0.0 END), 6) AS long_share, median(n) AS median_words FROM (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM benchmark WHERE item_id IN (SELECT item_id FROM cit WHERE fetch_status = 'ok'))"),
    "best_window": (best_window, r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, coalesce(list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\S'))[1], '') AS s FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, w, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')) AS q, unnest(range(0, CAST(floor(greatest(len(w) - 200 + 149, 0) / 150) AS BIGINT) + 1)) AS i FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, i, len(list_intersect(q, list_distinct(regexp_extract_all(lower(array_to_string(w[i * 150 + 1:i * 150 + 200], ' ')), '[a-z0-9]+')))) AS n FROM e)
SELECT doc_id, count(*) AS n_windows, max(n) AS best, arg_max(i, n * 100000 - i) AS best_window FROM n GROUP BY doc_id"""),
}
