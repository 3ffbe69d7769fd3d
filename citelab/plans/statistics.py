"""Queries with models, resampling, checks, adapters and incremental operators."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab import lineage
from citelab.functions import text
from citelab.operators import metrics as M
from citelab.operators import quality as Q
from citelab.operators import regression, resampling
from citelab.plans.core import CELL, TAU_SQL, Star, cells
from citelab.sources import adapters, bronze, fetch, registry, requests, silver
from citelab.sources import driver_tables as D
from citelab.sources.driver_tables import table
from citelab.streaming import incremental


def _model_frame(spark, sf_dir):
    """One row per labelled document: four outcomes, features of its lines, how much it cites (centred), its kind of citation."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    f = {"log_words": F.log1p(text.word_count(F.col("text"))), **{k: v for k, v in text.line_features(F.col("text")).items() if k in ("short_line_share", "newlines_per_100w", "bullet_line_share")}}
    cites = (F.col("doc_id") % 6).cast("double")
    rows = d.select("doc_id", "quality", "toxic", "lang", "source", F.log1p(F.col("n_chars")).alias("log_chars"), F.log1p(cites).alias("log_n_cited"), F.element_at(F.array(F.lit("none"), F.lit("few"), F.lit("many")), (F.least(cites / 2, F.lit(2)) + 1).cast("int")).alias("tier"), *[c.cast("double").alias(n) for n, c in f.items()])
    return regression.centred(lineage.cut(rows), "log_n_cited", "lang")


FIT = "outcome string, engine string, feature string, beta double, se double, z double, p double, n long, groups long"
OUTCOMES = (regression.Model("quality", "logit"), regression.Model("toxic", "logit"), regression.Model("log_words", "ols"), regression.Model("log_chars", "ols"))


def clustered_models(spark, sf_dir):
    """Four outcomes for every engine (a language; rows without one belong to none), errors clustered by source, and q values
    within each model. Features of lines, the centred number of citations, and its tier as dummies.
    A fit that isn't defined (no more rows than columns, one cluster, an outcome that doesn't vary) gives rows of nulls;
    if no feature varies either, one row without a feature."""
    from citelab.operators.relational import benjamini_hochberg

    df, dummies = regression.with_dummies(_model_frame(spark, sf_dir), ["tier"])
    own = ["log_words", "short_line_share", "newlines_per_100w", "bullet_line_share"]
    features = [*own, "log_n_cited", *dummies]
    out = []
    for (engine, outcome), fit in sorted(regression.fit_groups(df, "lang", features, OUTCOMES, "source").items()):
        rows = fit.rows()
        if not np.isfinite([r[2] for r in rows]).all():
            rows = [(n, None, None, None, None, *r[5:]) for n, r in zip(fit.names if len(fit.names) > 1 else [None], rows)]
        out += [(outcome, engine, *(r if len(rows) > 1 or r[0] is None else (None, None, None, None, None, *r[5:]))) for r in rows]
    fits = spark.createDataFrame(out, FIT)
    # the family of a model's q values is its features; its controls have none
    family = F.col("feature").isin(own)
    q = benjamini_hochberg(fits.where(family), "p", ["outcome", "engine"]).withColumn("q", F.when(F.col("p").isNotNull(), F.col("q")))
    q = q.unionByName(fits.where("feature <> 'const' or feature is null").where(~F.coalesce(family, F.lit(False))).withColumn("q", F.lit(None).cast("double")))
    return q.select("outcome", "engine", "feature", *[F.round(c, 6).alias(c) for c in ("beta", "se", "z", "p", "q")], "n", "groups")


def simple_regression(spark, sf_dir):
    """One feature: the slope and intercept that SQL has functions for."""
    x, names = regression.design(table(spark, sf_dir, "part"), ["p_size"])
    fit = regression.ols(x, names, "p_retailprice", "p_brand")
    return spark.createDataFrame([(round(float(fit.beta[1]), 6), round(float(fit.beta[0]), 4), fit.n, fit.groups)], "slope double, intercept double, n long, groups long")


def repeat_se(spark, sf_dir):
    c = cells(Star(spark, sf_dir)).where("cleaned_ais is not null")
    s = resampling.analytic_se(c, ["engine", "query_id"], "cleaned_ais")
    return s.select("engine", "query_id", "k", F.round("se", 6).alias("se"), F.round("relative_se", 6).alias("relative_se"))


def repeat_first_stable(spark, sf_dir):
    c = cells(Star(spark, sf_dir)).where("cleaned_ais is not null")
    s = resampling.analytic_se(c, ["engine", "query_id"], "cleaned_ais", (1, 2, 3, 4, 5, 10, 20, 40))
    return resampling.first_stable(s, ["engine", "query_id"])


def repeat_bootstrap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", F.col("n_chars").cast("double").alias("v"))
    return resampling.bootstrap_se(d, ["lang", "source"], "v").select("lang", "source", "k", F.round("se", 6).alias("se"))


def quality_checklist(spark, sf_dir):
    """Checks of the star schema; some of them count what real tables have of what they look for."""
    s = Star(spark, sf_dir)
    c = cells(s)
    docs = table(spark, sf_dir, "documents")
    relabelled = docs.select(F.when(F.col("source").isNull(), "none").otherwise(F.col("source")).alias("source"))
    profile = F.when(F.col("run_index") > 8, "long").otherwise("scaleup").alias("run_profile")
    stored = s.sents.groupBy("doc_id").agg(F.count("*").alias("n"))
    cut = lambda t: F.size(F.filter(F.split(F.regexp_replace(t, r"(?U)\s+", " "), r"(?<=[.!?]) "), lambda x: F.trim(x) != ""))
    again = docs.select("doc_id", F.coalesce(cut(F.col("text")), F.lit(0)).alias("m")).join(stored, "doc_id", "full")
    folder = f"{lineage.shared_folder(spark)}/citelab-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    Q.freeze(rows.union(rows), folder)  # every row twice
    swapped = rows.union(rows.withColumn("role", F.when(F.col("role") == "user", "assistant").otherwise(F.col("role"))))
    return Q.checklist([
        Q.unique(s.keys, "response keys", ["engine", "query_id", "run_index"]),
        Q.unique(s.scores, "score keys", ["doc_id", "sentence_idx", "citation_position"]),
        Q.unique(docs, "texts", ["text"]),
        Q.conditions(c, {"ais bounds": Q.outside("cleaned_ais"), "norm bounds": Q.outside("pawc_norm"), "prominence bounds": Q.outside("cleaned_pawc_total"), "sentences add up": F.col("n_artifacts") + F.col("cleaned_n") != F.col("n_sentences")}),
        Q.conditions(s.keys, {"engines": Q.unknown("engine", ["en", "de", "fr", "es"]), "two engines": Q.unknown("engine", ["en", "de"])}),
        Q.exclusive(s.keys, "one query a response", "doc_id", "query_id"),
        Q.exclusive(s.keys, "one engine a query", "query_id", "engine"),
        Q.count_where(again, "segments counted again", ~F.coalesce("n", F.lit(0)).eqNullSafe(F.col("m"))),
        Q.same_counts(docs, relabelled, "sources kept", "source"),
        Q.same_counts(s.keys, docs.where("doc_id % 2 = 0").select(F.col("lang").alias("engine")), "engines kept", "engine"),
        Q.one_value(s.keys.select(profile), "one profile", "run_profile"),
        Q.non_increasing(M.tau_sweep(s.keys, s.sents, s.cits, s.scores), "ais falls with tau", "doc_id", "tau", "cleaned_ais"),
        Q.at_threshold(s.scores, "scores at the threshold", "entail_score", 0.5),
        Q.schema_equals(spark, docs, "schema as declared", T.StructType.fromDDL(DECLARED)),
        Q.schema_equals(spark, docs.select("text", "doc_id", F.col("n_chars").cast("int").alias("n_chars")), "schema of a draft", T.StructType.fromDDL(DECLARED)),
        Q.dropped_citations(docs.select(F.when(F.col("doc_id") % 4 == 0, "an url_citation").otherwise("none").alias("raw"), (F.col("doc_id") % 6).alias("found")), "dropped citations", "raw", "found"),
        Q.frozen(spark, folder, "frozen table kept"),
        Q.frozen(spark, folder, "frozen table with rows exchanged", swapped),
        Q.count_where(registry.registry(docs, "text", lambda t: F.substring(F.sha2(text.strip(t), 256), 1, 3)), "ids of several texts", F.col("n_texts") > 1),
    ])


#: What documents is declared to be.
DECLARED = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_DUCK = {"bigint": "BIGINT", "string": "VARCHAR"}


def _described(relation: str) -> str:
    """Differences of a relation's columns from the declared ones, as DuckDB describes it."""
    want = ", ".join(f"({i}, '{n}', '{_DUCK[t]}')" for i, (n, t) in enumerate((c.split() for c in DECLARED.split(", ")), 1))
    return f"SELECT count(*) FROM (SELECT row_number() OVER () AS i, column_name, column_type FROM (DESCRIBE {relation})) a FULL JOIN (VALUES {want}) AS b(j, n, t) ON i = j WHERE i IS NULL OR j IS NULL OR column_name <> n OR column_type <> t"


def _print_sql(relation: str) -> str:
    digits = lambda at, m: f"CAST(sum(CAST('0x' || substr(h, {at}, 15) AS BIGINT) % {m}) % {m} AS BIGINT)"
    return f"SELECT count(*) AS r, {digits(1, Q.MODULI[0])} AS f, {digits(17, Q.MODULI[1])} AS s FROM (SELECT md5(concat_ws('|', coalesce('=' || conv_id, '-'), coalesce('=' || turn, '-'), coalesce('=' || role, '-'))) AS h FROM ({relation}))"


def _differing(other: str) -> str:
    """How many of a fingerprint's numbers another half makes differ, when the first half of the rows is the table itself."""
    own = "SELECT conv_id, turn, role FROM conversations"
    return f"SELECT CAST(a.r <> b.r AS INT) + CAST(a.f <> b.f AS INT) + CAST(a.s <> b.s AS INT) FROM ({_print_sql(f'{own} UNION ALL {own}')}) a, ({_print_sql(f'SELECT * FROM ({other}) UNION ALL {own}')}) b"


_CHECKS = [
    ("response keys", "SELECT count(*) - count(DISTINCT (engine, query_id, run_index)) FROM resp"),
    ("score keys", "SELECT count(*) - count(DISTINCT (doc_id, sentence_idx, citation_position)) FROM score"),
    ("texts", "SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM documents GROUP BY text)"),
    ("ais bounds", "SELECT count(*) FROM cell WHERE cleaned_ais < -1e-9 OR cleaned_ais > 1 + 1e-9"),
    ("norm bounds", "SELECT count(*) FROM cell WHERE pawc_norm < -1e-9 OR pawc_norm > 1 + 1e-9"),
    ("prominence bounds", "SELECT count(*) FROM cell WHERE cleaned_pawc_total < -1e-9 OR cleaned_pawc_total > 1 + 1e-9"),
    ("engines", "SELECT count(*) FROM resp WHERE engine IS NOT NULL AND engine NOT IN ('en', 'de', 'fr', 'es')"),
    ("two engines", "SELECT count(*) FROM resp WHERE engine IS NOT NULL AND engine NOT IN ('en', 'de')"),
    ("one query a response", "SELECT count(*) FROM (SELECT doc_id FROM resp GROUP BY doc_id HAVING count(DISTINCT query_id) > 1)"),
    ("one engine a query", "SELECT count(*) FROM (SELECT query_id FROM resp GROUP BY query_id HAVING count(DISTINCT engine) > 1)"),
    ("sentences add up", "SELECT count(*) FROM cell WHERE n_artifacts + cleaned_n <> n_sentences"),
    ("segments counted again", r"SELECT count(*) FROM (SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS m FROM documents) a FULL JOIN (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id) b ON a.doc_id = b.doc_id WHERE coalesce(n, 0) <> m"),
    ("sources kept", "SELECT count(*) FROM (SELECT source, count(*) AS x FROM documents GROUP BY source) a FULL JOIN (SELECT coalesce(source, 'none') AS source, count(*) AS y FROM documents GROUP BY ALL) b ON a.source IS NOT DISTINCT FROM b.source WHERE x IS DISTINCT FROM y"),
    ("engines kept", "SELECT count(*) FROM (SELECT engine, count(*) AS x FROM resp GROUP BY engine) a FULL JOIN (SELECT lang AS engine, count(*) AS y FROM documents WHERE doc_id % 2 = 0 GROUP BY lang) b ON a.engine IS NOT DISTINCT FROM b.engine WHERE x IS DISTINCT FROM y"),
    ("one profile", "SELECT greatest(count(DISTINCT CASE WHEN run_index > 8 THEN 'long' ELSE 'scaleup' END) - 1, 0) FROM resp"),
    ("ais falls with tau", "SELECT count(*) FROM (SELECT coalesce(cleaned_ais, 0) AS a, lag(coalesce(cleaned_ais, 0)) OVER (PARTITION BY doc_id ORDER BY tau) AS b FROM aggt) WHERE a > b + 1e-9"),
    ("scores at the threshold", "SELECT count(*) FROM score WHERE abs(entail_score - 0.5) < 1e-12"),
    ("schema as declared", _described("documents")),
    ("schema of a draft", _described("SELECT text, doc_id, CAST(n_chars AS INTEGER) AS n_chars FROM documents")),
    ("dropped citations", "SELECT count(*) FROM documents WHERE doc_id % 4 = 0 AND doc_id % 6 = 0"),
    ("frozen table kept", _differing("SELECT conv_id, turn, role FROM conversations ORDER BY turn, role, conv_id")),
    ("frozen table with rows exchanged", _differing("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'assistant' ELSE role END AS role FROM conversations")),
    ("ids of several texts", r"SELECT count(*) FROM (SELECT substr(sha256(t), 1, 3) AS k FROM (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE regexp_matches(text, '\S')) GROUP BY k HAVING count(DISTINCT t) > 1)"),
]
CHECKS_SQL = CELL.rstrip() + ",\n" + TAU_SQL[TAU_SQL.index("taus(tau)") : TAU_SQL.index(",\nfet AS")] + "\n" + " UNION ALL ".join(f"SELECT '{name}' AS \"check\", n = 0 AS passed, CAST(n AS BIGINT) AS detail FROM (SELECT coalesce(({sql}), 0) AS n)" for name, sql in _CHECKS)


def threshold_ties(spark, sf_dir):
    """Scores that are exactly the threshold, by engine."""
    s = D.scores(spark, sf_dir).join(D.keys(spark, sf_dir), "doc_id")
    return s.groupBy("engine").agg(F.sum((F.abs(F.col("entail_score") - 0.5) < 1e-12).cast("long")).alias("ties"), F.count("*").alias("n"))


def _captures(spark, sf_dir):
    """Raw captures in every engine's form, made from the citations of each document."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    c = D.citations(spark, sf_dir).join(pages, "page_id")
    per = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("citation_position", "url"))).alias("c"))
    per = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer_text")).join(per, "doc_id", "left")
    url = F.coalesce(F.transform("c", lambda x: x["url"]), F.array().cast("array<string>"))
    lit = F.lit
    as_struct = lambda kind: F.transform(url, lambda u: F.struct(lit(kind).alias("type"), u.alias("url"), lit("t").alias("title")))
    chunks = F.transform(url, lambda u: F.struct(F.struct(u.alias("uri"), lit("site.com").alias("title")).alias("web")))
    forms = {
        "chatgpt": F.to_json(F.struct(F.array(F.struct(lit("message").alias("type"), F.array(F.struct(lit("output_text").alias("type"), lit("x").alias("text"), as_struct("url_citation").alias("annotations"))).alias("content"))).alias("output"))),
        "claude": F.to_json(F.struct(F.array(F.struct(lit("text").alias("type"), lit("x").alias("text"), as_struct("web_search_result_location").alias("citations"))).alias("content"))),
        "gemini": F.when(F.col("doc_id") % 12 < 6, F.to_json(F.struct(F.array(F.struct(F.struct(chunks.alias("groundingChunks")).alias("groundingMetadata"))).alias("candidates")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(chunks.alias("grounding_chunks")).alias("grounding_metadata"))).alias("candidates")))),
        "perplexity": F.when(F.col("doc_id") % 12 < 6, F.to_json(F.struct(url.alias("citations")))).otherwise(F.to_json(F.struct(F.transform(url, lambda u: F.struct(u.alias("url"), lit("t").alias("title"))).alias("search_results")))),
        "mistral": F.to_json(F.struct(F.array(F.struct(lit("message.output").alias("type"), as_struct("tool_reference").alias("content"))).alias("outputs"))),
        "kimi": lit("{}"),
    }
    names = list(forms)
    engine = F.element_at(F.array(*[lit(n) for n in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    raw = lit(None).cast("string")
    for n, f in forms.items():
        raw = F.when(F.col("engine") == n, f).otherwise(raw)
    rows = per.withColumn("engine", engine)
    answer = F.when(F.col("engine") == "kimi", F.concat(lit("Sources:\n"), F.array_join(F.transform(url, lambda u: F.concat(u, lit(")."))), "\n"))).otherwise("x")
    return rows.select(F.col("doc_id").cast("string").alias("query_id"), "engine", lit(1).cast("long").alias("run_index"), lit("").alias("model_served"), lit("").alias("timestamp_utc"), answer.alias("answer_text"), raw.alias("raw_response"), lit("scaleup").alias("run_profile"), F.concat(lit('{"prompt_tokens": '), F.col("doc_id").cast("string"), lit(', "output_tokens": 7}')).alias("usage"))


def captures_from_files(spark, sf_dir):
    """Captures written as JSON files and read again, with a file that isn't JSON, answers that aren't, and an engine that nobody
    knows: every record comes out once, as good or with what is wrong with it."""
    c = _captures(spark, sf_dir)
    n = F.col("query_id").cast("long") % 10
    c = c.withColumns({"engine": F.when(n == 5, "nobody").otherwise(F.col("engine")), "raw_response": F.when(n == 3, "{").otherwise(F.col("raw_response"))})
    path = f"{lineage.shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    # files of an array of 200 captures each, and a broken one
    files = c.groupBy(F.floor(F.col("query_id").cast("long") / 200).alias("part")).agg(F.to_json(F.collect_list(F.struct(*c.columns))).alias("value"))
    broken = spark.range(1).select(F.lit(-1).cast("long").alias("part"), F.lit('[{"query_id": ').alias("value"))
    files.unionByName(broken).repartition("part").write.partitionBy("part").text(path)
    good, bad = bronze.reconstruct(bronze.read(spark, path))
    canonical, failed = adapters.normalise(good)
    of = lambda df, status, engine: df.groupBy(status.alias("status"), engine.alias("engine")).agg(F.count("*").alias("n"))
    return of(canonical, F.lit("good"), F.col("engine")).unionByName(of(failed, F.col("reason"), F.col("engine"))).unionByName(of(bad, F.lit("not JSON"), F.lit("")))


def request_bodies(spark, sf_dir):
    """What each engine is asked, and the forced variant of one."""
    models = {name: f"{name}-1" for name in requests.BUILDERS} | {"chatgpt_forced": "chatgpt-1"}
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("question "), F.col("item_id").cast("string")).alias("question"), F.explode(F.array(*[F.lit(m) for m in models])).alias("engine"))
    return requests.bodies(q, models).select("item_id", "engine", "model_requested", "body")


def utc_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", requests.utc_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


def paced_calls(spark, sf_dir):
    """The delay that each user's calls have come to: longer after errors, shorter after clean windows."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("engine"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return incremental.final_delays(e, 0.5, 30.0).select("engine", "calls", F.round("delay", 9).alias("delay"))


def paced_stream(spark, sf_dir):
    """Pacing and breakers of the same calls as a stream in two batches, a state for each user kept between them."""
    e = table(spark, sf_dir, "events")
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    calls = e.select(F.col("user_id").cast("string").alias("engine"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "error").alias("signature"), (F.col("event_id") > half).cast("int").alias("part"))
    folder = f"{lineage.shared_folder(spark)}/citelab-{uuid.uuid4().hex}"
    got = incremental.watched(calls, "part", folder, limit=3)
    return got.select(F.col("engine").cast("long").alias("engine"), "calls", "failures", F.round("delay", 9).alias("delay"), "tripped_at")


def profiles(spark, sf_dir):
    """Whether the records of each engine are of one profile."""
    c = _captures(spark, sf_dir).withColumn("run_profile", F.when((F.col("engine") == "claude") & (F.col("query_id").cast("long") > 20), "pilot").otherwise(F.col("run_profile")))
    return c.groupBy("engine").agg(F.count_distinct("run_profile").alias("profiles"), (F.count_distinct("run_profile") <= 1).alias("single"))


def adapters_normalised(spark, sf_dir):
    good, _ = adapters.normalise(_captures(spark, sf_dir))
    return silver.citations(good).select(F.col("query_id").cast("long").alias("doc_id"), "engine", "position", "url", "provenance")


def silver_from_captures(spark, sf_dir):
    good, _ = adapters.normalise(_captures(spark, sf_dir))
    return silver.responses(good).groupBy("engine").agg(F.count("*").alias("n"), F.sum("n_cited_sources").alias("cited"), F.sum(F.col("has_citations").cast("long")).alias("with_citations"))


def token_ledger(spark, sf_dir):
    prices = spark.createDataFrame([("chatgpt", 2.5, 10.0, 0.01), ("claude", 3.0, 15.0, 0.01), ("gemini", 0.3, 2.5, 0.0)], "engine string, tokens_in double, tokens_out double, per_call double")
    t = silver.token_ledger(_captures(spark, sf_dir), prices)
    return t.select("engine", "calls", "tok_in", "tok_out", F.round("dollars", 6).alias("dollars"))


def sources_from_pages(spark, sf_dir):
    s = fetch.from_pages(table(spark, sf_dir, "pages"))
    return s.groupBy("fetch_status").agg(F.count("*").alias("n"), F.sum("content_length").alias("bytes"))


def resume_pending(spark, sf_dir):
    """Cells still to do when two thirds are there."""
    k = D.keys(spark, sf_dir)
    return incremental.pending(k, k.where("doc_id % 3 <> 0"), ["engine", "query_id", "run_index"]).groupBy("engine").agg(F.count("*").alias("n"))


def breaker(spark, sf_dir):
    """Users whose events were errors three times running."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("engine"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "error").alias("signature"))
    return incremental.breaker_trips(e, limit=3)


def windowed_events(spark, sf_dir):
    w = incremental.event_windows(table(spark, sf_dir, "events"), "1 day")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


def event_sessions(spark, sf_dir):
    s = incremental.sessions(table(spark, sf_dir, "events"), "6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


def json_answers(spark, sf_dir):
    """Arrays in models' answers, with prose and fences around them."""
    d = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Sure:\n```json\n[1, 2, "), F.col("item_id").cast("string"), F.lit("]\n```")).alias("t"))
    a = F.from_json(text.json_array_in(F.col("t")), "array<long>")
    return d.select("item_id", F.size(a).cast("long").alias("n"), F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.length(text.without_fences(F.substring("t", 7, 100))).cast("long").alias("inner_len"))


_USER = """'"messages":[{"role":"user","content":"' || 'question ' || item_id || '"}]'"""
_REQUESTS_SQL = f"""WITH b AS (SELECT item_id, unnest([
  {{'engine': 'chatgpt', 'body': '{{"model":"chatgpt-1","input":"question ' || item_id || '","tools":[{{"type":"web_search"}}]}}'}},
  {{'engine': 'claude', 'body': '{{"model":"claude-1","max_tokens":4096,"tools":[{{"type":"web_search_20250305","name":"web_search"}}],' || {_USER} || '}}'}},
  {{'engine': 'gemini', 'body': '{{"model":"gemini-1","contents":"question ' || item_id || '","tools":["google_search"]}}'}},
  {{'engine': 'perplexity', 'body': '{{"model":"perplexity-1",' || {_USER} || '}}'}},
  {{'engine': 'kimi', 'body': '{{"model":"kimi-1",' || {_USER} || ',"max_tokens":4096,"tools":[{{"type":"builtin_function","function":{{"name":"$web_search"}}}}]}}'}},
  {{'engine': 'mistral', 'body': '{{"model":"mistral-1","inputs":"question ' || item_id || '","tools":[{{"type":"web_search"}}]}}'}},
  {{'engine': 'chatgpt_forced', 'body': '{{"model":"chatgpt-1","input":"question ' || item_id || '","tools":[{{"type":"web_search"}}],"tool_choice":{{"type":"web_search"}}}}'}}
]) AS x FROM benchmark) SELECT item_id, x.engine AS engine, CASE WHEN x.engine = 'chatgpt_forced' THEN 'chatgpt-1' ELSE x.engine || '-1' END AS model_requested, x.body AS body FROM b"""
MODES = json.dumps(["chatgpt", "claude", "gemini", "perplexity", "mistral", "kimi"]).replace('"', "'")
PACED_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r(user_id, i, n, delay, clean) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), n, CAST(0.5 AS DOUBLE), 0 FROM e UNION ALL
  SELECT r.user_id, e.i, r.n, CASE WHEN NOT ok THEN least(30.0, delay * CAST(1.5 AS DOUBLE)) WHEN clean + 1 >= 8 THEN greatest(0.5, delay * CAST(0.85 AS DOUBLE)) ELSE delay END, CASE WHEN NOT ok THEN 0 ELSE clean + 1 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
"""
QUERIES = {
    "clustered_models": (clustered_models, None),
    "simple_regression": (simple_regression, "SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, count(*) AS n, count(DISTINCT p_brand) AS groups FROM part"),
    "repeat_se": (repeat_se, CELL.rstrip() + ", g AS (SELECT engine, query_id, stddev_pop(cleaned_ais) AS sd, avg(cleaned_ais) AS m FROM cell WHERE cleaned_ais IS NOT NULL GROUP BY ALL), e AS (SELECT *, unnest(range(1, 6)) AS k FROM g) SELECT engine, query_id, k, round(sd / sqrt(k), 6) AS se, round(CASE WHEN m <> 0 THEN sd / sqrt(k) / abs(m) END, 6) AS relative_se FROM e"),
    "repeat_first_stable": (repeat_first_stable, CELL.rstrip() + ", g AS (SELECT engine, query_id, stddev_pop(cleaned_ais) AS sd, avg(cleaned_ais) AS m FROM cell WHERE cleaned_ais IS NOT NULL GROUP BY ALL), e AS (SELECT *, unnest([1, 2, 3, 4, 5, 10, 20, 40]) AS k FROM g) SELECT engine, query_id, CAST(min(CASE WHEN m <> 0 AND sd / sqrt(k) / abs(m) < 0.1 THEN k END) AS BIGINT) AS first_k FROM e GROUP BY ALL"),
    "repeat_bootstrap": (repeat_bootstrap, """WITH v AS (SELECT lang, source, CAST(n_chars AS DOUBLE) AS v, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang, source) AS n FROM documents WHERE n_chars IS NOT NULL),
k AS (SELECT lang, source, n, k, unnest(range(1000)) AS t FROM (SELECT lang, source, n, unnest([1, 2, 3, 4, 5]) AS k FROM v WHERE i = 0)),
d AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '42', lang, source, k, t, j)), 1, 15) AS BIGINT) % n AS i FROM (SELECT *, unnest(range(k)) AS j FROM k)),
m AS (SELECT d.lang, d.source, d.k, t, avg(v) AS m FROM d JOIN v ON v.lang IS NOT DISTINCT FROM d.lang AND v.source IS NOT DISTINCT FROM d.source AND v.i = d.i GROUP BY ALL)
SELECT lang, source, CAST(k AS BIGINT) AS k, round(stddev_pop(m), 6) AS se FROM m GROUP BY ALL"""),
    "quality_checklist": (quality_checklist, CHECKS_SQL),
    "threshold_ties": (threshold_ties, D.with_sql("resp sent cit score") + "SELECT engine, CAST(sum(CASE WHEN abs(entail_score - 0.5) < 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS ties, count(*) AS n FROM score JOIN resp ON resp.doc_id = score.doc_id GROUP BY engine"),
    "captures_from_files": (captures_from_files, f"WITH d AS (SELECT doc_id % 10 AS m, {MODES}[doc_id % 6 + 1] AS engine FROM documents), s AS (SELECT CASE WHEN m = 5 THEN 'unknown engine' WHEN m = 3 THEN 'malformed answer' ELSE 'good' END AS status, CASE WHEN m = 5 THEN 'nobody' ELSE engine END AS engine FROM d) SELECT status, engine, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'not JSON', '', 1"),
    "request_bodies": (request_bodies, _REQUESTS_SQL),
    "utc_stamps": (utc_stamps, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp FROM events"),
    "paced_calls": (paced_calls, PACED_SQL + "SELECT user_id AS engine, n AS calls, round(delay, 9) AS delay FROM r WHERE i = n"),
    "paced_stream": (paced_stream, PACED_SQL.rstrip() + """, a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS g FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, g, event_type = 'error' ORDER BY event_id) AS n FROM a),
t AS (SELECT user_id, min(event_id) AS tripped_at FROM b WHERE event_type = 'error' AND n = 3 GROUP BY user_id), f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY user_id)
SELECT r.user_id AS engine, n AS calls, failures, round(delay, 9) AS delay, tripped_at FROM r JOIN f ON f.user_id = r.user_id LEFT JOIN t ON t.user_id = r.user_id WHERE i = n"""),
    "profiles": (profiles, f"WITH d AS (SELECT {MODES}[doc_id % 6 + 1] AS engine, doc_id FROM documents), p AS (SELECT engine, CASE WHEN engine = 'claude' AND doc_id > 20 THEN 'pilot' ELSE 'scaleup' END AS p FROM d) SELECT engine, count(DISTINCT p) AS profiles, count(DISTINCT p) <= 1 AS single FROM p GROUP BY engine"),
    "adapters_normalised": (adapters_normalised, D.with_sql("cit", "u AS (SELECT cit.doc_id, citation_position AS p, url FROM cit JOIN pages ON pages.page_id = cit.page_id)", "o AS (SELECT *, " + f"{MODES}[doc_id % 6 + 1]" + " AS engine, row_number() OVER (PARTITION BY doc_id, url ORDER BY p) AS n FROM u)") + "SELECT doc_id, engine, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS position, url, CASE WHEN engine = 'kimi' THEN 'self_reported_prompt_elicited' ELSE 'provider_certified' END AS provenance FROM o WHERE n = 1"),
    "silver_from_captures": (silver_from_captures, D.with_sql("cit", f"d AS (SELECT doc_id, {MODES}[doc_id % 6 + 1] AS engine FROM documents)", "u AS (SELECT cit.doc_id, count(DISTINCT url) AS n FROM cit JOIN pages ON pages.page_id = cit.page_id GROUP BY cit.doc_id)") + "SELECT engine, count(*) AS n, CAST(coalesce(sum(u.n), 0) AS BIGINT) AS cited, CAST(count(u.n) AS BIGINT) AS with_citations FROM d LEFT JOIN u ON d.doc_id = u.doc_id GROUP BY engine"),
    "token_ledger": (token_ledger, f"WITH d AS (SELECT {MODES}[doc_id % 6 + 1] AS engine, doc_id FROM documents), p(engine, i, o, c) AS (VALUES ('chatgpt', 2.5, 10.0, 0.01), ('claude', 3.0, 15.0, 0.01), ('gemini', 0.3, 2.5, 0.0)), t AS (SELECT engine, count(*) AS calls, CAST(sum(doc_id) AS BIGINT) AS tok_in, CAST(sum(7) AS BIGINT) AS tok_out FROM d GROUP BY engine) SELECT t.engine, calls, tok_in, tok_out, round(CAST(tok_in / 1e6 * coalesce(i, 0) + tok_out / 1e6 * coalesce(o, 0) + calls * coalesce(c, 0) AS DOUBLE), 6) AS dollars FROM t LEFT JOIN p ON t.engine = p.engine"),
    "sources_from_pages": (sources_from_pages, "SELECT CASE WHEN coalesce(trim(html), '') <> '' THEN 'ok' ELSE 'empty_response' END AS fetch_status, count(*) AS n, CAST(sum(octet_length(encode(coalesce(html, '')))) AS BIGINT) AS bytes FROM pages GROUP BY ALL"),
    "resume_pending": (resume_pending, "SELECT lang AS engine, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY lang"),
    "breaker": (breaker, "WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS g FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, g, event_type = 'error' ORDER BY event_id) AS n FROM a) SELECT user_id AS engine, 'error' AS signature, min(event_id) AS tripped_at FROM b WHERE event_type = 'error' AND n = 3 GROUP BY user_id"),
    "windowed_events": (windowed_events, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"),
    "event_sessions": (event_sessions, "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM a), c AS (SELECT user_id, s, count(*) AS n FROM b GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY user_id"),
    "json_answers": (json_answers, "SELECT item_id, CAST(3 AS BIGINT) AS n, 3 + item_id AS total, CAST(length('[1, 2, ' || item_id || ']') AS BIGINT) AS inner_len FROM benchmark"),
}
