"""Queries that write, read again, resume and fetch: what the sinks and the incremental runs leave behind."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citelab import lineage
from citelab.functions import text
from citelab.sources import fetch, page_source, registry, sinks
from citelab.sources.driver_tables import table
from citelab.streaming import incremental


def _folder(spark) -> str:
    return f"{lineage.shared_folder(spark)}/storage-{uuid.uuid4().hex}"


def sinks_round_trip(spark, sf_dir):
    """Rows found after each way of writing: by key, twice; appended, twice; frozen, and again; guarded; logged; exported."""
    at = _folder(spark)
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("e"), F.col("n_regionkey").cast("string")).alias("engine"))
    some = n.where("n_nationkey < 10")
    rows = []
    sinks.write_by_key(n, f"{at}/key")
    sinks.write_by_key(some, f"{at}/key")  # the partitions of `some` are rewritten, the others stay
    rows.append(("by key", spark.read.parquet(f"{at}/key").count()))
    rows.append(("appended first", sinks.append_new(some, f"{at}/append", ["n_nationkey"])))
    rows.append(("appended then", sinks.append_new(n.union(some), f"{at}/append", ["n_nationkey"])))
    rows.append(("appended again", sinks.append_new(n, f"{at}/append", ["n_nationkey"])))
    sinks.freeze(n, f"{at}/frozen", tau=0.5)
    rows.append(("frozen", spark.read.parquet(f"{at}/frozen").count()))
    rows.append(("manifest", spark.read.text(f"{at}/frozen/_manifest").select(F.get_json_object("value", "$.rows").cast("long")).first()[0]))
    try:
        sinks.freeze(n, f"{at}/frozen")
        rows.append(("frozen twice", 1))
    except Exception:
        rows.append(("frozen twice", 0))
    try:
        sinks.write_guarded(spark.read.parquet(f"{at}/frozen"), f"{at}/frozen")
        rows.append(("overwrote its input", 1))
    except sinks.WouldOverwriteInput:
        rows.append(("overwrote its input", 0))
    sinks.failure_log(some, f"{at}/log")
    sinks.failure_log(some, f"{at}/log")
    rows.append(("logged", spark.read.json(f"{at}/log").count()))
    sinks.export_csv(n, f"{at}/csv")
    rows.append(("exported", spark.read.option("header", True).csv(f"{at}/csv").count()))
    return spark.createDataFrame(rows, "sink string, n long")


def checkpointed_runs(spark, sf_dir):
    """A stream of files taken in two runs with one checkpoint: every row comes once, and a run without news takes none."""
    at = _folder(spark)
    n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    taken = []

    def run() -> None:
        source = spark.readStream.schema(n.schema).parquet(f"{at}/in")
        before = len(taken)
        incremental.run_available(source, lambda df, _: (df.write.mode("append").parquet(f"{at}/out"), taken.append(df.count())), f"{at}/checkpoint")
        rows.append((f"run {len(rows) + 1}", sum(taken[before:])))

    rows: list[tuple[str, int]] = []
    for part in (F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 3 > 0):
        n.where(part).write.mode("append").parquet(f"{at}/in")
        run()
    run()
    out = spark.read.parquet(f"{at}/out")
    rows += [("rows", out.count()), ("keys", out.distinct().count())]
    return spark.createDataFrame(rows, "what string, n long")


def fetched_pages(spark, sf_dir):
    """Pages asked for with retries: what each answer and each failure comes to, and in how many attempts."""

    def get(url):
        n = len(url)
        if n % 11 == 0:
            raise TimeoutError
        if n % 13 == 0:
            return 503, ""
        if n % 5 == 0:
            return 403, "no"
        return 200, "" if n % 7 == 0 else "<title>t</title><p>text</p>"

    u = table(spark, sf_dir, "pages").select("url")
    got = fetch.fetch(u, get, spacing=0.0, sleep=lambda _: None)
    return got.groupBy("fetch_status", "attempts").agg(F.count("*").cast("long").alias("n")).select("fetch_status", F.col("attempts").cast("long").alias("attempts"), "n")


def loaded_splits(spark, sf_dir):
    """The first split that is there, by preference, and an error if none is."""
    at = _folder(spark)
    n = table(spark, sf_dir, "region")
    n.write.parquet(f"{at}/small/train.parquet")
    n.where("r_regionkey < 2").write.parquet(f"{at}/default/train.parquet")
    rows = []
    for configs in (("none", "small"), ("default", "small"), ("none",)):
        try:
            df, config, split = registry.load(spark, at, configs)
            rows.append((",".join(configs), f"{config}/{split}", df.count()))
        except registry.NoSuchDataset:
            rows.append((",".join(configs), "", 0))
    return spark.createDataFrame(rows, "asked string, found string, n long")


def blank_fills(spark, sf_dir):
    """Predictions that go into blank facets only."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("query_id")
    facets = d.select(key, F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("topic"), F.col("source").alias("kind"))
    predicted = d.where("doc_id % 2 = 0").select(key, F.lit("guess").alias("topic"), F.lit("never").alias("kind"))
    out = registry.fill_blanks(facets, predicted, ["topic", "kind"])
    return out.select(F.col("query_id").cast("long").alias("doc_id"), text.strip(F.coalesce("topic", F.lit(""))).alias("topic"), "kind", "filled")


def spaced_pages(spark, sf_dir):
    """Pages by the source that deals hosts over partitions and spaces a host's pages by a tenth of a second."""
    p = page_source.stored_pages(spark, f"{sf_dir}/pages.parquet")
    return p.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("fetch_status") == "ok").cast("long")).alias("ok"), F.sum("content_length").alias("bytes"), F.round(F.max("due"), 6).alias("last_due"))


def streamed_pages(spark, sf_dir):
    """The same source as a stream that is run twice, with pages added in between: each page once, in the batch that it belongs to."""
    at = _folder(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")

    def keep(batch, k):
        batch.select("page_id", "host", "due").withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{at}/seen/batch={k}")

    for rest in (0, 1):
        pages.where(F.col("page_id") % 2 == rest).orderBy("page_id").coalesce(1).write.mode("append").parquet(f"{at}/pages")
        incremental.run_available(page_source.stored_pages(spark, f"{at}/pages", stream=True, buckets=4), keep, f"{at}/progress")
    seen = spark.read.schema("page_id long, host string, due double, batch long").parquet(f"{at}/seen")
    return seen.groupBy("batch", "host").agg(F.count("*").alias("n"), F.sum("page_id").alias("ids"), F.round(F.max("due"), 6).alias("last_due"))


QUERIES = {
    "sinks_round_trip": (sinks_round_trip, "WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_nationkey < 10) AS s, count(*) FILTER (WHERE n_nationkey < 10 OR n_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 10)) AS k FROM nation) SELECT x.sink AS sink, x.n AS n FROM (SELECT unnest([{'sink': 'by key', 'n': k}, {'sink': 'appended first', 'n': s}, {'sink': 'appended then', 'n': n - s}, {'sink': 'appended again', 'n': 0}, {'sink': 'frozen', 'n': n}, {'sink': 'manifest', 'n': n}, {'sink': 'frozen twice', 'n': 0}, {'sink': 'overwrote its input', 'n': 0}, {'sink': 'logged', 'n': 2 * s}, {'sink': 'exported', 'n': n}]) AS x FROM c)"),
    "checkpointed_runs": (checkpointed_runs, "WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 3 = 0) AS a FROM customer) SELECT x.what AS what, x.n AS n FROM (SELECT unnest([{'what': 'run 1', 'n': a}, {'what': 'run 2', 'n': n - a}, {'what': 'run 3', 'n': 0}, {'what': 'rows', 'n': n}, {'what': 'keys', 'n': n}]) AS x FROM c)"),
    "fetched_pages": (fetched_pages, "WITH u AS (SELECT DISTINCT url, length(url) AS n FROM pages WHERE url IS NOT NULL), s AS (SELECT CASE WHEN n % 11 = 0 THEN 'timeout' WHEN n % 13 = 0 THEN 'http_503' WHEN n % 5 = 0 THEN 'http_403' WHEN n % 7 = 0 THEN 'empty_response' ELSE 'ok' END AS fetch_status, CAST(CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN 4 ELSE 1 END AS BIGINT) AS attempts FROM u) SELECT fetch_status, attempts, count(*) AS n FROM s GROUP BY ALL"),
    "spaced_pages": (spaced_pages, r"SELECT regexp_extract(coalesce(url, ''), '^[^:/?#]+://([^/?#]*)', 1) AS host, count(*) AS n, CAST(sum(CASE WHEN coalesce(trim(html), '') <> '' THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(octet_length(encode(coalesce(html, '')))) AS BIGINT) AS bytes, round(CAST((count(*) - 1) * 0.1 AS DOUBLE), 6) AS last_due FROM pages GROUP BY ALL"),
    "streamed_pages": (streamed_pages, "SELECT page_id % 2 AS batch, regexp_extract(coalesce(url, ''), '^[^:/?#]+://([^/?#]*)', 1) AS host, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS ids, round(CAST((count(*) - 1) * 0.1 AS DOUBLE), 6) AS last_due FROM pages GROUP BY ALL"),
    "loaded_splits": (loaded_splits, "SELECT x.asked AS asked, x.found AS found, x.n AS n FROM (SELECT unnest([{'asked': 'none,small', 'found': 'small/train', 'n': count(*)}, {'asked': 'default,small', 'found': 'default/train', 'n': count(*) FILTER (WHERE r_regionkey < 2)}, {'asked': 'none', 'found': '', 'n': 0}]) AS x FROM region)"),
    "blank_fills": (blank_fills, "SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND lang IS NOT NULL THEN lang WHEN doc_id % 2 = 0 THEN 'guess' ELSE '' END AS topic, CASE WHEN source IS NULL OR trim(source) = '' THEN CASE WHEN doc_id % 2 = 0 THEN 'never' ELSE source END ELSE source END AS kind, CAST(CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 1 AND lang IS NOT NULL THEN 0 ELSE 1 END + CASE WHEN source IS NULL OR trim(source) = '' THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS filled FROM documents"),
}
