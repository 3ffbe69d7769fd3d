"""Queries with the joins, aggregates, windows, sorts, set operations and reshapings, over the shared tables."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citelab.operators import relational as R
from citelab.sources.driver_tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql(text: str):
    """A query that Spark and DuckDB read alike."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark, sf_dir):
        return spark.sql(re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", text), **{t: table(spark, sf_dir, t) for t in used})

    return run, text


def join_left_checked(spark, sf_dir):
    """Orders with their customer: many to one, every order must find one."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = R.checked_join(o.withColumnRenamed("o_custkey", "c_custkey"), c.select("c_custkey", "c_mktsegment"), ["c_custkey"], matched=True)
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def join_one_to_one(spark, sf_dir):
    d, y = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return R.checked_join(y, d, ["doc_id"], validate="1:1").groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("quality").alias("quality"))


def join_deduplicated_dimension(spark, sf_dir):
    """A dimension is made unique by a stated rule before it is joined."""
    s = table(spark, sf_dir, "supplier")
    first = s.withColumn("n", F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))).where("n = 1").select("s_nationkey", F.col("s_name").alias("first_supplier"))
    n = table(spark, sf_dir, "nation")
    return n.join(first, n.n_nationkey == first.s_nationkey, "left").select("n_name", "first_supplier")


def join_outer_indicator(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_nationkey").distinct().withColumnRenamed("c_nationkey", "k")
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey").distinct().withColumnRenamed("s_nationkey", "k")
    return R.outer_indicator(c, s, ["k"]).groupBy("side").agg(F.count("*").alias("n"))


def densified_grid(spark, sf_dir):
    """Every engine x tier, with 0 where nothing was cited; the grid is of two small dimensions."""
    d = table(spark, sf_dir, "events")
    a, b = d.select("event_type").distinct(), spark.range(5).select(F.col("id").alias("bucket"))
    counts = d.groupBy("event_type", (F.col("user_id") % 5).alias("bucket")).agg(F.count("*").alias("n"))
    return a.crossJoin(b).join(counts, ["event_type", "bucket"], "left").select("event_type", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def map_lookup(spark, sf_dir):
    m = F.create_map(*[F.lit(x) for kv in {"A": "accepted", "N": "new", "R": "returned"}.items() for x in kv])
    return table(spark, sf_dir, "lineitem").groupBy(F.element_at(m, F.col("l_returnflag")).alias("state")).agg(F.count("*").alias("n"))


def adjusted_skew(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    q = F.percentile("o_totalprice", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    d = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"), F.round(R.adjusted_skew("o_totalprice"), 6).alias("skew"), q.alias("q"))
    return d.select("o_orderpriority", "n", "mean", "sd", "skew", *[F.round(F.col("q")[i], 4).alias(f"q{i}") for i in range(5)])


def intervals(spark, sf_dir):
    """Mean with a t interval, share with a Wilson interval."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("sd"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("k"))
    half = R.t_point(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    lo, hi = R.wilson(F.col("k"), F.col("n"))
    r = lambda c, n: F.round(c, 4 if n.startswith("t") else 6).alias(n)
    return g.select("o_orderpriority", "n", r(F.col("m") - half, "t_lo"), r(F.col("m") + half, "t_hi"), r(lo, "w_lo"), r(hi, "w_hi"))


def crosstab_share(spark, sf_dir):
    """Row shares in percent of a pivot with fixed columns."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count("l_orderkey")).fillna(0)
    n = F.col("O") + F.col("F")
    return p.select("l_returnflag", F.round(100.0 * F.col("O") / n, 6).alias("open_pct"), F.round(100.0 * F.col("F") / n, 6).alias("filled_pct"))


def histogram_edges(spark, sf_dir):
    """Unequal bins, the last one open to the right."""
    edges = (0, 1, 5, 10, 25)
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = F.when(F.col("n") <= edges[1], "1")
    for lo, hi in zip(edges[1:], edges[2:], strict=False):
        b = b.when(F.col("n") <= hi, f"{lo + 1}-{hi}")
    return d.groupBy(b.otherwise("more").alias("bin")).agg(F.count("*").alias("n_customers"))


def five_numbers(spark, sf_dir):
    """Box plots: quartiles, and the last values within 1.5 of the quartiles' distance."""
    o = table(spark, sf_dir, "orders")
    q = R.exact_quantiles(o, "o_totalprice", (0.25, 0.5, 0.75), "o_orderpriority")
    j = o.join(F.broadcast(q), "o_orderpriority")
    q1, q3 = F.col("q")[0], F.col("q")[2]
    v = F.col("o_totalprice")
    inside = (v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))
    return j.groupBy("o_orderpriority").agg(*[F.round(F.first(F.col("q")[i]), 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))], F.round(F.min(F.when(inside, v)), 4).alias("low"), F.round(F.max(F.when(inside, v)), 4).alias("high"), F.sum((~inside).cast("long")).alias("outside"))


def concentration(spark, sf_dir):
    """Share of the ten largest customers and the Gini coefficient of spending."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    total = c.agg(F.sum("v").alias("s"))
    top = c.orderBy(F.desc("v"), "o_custkey").limit(10).agg(F.sum("v").alias("t"))
    g = R.gini(c, "v")
    return total.join(F.broadcast(top), how="cross").join(F.broadcast(g), how="cross").select(F.round(F.col("t") / F.col("s"), 6).alias("top10_share"), F.round("gini", 6).alias("gini"))


def average_ranks(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return p.select("p_brand", "n", R.average_rank("n", descending=True).alias("rank"))


def decile_bins(spark, sf_dir):
    b = R.quantile_bin(table(spark, sf_dir, "part"), "p_size", 10, "decile")
    return b.groupBy("decile").agg(F.count("*").alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))


def step_up(spark, sf_dir):
    """q values of p values made from part keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("model"), ((F.col("p_partkey") * 7919 % 1009) / 1009.0).alias("p"))
    return R.benjamini_hochberg(p, "p", ["model"]).select("p_partkey", "model", F.round("q", 6).alias("q"))


def winsorised(spark, sf_dir):
    z = R.winsorised_z(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size")), ["p_retailprice", "p_size"])
    return z.select("p_partkey", F.round("p_retailprice", 6).alias("z_price"), F.round("p_size", 6).alias("z_size"))


def collapsed_categories(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    a = R.collapse_rare(d, "p_type", 100, "other_type", "kind")
    a = R.top_categories(a, "p_brand", 5, "other_brand", "brand")
    return a.groupBy("kind", "brand").agg(F.count("*").alias("n"))


def rank_correlation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("x"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("y"))
    return R.spearman(p, "x", "y", ["p_brand"]).select("p_brand", "n", F.round("rho", 6).alias("rho"))


def rank_correlation_overall(spark, sf_dir):
    """Over all rows at once: ranks come from range partitions, not from one task."""
    o = table(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_custkey") % 50).alias("k"))
    return R.spearman(o, "o_totalprice", "k").select("n", F.round("rho", 6).alias("rho"))


def correlation_matrix(spark, sf_dir):
    """All pairs of columns, flagged from 0.5 on."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = table(spark, sf_dir, "lineitem").agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows)).select("a", "b", F.round("r", 6).alias("r"), (F.abs("r") >= 0.5).alias("high"))


def agreement(spark, sf_dir):
    y = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("long")), "doc_id")
    k = R.kappa(y.select(F.col("quality") == 1, F.col("long")).toDF("a", "b"), "a", "b")
    return k.select("both", "only_a", "only_b", "neither", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


def stratified(spark, sf_dir):
    return R.stratified_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey", 5)


def failure_runs(spark, sf_dir):
    """The longest run of equal events of each user."""
    e = table(spark, sf_dir, "events")
    return R.runs_of(e.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type").groupBy("user_id").agg(F.max("run_length").cast("long").alias("longest"), F.count("*").alias("n"))


def unpivoted(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.round(F.avg(x), 6).alias(x) for x in ("l_quantity", "l_discount", "l_tax")])
    return c.unpivot("l_returnflag", ["l_quantity", "l_discount", "l_tax"], "measure", "value")


def json_fields(spark, sf_dir):
    """A field of a JSON text, and the keys it has."""
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("s"), F.max("k").alias("m"))


QUERIES = {
    "join_left_checked": (join_left_checked, "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "join_one_to_one": (join_one_to_one, "SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS toxic, CAST(sum(quality) AS BIGINT) AS quality FROM labels JOIN documents USING (doc_id) GROUP BY lang"),
    "join_deduplicated_dimension": (join_deduplicated_dimension, "SELECT n_name, s_name AS first_supplier FROM nation LEFT JOIN (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1) ON n_nationkey = s_nationkey"),
    "join_outer_indicator": (join_outer_indicator, "SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) b ON a.k = b.k GROUP BY ALL"),
    "join_inner_agg": sql("SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "join_semi": sql("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY c_mktsegment"),
    "join_anti": sql("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_paired_delta": sql("SELECT a.p_brand, a.n AS n_small, b.n AS n_large, b.n - a.n AS delta, round((b.m - a.m) / a.m * 100, 6) AS pct FROM (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part WHERE p_size <= 25 GROUP BY p_brand) a JOIN (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part WHERE p_size > 25 GROUP BY p_brand) b ON a.p_brand = b.p_brand"),
    "densified_grid": (densified_grid, "SELECT event_type, bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(range(5)) AS bucket) LEFT JOIN (SELECT event_type, user_id % 5 AS bucket, count(*) AS n FROM events GROUP BY ALL) USING (event_type, bucket)"),
    "map_lookup": (map_lookup, "SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'new' WHEN 'R' THEN 'returned' END AS state, count(*) AS n FROM lineitem GROUP BY ALL"),
    "agg_named": sql("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS mean_price, min(l_shipdate) AS first_ship, max(l_tax) AS max_tax, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_median": sql("SELECT o_orderpriority, round(median(o_totalprice), 4) AS med FROM orders GROUP BY o_orderpriority"),
    "agg_two_level": sql("SELECT c_mktsegment, round(avg(m), 4) AS macro, round(sum(s) / sum(n), 4) AS micro FROM (SELECT c_mktsegment, c_custkey, avg(o_totalprice) AS m, sum(o_totalprice) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey) GROUP BY c_mktsegment"),
    "agg_value_counts": sql("SELECT event_type, count(*) AS n, round(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY event_type"),
    "agg_any_all": sql("SELECT l_suppkey, bool_or(l_discount > 0.09) AS any_high, bool_and(l_tax >= 0) AS all_taxed FROM lineitem GROUP BY l_suppkey"),
    "agg_having": sql("SELECT p_type, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) >= 10"),
    "agg_same_sign": sql("SELECT l_suppkey, bool_and(x > 0) OR bool_and(x < 0) AS same_sign FROM (SELECT l_suppkey, l_returnflag, avg(l_discount) - 0.05 AS x FROM lineitem GROUP BY l_suppkey, l_returnflag) GROUP BY l_suppkey"),
    "agg_inverse_variance": sql("SELECT l_returnflag, round(sum(b / (s * s)) / sum(1 / (s * s)), 6) AS beta, round(sqrt(1 / sum(1 / (s * s))), 6) AS se FROM (SELECT l_returnflag, l_suppkey, avg(l_discount) AS b, stddev_samp(l_discount) / sqrt(count(*)) AS s FROM lineitem GROUP BY l_returnflag, l_suppkey HAVING count(*) > 5) WHERE s > 0 GROUP BY l_returnflag"),
    "agg_conditional_unconditional": sql("SELECT o_orderstatus, round(avg(coalesce(x, 0)), 6) AS all_rows, round(avg(x), 6) AS some_rows, count(x) AS n FROM (SELECT o_orderstatus, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS x FROM orders) GROUP BY o_orderstatus"),
    "agg_cost_ledger": sql("SELECT event_type, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS units, round(CAST(sum(floor(value)) AS DOUBLE) / CAST(1000000 AS DOUBLE) * CAST(2.5 AS DOUBLE) + CAST(count(*) AS DOUBLE) * CAST(0.005 AS DOUBLE), 6) AS dollars FROM events GROUP BY event_type"),
    "adjusted_skew": (adjusted_skew, "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(skewness(o_totalprice), 6) AS skew, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS q{i}" for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))) + " FROM orders GROUP BY o_orderpriority"),
    "intervals": (intervals, "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS k FROM orders GROUP BY ALL), t AS (SELECT *, 1.959964 + (pow(1.959964, 3) + 1.959964) / (4 * (n - 1)) + (5 * pow(1.959964, 5) + 16 * pow(1.959964, 3) + 3 * 1.959964) / (96 * (n - 1) * (n - 1)) AS tp, k / n AS p FROM g) SELECT o_orderpriority, n, round(m - tp * sd / sqrt(n), 4) AS t_lo, round(m + tp * sd / sqrt(n), 4) AS t_hi, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS w_lo, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS w_hi FROM t"),
    "crosstab_share": (crosstab_share, "SELECT l_returnflag, round(100.0 * count(*) FILTER (WHERE l_linestatus = 'O') / count(*), 6) AS open_pct, round(100.0 * count(*) FILTER (WHERE l_linestatus = 'F') / count(*), 6) AS filled_pct FROM lineitem GROUP BY l_returnflag"),
    "histogram_edges": (histogram_edges, "SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' ELSE 'more' END AS bin, count(*) AS n_customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY ALL"),
    "five_numbers": (five_numbers, "WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders GROUP BY ALL), j AS (SELECT orders.o_orderpriority, a, b, c, o_totalprice AS v, o_totalprice >= a - 1.5 * (c - a) AND o_totalprice <= c + 1.5 * (c - a) AS ins FROM orders JOIN q ON orders.o_orderpriority = q.o_orderpriority) SELECT o_orderpriority, round(first(a), 4) AS q1, round(first(b), 4) AS median, round(first(c), 4) AS q3, round(min(CASE WHEN ins THEN v END), 4) AS low, round(max(CASE WHEN ins THEN v END), 4) AS high, CAST(sum(CASE WHEN ins THEN 0 ELSE 1 END) AS BIGINT) AS outside FROM j GROUP BY o_orderpriority"),
    "concentration": (concentration, "WITH c AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM c) SELECT round((SELECT sum(v) FROM (SELECT v FROM c ORDER BY v DESC, o_custkey LIMIT 10)) / sum(v), 6) AS top10_share, round(sum((2 * i - n - 1) * v) / (first(n) * sum(v)), 6) AS gini FROM r"),
    "average_ranks": (average_ranks, "SELECT p_brand, n, rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS rank FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)"),
    "decile_bins": (decile_bins, "WITH q AS (SELECT min(p_size) AS lo, max(p_size) AS hi, " + ", ".join(f"quantile_cont(p_size, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM part), b AS (SELECT p_size, len(list_filter(list_distinct([" + ", ".join(f"e{i}" for i in range(1, 10)) + "]), lambda z: z < p_size AND z > lo AND z < hi)) AS decile FROM part, q) SELECT CAST(decile AS BIGINT) AS decile, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM b GROUP BY decile"),
    "step_up": (step_up, "WITH p AS (SELECT p_partkey, p_brand AS model, (p_partkey * 7919 % 1009) / 1009.0 AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p) AS i, count(*) OVER (PARTITION BY model) AS m FROM p) SELECT p_partkey, model, round(least(1.0, min(p * m / i) OVER (PARTITION BY model ORDER BY i DESC)), 6) AS q FROM r"),
    "winsorised": (winsorised, "WITH q AS (SELECT quantile_cont(p_retailprice, 0.01) AS a, quantile_cont(p_retailprice, 0.99) AS b, quantile_cont(p_size, 0.01) AS c, quantile_cont(p_size, 0.99) AS d FROM part), h AS (SELECT p_partkey, least(greatest(p_retailprice, a), b) AS x, least(greatest(p_size, c), d) AS y FROM part, q) SELECT p_partkey, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 6) AS z_price, round((y - avg(y) OVER ()) / stddev_samp(y) OVER (), 6) AS z_size FROM h"),
    "collapsed_categories": (collapsed_categories, "WITH t AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), b AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5) SELECT CASE WHEN n >= 100 THEN part.p_type ELSE 'other_type' END AS kind, CASE WHEN p_brand IN (SELECT p_brand FROM b) THEN p_brand ELSE 'other_brand' END AS brand, count(*) AS n FROM part JOIN t ON part.p_type = t.p_type GROUP BY ALL"),
    "rank_correlation": (rank_correlation, "WITH p AS (SELECT p_brand, p_size AS x, p_retailprice AS y FROM part WHERE p_partkey % 7 <> 0), r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY x) + (count(*) OVER (PARTITION BY p_brand, x) - 1) / 2 AS x, rank() OVER (PARTITION BY p_brand ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, y) - 1) / 2 AS y FROM p) SELECT p_brand, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY p_brand"),
    "rank_correlation_overall": (rank_correlation_overall, "WITH p AS (SELECT o_totalprice AS x, o_custkey % 50 AS y FROM orders), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y FROM p) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r"),
    "correlation_matrix": (correlation_matrix, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, abs(corr({a}, {b})) >= 0.5 AS high FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")))),
    "agreement": (agreement, "WITH y AS (SELECT quality = 1 AS a, n_chars > 1000 AS b FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE a AND b) AS tt, count(*) FILTER (WHERE a AND NOT b) AS tf, count(*) FILTER (WHERE NOT a AND b) AS ft, count(*) FILTER (WHERE NOT a AND NOT b) AS ff, count(*) AS n FROM y), k AS (SELECT *, (tt + ff) / n AS po, ((tt + tf) * (tt + ft) + (ft + ff) * (tf + ff)) / (n * n) AS pe FROM c) SELECT tt AS both, tf AS only_a, ft AS only_b, ff AS neither, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM k"),
    "stratified": (stratified, "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_custkey || '|42')) <= 5"),
    "simple_sample": sql("SELECT p_partkey, p_name FROM part ORDER BY md5(concat(CAST(p_partkey AS VARCHAR(20)), '|7')) LIMIT 50"),
    "failure_runs": (failure_runs, "WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events), b AS (SELECT user_id, event_type, g, count(*) AS n FROM a GROUP BY ALL) SELECT user_id, max(n) AS longest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY user_id"),
    "unpivoted": (unpivoted, "UNPIVOT (SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY l_returnflag) ON l_quantity, l_discount, l_tax INTO NAME measure VALUE value"),
    "json_fields": (json_fields, "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS s, max(k) AS m FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"),
    "window_totals": sql("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders"),
    "window_cumulative": sql("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders"),
    "window_duplicates": sql("SELECT p_name, count(*) - 1 AS extra FROM part GROUP BY p_name HAVING count(*) > 1"),
    "sort_first_row": sql("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1"),
    "sort_by_abs": sql("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20"),
    "sort_top_per_group": sql("SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 10"),
    "sort_bottom": sql("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 8"),
    "sort_offset": sql("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 100"),
    "sort_max_by": sql("SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS best, min_by(o_orderkey, o_totalprice) AS least FROM orders GROUP BY o_custkey"),
    "sort_present_in_all": sql("SELECT p_size FROM part GROUP BY p_size HAVING count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part) ORDER BY p_size LIMIT 10"),
    "sort_group_max": sql("SELECT p_brand, max(abs(p_retailprice - 1000)) AS m FROM part GROUP BY p_brand ORDER BY m DESC, p_brand LIMIT 5"),
    "sort_custom_order": sql("SELECT k.p AS priority, k.i AS place, coalesce(n, 0) AS n FROM (SELECT '1-URGENT' AS p, 1 AS i UNION ALL SELECT '2-HIGH', 2 UNION ALL SELECT 'none', 3) k LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority) o ON k.p = o_orderpriority"),
    "set_union_all": sql("SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier) GROUP BY kind"),
    "set_distinct": sql("SELECT DISTINCT p_brand, p_size FROM part"),
    "set_except": sql("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0"),
    "set_intersect": sql("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "filter_in": sql("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type"),
    "filter_range": sql("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.05 AND l_discount < 0.08"),
    "filter_case": sql("SELECT CASE WHEN n = 1 THEN 'single' WHEN n <= 3 THEN 'few' ELSE 'many' END AS breadth, count(*) AS suppliers FROM (SELECT l_suppkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_suppkey) GROUP BY 1"),
    "filter_fill_blanks": sql("SELECT coalesce(nullif(trim(p_type), ''), p_brand) AS v, count(*) AS n FROM (SELECT p_brand, CASE WHEN p_partkey % 3 = 0 THEN '  ' WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS p_type FROM part) GROUP BY 1"),
    "filter_clip": sql("SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL THEN least(greatest(c_acctbal, -100), 5000) END AS clipped FROM customer"),
    "scan_pruned": sql("SELECT l_returnflag, max(l_tax) AS t FROM lineitem WHERE l_suppkey = 7 GROUP BY l_returnflag"),
}
