"""Joins with a stated cardinality, and reshaping, ranking and statistics that SQL has no single word for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citelab import lineage

from citelab.lineage import global_prefix


class CardinalityError(ValueError):
    pass


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "m:1", matched: bool = False) -> DataFrame:
    """A join whose sides have unique keys where `validate` says 1 (1:1, m:1, 1:m), and no row unmatched if `matched`.

    The checks are aggregates over the keys only.
    """
    on = list(on)
    for side, df in zip(validate.split(":"), (left, right), strict=True):
        if side == "1" and not df.groupBy(*on).count().where("count > 1").isEmpty():
            raise CardinalityError(f"keys {on} aren't unique on a side that must have them once")
    if matched and not left.join(right.select(*on), on, "left_anti").isEmpty():
        raise CardinalityError(f"rows without a match on {on}")
    return left.join(right, on, how)


def outer_indicator(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with side: both, left_only, right_only."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    out = a.join(b, list(on), "full")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return out.withColumn("side", side).drop("_l", "_r")


def average_rank(value: str, by: Sequence[str] = (), descending: bool = False) -> Column:
    """Ranks from 1, ties sharing their average."""
    order = F.desc(value) if descending else F.asc(value)
    return F.rank().over(W.partitionBy(*by).orderBy(order)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def adjusted_skew(c: str) -> Column:
    """Sample skewness as the usual packages report it (the built-in is the population's)."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, d = k / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return centre - half, centre + half


#: 97.5 % points of Student's t for 1 to 30 degrees of freedom.
T975 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def t_point(df: Column) -> Column:
    """The 97.5 % point: tabled up to 30, then by its expansion around the normal's."""
    z = 1.959964
    far = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    return F.when(df < 1, None).when(df <= 30, F.element_at(F.array(*[F.lit(t) for t in T975]), F.least(df, F.lit(30)).cast("int"))).otherwise(far)


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """Step-up q values within each group; ties in p have the same q."""
    w = W.partitionBy(*by)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(p)), "_m": F.count(p).over(w)})
    raw = F.col(p) * F.col("_m") / F.col("_r")
    low = F.min(raw).over(w.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), low))).drop("_r", "_m")


def exact_quantiles(df: DataFrame, value: str, at: Sequence[float], by: str | None = None) -> DataFrame:
    """(by, q): the exact quantiles of a column, by linear interpolation, as an array; null values don't count.

    Equal values are counted first, different ones sorted by range partitions; a value's place is the sum of its
    partition's offset and its own within it. So no task holds more of a group than a partition, and no group is collected.
    """
    group = F.col(by) if by else F.lit(0)
    counts = df.where(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("v")).groupBy("g", "v").agg(F.count("*").alias("c"))
    rows = lineage.cut(counts.repartitionByRange("g", "v").withColumn("p", F.spark_partition_id()))
    parts = rows.groupBy("g", "p").agg(F.sum("c").alias("s"))  # as many rows as partitions and groups
    ahead = F.sum("s").over(W.partitionBy("g").orderBy("p")) - F.col("s")
    parts = parts.select("g", "p", ahead.alias("ahead"), F.sum("s").over(W.partitionBy("g")).alias("n"))
    before = F.sum("c").over(W.partitionBy("g", "p").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c")
    same = F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.p") == F.col("b.p"))
    placed = rows.withColumn("own", before).alias("a").join(parts.alias("b"), same).select("a.g", "v", "c", "n", (F.col("own") + F.col("ahead")).alias("before"))
    here = lambda k: F.max(F.when((k >= F.col("before")) & (k < F.col("before") + F.col("c")), F.col("v")))
    cells = []
    for i, q in enumerate(at):
        k = F.lit(float(q)) * (F.col("n") - 1)
        cells += [here(F.floor(k)).alias(f"lo{i}"), here(F.ceil(k)).alias(f"hi{i}"), F.max(k - F.floor(k)).alias(f"f{i}")]
    found = placed.groupBy("g").agg(*cells)
    q = F.array(*[(1 - F.col(f"f{i}")) * F.col(f"lo{i}") + F.col(f"f{i}") * F.col(f"hi{i}") for i in range(len(at))])
    return found.select(F.col("g").alias(by), q.alias("q")) if by else found.select(q.alias("q"))


def quantile_edges(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """One row with the distinct edges of n quantile bins."""
    return exact_quantiles(df, value, [i / n for i in range(n + 1)]).select(F.array_distinct("q").alias("edges"))


def quantile_bin(df: DataFrame, value: str, n: int = 10, out: str = "bin") -> DataFrame:
    """Bins by quantile, closed on the right; equal edges are one, so ties never straddle bins."""
    edges = quantile_edges(df, value, n)
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    with_edges = df.join(F.broadcast(edges), how="cross")  # one row of n + 1 numbers
    return with_edges.withColumn(out, F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(value))).cast("long"))).drop("edges")


def winsorised_z(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns held within two quantiles, then standardised (sample deviation; 1 where it is 0)."""
    held = df
    for c in cols:
        held = held.join(F.broadcast(exact_quantiles(df, c, (low, high)).withColumnRenamed("q", f"_q_{c}")), how="left", on=F.lit(True))  # one row
    held = held.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_q_{c}")[0]), F.col(f"_q_{c}")[1])) for c in cols}).drop(*[f"_q_{c}" for c in cols])
    m = held.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    out = held.join(F.broadcast(m), how="cross")
    sd = lambda c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / sd(c) for c in cols}).drop(*[f"_{k}_{c}" for c in cols for k in "ms"])


def collapse_rare(df: DataFrame, col: str, least: int, other: str, out: str) -> DataFrame:
    """Values with fewer than `least` rows become `other`."""
    n = df.groupBy(col).agg(F.count("*").alias("_n"))
    return df.join(n, col, "left").withColumn(out, F.when(F.col("_n") >= least, F.col(col)).otherwise(other)).drop("_n")


def top_categories(df: DataFrame, col: str, n: int, other: str, out: str) -> DataFrame:
    """The n most frequent values stay (ties by name), the rest becomes `other`."""
    top = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), col).limit(n).select(col, F.lit(True).alias("_top"))
    return df.join(F.broadcast(top), col, "left").withColumn(out, F.when(F.col("_top"), F.col(col)).otherwise(other)).drop("_top")


def global_average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks over all rows, ties sharing their average: of the distinct values, then joined back. Nulls have no rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    ranks = global_prefix(counts, value, F.col("_c"), "_before").select(value, (F.col("_before") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(ranks, value, "left")


def gini(df: DataFrame, value: str) -> DataFrame:
    """The Gini coefficient by the rank formula, over the distinct values and how often each occurs."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    placed = global_prefix(counts, value, F.col("_c"), "_before")
    n = counts.agg(F.sum("_c").alias("_n"))
    v, c = F.col(value), F.col("_c")
    total = placed.agg(F.sum(v * c * (2 * F.col("_before") + c)).alias("_a"), F.sum(v * c).alias("_s"))
    return total.join(F.broadcast(n), how="cross").select(((F.col("_a") - F.col("_n") * F.col("_s")) / (F.col("_n") * F.col("_s"))).alias("gini"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation over rows that have both values; null where either side doesn't vary."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if by:
        ranked = both.withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    else:
        ranked = global_average_rank(global_average_rank(both, x, "_x"), y, "_y")
    rho = F.when((F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0), F.corr("_x", "_y"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("rho"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two yes/no columns with its confusion counts."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    c = df.agg(F.sum(x * y).alias("both"), F.sum(x * (1 - y)).alias("only_a"), F.sum((1 - x) * y).alias("only_b"), F.sum((1 - x) * (1 - y)).alias("neither"))
    n = F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither")
    po = (F.col("both") + F.col("neither")) / n
    pe = ((F.col("both") + F.col("only_a")) * (F.col("both") + F.col("only_b")) + (F.col("only_b") + F.col("neither")) * (F.col("only_a") + F.col("neither"))) / (n * n)
    return c.select("*", po.alias("agreement"), F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"))


def stratified_sample(df: DataFrame, by: Sequence[str], key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of each group, the same ones on every run and every partitioning."""
    order = F.sha2(F.concat(F.col(key).cast("string"), F.lit("|" + seed)), 256)
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def runs_of(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Each row's place in its run of equal values (gaps and islands)."""
    w = W.partitionBy(*by).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("long"), F.lit(1))
    marked = df.withColumn("_run", F.sum(F.when(F.row_number().over(w) == 1, 1).otherwise(new)).over(w))
    return marked.withColumn("run_length", F.row_number().over(W.partitionBy(*by, "_run").orderBy(*order)))
