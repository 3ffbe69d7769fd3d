"""Standard errors of a mean over k repeats: by resampling, and in closed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelab.lineage import ranks, same


def analytic_se(df: DataFrame, by: Sequence[str], value: str, ks: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """What resampling tends to: the population deviation over the square root of k, per group."""
    g = df.groupBy(*by).agg(F.stddev_pop(value).alias("sd"), F.avg(value).alias("mean"))
    return g.select(*by, F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "sd", "mean").select(*by, F.col("k").cast("long").alias("k"), (F.col("sd") / F.sqrt("k")).alias("se"), F.when(F.col("mean") != 0, F.col("sd") / F.sqrt("k") / F.abs("mean")).alias("relative_se"))


def draw(n, *counter) -> Column:
    """A number below n from a counter: the first 60 bits of the counter's MD5 modulo n, so other engines draw the same."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *counter)), 1, 15), 16, 10).cast("long"), n)


def bootstrap_se(df: DataFrame, by: Sequence[str], value: str, ks: Sequence[int] = (1, 2, 3, 4, 5), draws: int = 1000, seed: int = 42) -> DataFrame:
    """Per group and k the deviation of means of k values drawn with replacement.

    A draw is a place in the group's order, from a generator that hashes (seed, group, k, draw, position), and is joined with the
    value at that place: by group and place, so the join is dealt evenly and no group stands in one task. Groups without a value have no rows."""
    by = list(by)
    values = ranks(df.where(F.col(value).isNotNull()).select(*by, value), by, value, "_rank", "_n")
    groups = values.where("_rank = 0").select(*by, "_n")
    ids = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = groups.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).withColumn("_draw", ids(F.lit(draws))).withColumn("_j", ids(F.col("k")))
    asked = asked.withColumn("_place", draw(F.col("_n"), F.lit(str(seed)), *by, "k", "_draw", "_j"))
    got = asked.alias("a").join(values.alias("b"), same(by, "a", "b") & (F.col("a._place") == F.col("b._rank")))
    means = got.groupBy(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.k").cast("long").alias("k"), "a._draw").agg(_total(F.collect_list(f"b.{value}")).alias("_sum"))
    means = means.withColumn("_mean", F.col("_sum") / F.col("k")).groupBy(*by, "k").agg(F.collect_list("_mean").alias("_m"))  # `draws` of them
    mean = _total(F.col("_m")) / draws
    return means.withColumn("_mean", mean).select(*by, "k", F.sqrt(_total(F.transform("_m", lambda m: (m - F.col("_mean")) * (m - F.col("_mean")))) / draws).alias("se"))


def _total(values: Column) -> Column:
    """The sum of an array in the order of its values, so that it is the same whatever order they came in."""
    return F.aggregate(F.array_sort(values), F.lit(0.0), lambda a, x: a + x)


def first_stable(df: DataFrame, by: Sequence[str], k: str = "k", relative: str = "relative_se", limit: float = 0.1) -> DataFrame:
    """The least k whose relative error is below the limit; null if none is."""
    return df.groupBy(*by).agg(F.min(F.when(F.col(relative) < limit, F.col(k))).alias("first_k"))
