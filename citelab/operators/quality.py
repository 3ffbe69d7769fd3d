"""Checks of tables, each as a row (check, passed, detail), and what to do when one fails."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "check string, passed boolean, detail long"


def _row(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """One aggregate: the number of bad things, which must be 0."""
    return df.agg(F.coalesce(bad, F.lit(0)).cast("long").alias("detail")).select(F.lit(name).alias("check"), (F.col("detail") == 0).alias("passed"), "detail")


def count_where(df: DataFrame, name: str, cond: Column) -> DataFrame:
    return _row(df, name, F.sum(F.coalesce(cond, F.lit(False)).cast("long")))


def conditions(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """A check for each named condition that no row may fulfil, all in one pass over df."""
    counts = df.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(f"n{i}") for i, c in enumerate(bad.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), (F.col(f"n{i}") == 0).alias("passed"), F.col(f"n{i}").alias("detail")) for i, name in enumerate(bad)])
    return counts.select(F.inline(rows))


def outside(col: str, low: float = 0.0, high: float = 1.0, slack: float = 1e-9) -> Column:
    return (F.col(col) < low - slack) | (F.col(col) > high + slack)


def unknown(col: str, allowed: Sequence[str]) -> Column:
    return F.col(col).isNotNull() & ~F.col(col).isin(*allowed)


def one_value(df: DataFrame, name: str, col: str) -> DataFrame:
    return _row(df, name, F.greatest(F.count_distinct(col) - 1, F.lit(0)))


def unique(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Counts the copies beyond the first of each key."""
    return _row(df.groupBy(*keys).agg((F.count("*") - 1).alias("extra")), name, F.sum("extra"))


def in_bounds(df: DataFrame, name: str, col: str, low: float = 0.0, high: float = 1.0, slack: float = 1e-9) -> DataFrame:
    return count_where(df, name, outside(col, low, high, slack))


def in_vocabulary(df: DataFrame, name: str, col: str, allowed: Sequence[str]) -> DataFrame:
    return count_where(df, name, unknown(col, allowed))


def exclusive(df: DataFrame, name: str, key: str, label: str) -> DataFrame:
    """A key has one label only."""
    return _row(df.groupBy(key).agg(F.count_distinct(label).alias("n")), name, F.sum((F.col("n") > 1).cast("long")))


def same_counts(a: DataFrame, b: DataFrame, name: str, col: str) -> DataFrame:
    """Categories keep their numbers through a relabelling."""
    x = a.groupBy(col).agg(F.count("*").alias("x"))
    y = b.groupBy(col).agg(F.count("*").alias("y"))
    j = x.join(y, x[col].eqNullSafe(y[col]), "full")
    return _row(j, name, F.sum((~F.col("x").eqNullSafe(F.col("y"))).cast("long")))


def non_increasing(df: DataFrame, name: str, key: str, order: str, value: str) -> DataFrame:
    """value never grows with order within a key; null counts as nothing."""
    from pyspark.sql import Window as W

    last = F.lag(F.coalesce(value, F.lit(0.0))).over(W.partitionBy(key).orderBy(order))
    return count_where(df.withColumn("_last", last), name, F.coalesce(F.col(value), F.lit(0.0)) > F.col("_last") + 1e-9)


def at_threshold(df: DataFrame, name: str, col: str, tau: float, slack: float = 1e-12) -> DataFrame:
    """Values so near a threshold that rounding decides."""
    return count_where(df, name, F.abs(F.col(col) - tau) < slack)


def schema_equals(spark: SparkSession, df: DataFrame, name: str, expected: T.StructType) -> DataFrame:
    """Names, types and their order."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    bad = sum(a != b for a, b in zip(have, want, strict=False)) + abs(len(have) - len(want))
    return spark.range(1).select(F.lit(name).alias("check"), F.lit(bad == 0).alias("passed"), F.lit(bad).cast("long").alias("detail"))


def dropped_citations(df: DataFrame, name: str, raw: str, found: str, mark: str = "url_citation") -> DataFrame:
    """Raw answers that speak of citations although none was read."""
    return count_where(df, name, (F.col(found) == 0) & (F.size(F.split(F.col(raw), mark)) > 1))


#: The primes that a fingerprint's sums are taken by.
MODULI = (2147483647, 2147483629)


def fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(rows, first, second) of a table's rows as a multiset, whatever their order.

    Each row's MD5 gives two numbers; they are added up by two primes. Sums, unlike exclusive ors, tell how often a row occurs: a table in
    which two copies of one row have become two of another has another fingerprint."""
    parts = [F.concat(F.lit("="), F.col(c).cast("string")) for c in cols]
    row = F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("-")) for p in parts]))
    number = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("long")
    total = lambda at, m: F.pmod(F.coalesce(F.sum(F.pmod(number(at), F.lit(m)).cast("decimal(38,0)")), F.lit(0)), F.lit(m)).cast("long")
    return df.agg(F.count("*").alias("rows"), total(1, MODULI[0]).alias("first"), total(17, MODULI[1]).alias("second"))


def freeze(df: DataFrame, path: str) -> None:
    """Writes a table, and beside it its fingerprint over all columns."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    stored = df.sparkSession.read.parquet(f"{path}/table")
    fingerprint(stored, stored.columns).coalesce(1).write.mode("overwrite").json(f"{path}/fingerprint")


def frozen(spark: SparkSession, path: str, name: str, table: DataFrame | None = None) -> DataFrame:
    """Whether a frozen table, or another that should be the same, still has the fingerprint that was stored; detail counts what differs."""
    table = spark.read.parquet(f"{path}/table") if table is None else table
    kinds = "rows long, first long, second long"
    both = fingerprint(table, table.columns).crossJoin(spark.read.schema(kinds).json(f"{path}/fingerprint").selectExpr("rows as r", "first as f", "second as s"))  # a row each
    return _row(both, name, F.sum((F.col("rows") != F.col("r")).cast("long") + (F.col("first") != F.col("f")).cast("long") + (F.col("second") != F.col("s")).cast("long")))


def leaves(df: DataFrame) -> DataFrame:
    """(path, type, n_values) of a nested table: every leaf of its schema and how many values it has in all rows."""

    def found(c: Column, kind: T.DataType, at: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from found(c[f.name], f.dataType, f"{at}.{f.name}")
        elif isinstance(kind, T.ArrayType):
            for path, leaf, count in found_in(kind.elementType, f"{at}[]"):
                yield path, leaf, total_of(count)(c)
        else:
            yield at, kind, c.isNotNull().cast("long")

    def field_of(count, name: str):
        return lambda e: count(e[name])

    def total_of(count):
        return lambda e: F.coalesce(F.aggregate(F.transform(e, count), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))

    def found_in(kind: T.DataType, at: str):
        """Leaves of an array's elements, each with a function that counts its values in one element."""
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                for path, leaf, count in found_in(f.dataType, f"{at}.{f.name}"):
                    yield path, leaf, field_of(count, f.name)
        elif isinstance(kind, T.ArrayType):
            for path, leaf, count in found_in(kind.elementType, f"{at}[]"):
                yield path, leaf, total_of(count)
        else:
            yield at, kind, lambda e: e.isNotNull().cast("long")

    rows = [r for f in df.schema.fields for r in found(F.col(f.name), f.dataType, f.name)]
    counts = df.agg(*[F.sum(c).alias(f"n{i}") for i, (_, _, c) in enumerate(rows)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(path).alias("path"), F.lit(kind.simpleString()).alias("type"), F.coalesce(f"n{i}", F.lit(0)).alias("n_values")) for i, (path, kind, _) in enumerate(rows)])))


def checklist(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


class QualityError(AssertionError):
    pass


def require(checks: DataFrame) -> None:
    """Raises with the names of the checks that failed."""
    failed = [r["check"] for r in checks.where(~F.col("passed")).orderBy("check").limit(50).collect()]
    if failed:
        raise QualityError(", ".join(failed))
