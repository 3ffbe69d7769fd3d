"""Public suffixes and registrable domains by rules: the longest rule wins, `*` stands for one label, an exception beats all."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelab.functions import lists

#: Rules up to this number are sent to all tasks (a full list has about 10,000); more are joined by a shuffle.
SENT = 100_000


def rules(spark: SparkSession, lines: Iterable[str] = lists.SUFFIX_RULES) -> DataFrame:
    """(rule) from lines of a list in the published format: a rule ends at white space; blank lines and comments (//) say nothing."""
    kept = sorted({w[0].lower() for line in lines if (w := line.split()) and not w[0].startswith("//")})
    return spark.createDataFrame([(r,) for r in kept], "rule string")


def _joined(labels: Column, n: Column) -> Column:
    """The last n labels."""
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def with_suffixes(df: DataFrame, domain: str, known: DataFrame) -> DataFrame:
    """df with public_suffix and registrable_domain of the hosts in column `domain`.

    The suffixes of each different host are joined with the rules: one row for each label of a host and kind of rule. A host without a rule has its last
    label as suffix. registrable_domain is the suffix and one label more; null for a host that is a suffix itself, that begins with a dot or
    that is null or empty. Addresses of four numbers have neither."""
    host = F.lower(F.trim(F.col(domain).cast("string")))
    hosts = df.select(host.alias("_host")).where("_host <> '' and not startswith(_host, '.')").where(~F.col("_host").rlike(r"^\d+(\.\d+){3}$|[:\[]")).distinct()
    labels = F.split("_host", r"\.")
    each = hosts.select("_host", labels.alias("_l")).select("_host", "_l", F.explode(F.sequence(F.lit(1), F.size("_l"))).alias("_n"))
    own, above = _joined(F.col("_l"), F.col("_n")), _joined(F.col("_l"), F.col("_n") - 1)
    asked = each.select("_host", F.inline(F.array(F.struct(own.alias("rule"), F.col("_n").alias("_take"), F.lit(False).alias("_except")), F.struct(F.concat(F.lit("!"), own).alias("rule"), (F.col("_n") - 1).alias("_take"), F.lit(True).alias("_except")), F.struct(F.when(F.col("_n") > 1, F.concat(F.lit("*."), above)).alias("rule"), F.col("_n").alias("_take"), F.lit(False).alias("_except")))))
    small = known.limit(SENT + 1).count() <= SENT
    found = asked.where("rule is not null").join(F.broadcast(known) if small else known, "rule")
    best = found.groupBy("_host").agg(F.max(F.struct("_except", "_take"))["_take"].alias("_found"))
    take = F.coalesce("_found", F.lit(1))
    parts = hosts.join(best, "_host", "left").select("_host", _joined(labels, take).alias("public_suffix"), F.when(F.size(labels) > take, _joined(labels, take + 1)).alias("registrable_domain"))
    kept = df.drop("public_suffix", "registrable_domain").withColumn("_key", host)
    return kept.join(parts, F.col("_key") == F.col("_host"), "left").drop("_key", "_host")
