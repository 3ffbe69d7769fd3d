"""The registry of queries: loading with fallbacks, stable ids, collisions, samples, facets with a vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelab.functions import text, urls
from citelab.operators.quality import in_vocabulary


class NoSuchDataset(ValueError):
    pass


def load(spark: SparkSession, root: str, configs: Sequence[str] = ("default",), splits: Sequence[str] = ("test", "train")) -> tuple[DataFrame, str, str]:
    """The first of root/config/split.parquet that is there, in the order of preference, and which it was."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for config in configs:
        for split in splits:
            path = f"{root}/{config}/{split}.parquet"
            p = fs_path(path)
            if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                return spark.read.parquet(path), config, split
    raise NoSuchDataset(f"none of {list(configs)} x {list(splits)} below {root}")


def registry(queries: DataFrame, column: str = "query_text", key: Callable[[Column], Column] = urls.query_key) -> DataFrame:
    """One row for each id of a text, by `key`; blank texts have none."""
    named = queries.where(~text.is_blank(F.col(column))).withColumn("query_id", key(F.col(column)))
    return named.groupBy("query_id").agg(F.min(text.strip(F.col(column))).alias("query_text"), F.count("*").alias("n_rows"), F.count_distinct(text.strip(F.col(column))).alias("n_texts"))


def collisions(reg: DataFrame) -> DataFrame:
    """Ids that stand for several texts."""
    return reg.where("n_texts > 1")


def seeded_sample(reg: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The same n rows on every run, in the order of their ids."""
    return reg.orderBy(F.sha2(F.concat("query_id", F.lit(f"|{seed}")), 256), "query_id").limit(n).orderBy("query_id")


#: Facets whose values are few.
FACETS = {
    "complexity": ["simple", "intermediate", "complex"],
    "sensitivity": ["sensitive", "non-sensitive"],
    "intent": ["informational", "navigational", "transactional"],
    "content_type": ["factual", "opinion", "debate", "mixed"],
    "temporality": ["evergreen", "latest", "historical", "undefined"],
}


def facet_checks(facets: DataFrame) -> list[DataFrame]:
    return [in_vocabulary(facets, f"facet {c}", c, v) for c, v in FACETS.items() if c in facets.columns]


def with_url_rule(facets: DataFrame) -> DataFrame:
    """Queries that are addresses: domain link, response type navigation."""
    u = urls.looks_like_url(F.col("query_text"))
    return facets.withColumns({"domain": F.when(u, "link").otherwise(F.col("domain")), "response_type": F.when(u, "navigation").otherwise(F.col("response_type"))})


def fill_blanks(facets: DataFrame, predicted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Predictions go only where a facet is blank; `filled` counts them in each row."""
    p = predicted.select("query_id", *[F.col(c).alias(f"_p_{c}") for c in columns])
    j = facets.join(p, "query_id", "left")
    blank = {c: text.is_blank(F.col(c)) & F.col(f"_p_{c}").isNotNull() for c in columns}
    n = sum((b.cast("long") for b in blank.values()), F.lit(0).cast("long"))
    return j.withColumn("filled", n).withColumns({c: F.when(b, F.col(f"_p_{c}")).otherwise(F.col(c)) for c, b in blank.items()}).drop(*[f"_p_{c}" for c in columns])
