"""Raw captures: one JSON file per engine, query and run, with a fixed envelope around a provider's answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTS = ("query_id", "engine", "model_requested", "model_served", "timestamp_utc", "query_text", "answer_text", "run_profile")
OBJECTS = ("request_params", "raw_response", "usage")
#: Objects differ by provider, so they are kept as JSON text and read by the adapter of the engine.
ENVELOPE = T.StructType([*[T.StructField(n, T.StringType()) for n in (*TEXTS, *OBJECTS)], T.StructField("run_index", T.LongType()), T.StructField("_corrupt_record", T.StringType())])
KEY = ("engine", "query_id", "run_index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All captures below path. A file that isn't JSON becomes a row with _corrupt_record; nothing is inferred."""
    return spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).json(path)


def reconstruct(raw: DataFrame, profile: str = "scaleup") -> tuple[DataFrame, DataFrame]:
    """(good, bad): the envelope with its defaults, and the rows that can't be used. Nothing is dropped silently."""
    usable = F.col("_corrupt_record").isNull() & F.col("query_id").isNotNull() & F.col("engine").isNotNull() & F.col("run_index").isNotNull()
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in TEXTS[:-1]]
    objects = [F.coalesce(F.nullif(F.col(c), F.lit("null")), F.lit("{}")).alias(c) for c in OBJECTS]
    good = raw.where(usable).select(*texts, *objects, "run_index", F.coalesce("run_profile", F.lit(profile)).alias("run_profile"))
    return good, raw.where(~usable)


class MixedProfiles(ValueError):
    pass


def single_profile(records: DataFrame) -> str | None:
    """The profile of all records; an error if there are several."""
    found = [r[0] for r in records.select("run_profile").distinct().limit(3).collect()]
    if len(found) > 1:
        raise MixedProfiles(f"records of several profiles: {sorted(found)}")
    return found[0] if found else None
