"""Preference formatting: the turns that a chosen and a rejected conversation share are rendered once
as the prompt; what follows in each is its completion, with the spans that a loss may count (the
assistant's words and the end of its turn).

Only DataFrame functions are used. A conversation is one row of the result, so its turns meet in one
task; no group beyond a conversation does.

Ids of conversations are integers where they are paired by mismatched_pairs(). Nulls: a null role is the empty role, a null text the empty text, a null turn number comes first;
rows whose conv_id is null belong to no conversation and are left out. Turns with the same number are
ordered by role and text; rows that repeat stay. A pair whose sides are equal has empty completions.
If either side is null there is no pair. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.llm import common

ASSISTANT = "assistant"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


END = "<|end|>\n"


def render(turns: Column) -> Column:
    """The turns (role, text) as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END))), "")


def loss_spans(turns: Column, role: str = ASSISTANT) -> Column:
    """Where render(turns) has text of `role` and the end of its turn, in characters."""
    size = lambda t: F.length(t["text"]) + len(END)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(head(t["role"]))
        end = start + size(t)
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """The length of the longest common prefix of two arrays of turns."""
    least = F.least(F.size(a), F.size(b))
    differ = F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b))).alias("i")), lambda z: ~z["a"].eqNullSafe(z["b"]))
    return F.when(least == 0, F.lit(0)).otherwise(F.least(least, F.coalesce(F.try_element_at(differ, F.lit(1))["i"], least)))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: chosen and rejected as arrays of (role, text), and any other columns, which are kept.

    Adds n_prefix, prompt, chosen_text, rejected_text, chosen_spans, rejected_spans; chosen and rejected go.
    """
    keep = [c for c in pairs.columns if c.lower() not in {"chosen", "rejected", "n_prefix", "prompt", "chosen_text", "rejected_text", "chosen_spans", "rejected_spans"}]
    chosen, rejected, n = common.unused(pairs, "chosen", "rejected", "n")
    clean = lambda c: F.transform(c, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    named = pairs.where("chosen is not null and rejected is not null").select(*keep, clean(F.col("chosen")).alias(chosen), clean(F.col("rejected")).alias(rejected))
    cut = named.withColumn(n, common_turns(F.col(chosen), F.col(rejected)))
    rest = lambda c: F.slice(c, F.col(n) + 1, F.greatest(F.size(c) - F.col(n), F.lit(0)))
    return cut.select(
        *keep,
        F.col(n).cast("long").alias("n_prefix"),
        render(F.slice(chosen, F.lit(1), F.col(n))).alias("prompt"),
        render(rest(F.col(chosen))).alias("chosen_text"),
        render(rest(F.col(rejected))).alias("rejected_text"),
        loss_spans(rest(F.col(chosen))).alias("chosen_spans"),
        loss_spans(rest(F.col(rejected))).alias("rejected_spans"),
    )


def conversations_as_rows(turns: DataFrame) -> DataFrame:
    """One row per conv_id with its turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def neighbours(turns: DataFrame) -> DataFrame:
    """(conv_id, partner, paired) of each conversation with an assistant turn: the one whose id differs in the last bit
    (paired), else the next in the order of ids, the last one's being the first; a lone conversation is its own."""
    ids = turns.where(F.col("conv_id").isNotNull() & (F.col("role") == ASSISTANT)).select("conv_id").distinct()
    ids = common.cut(ids.repartitionByRange("conv_id").select("conv_id", F.spark_partition_id().alias("p")))
    # one id a partition: where the next partition begins
    starts = sorted(r[1] for r in ids.groupBy("p").agg(F.min("conv_id")).collect())
    begins = F.array(*[F.lit(x).cast(ids.schema["conv_id"].dataType) for x in starts])
    after = F.lead("conv_id").over(W.partitionBy("p").orderBy("conv_id"))
    rows = ids.withColumn("next", after).withColumn("next", F.coalesce("next", F.try_element_at(F.filter(begins, lambda x: x > F.col("conv_id")), F.lit(1)), F.try_element_at(begins, F.lit(1))))
    twins = ids.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("conv_id").alias("twin"))
    return rows.join(twins, "conv_id", "left").select("conv_id", F.coalesce("twin", "next").alias("partner"), F.col("twin").isNotNull().alias("paired"))


def mismatched_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is a conversation up to its last assistant turn; rejected has
    the last assistant turn of its neighbour there (the conversation whose id differs in the last bit).
    Without such a neighbour the next conversation in the order of ids lends its last assistant turn, and
    rejected parts at the first assistant turn already; a conversation without any other is paired with an
    empty reply. Conversations without an assistant turn make no pair."""
    rows = conversations_as_rows(turns)
    said = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.try_element_at("turns", i)["role"] == ASSISTANT)
    ended = rows.withColumn("said", said).where(F.size("said") > 0).select("conv_id", F.slice("turns", F.lit(1), F.array_max("said")).alias("chosen"), F.array_min("said").alias("first"))
    reply = ended.select(F.col("conv_id").alias("partner"), F.try_element_at("chosen", F.lit(-1)).alias("reply"))
    both = ended.join(neighbours(turns), "conv_id").join(reply, "partner")
    empty = F.struct(F.lit(ASSISTANT).alias("role"), F.lit("").alias("text"))
    other = F.when(F.col("partner") == F.col("conv_id"), empty).otherwise(F.col("reply"))
    shared = F.when(F.col("paired"), F.size("chosen")).otherwise(F.col("first")) - 1
    return both.select("conv_id", "chosen", F.concat(F.slice("chosen", F.lit(1), shared), F.array(other)).alias("rejected"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_pairs(mismatched_pairs(common.documents(spark, sf_dir, "conversations")))
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "n_prefix", "prompt", "chosen_text", "rejected_text", as_text("chosen_spans").alias("chosen_spans"), as_text("rejected_spans").alias("rejected_spans"))
