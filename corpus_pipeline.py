"""Curation of a corpus in five stages, each over all that the one before it kept.

1 language   documents without a recognisable language go (und, or ambiguous)
2 lines      lines that equal or nearly equal an earlier one go from the texts, and documents of which nothing is left
3 copies     of each group of near-duplicates one document stays
4 benchmark  documents with a passage of a benchmark item go
5 mixture    documents get a domain and a rate; those with rate 0 go

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. n_chars follows the text. Nulls, ties, repeated rows and empty tables are as the operators
define them (ids are integers): a null text has no language, so it goes in the first stage. Documents are told by doc_id and text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelab.llm import common, decontaminate, jaccard, langid, line_dedup, mixing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is told: null texts, texts without a letter and ambiguous ones go."""
    model = langid.train(docs.where(~langid.held_out()))
    named = langid.identify(docs, model)
    return named.where(f"lang_pred <> '{langid.UND}' and not ambiguous").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that equal or nearly equal an earlier one; those that lose all they had go, since they are
    copies; texts that were blank before stay. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).where(~((F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")))
    return common.with_text_size(out.select(*docs.columns))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates; blank texts and null ids stay."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without a passage of a benchmark item."""
    found = decontaminate.decontaminate(docs, common.documents(spark, sf_dir, "benchmark"))
    return found.where("size(hit_spans) = 0").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with n_tokens, domain and the rate at which the mixture takes them; those with rate 0 go."""
    out = mixing.mix(docs, common.documents(spark, sf_dir, "labels"))
    return out.where("rate > 0").select(*docs.columns, "n_tokens", "domain", "rate")


STAGES = [("language", language), ("lines", lines), ("copies", copies), ("benchmark", benchmark), ("mixture", mixture)]

#: The language model and the domain classifier can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last gives is written to the shared folder and read again."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:  # nothing reads the stage before any more
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{STAGES[k - 1][0]}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
