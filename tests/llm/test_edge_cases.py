"""Texts longer than a step, empty tables, clashing columns and repeats through operators whose own tests leave them out."""

import hashlib

import pytest
from pyspark.sql import functions as F

from citelab.llm import chat_format, common, decontaminate, jaccard, langid, pii, suffix_dedup, tiff

DOCS = "doc_id long, text string"
#: More than one step of bytes, without much that repeats.
LONG = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[: 4 + i % 9] for i in range(150_000))


def test_long_texts_are_longer_than_a_step():
    assert len(LONG) > common.STEP_BYTES


@pytest.fixture(scope="module")
def long_docs(spark):
    words = LONG.split()
    end = " ".join(words[-60:])
    return spark.createDataFrame([(1, LONG), (2, "some words before " + end), (3, LONG + " one more"), (4, None), (5, "")], DOCS)


def test_decontamination_of_long_texts(spark, long_docs):
    words = LONG.split()
    items = spark.createDataFrame([("a", " ".join(words[120_000:120_015])), ("b", " ".join(words[-12:])), ("c", "nothing of this is there at all in any of the texts")], "item_id string, text string")
    got = {r.doc_id: [(s.start, s.end) if hasattr(s, "start") else tuple(s) for s in r.hit_spans] for r in decontaminate.decontaminate(long_docs, items).collect()}
    assert {d: len(s) for d, s in got.items()} == {1: 2, 2: 1, 3: 2, 4: 0, 5: 0}


def test_near_duplicates_of_long_texts(spark, long_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(long_docs).collect()}
    n = len(set(zip(*(LONG.split()[k:] for k in range(5)), strict=False)))
    assert got[1] == (n, 1) and got[3] == (n + 2, 1) and got[2][1] == 2 and got[4] == (0, 4) and got[5] == (0, 5)


def test_near_duplicates_of_odd_tables(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, "other words", "z"), (None, "a b c d e f", "w")]
    df = spark.createDataFrame(rows, DOCS + ", source string").withColumns({c: F.lit("own") for c in ("n_shingles", "component_id", "h", "key", "rep", "k", "n")})
    got = jaccard.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3)]


def test_languages_of_long_texts(spark, long_docs):
    taught = spark.createDataFrame([(i, t, g) for i in range(20) for t, g in ((f"the of and this is {i}", "en"), (f"der die und das ist {i}", "de"))], "doc_id long, text string, lang string").withColumn("doc_id", F.monotonically_increasing_id())
    model = langid.train(taught)
    docs = spark.createDataFrame([(1, "der und die das ist " * 60_000), (2, "the and of this is " * 60_000), (3, "1 2 3 " * 200_000)], DOCS)
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()} == {1: "de", 2: "en", 3: "und"}


def test_pages_of_long_texts(spark, long_docs, tmp_path):
    long_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in tiff.op9_tiff(spark, str(tmp_path)).collect()}
    for doc_id, text in ((1, LONG), (3, LONG + " one more"), (4, ""), (5, "")):
        raw = text.encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert (got[doc_id].n_bytes, got[doc_id].payload_bytes, got[doc_id].payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert tiff.op9_tiff(spark, str(tmp_path / "none")).count() == 0


def test_repeated_strings_of_long_texts(spark, long_docs, tmp_path):
    """All of one is in the other, and the short one's end is in both."""
    long_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    tail = len(" " + " ".join(LONG.split()[-60:]))
    assert got[1].n_removed == len(LONG) and got[1].n_spans == 1 and got[3].n_removed == len(LONG) and got[4].n_bytes == got[5].n_bytes == 0
    assert got[2].n_removed == (tail if tail >= 400 else 0)


def test_repeated_turns_and_extra_columns(spark):
    rows = [(0, 1, "user", "hi"), (0, 1, "user", "hi"), (0, 2, "assistant", "yes"), (1, 1, None, None), (1, None, "user", "first"), (1, 2, "assistant", "no"), (None, 1, "user", "nobody")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("chosen", "rejected", "n_prefix", "prompt")})
    got = {r.conv_id: r for r in chat_format.format_pairs(chat_format.mismatched_pairs(df)).collect()}
    assert set(got) == {0, 1} and got[0].n_prefix == 2 and got[0].prompt.count("hi") == 2 and got[1].prompt.startswith("<|user|>\nfirst")


def test_the_query_of_pseudonyms_has_a_key_of_its_own(spark, tmp_path):
    """The same rows in every process, other ones than the operator's and than with the session's key."""
    spark.createDataFrame([(1, "card 4111 1111 1111 1111, 10.1.2.3"), (2, None)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    text = lambda df, c: {r.doc_id: r[c] for r in df.collect()}[1]
    first = text(pii.op8_pii(spark, str(tmp_path)), "text")
    assert first == text(pii.pseudonymise(docs, pii.QUERY_KEY), "clean_text") != text(pii.pseudonymise(docs), "clean_text")
    spark.conf.set(pii.SETTING, "another key")
    try:
        assert text(pii.op8_pii(spark, str(tmp_path)), "text") == text(pii.pseudonymise(docs, "another key"), "clean_text") != first
    finally:
        spark.conf.unset(pii.SETTING)


def test_places_of_lines_keep_their_order(spark):
    """Places fit into 64 bits where ids allow it, and lines are told apart in the same order where they don't."""
    from citelab.llm import line_dedup

    base = [f"word{i}." for i in range(24)]
    say = lambda *gone: " ".join(w for i, w in enumerate(base) if i not in gone)
    docs = [(7, "x\n" * 5 + say(3)), (-4, say() + "\n\n" + say(20)), (900, say(5, 6))]
    for more, kind in (([], "bigint"), ([(None, say(9)), (2**63 - 1, say(1)), (-(2**63), say(2))], "decimal(38,0)")):
        df = spark.createDataFrame(docs + more, "doc_id long, text string")
        lines = line_dedup.occurrences(df)
        distinct = line_dedup.distinct_lines(lines)
        placed = line_dedup.placed(lines.withColumn("was", F.col("at")), distinct)
        assert dict(placed.dtypes)["at"] == kind
        rows = placed.select("at", "was").collect()
        firsts = {r["first"] for r in distinct.collect()}
        assert firsts <= {r.was for r in rows} and [r.was for r in sorted(rows)] == sorted(r.was for r in rows)
        got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(df).select("doc_id", "text", "n_removed").collect()}
        assert got == set(line_dedup.brute_force(docs + more))
