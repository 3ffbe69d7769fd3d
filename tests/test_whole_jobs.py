"""Queries take all of their rows: small tables on which a cut would show."""

import pytest

from citelab.plans import core, designs, statistics

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    """Writes rows of documents (and others) and gives their folder."""

    def put(rows, schema=DOCS, name="documents"):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def test_first_run_reads_all_rows(spark, folder):
    at = folder([(i, "t", "en", s, 1) for i, s in ((3, "a"), (4, "a"), (6, "b"), (7, "c"))])
    assert {(r.query_id, r.run_index, r.doc_id) for r in core.first_run(spark, at).collect()} == {("a", 1, 3), ("b", 1, 6), ("c", 1, 7)}
    # run 1 missing
    k = spark.createDataFrame([(5, "en", "q", 3), (8, "en", "q", 2), (9, "en", "p", 2), (1, "en", "p", 1)], "doc_id long, engine string, query_id string, run_index long")
    assert {(r.query_id, r.run_index, r.doc_id) for r in core.first_of(k).collect()} == {("q", 2, 8), ("p", 1, 1)}


def test_cost_estimates_read_all_rows(spark, folder):
    at = folder([(10, "a b", "en", "s", 1), (11, "a b c d", "en", "s", 1), (13, "a", "de", "s", 1)])
    assert {r.lang: (r.sync, r.batched) for r in designs.cost_estimates(spark, at).collect()} == {"en": (0.06, 0.03), "de": (0.02, 0.01)}


def test_zero_shot_labels_read_whole_texts(spark, folder):
    at = folder([(1, "the " + "x" * 2000 + " der die und das", "de", "s", 1)])
    assert [(r.doc_id, r.label, r.score) for r in designs.zero_shot_labels(spark, at).collect()] == [(1, "de", 4.0)]


def test_clustered_models_fit_every_engine(spark, folder):
    say = lambda i: "\n".join(["word " * (1 + i * 7 % 11)] * (1 + i % 4))
    rows = [(i, say(i), lang, f"s{i % 5}", 1) for j, lang in enumerate(("de", "en", "it")) for i in range(40 * j, 40 * j + 40)]
    folder([(i, i * 3 % 7 % 2, 0) for i in range(121)], "doc_id long, quality long, toxic long", "labels")
    got = statistics.clustered_models(spark, folder([*rows, (120, "alone", "xx", "s", 1)])).collect()
    assert {(r.outcome, r.engine) for r in got} == {(o, e) for o in ("quality", "toxic", "log_words", "log_chars") for e in ("de", "en", "it", "xx")}
    # toxic and log_chars don't vary here
    assert all((r.beta is None) == (r.engine == "xx" or r.outcome in ("toxic", "log_chars")) and (r.q is None) == (r.beta is None or r.feature.startswith("tier") or r.feature == "log_n_cited") for r in got)
    assert all((r.n, r.groups) == ((1, 1) if r.engine == "xx" else (40, 5)) for r in got)


def test_search_composition_has_no_cap(spark, folder):
    at = folder([*[(6 * i + 1, "t", "en", "a", 1) for i in range(9)], *[(6 * i + 2, "t", "en", "b", 1) for i in range(5)], (6, "t", "en", "c", 1)])
    assert {(r.engine, r.searched, r.n_cells) for r in core.search_composition(spark, at).collect()} == {("en", 9, 1), ("en", 5, 1), ("en", 0, 1)}


def test_repeat_bootstrap_draws_as_often_as_the_default(spark, folder):
    from citelab.operators import resampling

    at = folder([(i, "t", "en", "a", i * i) for i in range(8)])
    want = resampling.bootstrap_se(spark.createDataFrame([("en", "a", float(i * i)) for i in range(8)], "lang string, source string, v double"), ["lang", "source"], "v", draws=1000)
    assert sorted(statistics.repeat_bootstrap(spark, at).collect()) == [(*r[:3], round(r.se, 6)) for r in sorted(want.collect())]


def test_scores_shuffle_no_sentence(spark):
    """Sentences meet their sources where they are read; the plan deals nothing but the sizes' counts."""
    from pyspark.sql import functions as F

    from citelab.sources import driver_tables as D

    sf = "/root/testdata/sf0.001"
    s = D.sentences(spark, sf).select("doc_id", "sentence_idx", F.split("sentence_text", " ").alias("ts"))
    plan = D.lexical_scores(D.cited(spark, sf, s), D.table(spark, sf, "benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    rows = D.cited(spark, sf, s.select("doc_id", "sentence_idx"))
    assert rows.count() == s.join(D.citations(spark, sf), "doc_id").count() > 0


def test_texts_are_segmented_once(spark, folder):
    """The plan splits each text once and strips each sentence once; answers without a sentence give no row."""
    from citelab.sources import driver_tables as D

    at = folder([(1, " One two three four. # x?  Yes! ", "en", "s", 1), (2, " ", "en", "s", 1), (3, None, "en", "s", 1)])
    s = D.segmented(spark, at)
    assert [(r.doc_id, r.sentence_idx, r.sentence_text, r.word_count, r.is_artifact, r.n_sentences) for r in s.orderBy("sentence_idx").collect()] == [(1, 1, "One two three four.", 4, False, 3), (1, 2, "# x?", 2, True, 3), (1, 3, "Yes!", 1, True, 3)]
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?])") == 1 and plan.count("regexp_replace(sentence_text") == 1


def test_artifacts_by_their_words(spark):
    """As by counting all words, for any white space."""
    import re

    from pyspark.sql import functions as F

    from citelab.functions import text

    cases = ["", " ", "a b c", "a b c d", " a  b\tc\n", "a\u00a0b\u2003c d", "a\u00a0b c", "# a b c d e", "1. 2. 3. 4.", "- - - - -", "1 2 3 4 5 6 7 8", "x" * 5000, "a " * 4000, "ä ö ü ß", "a b c\x1cd", "....", ". . . . . .", None]
    white = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

    def want(c):
        t = re.sub(f"^[{white}]+|[{white}]+$", "", c or "")
        return t == "" or t.startswith("#") or len([w for w in re.split(f"[{white}]+", t) if w]) <= 3 or bool(re.fullmatch(r"[#\-*0-9.\t-\r ]{1,10}", t))

    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text.is_artifact(F.col("t")).alias("a")).collect()
    assert {r.i: r.a for r in got} == {i: want(c) for i, c in enumerate(cases)}


def test_chunked_claims_are_dealt_once(spark):
    """Claims are shuffled by answer; neither their chunks nor what is counted by answer and chunk shuffles them again."""
    from pyspark.sql import functions as F

    from citelab.operators import judging as J

    claims = spark.range(600).select(F.floor(F.col("id") / 60).alias("doc_id"), (F.floor(F.col("id") % 60 / 3) + 1).alias("sentence_idx"), (F.col("id") % 3).alias("citation_position"), (F.col("id") % 7 / 7).alias("claim"))
    v = J.answer_in_chunks(claims, 5, lambda c: F.to_json(F.transform(c, lambda x: x["claim"] >= 0.5)))
    per = v.groupBy("doc_id", "citation_position", F.floor((F.col("sentence_idx") - 1) / 5)).agg(F.count("verdict").alias("n"))
    assert [r.n for r in per.collect()] == [5] * 120
    assert per._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
