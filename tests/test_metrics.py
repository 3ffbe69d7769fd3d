"""Measures on hand-computed cells, and properties that hold for all."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citelab.operators import metrics as M

SENT = "doc_id long, sentence_idx long, sentence_text string, word_count long, position_weight double, is_artifact boolean, n_sentences long"
SCORE = "doc_id long, sentence_idx long, citation_position long, entail_score double"
CIT = "doc_id long, citation_position long, item_id long, page_id long, fetch_status string"


def star(spark, sents, cits, scores):
    docs = spark.createDataFrame([(d,) for d in {s[0] for s in sents} | {c[0] for c in cits} | {99}], "doc_id long")
    n = {}
    for d, *_ in sents:
        n[d] = n.get(d, 0) + 1
    rows = [(d, i, "t", wc, (n[d] - i + 1) / n[d], art, n[d]) for d, i, wc, art in sents]
    return docs, spark.createDataFrame(rows, SENT), spark.createDataFrame([(d, p, 0, 0, s) for d, p, s in cits], CIT), spark.createDataFrame(scores, SCORE)


def test_four_sentences_two_sources(spark):
    words, one, two = [10, 8, 12, 6], [1, 1, 0, 0], [1, 0, 1, 0]
    tables = star(spark, [(1, i + 1, w, False) for i, w in enumerate(words)], [(1, 1, "ok"), (1, 2, "ok")], [(1, i + 1, p, float(x) * 0.5) for p, col in ((1, one), (2, two)) for i, x in enumerate(col)])
    r = {x.doc_id: x for x in M.cleaned_metrics(*tables).collect()}
    assert r[1].cleaned_ais == 0.75 and r[1].cleaned_pawc_total == 32 and r[1].omega == 23.5
    assert abs(r[1].pawc_norm - 32 / 47) < 1e-12 and abs(r[1].coverage - 0.9) < 1e-12
    assert {x.citation_position: x.pawc for x in M.pawc_by_source(tables[1], tables[3]).collect()} == {1: 16.0, 2: 16.0}
    assert r[99].cleaned_ais is None and r[99].pawc_norm is None and r[99].cleaned_pawc_total == 0


def test_edge_cells(spark):
    """Only artifacts; no fetched source; a score that is exactly the threshold."""
    tables = star(spark, [(1, 1, 2, True), (2, 1, 5, False), (3, 1, 5, False)], [(1, 1, "ok"), (2, 1, "http_403"), (3, 1, "ok")], [(1, 1, 1, 1.0), (3, 1, 1, 0.5)])
    r = {x.doc_id: x for x in M.cleaned_metrics(*tables).collect()}
    assert (r[1].cleaned_ais, r[1].cleaned_pawc_total, r[1].pawc_norm, r[1].n_artifacts) == (None, 0.0, None, 1)
    assert r[2].cleaned_ais == 0 and r[2].pawc_norm is None and r[3].cleaned_ais == 1 and r[3].pawc_norm == 1


def test_cv_reaches_the_root_of_the_repeats(spark):
    rows = [("e", "q", float(v), 0.5, None, n) for v, n in ((0, 0), (0, 1), (0, 1), (9, 2))] + [("e", "z", 0.0, None, None, 1)] * 3
    df = spark.createDataFrame(rows, "engine string, query_id string, cleaned_pawc_total double, cleaned_ais double, pawc_norm double, n_cited long")
    r = {x.query_id: x for x in M.cell_aggregates(df).collect()}
    assert abs(r["q"].pawc_cv - 2) < 1e-12 and r["q"].ais_cv == 0 and r["z"].pawc_cv is None and r["z"].ais_cv is None
    assert r["q"].did_search_rate == 0.75 and not r["q"].citations_consistent and r["z"].citations_consistent and r["z"].n_runs_ais == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 30), st.booleans()), min_size=1, max_size=8), st.data())
def test_bounds_and_monotone(spark, sents, data):
    m = data.draw(st.integers(1, 3))
    scores = [(1, i + 1, p, data.draw(st.sampled_from([0.0, 0.3, 0.45, 0.5, 0.65, 1.0]))) for i in range(len(sents)) for p in range(1, m + 1)]
    tables = star(spark, [(1, i + 1, wc, a) for i, (wc, a) in enumerate(sents)], [(1, p, "ok") for p in range(1, m + 1)], scores)
    rows = sorted((r.tau, r.cleaned_ais, r.pawc_norm) for r in M.tau_sweep(*tables).where("doc_id = 1").collect())
    for i, col in ((1, "ais"), (2, "norm")):
        values = [r[i] for r in rows]
        if all(s[1] for s in sents):
            assert values == [None] * 5, col
        else:
            assert all(0 <= v <= 1 + 1e-9 for v in values) and all(a >= b - 1e-12 for a, b in zip(values, values[1:], strict=False))
    clean = M.cleaned_metrics(*tables).where("doc_id = 1").first()
    assert clean.n_artifacts + clean.cleaned_n == len(sents)
    assert math.isclose(clean.cleaned_ais or 0, next((a for t, a, _ in rows if t == 0.5), 0) or 0)


def test_events(spark):
    docs, sents, cits, scores = star(spark, [(1, 1, 5, False), (1, 2, 5, True)], [(1, 1, "ok"), (1, 2, "http_403"), (1, 3, "ok")], [(1, 1, 1, 0.6), (1, 1, 3, 0.1), (1, 2, 3, 1.0)])
    r = {x.citation_position: x for x in M.citation_events(docs, sents, cits, scores).collect()}
    assert [r[i].rel_position for i in (1, 2, 3)] == [0, 0.5, 1] and r[2].pairs_n is None and r[3].pairs_n == 1
    assert r[1].supported_share == 1 and r[3].contradiction_share == 1 and r[2].fetch_ok == 0


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.49, 0.5, 1.0)], "s double")
    assert [r[0] for r in df.select(M.bands(F.col("s"), (0.3, 0.5), ("a", "b", "c"))).collect()] == ["a", "b", "b", "c", "c"]


@pytest.mark.parametrize("tau", [0.3, 0.7])
def test_norm_parts_add_up(spark, tau):
    tables = star(spark, [(1, 1, 4, True), (1, 2, 6, False), (1, 3, 9, False)], [(1, 1, "ok"), (1, 2, "http_403")], [(1, i, 1, 0.5) for i in (1, 2, 3)])
    r = M.norm_variants(*tables, tau=tau).where("doc_id = 1").first()
    assert abs(r.part_sources + r.part_mass + r.part_both - r.difference) < 1e-9


def test_prominence_is_one_value_in_every_order(spark):
    """Words by tenths add up to 24.8; as doubles they give 24.8, 24.799999999999997 or 24.800000000000004 by the order of the rows."""
    words = [(1, 5), (2, 1), (3, 7), (4, 3), (5, 2), (6, 9), (7, 4), (8, 6), (9, 8), (10, 5)]
    want = sum(w * (10 - k + 1) for k, w in words) / 10
    seen = set()
    for turn in range(10):
        rows = words[turn:] + words[:turn]
        docs, sents, cits, scores = star(spark, [(1, k, w, False) for k, w in words], [(1, 1, "ok")], [(1, k, 1, 1.0) for k, _ in rows])
        seen |= {r.pawc for r in M.pawc_by_source(sents, scores.coalesce(1)).collect()}
    assert seen == {want}
