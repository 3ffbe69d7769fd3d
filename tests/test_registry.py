"""The registry of queries."""

import pytest

from citelab.sources import registry as R


def test_load_falls_back(spark, tmp_path):
    df = spark.createDataFrame([("q",)], "query_text string")
    df.write.parquet(str(tmp_path / "b" / "train.parquet"))
    got, config, split = R.load(spark, str(tmp_path), ("a", "b"))
    assert (config, split, got.count()) == ("b", "train", 1)
    with pytest.raises(R.NoSuchDataset):
        R.load(spark, str(tmp_path), ("a",))


def test_ids_samples_and_rules(spark):
    rows = [("who is x",), (" who is x ",), ("www.a.com",), ("  ",), (None,), *[(f"query {i}",) for i in range(20)]]
    reg = R.registry(spark.createDataFrame(rows, "query_text string"))
    got = {r.query_text: r for r in reg.collect()}
    assert len(got) == 22 and got["who is x"].n_rows == 2 and R.collisions(reg).count() == 0
    assert all(r.query_id.startswith("gb_") and len(r.query_id) == 19 for r in got.values())
    a, b = R.seeded_sample(reg, 5), R.seeded_sample(reg.repartition(3), 5)
    assert a.collect() == b.collect() and R.seeded_sample(reg, 5, 7).collect() != a.collect()


def test_facets(spark):
    f = spark.createDataFrame([("1", "www.a.com", "x", "y", "simple", None), ("2", "why", "x", "y", "odd", " ")], "query_id string, query_text string, domain string, response_type string, complexity string, intent string")
    ruled = {r.query_id: (r.domain, r.response_type) for r in R.with_url_rule(f).collect()}
    assert ruled == {"1": ("link", "navigation"), "2": ("x", "y")}
    assert [(r["check"], r.passed) for c in R.facet_checks(f) for r in c.collect()] == [("facet complexity", False), ("facet intent", False)]
    p = spark.createDataFrame([("1", "complex", "informational"), ("2", "complex", None)], "query_id string, complexity string, intent string")
    got = {r.query_id: (r.complexity, r.intent, r.filled) for r in R.fill_blanks(f, p, ["complexity", "intent"]).collect()}
    assert got == {"1": ("simple", "informational", 1), "2": ("odd", " ", 0)}
