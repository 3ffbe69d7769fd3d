"""Regression, resampling, ranks and checks against numpy and known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelab.operators import quality, regression, relational, resampling


def clustered(spark, binary, n=600, seed=3):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 30, n)
    x = rng.normal(size=(n, 2)) + rng.normal(size=30)[g][:, None] * 0.3
    eta = 0.4 + 0.8 * x[:, 0] - 0.5 * x[:, 1] + (0 if binary else rng.normal(size=30)[g] * 0.5)
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float) if binary else eta + rng.normal(size=n)
    rows = [(float(a), float(b), float(c), f"g{d}") for a, b, c, d in zip(x[:, 0], x[:, 1], y, g, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, y double, g string"), np.column_stack([np.ones(n), x]), y, g


def numpy_errors(x, resid, bread, g):
    k, groups = x.shape[1], np.unique(g)
    meat = sum(np.outer(s, s) for s in (x[g == c].T @ resid[g == c] for c in groups))
    v = bread @ meat @ bread * len(groups) / (len(groups) - 1) * (len(x) - 1) / (len(x) - k)
    return np.sqrt(np.diag(v))


def test_ols(spark):
    df, x, y, g = clustered(spark, False)
    d, names = regression.design(df, ["a", "b"])
    fit = regression.ols(d, names, "y", "g")
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    assert np.allclose(fit.beta, beta) and np.allclose(fit.se, numpy_errors(x, y - x @ beta, bread, g)) and fit.groups == 30
    assert abs(regression.two_sided(1.959964) - 0.05) < 1e-6


def test_logit(spark):
    df, x, y, g = clustered(spark, True)
    d, names = regression.design(df, ["a", "b"])
    fit = regression.logit(d, names, "y", "g")
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
        beta = beta + bread @ x.T @ (y - p)
    assert np.allclose(fit.beta, beta, atol=1e-6) and np.allclose(fit.se, numpy_errors(x, y - p, bread, g), rtol=1e-4)
    assert np.abs(fit.beta - [0.4, 0.8, -0.5]).max() < 0.4


def test_models_of_all_groups_are_those_of_each(spark):
    """fit_groups against numpy's own fits, group by group."""
    parts, want = None, {}
    for group, seed in (("u", 3), ("v", 4)):
        df, x, y, g = clustered(spark, True, seed=seed)
        z = x[:, 1] * 2 + np.sin(np.arange(len(y)))
        rows = [(group, float(a), float(b), float(c), float(d), f"g{e}") for a, b, c, d, e in zip(x[:, 1], x[:, 2], y, z, g, strict=True)]
        part = spark.createDataFrame(rows, "e string, a double, b double, y double, z double, g string")
        parts = part if parts is None else parts.union(part)
        bread = np.linalg.inv(x.T @ x)
        beta = bread @ x.T @ z
        want[group, "z"] = beta, numpy_errors(x, z - x @ beta, bread, g)
        beta = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ beta))
            bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
            beta = beta + bread @ x.T @ (y - p)
        want[group, "y"] = beta, numpy_errors(x, y - p, bread, g)
    models = [regression.Model("y", "logit"), regression.Model("z", "ols")]
    got = regression.fit_groups(parts.withColumn("same", F.lit(1.0)), "e", ["a", "b", "same"], models, "g")
    assert got.keys() == want.keys()
    for key, (beta, se) in want.items():
        assert got[key].names == ["const", "a", "b"] and np.allclose(got[key].beta, beta, atol=1e-6) and np.allclose(got[key].se, se, rtol=1e-4) and got[key].n == 600


def test_degenerate_outcomes_and_design(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", "g1"), (2.0, 2.0, "b", "g2"), (3.0, 2.0, "c", "g2")], "x double, y double, k string, g string")
    d, names = regression.design(df.withColumn("same", F.lit(1.0)), ["x", "same"], ["k"], ["y"])
    assert names == ["const", "x", "k_b", "k_c"]
    d, names = regression.design(df, ["x"])
    for model in (regression.ols, regression.logit):
        assert np.isinf(model(d, names, "y", "g").se).all() and (model(d, names, "y", "g").p == 1).all()
    with pytest.raises(ValueError):
        regression.design(df, [], ["k"], most_levels=2)


def test_draws_by_hash_are_those_of_a_plain_loop(spark):
    import hashlib

    rows = [("a", 5.0), ("a", 1.0), ("a", 5.0), ("a", None), (None, 2.0), (None, 4.0), ("b", None), ("c", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in ("a", None, "c"):
        x = sorted(v for k, v in rows if k == g and v is not None)
        for k in (1, 3):
            place = lambda t, j: int(hashlib.md5("|".join(["9", *([g] if g else []), str(k), str(t), str(j)]).encode()).hexdigest()[:15], 16) % len(x)  # noqa: B023, E731
            want[g, k] = float(np.std([np.mean([x[place(t, j)] for j in range(k)]) for t in range(50)]))
    got = {(r.g, r.k): r.se for r in resampling.bootstrap_se(df, ["g"], "v", (1, 3), 50, 9).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_ranks_of_one_large_group_are_dealt_over_tasks(spark):
    """A group that is most of the rows, most of its values equal: every place once, and in no partition more than its share."""
    from citelab import lineage

    df = spark.range(200_000).select(F.when(F.col("id") < 190_000, "a").otherwise("b").alias("g"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(7).cast("double").alias("v"))
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = lineage.ranks(df, ["g"], "v", "_rank", "_n").persist()
        got.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    r = {x.g: x for x in got.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("_rank").alias("d"), F.max("_rank").alias("m"), F.max("_n").alias("s")).collect()}
    assert [(x.n, x.d, x.m + 1, x.s) for x in (r["a"], r["b"])] == [(190_000,) * 4, (10_000,) * 4]
    w = got.where("g = 'a'").selectExpr("v", "lag(v) over (order by _rank) as l")
    assert w.where("v < l").count() == 0
    assert max(x["count"] for x in got.where("g = 'a'").groupBy(F.spark_partition_id()).count().collect()) < 100_000
    got.unpersist()


def test_bootstrap_tends_to_the_closed_form(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 4, 9, 2, 7)] + [("b", 3.0)] * 4, "c string, v double")
    exact = {(r.c, r.k): r.se for r in resampling.analytic_se(df, ["c"], "v").collect()}
    drawn = {(r.c, r.k): r.se for r in resampling.bootstrap_se(df, ["c"], "v", draws=4000).collect()}
    assert all(abs(drawn[k] - exact[k]) < 0.08 * max(1, exact[k]) for k in exact)
    again = {(r.c, r.k): r.se for r in resampling.bootstrap_se(df.repartition(3), ["c"], "v", draws=4000).collect()}
    assert again == drawn
    stable = {r.c: r.first_k for r in resampling.first_stable(resampling.analytic_se(df, ["c"], "v"), ["c"]).collect()}
    assert stable == {"a": None, "b": 1}


def test_ranks_and_bins(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0)], "v double")
    assert sorted(r[0] for r in df.select(relational.average_rank("v", descending=True)).collect()) == [1.5, 1.5, 3.0, 4.0]
    ties = spark.createDataFrame([(float(v),) for v in [0] * 15 + list(range(1, 6))], "v double")
    got = relational.quantile_bin(ties, "v", 4).groupBy("bin").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 20 and len(got) <= 3
    z = relational.winsorised_z(df, ["v"]).agg(F.avg("v"), F.stddev_samp("v")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9


def test_step_up(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = [r.q for r in relational.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p").orderBy("p").collect()]
    assert np.allclose(got, [0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(relational.CardinalityError):
        relational.checked_join(a, b, ["k"])
    with pytest.raises(relational.CardinalityError):
        relational.checked_join(a, b.limit(1), ["k"], matched=True)
    assert relational.checked_join(a, b.limit(1), ["k"]).count() == 2
    assert {r.side for r in relational.outer_indicator(a, spark.createDataFrame([(2,), (3,)], "k long"), ["k"]).collect()} == {"both", "left_only", "right_only"}


def test_kappa_and_wilson(spark):
    rows = [(True, True)] * 20 + [(True, False)] * 5 + [(False, True)] * 10 + [(False, False)] * 15
    r = relational.kappa(spark.createDataFrame(rows, "a boolean, b boolean"), "a", "b").first()
    assert abs(r.kappa - 0.4) < 1e-12 and r.agreement == 0.7
    lo, hi = spark.range(1).select(*relational.wilson(F.lit(0), F.lit(10))).first()
    assert abs(lo) < 1e-12 and 0.2 < hi < 0.3


def test_checks(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.2), (None, None)], "k string, v double")
    rows = quality.checklist([quality.unique(df, "u", ["k"]), quality.in_bounds(df, "b", "v"), quality.in_vocabulary(df, "w", "k", ["a"]), quality.exclusive(df, "x", "k", "v"), quality.at_threshold(df, "t", "v", 0.5), quality.same_counts(df, df, "s", "k"), quality.one_value(df, "o", "k"), quality.schema_equals(spark, df, "d", df.schema)])
    got = {r["check"]: (r.passed, r.detail) for r in rows.collect()}
    assert got == {"u": (False, 1), "b": (False, 1), "w": (True, 0), "x": (False, 1), "t": (False, 1), "s": (True, 0), "o": (True, 0), "d": (True, 0)}
    with pytest.raises(quality.QualityError, match="b, t, u, x"):
        quality.require(rows)
    assert quality.fingerprint(df, ["k", "v"]).first() == quality.fingerprint(df.repartition(3), ["k", "v"]).first()
    together = quality.conditions(df, {"b": quality.outside("v"), "w": quality.unknown("k", ["a"]), "x": F.col("v").isNull()})
    assert {r["check"]: (r.passed, r.detail) for r in together.collect()} == {"b": (False, 1), "w": (True, 0), "x": (False, 1)} and together.columns == rows.columns
    raw = spark.createDataFrame([('{"url_citation"}', 0), ("{}", 0)], "raw string, n long")
    assert quality.dropped_citations(raw, "c", "raw", "n").first().detail == 1


def test_answers_of_a_judge_are_read(spark):
    """Prose, strings, numbers that nobody asked for, left out statements, arrays that break off."""
    from citelab.operators import judging

    sents = spark.createDataFrame([(1, i, f"s{i}") for i in (1, 2, 3)] + [(2, 1, "t1"), (3, 1, "u1")], "doc_id long, sentence_idx long, text string")
    sources = spark.createDataFrame([(1, 4, "late"), (1, 2, "early"), (2, 1, "one"), (4, 1, "none asks")], "doc_id long, citation_position long, text string")
    asked = judging.requests(sents, sources, 2).collect()
    assert sorted((r.doc_id, r.chunk, r.numbers, r.statements, r.positions, r.texts) for r in asked) == [(1, 0, [1, 2], ["s1", "s2"], [2, 4], ["early", "late"]), (1, 1, [3], ["s3"], [2, 4], ["early", "late"]), (2, 0, [1], ["t1"], [1], ["one"])]

    def said(answer):
        rows = judging.supports(judging.answered(judging.requests(sents, sources, 3), lambda s, t: answer if len(s) == 3 else "[]")).collect()
        return sorted((r.doc_id, r.sentence_idx, r.citation_position) for r in rows)

    assert said('Sure: {"1": [1], "2": ["2", 1, 2], "3": []} ok') == [(1, 1, 2), (1, 2, 2), (1, 2, 4)]
    assert said('{"0": [1], "4": [1], "1": [0, 3, "x", -1, 2], "y": [1]}') == [(1, 1, 4)]
    assert said('{"1": [1') == said("none") == said(None) == said("") == said("{}") == []


def plain_linkage(d, method):
    """The two nearest clusters again and again, distances from all pairs of members."""
    groups, heights = [[i] for i in range(len(d))], []
    far = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(groups) > 1:
        h, i, j = min((float(far(d[np.ix_(a, b)])), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append((h, tuple(sorted(groups[i] + groups[j]))))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    return heights


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_linkage_against_plain_merging(method):
    from citelab.operators import linkage

    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 9, 30):
        x = rng.random((n, n))
        d = (x + x.T) / 2
        got, members = linkage.linkage(d, method), {i: (i,) for i in range(n)}
        want = plain_linkage(d, method)
        assert len(got) == n - 1
        for k, ((a, b, h, size), (height, group)) in enumerate(zip(got, want, strict=True)):
            members[n + k] = tuple(sorted(members[a] + members[b]))
            assert abs(h - height) < 1e-9 and members[n + k] == group and size == len(group)
    same = linkage.linkage(np.ones((5, 5)), method)
    assert [m[2] for m in same] == [1.0] * 4 and same[-1][3] == 5
    assert linkage.clusters("abc", [(0, 1, 0.1, 2), (2, 3, 0.9, 3)], 0.5) == {"a": "a", "b": "a", "c": "c"}


def test_correlation_distances(spark):
    from citelab.operators import linkage

    rng = np.random.default_rng(2)
    v = rng.random((4, 12))
    v[2] = -v[0] * 2 + 1
    rows = [(f"s{i}", j, float(v[i, j])) for i in range(4) for j in range(12) if (i, j) != (3, 0)] + [("s0", 5, float(v[0, 5])), ("flat", 1, 1.0), (None, 1, 1.0)]
    names, d = linkage.correlation_distances(spark.createDataFrame(rows, "s string, p long, v double"), "s", "p", "v")
    assert names == ["flat", "s0", "s1", "s2", "s3"] and np.allclose(d[1, 3], 2) and np.allclose(d[0, 1:], 1) and np.allclose(d, d.T)
    assert np.allclose(d[1, 2], 1 - np.corrcoef(v[0], v[1])[0, 1]) and np.allclose(d[2, 4], 1 - np.corrcoef(v[1, 1:], v[3, 1:])[0, 1])


def test_fingerprints_of_multisets(spark, tmp_path):
    """Two copies of one row that become two of another, which an exclusive or of hashes doesn't see."""
    kind = "k string, v double"
    df = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", None), (None, 1.0)], kind)
    quality.freeze(df, str(tmp_path / "t"))
    same = [quality.frozen(spark, str(tmp_path / "t"), "x", t).first().detail for t in (None, df.repartition(3))]
    assert same == [0, 0]
    for rows, detail in (([("c", 0.5), ("c", 0.5), ("b", None), (None, 1.0)], 2), ([("a", 0.5), ("b", None), (None, 1.0)], 3), ([("a", 0.5), ("a", 0.5), ("b", 1.0), (None, None)], 2)):
        assert quality.frozen(spark, str(tmp_path / "t"), "x", spark.createDataFrame(rows, kind)).first().detail == detail
    assert tuple(quality.fingerprint(df.limit(0), ["k", "v"]).first()) == (0, 0, 0)


def test_leaves_of_nested_tables(spark):
    df = spark.createDataFrame([([[1, None], []], (None, [("x",), (None,)])), (None, None)], "a array<array<int>>, s struct<b: int, c: array<struct<d: string>>>")
    assert [tuple(r) for r in quality.leaves(df).collect()] == [("a[][]", "int", 1), ("s.b", "int", 0), ("s.c[].d", "string", 1)]


def test_best_first_premises(spark):
    """Against every window, with few of them scored."""
    import random

    from citelab.operators import premises

    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)]
    sources = {k: [sorted(set(words[s : s + 15])) for s in range(at, at + n * 10, 10)] for k, at, n in (("long", 0, 500), ("short", 5200, 3), ("same", 40, 1))}
    sources["twice"] = sources["long"][:40] * 2
    claims = [(i, k, sorted(set(rng.choices(words, k=rng.randint(1, 12))) | ({"new"} if i % 5 == 0 else set()))) for i in range(60) for k in sources] + [(-1, "long", []), (-2, "long", ["unknown"]), (-3, "gone", ["w1"])]
    df = spark.createDataFrame(claims, "i int, k string, tokens array<string>")
    src = spark.createDataFrame([*sources.items(), ("empty", [])], "k string, windows array<array<string>>")
    for each in (20_000, 7):  # the second deals each source over several tasks
        got = {(r.i, r.k): r for r in premises.best_first(df, src, "k", each=each).collect()}
        assert len(got) == len(claims) - 1
        for i, k, tokens in claims[:-1]:
            best = max(range(len(sources[k])), key=lambda w: (len(set(tokens) & set(sources[k][w])), -w))  # noqa: B023
            assert (got[i, k].score, got[i, k].window, got[i, k].windows) == (len(set(tokens) & set(sources[k][best])), best, len(sources[k]))
        assert sum(r.scored for r in got.values()) < 0.1 * sum(r.windows for r in got.values())

    def share(claim, window):
        return sum(t in window for t in claim) / (len(claim) + len(window))

    got = {(r.i, r.k): r for r in premises.best_first(df, src, "k", share, lambda n: n / (n + 1)).collect()}
    for i, k, tokens in claims[:-1]:
        best = max(range(len(sources[k])), key=lambda w: (share(tokens, sources[k][w]), -w))  # noqa: B023
        assert (got[i, k].score, got[i, k].window) == (share(tokens, sources[k][best]), best)


def test_best_first_premises_sent_or_shuffled(spark):
    """Sources that are sent to the claims, that meet them in a shuffle, and the windows scored one by one give the same; where sources are sent, no claim is shuffled."""
    import random

    from citelab.operators import premises

    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.6))}"
    sources = [(k, [sorted({word() for _ in range(9)}) for _ in range(1 + k * k % 23)]) for k in range(12)] + [(90, []), (91, None)]
    claims = [(i, rng.randrange(14), sorted({word() for _ in range(rng.randrange(9))})) for i in range(400)] + [(900, 90, ["w1"]), (901, 91, ["w1"])]
    df = spark.createDataFrame(claims, "i int, k int, tokens array<string>").repartition(3)
    src = spark.createDataFrame(sources, "k int, windows array<array<string>>")
    plain = lambda claim, window: premises.shared(claim, window)
    want = {r[:4] + r[5:] for r in map(tuple, premises.best_first(df, src, "k", plain, send=0).collect())}
    known = dict(sources[:12])
    best = {(i, k, max((len(set(t) & set(w)), -n) for n, w in enumerate(known[k]))) for i, k, t in claims if k in known}
    assert {(i, k, (score, -window)) for i, k, score, window, _ in want} == best
    for send, each in ((premises.SENT, 20_000), (0, 20_000), (0, 7)):
        got = premises.best_first(df, src, "k", each=each, send=send)
        assert {r[:4] + r[5:] for r in map(tuple, got.collect())} == want
    sent = premises.best_first(df.select("i", "k", "tokens"), src, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in sent and "Join" not in sent


def test_windows_split_their_text_once(spark):
    """As long a text again takes twice the time, not four times: the plan holds one split."""
    from citelab.functions import text

    d = spark.createDataFrame([("a b c d e",), ("a",), ("",), (None,)], "t string").select(text.windows(F.col("t"), 3, 2).alias("w"))
    assert [r.w for r in d.collect()] == [["a b c", "c d e"], ["a"], [], []]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(0, 9, 500).astype(float), "b": rng.normal(size=333), "c": np.array([4.0]), "d": np.repeat(2.0, 50)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("e", None)]
    at = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r.q for r in relational.exact_quantiles(df, "x", at, "k").collect()}
    assert got.keys() == groups.keys() and all(np.allclose(got[g], np.quantile(x, at)) for g, x in groups.items())
    whole = relational.exact_quantiles(df, "x", at).first().q
    assert np.allclose(whole, np.quantile(np.concatenate([*groups.values()]), at))
    assert relational.exact_quantiles(df.limit(0), "x", at, "k").count() == 0


def test_pairs_are_judged_once_and_counted(spark, tmp_path):
    """Items with one text are one source; what is asked is logged, each distinct pair once; texts of sources stay out of the shuffle."""
    from citelab.operators import judging

    log = str(tmp_path / "asked")

    def decide(rows):
        with open(log, "a") as f:
            f.writelines(f"{c}|{s}\n" for c, s in rows)
        return [float(len(c) + len(s)) for c, s in rows]

    meetings = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 4), ("a", 1)], "claim string, key long")
    sources = spark.createDataFrame([(1, "x"), (2, "x"), (3, "yy"), (4, None)], "key long, source string")
    got = judging.judged_counts(meetings, sources, decide)
    assert sorted(map(tuple, got.collect())) == [("a", "x", 3, 2.0), ("a", "yy", 1, 3.0), ("b", "x", 1, 2.0)]
    assert sorted(open(log).read().split()) == ["a|x", "a|yy", "b|x"]


def test_answers_leave_texts_behind(spark):
    """Sentences are dealt once, by answer, and an answer's row doesn't carry the texts that it was asked with."""
    from citelab.operators import judging
    from citelab.plans import designs

    sents = spark.createDataFrame([(1, i, f"word{i} here") for i in range(1, 6)] + [(2, 1, "none")], "doc_id long, sentence_idx long, text string")
    sources = spark.createDataFrame([(1, 1, "word1 here"), (1, 2, "word5 and here")], "doc_id long, citation_position long, text string")
    asked = judging.requests(sents, sources, 2)
    assert asked._jdf.queryExecution().sparkPlan().toString().count("REPARTITION_BY_COL") + asked._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") >= 1
    got = judging.answered(asked, lambda s, t: f'{{"1": [{len(t)}]}}')
    assert "texts" not in got.columns and "statements" not in got.columns
    assert sorted(tuple(r) for r in judging.supports(got).collect()) == [(1, 1, 2), (1, 3, 2), (1, 5, 2)]
    designs.source_tokens.cache_clear()
    for _ in range(3):
        designs.reading_judge(["word1 here"], ["word1 here", "word5"])
    assert designs.source_tokens.cache_info().misses == 2
