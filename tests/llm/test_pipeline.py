"""The pipeline's stages on a small corpus with planted cases, against what each must do."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from citelab.llm import decontaminate, jaccard, line_dedup  # noqa: E402


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "copies", "benchmark", "mixture"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with copies, lines, a benchmark passage and rows without language."""
    out = str(tmp_path_factory.mktemp("sf"))
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    langs = [r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    item = " ".join(f"bench{i}" for i in range(30))
    rows = [(i, t, lg, "s", len(t)) for i, (t, lg) in enumerate(zip(base, langs, strict=True))]
    rows += [(100, base[5] + "\n" + base[6], "en", "s", 0), (101, base[7], langs[7], "s", 0), (102, base[8] + " " + item, langs[8], "s", 0), (103, None, "en", "s", 0), (104, "12345 !!", "en", "s", 0), (105, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(50)], "doc_id long, quality long, toxic long").write.parquet(f"{out}/labels.parquet")
    return out, rows, item


def test_stages_do_what_brute_force_says(spark, folder):
    sf_dir, rows, item = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    first = corpus_pipeline.language(spark, docs, sf_dir)
    assert first.columns == columns
    kept = sorted((r.doc_id, r.text) for r in first.collect())
    assert [d for d, *_ in rows if d not in (103, 104, 105)] == [d for d, _ in kept]

    second = corpus_pipeline.lines(spark, first, sf_dir)
    want = {d: t for d, t, n in line_dedup.brute_force(kept) if t.strip() or not n}
    got = {r.doc_id: r for r in second.collect()}
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())

    third = corpus_pipeline.copies(spark, second, sf_dir)
    comp = jaccard.brute_force(sorted(want.items()))
    assert sorted(r.doc_id for r in third.collect()) == sorted({c for _, _, c in comp})

    fourth = corpus_pipeline.benchmark(spark, third, sf_dir)
    left = [(r.doc_id, r.text) for r in third.collect()]
    clean = {d for d, *_, bad in decontaminate.brute_force(left, [(1, item)]) if not bad}
    assert {r.doc_id for r in fourth.collect()} == clean and 102 not in clean

    last = corpus_pipeline.mixture(spark, fourth, sf_dir)
    assert last.columns == [*columns, "n_tokens", "domain", "rate"] and {r.doc_id for r in last.collect()} <= clean


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder[0]).collect()
    ids = [r.doc_id for r in got]
    assert ids and len(ids) == len(set(ids)) and not {102, 103, 104, 105} & set(ids)
    # 100 and 101 have earlier documents' lines only
    assert not {100, 101} & set(ids) and all(r.text.strip() and r.n_chars == len(r.text) for r in got)


def test_extra_columns_with_clashing_names(spark, folder):
    names = ["h", "n", "rh", "_h", "_id", "_rh", "_gone", "_lines", "_spans", "_items", "_n", "_row", "_to", "_k", "sig", "count", "row", "y", "t", "p", "x"]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").withColumns({c: F.lit("own") for c in names})
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
        got = docs.select(*names).distinct().collect()
        assert [tuple(r) for r in got] == [("own",) * len(names)]


def test_empty_documents(spark, folder):
    sf_dir = folder[0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
