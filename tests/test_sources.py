"""Captures, adapters, silver tables, fetching and writers."""

import json

import pytest
from pyspark.sql import functions as F

from citelab.sources import adapters, bronze, fetch, silver, sinks

RAW = {
    "chatgpt": {"output": [{"type": "reasoning"}, {"type": "web_search_call"}, {"type": "message", "content": [{"type": "output_text", "text": "first", "annotations": [{"type": "url_citation", "url": "https://www.a.com/x", "title": "A"}, {"type": "other", "url": "https://no.com"}, {"type": "url_citation", "url": "https://b.com", "title": "B"}, {"type": "url_citation", "url": "https://www.a.com/x", "title": "again"}]}]}]},
    "claude": {"content": [{"type": "server_tool_use"}, {"type": "text", "text": "Hello ", "citations": None}, {"type": "text", "text": "world", "citations": [{"type": "web_search_result_location", "url": "https://www.c.com", "title": "C"}]}]},
    "gemini": {"candidates": [{"groundingMetadata": {"groundingChunks": [{"web": {"uri": "https://r/1", "title": "d.com"}}, {"web": {"uri": "https://r/2", "title": "e.com", "domain": "real.com"}}, {}]}}]},
    "gemini2": {"candidates": [{"grounding_metadata": {"grounding_chunks": [{"web": {"uri": "https://r/3", "title": "f.com"}}]}}]},
    "perplexity": {"search_results": [{"url": "https://g.com", "title": "G"}], "citations": ["https://ignored.com"]},
    "perplexity2": {"search_results": [], "citations": ["https://h.com", "https://h.com", "", "https://i.com"]},
    "mistral": {"outputs": [{"type": "tool"}, {"type": "message.output", "model": "m-1", "content": [{"type": "text", "text": "T"}, {"type": "tool_reference", "source": "https://j.com", "title": "J"}]}, {"type": "message.output", "content": "plain"}]},
    "kimi": {},
    "nobody": {},
}


def write(tmp_path, **changes):
    for i, (name, raw) in enumerate(RAW.items()):
        d = {"query_id": f"q{i}", "engine": name.rstrip("2"), "run_index": 1, "raw_response": raw, "answer_text": "See https://k.com/a). and (https://l.com/b]" if name == "kimi" else None, "run_profile": "pilot", "usage": {"prompt_tokens": 5, "output_tokens": 3}} | changes
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=1))
    return str(tmp_path)


def test_adapters(spark, tmp_path):
    raw = bronze.read(spark, write(tmp_path))
    good, bad = bronze.reconstruct(raw)
    assert bad.count() == 0 and bronze.single_profile(good) == "pilot"
    canonical, failed = adapters.normalise(good)
    assert [r.engine for r in failed.collect()] == ["nobody"]
    got = {r.query_id: r for r in canonical.collect()}
    cited = lambda q: [(c.position, c.url, c.title, c.domain) for c in got[q].cited_sources]
    assert cited("q0") == [(1, "https://www.a.com/x", "A", "a.com"), (2, "https://b.com", "B", "b.com")] and got["q0"].answer_text == "first"
    assert cited("q1") == [(1, "https://www.c.com", "C", "www.c.com")] and got["q1"].answer_text == "Hello world"
    assert cited("q2") == [(1, "https://r/1", "d.com", "d.com"), (2, "https://r/2", "e.com", "real.com")] and cited("q3")[0][3] == "f.com"
    assert cited("q4") == [(1, "https://g.com", "G", "g.com")] and [c[1] for c in cited("q5")] == ["https://h.com", "https://i.com"]
    assert cited("q6") == [(1, "https://j.com", "J", "j.com")] and got["q6"].answer_text == "Tplain" and got["q6"].model_served == "m-1"
    assert [c[1] for c in cited("q7")] == ["https://k.com/a", "https://l.com/b"] and got["q7"].cited_sources[0].provenance == adapters.SELF_REPORTED
    r = {x.query_id: x for x in silver.responses(canonical).collect()}
    assert r["q0"].n_cited_sources == 2 and r["q0"].n_unique_domains == 2 and r["q7"].has_citations and r["q5"].citation_provenance == adapters.CERTIFIED
    assert silver.citations(canonical).count() == 12


def test_bad_files_are_counted(spark, tmp_path):
    write(tmp_path)
    (tmp_path / "broken.json").write_text('{"query_id": "x", ')
    (tmp_path / "partial.json").write_text('{"engine": "claude"}')
    good, bad = bronze.reconstruct(bronze.read(spark, str(tmp_path)).cache())
    assert good.count() == len(RAW) and bad.count() == 2


def test_mixed_profiles(spark, tmp_path):
    write(tmp_path)
    (tmp_path / "other.json").write_text(json.dumps({"query_id": "z", "engine": "kimi", "run_index": 2, "run_profile": "scaleup"}))
    with pytest.raises(bronze.MixedProfiles):
        bronze.single_profile(bronze.reconstruct(bronze.read(spark, str(tmp_path)))[0])


def test_ledger(spark, tmp_path):
    good, _ = bronze.reconstruct(bronze.read(spark, write(tmp_path)))
    prices = spark.createDataFrame([("claude", 1e6, 2e6, 1.0)], "engine string, tokens_in double, tokens_out double, per_call double")
    got = {r.engine: r for r in silver.token_ledger(good, prices).collect()}
    assert got["claude"].dollars == 5 + 6 + 1 and got["kimi"].dollars == 0 and got["gemini"].tok_in == 10


def test_retry_and_status():
    waits = []
    answers = iter([(429, ""), (500, ""), (200, "<p>x</p>")])
    assert fetch.call_with_retry(lambda u: next(answers), "u", sleep=waits.append, jitter=0) == ("ok", 200, "<p>x</p>", 3) and waits == [2, 4]

    def fails(e):
        def get(u):
            raise e

        return get

    none = lambda s: None
    assert fetch.call_with_retry(fails(TimeoutError()), "u", sleep=none)[0] == "timeout"
    assert fetch.call_with_retry(fails(ConnectionError()), "u", sleep=none)[0] == "connection_error"
    assert fetch.call_with_retry(fails(KeyError("x")), "u", sleep=none) == ("KeyError", None, None, 1)
    assert fetch.call_with_retry(lambda u: (404, ""), "u", sleep=none)[0] == "http_404" and fetch.call_with_retry(lambda u: (200, " "), "u")[0] == "empty_response"
    assert fetch.backoff(10) == 30


def test_fetch(spark):
    wanted = spark.createDataFrame([("https://a.com/1",), ("https://a.com/1",), ("https://b.com/x",), (None,)], "url string")
    got = {r.url_canonical: r for r in fetch.fetch(wanted, lambda u: (200, f"<title>t</title><p>{u}</p>") if "a.com" in u else (403, ""), spacing=0, sleep=lambda s: None).collect()}
    assert got["https://a.com/1"].cleaned_text == "t https://a.com/1" and got["https://b.com/x"].fetch_status == "http_403" and got["https://b.com/x"].cleaned_text == "" and len(got) == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "engine string, v int")
    p = str(tmp_path / "t")
    sinks.write_by_key(df, p)
    sinks.write_by_key(spark.createDataFrame([("a", 9)], "engine string, v int"), p)
    assert sorted((r.engine, r.v) for r in spark.read.parquet(p).collect()) == [("a", 9), ("b", 2)]
    with pytest.raises(sinks.WouldOverwriteInput):
        sinks.write_guarded(spark.read.parquet(p), p)
    q = str(tmp_path / "n")
    assert sinks.append_new(df, q, ["engine"]) == 2 and sinks.append_new(df.union(df), q, ["engine"]) == 0
    sinks.freeze(df, str(tmp_path / "f"), version="v1")
    assert json.loads(spark.read.text(str(tmp_path / "f" / "_manifest")).first()[0])["rows"] == 2
    with pytest.raises(Exception, match="exists|EXISTS"):
        sinks.freeze(df, str(tmp_path / "f"))
    sinks.failure_log(df.withColumn("error", F.lit("x")), str(tmp_path / "log"))
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_malformed_answers_fail_with_a_reason(spark):
    rows = [("q", "chatgpt", 1, "", "", "a", "{not json", "p"), ("q", "claude", 1, "", "", "a", "{}", "p"), ("q", None, 1, "", "", "a", "{}", "p")]
    df = spark.createDataFrame(rows, "query_id string, engine string, run_index long, model_served string, timestamp_utc string, answer_text string, raw_response string, run_profile string")
    good, failed = adapters.normalise(df)
    assert [r.engine for r in good.collect()] == ["claude"] and sorted((str(r.engine), r.reason) for r in failed.collect()) == [("None", "unknown engine"), ("chatgpt", "malformed answer")]


def test_workbook(spark):
    import io
    import zipfile
    from xml.etree import ElementTree

    from citelab.sources import sinks

    a = spark.createDataFrame([(1, "x < y & \x01", None), (2, "é", 2.5)], "n long, s string, v double").orderBy("n")
    book = zipfile.ZipFile(io.BytesIO(sinks.workbook({"first": a, "second/one": a.limit(0)})))
    assert book.testzip() is None
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    assert [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet")] == ["first", "second one"]
    rows = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml")).findall(".//m:row", ns)
    assert [["".join(c.itertext()) for c in r] for r in rows] == [["n", "s", "v"], ["1", "x < y & ", ""], ["2", "é", "2.5"]]
    with pytest.raises(ValueError):
        sinks.workbook({"small": a}, most=2)


def test_hosts_are_asked_side_by_side(spark):
    import time

    from citelab.sources import fetch

    def get(url):
        time.sleep(0.2)
        return 200, "<p>text</p>"

    df = spark.createDataFrame([(f"https://h{i}.com/a",) for i in range(40)], "url string").coalesce(1)
    began = time.time()
    got = fetch.fetch(df, get, spacing=0.0).collect()
    assert len(got) == 40 and {r.fetch_status for r in got} == {"ok"} and time.time() - began < 6


def test_stored_pages_by_host(spark, tmp_path):
    """Hosts in one partition each, due times by host, and what is added later as later offsets."""
    from citelab.sources import page_source

    at = str(tmp_path / "pages")
    rows = [(i, f"https://h{i % 3}.org/{i}" if i % 7 else None, f"<p>{i}</p>" if i % 5 else " ") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.where("page_id < 25").coalesce(1).write.parquet(at)
    df.where("page_id >= 25").coalesce(1).write.mode("append").parquet(at)
    got = page_source.stored_pages(spark, at, buckets=3, spacing=0.5).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.page_id, r.url, r.html) for r in got) == [tuple(r) for r in rows] and [r.position for r in sorted(got, key=lambda r: r.page_id)] == list(range(40))
    assert {r.fetch_status for r in got if r.page_id % 5 == 0} == {"empty_response"} and {r.content_length for r in got if r.page_id == 11} == {9}
    for host in {r.host for r in got}:
        own = sorted((r for r in got if r.host == host), key=lambda r: r.position)
        assert len({r.part for r in own}) == 1 and [r.due for r in own] == [i * 0.5 for i in range(len(own))]
    assert page_source.stored_pages(spark, str(tmp_path / "pages"), buckets=1).count() == 40

    stored = page_source._Stored({"path": at, "buckets": "2"})
    reader = page_source.StreamReader(stored)
    assert reader.initialOffset() == {"position": 0} and reader.latestOffset() == {"position": 40} and reader.partitions({"position": 40}, {"position": 40}) == []
    middle = [x for p in reader.partitions({"position": 20}, {"position": 30}) for b in reader.read(p) for x in b.column(0).to_pylist()]
    assert sorted(middle) == list(range(20, 30))


def test_stored_pages_wait_for_their_host(tmp_path):
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    from citelab.sources import page_source

    pq.write_table(pa.table({"page_id": [1, 2, 3, 4], "url": ["http://a/1", "http://a/2", "http://b/1", "http://a/3"], "html": ["x"] * 4}), tmp_path / "p.parquet")
    stored = page_source._Stored({"path": str(tmp_path / "p.parquet"), "buckets": "1", "spacing": "0.15", "wait": "true"})
    began, seen = time.monotonic(), []
    for b in stored.read(*stored.split(0, 4)):
        seen.append((b.column(1)[0].as_py(), time.monotonic() - began))
    assert [u for u, _ in seen] == ["http://a/1", "http://a/2", "http://b/1", "http://a/3"] and seen[1][1] >= 0.15 and seen[3][1] >= 0.3


def test_a_write_that_fails_leaves_what_was_there(spark, tmp_path):
    at = tmp_path / "table"
    sinks.write_guarded(spark.range(5), str(at))
    bad = spark.range(20, 40).repartition(3).select(F.when(F.col("id") == 33, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    for write in (sinks.write_atomic, sinks.write_guarded):
        with pytest.raises(Exception, match="broken"):
            write(bad, str(at))
        assert sorted(r.id for r in spark.read.parquet(str(at)).collect()) == list(range(5)) and [p.name for p in tmp_path.iterdir()] == ["table"]
    sinks.write_atomic(spark.range(7, 9), str(at) + "/")
    assert sorted(r.id for r in spark.read.parquet(str(at)).collect()) == [7, 8] and [p.name for p in tmp_path.iterdir()] == ["table"]
    with pytest.raises(sinks.WouldOverwriteInput):
        sinks.write_guarded(spark.read.parquet(str(at)), str(at))
