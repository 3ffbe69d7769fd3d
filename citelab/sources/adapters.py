"""Providers' answers as canonical citations, by built-in functions only.

Each engine has a reader: (raw_response JSON, answer text) -> the answer and its citations as
array<struct<url, title, domain>>, in order and with repeats. What all share, first place wins for a
repeated URL and places count from 1, is done once for all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelab.functions.urls import bare_domain, domain_of

SELF_REPORTED = "self_reported_prompt_elicited"
CERTIFIED = "provider_certified"
CITATIONS = "array<struct<url:string,title:string,domain:string>>"
NO_ELEMENTS = "[]"


def _cite(url: Column, title: Column, domain: Column) -> Column:
    return F.struct(url.cast("string").alias("url"), title.cast("string").alias("title"), domain.cast("string").alias("domain"))


def _array(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _blocks(parsed: Column, name: str, kind: str) -> Column:
    """The elements of an array in a parsed answer; none if it is missing."""
    return F.coalesce(parsed[name], F.from_json(F.lit(NO_ELEMENTS), kind))


def chatgpt(raw: Column, answer: Column) -> tuple[Column, Column]:
    item = "array<struct<type:string,content:array<struct<type:string,text:string,annotations:array<struct<type:string,url:string,title:string>>>>>>"
    items = F.filter(_blocks(F.from_json(raw, f"output {item}"), "output", item), lambda x: x["type"] == "message")
    blocks = F.flatten(F.transform(items, lambda x: _array(x["content"], "array<struct<type:string,text:string,annotations:array<struct<type:string,url:string,title:string>>>>")))
    notes = F.flatten(F.transform(blocks, lambda b: _array(b["annotations"], "array<struct<type:string,url:string,title:string>>")))
    cited = F.transform(F.filter(notes, lambda a: a["type"] == "url_citation"), lambda a: _cite(a["url"], a["title"], bare_domain(a["url"])))
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "output_text") & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"])
    return F.coalesce(F.nullif(answer, F.lit("")), F.try_element_at(texts, F.lit(1)), F.lit("")), cited


def claude(raw: Column, answer: Column) -> tuple[Column, Column]:
    cit = "array<struct<type:string,url:string,title:string>>"
    block = f"array<struct<type:string,text:string,citations:{cit}>>"
    blocks = F.filter(_blocks(F.from_json(raw, f"content {block}"), "content", block), lambda b: b["type"] == "text")
    cits = F.flatten(F.transform(blocks, lambda b: _array(b["citations"], cit)))
    cited = F.transform(F.filter(cits, lambda c: c["type"] == "web_search_result_location"), lambda c: _cite(c["url"], c["title"], domain_of(c["url"])))
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    return F.coalesce(F.nullif(answer, F.lit("")), joined), cited


def gemini(raw: Column, answer: Column) -> tuple[Column, Column]:
    chunk = "array<struct<web:struct<uri:string,title:string,domain:string>>>"
    meta = f"struct<grounding_chunks:{chunk},groundingChunks:{chunk}>"
    parsed = F.from_json(raw, f"candidates array<struct<grounding_metadata:{meta},groundingMetadata:{meta}>>")
    first = F.try_element_at(parsed["candidates"], F.lit(1))
    m = F.coalesce(first["grounding_metadata"], first["groundingMetadata"])
    chunks = F.coalesce(m["grounding_chunks"], m["groundingChunks"], F.from_json(F.lit(NO_ELEMENTS), chunk))
    cited = F.transform(F.filter(chunks, lambda c: c["web"].isNotNull()), lambda c: _cite(c["web"]["uri"], c["web"]["title"], F.coalesce(F.nullif(c["web"]["domain"], F.lit("")), c["web"]["title"])))
    return answer, cited


def perplexity(raw: Column, answer: Column) -> tuple[Column, Column]:
    found = "array<struct<url:string,title:string>>"
    parsed = F.from_json(raw, f"search_results {found}, citations array<string>")
    results = _blocks(parsed, "search_results", found)
    flat = _blocks(parsed, "citations", "array<string>")
    one = F.transform(results, lambda r: _cite(r["url"], r["title"], domain_of(r["url"])))
    two = F.transform(flat, lambda u: _cite(u, F.lit(None), domain_of(u)))
    return answer, F.when(F.size(results) > 0, one).otherwise(two)


def kimi(raw: Column, answer: Column) -> tuple[Column, Column]:
    urls = F.regexp_extract_all(answer, F.lit(r"""https?://[^\s\)\]\>\"'<]+"""), F.lit(0))
    cited = F.transform(F.transform(urls, lambda u: F.regexp_replace(u, r"""[.,;:)\]}>"']+$""", "")), lambda u: _cite(u, F.lit(None), domain_of(u)))
    return answer, cited


def mistral(raw: Column, answer: Column) -> tuple[Column, Column]:
    chunk = "array<struct<type:string,text:string,url:string,source:string,title:string>>"
    out = "array<struct<type:string,content:string>>"
    entries = F.filter(_blocks(F.from_json(raw, f"outputs {out}"), "outputs", out), lambda e: e["type"] == "message.output")
    # content is a string or an array of chunks; an array arrives here as its JSON text
    is_array = lambda e: F.coalesce(e["content"], F.lit("")).startswith("[{")
    plain = F.array(F.struct(F.lit("text").alias("type")))
    chunks = F.flatten(F.transform(entries, lambda e: F.when(is_array(e), _array(F.from_json(e["content"], chunk), chunk)).otherwise(F.transform(plain, lambda p: F.struct(p["type"].alias("type"), e["content"].alias("text"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("title"))))))
    text = F.array_join(F.transform(F.filter(chunks, lambda c: c["type"] == "text"), lambda c: F.coalesce(c["text"], F.lit(""))), "")
    url = lambda c: F.coalesce(F.nullif(c["url"], F.lit("")), c["source"])
    cited = F.transform(F.filter(chunks, lambda c: c["type"] == "tool_reference"), lambda c: _cite(url(c), c["title"], domain_of(url(c))))
    return F.coalesce(F.nullif(answer, F.lit("")), text), cited


READERS: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {"chatgpt": chatgpt, "claude": claude, "gemini": gemini, "perplexity": perplexity, "kimi": kimi, "mistral": mistral}
#: Variants of an engine: the same reading of another request.
VARIANTS = {"chatgpt_forced": "chatgpt"}


def numbered(cited: Column, provenance: Column) -> Column:
    """Each URL once, at its first place, with places from 1."""
    named = F.filter(cited, lambda c: F.coalesce(c["url"], F.lit("")) != "")
    once = F.filter(named, lambda c, i: ~F.exists(F.slice(named, F.lit(1), i), lambda o: o["url"] == c["url"]))
    return F.transform(once, lambda c, i: F.struct((i + 1).cast("long").alias("position"), c["url"].alias("url"), c["title"].alias("title"), c["domain"].alias("domain"), provenance.alias("provenance")))


def served_model(raw: Column) -> Column:
    """The model that a provider names in its answer, or in one of its outputs."""
    out = "array<struct<type:string,model:string>>"
    parsed = F.from_json(raw, f"model string, outputs {out}")
    entries = F.filter(_blocks(parsed, "outputs", out), lambda e: (e["type"] == "message.output") & (F.coalesce(e["model"], F.lit("")) != ""))
    return F.coalesce(F.nullif(parsed["model"], F.lit("")), F.try_element_at(entries, F.lit(1))["model"], F.lit(""))


def normalise(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical, failed): records of a known engine whose answer can be read, with answer_text and cited_sources, and the
    others with the reason. Nothing is dropped."""
    engines = {**{e: e for e in READERS}, **VARIANTS}
    answer, cited = F.lit(None).cast("string"), F.lit(None).cast(CITATIONS)
    for name, reader in engines.items():
        a, c = READERS[reader](F.col("raw_response"), F.col("answer_text"))
        answer = F.when(F.col("engine") == name, a).otherwise(answer)
        cited = F.when(F.col("engine") == name, c).otherwise(cited)
    reason = F.when(~F.coalesce(F.col("engine").isin(*engines), F.lit(False)), "unknown engine").when(F.col("raw_response").isNotNull() & F.try_parse_json("raw_response").isNull(), "malformed answer")
    records = records.withColumn("reason", reason)
    provenance = F.when(F.col("engine") == "kimi", SELF_REPORTED).otherwise(CERTIFIED)
    good = records.where("reason is null").select("query_id", "engine", "run_index", F.coalesce(F.nullif(F.col("model_served"), F.lit("")), served_model(F.col("raw_response"))).alias("model_served"), "timestamp_utc", answer.alias("answer_text"), numbered(cited, provenance).alias("cited_sources"), "run_profile")
    return good, records.where("reason is not null")
