"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A
window is WINDOW consecutive words of an item; an item of fewer words is one window. Of the k-grams
of each window the one with the least hash is its fingerprint, so equal windows have the same
fingerprint and every shared window is found. Documents' fingerprints are joined with the items';
hits are extended to the windows around them, which are compared by 128 bits.

A benchmark of up to BLOCK_BYTES of text is sent to all executors as an index, and documents are read against it in
one pass. A larger one is never sent or collected: the fingerprints of documents are joined with those of its windows,
documents with a common fingerprint give out their windows with such fingerprints, and these are joined with the items'
windows. Only documents that are hit, or pass a filter of bounded size by chance, are shuffled; equal texts count once.

Nulls: a null text has no words and hits nothing; an item whose id is null is left out; a row whose
doc_id is null is judged like any other. Rows that repeat are judged alike. An empty table of items
hits nothing, an empty table of documents gives no rows. Extra columns are kept by annotate(); those
named like a result column are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.llm import common

WINDOW, GRAM = 10, 5
#: Bytes of benchmark text that are sent to the executors; of a larger benchmark nothing is.
BLOCK_BYTES = 8 << 20
WORD = common.class_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def hashed_words(values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word and the first word of each row."""
    data, offsets = common.text_bytes(values)
    data = common.lower_table()[data]
    starts, ends, first = common.word_spans(data, offsets, WORD)
    return *(common.span_hash(common.prefix_hash(data, s), starts, ends, s) for s in (1, 2)), first


class Index:
    """Windows of a block of items: by length, sorted hashes, their second hashes and their items."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW, gram: int = GRAM) -> None:
        one, two, first = hashed_words(pa.array(texts, pa.string()))
        self.window, self.gram, self.by_length, self.ids = window, gram, {}, [str(i) for i in ids]
        counts = np.diff(first)
        found: dict[int, list] = {}
        for row, n in enumerate(counts):
            if n:
                k = min(int(n), window)
                at = np.arange(first[row], first[row] + n - k + 1)
                found.setdefault(k, []).append((at, np.full(len(at), row)))
        for k, parts in found.items():
            at, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = common.gram_hash(one, k, 11)[at], common.gram_hash(two, k, 12)[at]
            order = np.lexsort((row, b, a))
            a, b, row = a[order], b[order], row[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            groups = np.append(np.flatnonzero(new), len(a))
            # windows of the same items share a list, so a document that has many of them names its items once
            lists: dict[tuple, int] = {}
            of = np.array([lists.setdefault(tuple(sorted({*row[s:e].tolist()})), len(lists)) for s, e in zip(groups[:-1], groups[1:], strict=True)], np.int64)
            self.by_length[k] = (a[new], b[new], of, [*lists])
        grams = common.gram_hash(one, gram, 13)
        picked = [picks(grams[first[r] : first[r + 1] - gram + 1], window - gram + 1)[0] for r, n in enumerate(counts) if n >= window]
        self.fingerprints = np.unique(np.concatenate([grams[first[r] + p] for r, p in zip(np.flatnonzero(counts >= window), picked, strict=True)])) if picked else np.zeros(0, np.uint64)


def picks(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the leftmost least gram of each window of w grams: the distinct ones, and one for each window."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = common.window_min(grams, w)
    each = np.full(n, -1, np.int64)
    for j in range(w - 1, -1, -1):
        each = np.where(grams[j : j + n] == least, np.arange(j, j + n), each)
    return np.unique(each), each


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in sorted_values, or -1."""
    if not len(sorted_values) or not len(x):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def hits(index: Index, values) -> tuple[np.ndarray, list[list], list[list]]:
    """For each row: the number of words, the hit runs of words as (start, end), and the ids of the items."""
    one, two, first = hashed_words(values)
    counts, n_rows = np.diff(first), len(values)
    total = int(first[-1]) if n_rows else 0
    cover = np.zeros(total + 1, np.int64)
    items: list[set] = [set() for _ in range(n_rows)]
    row_of = np.repeat(np.arange(n_rows), counts)
    last = np.repeat(first[1:], counts)  # the end of each word's row
    for k, (a, b, of, lists) in index.by_length.items():
        at = np.arange(max(0, total - k + 1))
        at = at[at + k <= last[at]]
        if k == index.window and len(at):
            # a window is looked up only if its fingerprint is one of the items'
            grams = common.gram_hash(one, index.gram, 13)
            least = common.window_min(grams, index.window - index.gram + 1)
            at = at[member(index.fingerprints, least[at]) >= 0]
        if not len(at):
            continue
        place = member(a, common.gram_hash(one, k, 11)[at])
        at, place = at[place >= 0], place[place >= 0]
        same = b[place] == common.gram_hash(two, k, 12)[at]
        at, place = at[same], place[same]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + k, -1)
        for r, group in np.unique(np.stack([row_of[at], of[place]]), axis=1).T if len(at) else ():
            items[r].update(lists[group])
    hit = np.cumsum(cover)[:total] > 0
    before = np.concatenate([[False], hit[:-1]]) if total else hit
    starts_row = np.zeros(total, bool)
    starts_row[first[:-1][counts > 0]] = True
    begin = np.flatnonzero(hit & (~before | starts_row))
    after = np.concatenate([hit[1:], [False]]) if total else hit
    ends_row = np.zeros(total, bool)
    ends_row[first[1:][counts > 0] - 1] = True
    end = np.flatnonzero(hit & (~after | ends_row)) + 1
    spans: list[list] = [[] for _ in range(n_rows)]
    for s, e in zip(begin.tolist(), end.tolist(), strict=True):
        r = row_of[s]
        spans[r].append((s - int(first[r]), e - int(first[r])))
    return counts, spans, [sorted({index.ids[i] for i in x}) for x in items]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def found(counts, spans: list[list], items: list[list]) -> list:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return [pa.array(counts, pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind), pa.array(items, pa.list_(pa.string()))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with n_words, hit_spans (runs of hit words: start, end) and hit_items (the ids as strings)."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size > block_bytes:
        return decontaminate_by_join(docs, items, window, gram)
    got = items.toPandas()
    sent = docs.sparkSession.sparkContext.broadcast(Index(got["item"].tolist(), got["text"].tolist(), window, gram))
    return common.annotate(docs, "text", ADDED, lambda batch: found(*hits(sent.value, common.column(batch, "text"))))


# --- a benchmark of any size -------------------------------------------------------------------


def windows(values, lengths: list[int] | None, window: int, gram: int):
    """(k, row, place in the row, hash, second hash, fingerprint) of the windows of each length k; without lengths, of the
    windows of items. A window shorter than `window` is its own fingerprint."""
    one, two, first = hashed_words(values)
    counts, total = np.diff(first), int(first[-1])
    row_of, last = np.repeat(np.arange(len(values)), counts), np.repeat(first[1:], counts)
    for k in lengths or range(1, window + 1):
        at = np.arange(max(0, total - k + 1))
        at = at[at + k <= last[at]]
        if lengths is None:
            at = at[np.minimum(counts, window)[row_of[at]] == k]
        if len(at):
            a, b = common.gram_hash(one, k, 11)[at], common.gram_hash(two, k, 12)[at]
            mark = common.window_min(common.gram_hash(one, gram, 13), window - gram + 1)[at] if k == window else a
            yield k, row_of[at], at - first[row_of[at]], a, b, mark


WINDOWS = "k int, a long, b long, mark long"


def item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(item, k, a, b, mark): every window of the items once."""

    def run(batches):
        for part in common.slices(batches, "text"):
            for k, row, _, a, b, mark in windows(common.column(part, "text"), None, window, gram):
                yield pa.RecordBatch.from_arrays([common.column(part, "item").take(pa.array(row)), pa.array(np.full(len(row), k, np.int32)), *(pa.array(x.view(np.int64)) for x in (a, b, mark))], names=["item", "k", "a", "b", "mark"])

    return items.mapInArrow(run, "item string, " + WINDOWS).distinct()


def decontaminate_by_join(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    spark = docs.sparkSession
    have = common.cut(item_windows(items, window, gram))
    lengths = sorted(r.k for r in have.select("k").distinct().collect())  # window at most
    bits = spark.sparkContext.broadcast(common.filter_bits(have.select("mark").distinct(), "mark"))
    d1, d2, spans_, items_ = common.unused(docs, "d1", "d2", "spans", "items")
    keyed = docs.withColumns({d1: F.xxhash64("text"), d2: F.xxhash64(F.lit(1), "text")})
    texts = keyed.where("text is not null").select(F.col(d1).alias("d1"), F.col(d2).alias("d2"), "text")

    def marks(batches):
        for part in common.slices(batches, "text"):
            for _, row, _, _, _, mark in windows(common.column(part, "text"), lengths, window, gram):
                mark = mark.view(np.int64)
                keep = common.in_filter(bits.value, mark)
                pairs = np.unique(np.stack([row[keep], mark[keep]]), axis=1)
                row = pa.array(pairs[0])
                yield pa.RecordBatch.from_arrays([common.column(part, "d1").take(row), common.column(part, "d2").take(row), pa.array(pairs[1])], names=["d1", "d2", "mark"])

    # the join of fingerprints, then the texts that have common ones, each once
    shared = texts.mapInArrow(marks, "d1 long, d2 long, mark long").distinct().join(have.select("mark").distinct(), "mark", "left_semi")
    marked = common.cut(shared.groupBy("d1", "d2").agg(F.collect_set("mark").alias("marks")))
    some = common.perhaps_in(texts, "d1", marked, "d1").groupBy("d1", "d2").agg(F.min("text").alias("text")).join(marked, ["d1", "d2"])

    def extended(batches):
        for part in common.slices(batches, "text"):
            lists = common.column(part, "marks")
            own = lists.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            known = common.mix(own.view(np.uint64) + common.mix(of.astype(np.uint64)))
            for k, row, place, a, b, mark in windows(common.column(part, "text"), lengths, window, gram):
                keep = np.isin(common.mix(mark + common.mix(row.astype(np.uint64))), known)
                row = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays([common.column(part, "d1").take(row), common.column(part, "d2").take(row), pa.array(np.full(len(row), k, np.int32)), pa.array(place[keep].astype(np.int32)), *(pa.array(x[keep].view(np.int64)) for x in (a, b))], names=["d1", "d2", "k", "place", "a", "b"])

    # a window names its items once: the join gives a row for each place in a document, however many items share the window
    known = have.groupBy("k", "a", "b").agg(F.collect_set("item").alias("named"))
    met = some.mapInArrow(extended, "d1 long, d2 long, k int, place int, a long, b long").join(known, ["k", "a", "b"])
    span = F.struct(F.col("place").alias("start"), (F.col("place") + F.col("k")).alias("end"))
    hit = common.cut(met.groupBy("d1", "d2").agg(F.collect_set(span).alias(spans_), F.sort_array(F.array_distinct(F.flatten(F.collect_set("named")))).alias(items_)))
    # all documents: those that aren't hit don't take part in the join
    inside = common.flagged(keyed, d1, hit, "d1")
    flag = inside.columns[-1]
    both = inside.where(flag).join(hit.withColumnsRenamed({"d1": f"{d1}_hit", "d2": f"{d2}_hit"}), (F.col(d1) == F.col(f"{d1}_hit")) & (F.col(d2) == F.col(f"{d2}_hit")), "left").drop(f"{d1}_hit", f"{d2}_hit")
    none = inside.where(~F.col(flag)).withColumns({spans_: F.lit(None).cast(hit.schema[spans_].dataType), items_: F.lit(None).cast("array<string>")})
    rows = both.unionByName(none).drop(flag, d1, d2)

    def fn(batch):
        spans = [merge([(x["start"], x["end"]) for x in got or []]) for got in common.column(batch, spans_).to_pylist()]
        return found(np.diff(hashed_words(common.column(batch, "text"))[2]), spans, [x or [] for x in common.column(batch, items_).to_pylist()])

    return common.annotate(rows, "text", ADDED, fn).drop(spans_, items_)


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns of what decontaminate() returns."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return judged.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return digest(decontaminate(docs, common.documents(spark, sf_dir, "benchmark")))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract's rows by comparing every word position, for tests."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda s: word.findall((s or "").translate(lower))
    out = []
    for doc_id, text in docs:
        words, hit, found = split(text), set(), set()
        for item_id, item in items:
            have = split(item)
            k = min(window, len(have))
            for i in range(len(have) - k + 1) if k and item_id is not None else ():
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == have[i : i + k]:
                        hit.update(range(j, j + k))
                        found.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
