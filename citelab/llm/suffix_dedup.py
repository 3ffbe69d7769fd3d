"""Removal of long repeated byte strings by sorting suffixes.

A byte goes if it is covered by a string of LENGTH bytes that also starts anywhere else. To find those
strings, all suffixes that start one would have to be sorted; three things keep that small and lose none:

* Sampling by content. Each LENGTH-byte string has an anchor: the leftmost of its GRAM-byte pieces with
  the least hash. Equal strings have their anchors at the same distance from their start, so strings are
  grouped by anchor and by the distance's hundred; a lead is the 300 bytes that all strings of such a
  group have around their anchor. Only leads that occur twice are kept.
* Equal contexts (the bytes that the strings of a group cover) are counted, not sorted: where one occurs
  twice, all of its strings repeat. One representative stands for it below.
* For leads with different contexts the suffixes of the representatives are range-partitioned by their leading
  tokens, the lead's first 8 bytes in their order, then the lead's hash, with sampled splitters; a lead so
  frequent that several splitters equal it is dealt over their buckets. Each bucket sorts its suffixes by multikey
  quicksort: by one token of 8 bytes after the other, in the order of the bytes, going on only with suffixes that
  are equal so far. The 300 bytes of the leads are told apart by their bytes first, so tokens are taken from the
  100 bytes before and behind them. A lead that was dealt over several buckets is compared across their
  boundaries: each gives out one signature for each different string of the lead, and those are counted over all
  buckets.

Nulls: a null text is empty, loses nothing and keeps nothing. A null doc_id is an id like others.
Rows that repeat are documents of their own, so their strings occur twice. Strings never reach over
documents. An empty table gives no rows. Texts of any length are taken whole. Extra columns are kept by
dedup_strings(); those named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.llm import common

LENGTH, GRAM, PARTS = 400, 32, 4
#: Bytes of contexts in a bucket, about, and in one sort.
BUCKET_BYTES, SORT_BYTES = 16 << 20, 2 << 20
PLACE = np.uint64(31)


def ordered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number; numbers are in the order of the bytes."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | data[at + j].astype(np.uint64)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


class Runs:
    """The groups of strings of some rows: row, anchor q, distances l1..l2 (q - start), lead, context digest."""

    def __init__(self, values, length: int = LENGTH, gram: int = GRAM, parts: int = PARTS) -> None:
        data, offsets = common.text_bytes(values)
        self.data, self.offsets = data, offsets
        n, w, step = len(data), length - gram + 1, length // parts
        self.prefix = common.prefix_hash(data, 5)
        at = np.arange(max(0, n - gram + 1))
        grams = common.span_hash(self.prefix, at, at + gram, 5)
        # the place below the hash: of equal hashes the leftmost is the least
        least = common.window_min((grams >> PLACE << PLACE) | at.astype(np.uint64), w)
        p = np.arange(len(least))
        row = np.searchsorted(offsets, p, "right") - 1
        ok = p + length <= offsets[row + 1] if len(p) else np.zeros(0, bool)
        p, row, q = p[ok], row[ok], (least[ok] & np.uint64((1 << 31) - 1)).astype(np.int64)
        part = (q - p) // step
        new = np.ones(len(p), bool)
        new[1:] = (q[1:] != q[:-1]) | (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(p)) - 1 if len(begin) else begin
        self.row, self.q, part = row[begin], q[begin], part[begin]
        self.l2, self.l1 = self.q - p[begin], self.q - p[end]
        back = part * step
        self.lead = (common.span_hash(self.prefix, self.q - back, self.q + length - step - back, 5) + part.astype(np.uint64)).view(np.int64)
        self.length = length

    def tokens(self, keep: np.ndarray) -> np.ndarray:
        """The leads' first 8 bytes as numbers in the order of the bytes."""
        step = self.length // PARTS
        return ordered(self.data, self.q[keep] - self.l2[keep] // step * step)

    def digests(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the contexts and their place around the anchor."""
        s, e = (self.q - self.l2)[keep], (self.q - self.l1 + self.length)[keep]
        salt = (self.l1[keep] * 4096 + self.l2[keep]).astype(np.uint64)
        other = common.prefix_hash(self.data, 6)
        return tuple(common.mix(common.span_hash(x, s, e, seed) + salt * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) for x, seed in ((self.prefix, 5), (other, 6)))


def _instance(ih: np.ndarray, q: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """A name for a context where it stands; only rows that repeat id and text share names."""
    return common.mix(ih.view(np.uint64) + common.mix((q * 4096 + l1).astype(np.uint64))).view(np.int64)


def leads(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for part in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(Runs(common.column(part, "text"), length).lead)], names=["lead"])

    return docs.select("text").mapInArrow(run, "lead long")


def contexts(docs: DataFrame, seen: np.ndarray, length: int) -> DataFrame:
    """(doc_id, rh, q, l1, l2, token, lead, d1, d2, inst) of each group whose lead is in the filter; q from the text's start."""
    sent = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches):
        for part in common.slices(batches, "text"):
            r = Runs(common.column(part, "text"), length)
            keep = np.flatnonzero(common.in_filter(sent.value, r.lead))
            row = r.row[keep]
            q = r.q[keep] - r.offsets[row]
            rh = common.column(part, "rh").to_numpy()[row]
            d1, d2 = r.digests(keep)
            ih = common.column(part, "ih").to_numpy()[row]
            cols = [rh, q, r.l1[keep], r.l2[keep], r.tokens(keep), r.lead[keep], d1, d2, _instance(ih, q, r.l1[keep])]
            yield pa.RecordBatch.from_arrays([common.column(part, "doc_id").take(pa.array(row)), *map(pa.array, cols)], names=names)

    names = ["doc_id", "rh", "q", "l1", "l2", "token", "lead", "d1", "d2", "inst"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names[1:]]])
    return docs.select("doc_id", "rh", "ih", "text").mapInArrow(run, schema)


class Splitters:
    """Leads (token, hash) that divide the buckets in their order, and those that are dealt over several: leads that
    several splitters equal and whose contexts are more than one sort holds."""

    def __init__(self, token: np.ndarray, lead: np.ndarray, n: int, total: int) -> None:
        order = np.lexsort((lead, token))
        token, lead = token[order], lead[order]
        at = np.linspace(0, len(token), n + 1).astype(int)[1:-1] if len(token) else np.zeros(0, int)
        self.n, self.tokens, self.leads = n, token[at], lead[at]
        value, count = np.unique(self.leads, return_counts=True)
        value = value[count > 1]
        by_lead = np.sort(lead)
        share = (np.searchsorted(by_lead, value, "right") - np.searchsorted(by_lead, value, "left")) / max(1, len(lead))
        self.frequent = value[share * total > SORT_BYTES]

    def place(self, token: np.ndarray, lead: np.ndarray, side: str) -> np.ndarray:
        """How many splitters come before each lead (side right: or equal it)."""
        low, high = np.searchsorted(self.tokens, token, "left"), np.searchsorted(self.tokens, token, "right")
        out = low.copy()
        tied = np.flatnonzero(low < high)
        for first in np.unique(low[tied]):  # a run of splitters with one token, at most as many as there are buckets
            own = tied[low[tied] == first]
            out[own] = first + np.searchsorted(self.leads[first : high[own[0]]], lead[own], side)
        return out

    def bucket(self, token: np.ndarray, lead: np.ndarray, d1: np.ndarray) -> np.ndarray:
        low, high = self.place(token, lead, "left"), self.place(token, lead, "right")
        share = (d1.view(np.uint64) >> np.uint64(40)).astype(np.float64) / (1 << 24)
        return np.where(np.isin(lead, self.frequent), low + (share * (high - low + 1)).astype(np.int64), low)


SAMPLE = 1_000_000


def splitters(contexts: DataFrame, n: int, total: int) -> Splitters:
    """From a sample of 20 leads a bucket, SAMPLE at most, of contexts (token, lead, d1) of `total` bytes."""
    rows = contexts.count()
    part = min(1.0, min(20 * n, SAMPLE) / max(1, rows))
    sample = contexts.where(F.pmod(F.xxhash64("d1"), F.lit(1 << 30)) < int(part * (1 << 30))).select("token", "lead").toPandas()
    return Splitters(sample["token"].to_numpy(np.int64), sample["lead"].to_numpy(np.int64), n, total)


def context_bytes(docs: DataFrame, seen: np.ndarray, chosen: np.ndarray, split: Splitters, length: int) -> DataFrame:
    """(bucket, token, lead, d1, d2, l1, l2, ctx) of the contexts whose instance is in the second filter."""
    sc = docs.sparkSession.sparkContext
    sent, picked, parts = sc.broadcast(seen), sc.broadcast(chosen), sc.broadcast(split)

    def run(batches):
        for part in common.slices(batches, "text"):
            r = Runs(common.column(part, "text"), length)
            keep = np.flatnonzero(common.in_filter(sent.value, r.lead))
            row = r.row[keep]
            inst = _instance(common.column(part, "ih").to_numpy()[row], r.q[keep] - r.offsets[row], r.l1[keep])
            keep = keep[common.in_filter(picked.value, inst)]
            if len(keep):
                d1, d2 = r.digests(keep)
                s, e = (r.q - r.l2)[keep].tolist(), (r.q - r.l1 + length)[keep].tolist()
                whole = r.data.tobytes()
                ctx = pa.array([whole[i:j] for i, j in zip(s, e, strict=True)], pa.binary())
                token = r.tokens(keep)
                bucket = pa.array(parts.value.bucket(token, r.lead[keep], d1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([bucket, *map(pa.array, (token, r.lead[keep], d1, d2, r.l1[keep], r.l2[keep])), ctx], names=["bucket", "token", "lead", "d1", "d2", "l1", "l2", "ctx"])

    return docs.select("ih", "text").mapInArrow(run, "bucket int, token long, lead long, d1 long, d2 long, l1 long, l2 long, ctx binary")


def multikey(groups: np.ndarray, token, depth: int) -> np.ndarray:
    """Multikey quicksort by levels, beginning with the numbered groups: numbers of the groups of suffixes that are equal
    in all `depth` tokens, in the order of the tokens; 0 for a suffix alone. token(k, which): the k-th token of suffixes."""
    out = np.zeros(len(groups), np.int64)
    active = np.argsort(groups, kind="stable")
    own = groups[active]

    def several(active, own):
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        number = np.cumsum(new)
        many = np.bincount(number)[number] > 1 if len(number) else new
        return active[many], number[many]

    active, own = several(active, own)
    for k in range(depth):
        key = token(k, active)
        # only groups that this token parts are sorted
        same = own[1:] == own[:-1]
        parted = np.unique(own[1:][same & (key[1:] != key[:-1])])
        if len(parted):
            at = np.flatnonzero(np.isin(own, parted))
            order = at[np.lexsort((key[at], own[at]))]
            active[at], key[at] = active[order], key[order]
            new = np.ones(len(own), bool)
            new[1:] = ~same | (key[1:] != key[:-1])
            active, own = several(active, np.cumsum(new))
    out[active] = own
    return out


OUT = "kind int, lead long, l long, s1 long, s2 long, d1 long, d2 long, lo long, hi long"
NAMES = ["kind", "lead", "l", "s1", "s2", "d1", "d2", "lo", "hi"]


def sort_suffixes(rows: list[tuple], edges: set, length: int, parts: int = PARTS) -> pa.RecordBatch:
    """rows: (lead, d1, d2, l1, l2, ctx). Kind 0: distances lo..hi of context (d1, d2) at which a string repeats here;
    kind 1: one signature (s1, s2) for each different string of the leads in `edges`."""
    lead, d1, d2, l1, l2 = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
    step, own = length // parts, length - length // parts  # `own` bytes of a context are its lead
    data = np.frombuffer(b"".join(r[5] for r in rows) + bytes(8), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])])[:-1]
    back = l2 // step * step
    number: dict[bytes, int] = {}
    numbers = np.array([number.setdefault(r[5][s : s + own], len(number)) for r, s in zip(rows, (l2 - back).tolist(), strict=True)], np.int64)
    count = l2 - l1 + 1
    ctx = np.repeat(np.arange(len(rows)), count)
    along = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
    start, dist = base[ctx] + along, l2[ctx] - along
    # what is before the lead, in whole tokens that may reach into it; then what is behind, in tokens that end with the string
    before = dist - back[ctx]
    n_before, n_behind = -(-before // 8), -(-(step - before) // 8)
    behind = start + length - 8 * n_behind

    def token(k: int, which: np.ndarray) -> np.ndarray:
        left, n = n_before[which], n_behind[which]
        at = np.where(k < left, start[which] + 8 * k, behind[which] + 8 * np.minimum(k - left, n - 1))
        return ordered(data, np.where((k >= left) & (n == 0), start[which], at))

    # strings with a lead in common at one distance; their number in the bytes' order of what differs
    group = numbers[ctx] * length + dist
    same = multikey(group, token, -(-step // 8) + 1)
    prefix = common.prefix_hash(data, 8)
    hit = same > 0
    # runs of distances that repeat, within a context
    new = hit.copy()
    new[1:] &= ~hit[:-1] | (ctx[1:] != ctx[:-1])
    last = hit.copy()
    last[:-1] &= ~hit[1:] | (ctx[1:] != ctx[:-1])
    b, e = np.flatnonzero(new), np.flatnonzero(last)
    zero = np.zeros(len(b), np.int64)
    cols = [zero.astype(np.int32), lead[ctx[b]], zero, zero, zero, d1[ctx[b]], d2[ctx[b]], dist[e], dist[b]]
    at = np.flatnonzero(np.isin(lead, np.array(sorted(edges), np.int64))[ctx])
    if len(at):
        _, one = np.unique(np.where(same[at] > 0, same[at], -1 - at), return_index=True)
        at = at[one]
        s1 = common.span_hash(prefix, start[at], start[at] + length, 8).view(np.int64)
        other = common.prefix_hash(data, 9)
        s2 = common.span_hash(other, start[at], start[at] + length, 9).view(np.int64)
        more = [np.ones(len(at), np.int32), lead[ctx[at]], dist[at], s1, s2, d1[ctx[at]], d2[ctx[at]], dist[at], dist[at]]
        cols = [np.concatenate(x) for x in zip(cols, more, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=NAMES)


def sorted_buckets(rows: DataFrame, split: Splitters, length: int) -> DataFrame:
    """What sort_suffixes() gives for every bucket."""
    edges = {int(x) for x in split.frequent}

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0] and size >= SORT_BYTES:
                    yield sort_suffixes(held, edges, length)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield sort_suffixes(held, edges, length)

    dealt = rows.repartitionById(split.n, F.col("bucket")).sortWithinPartitions("bucket", "token", "lead")
    return dealt.select("lead", "d1", "d2", "l1", "l2", "ctx").mapInArrow(run, OUT)


def repeated_spans(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, rh, spans): where each text (doc_id, rh, text) has strings that occur elsewhere; spans may overlap."""
    docs = docs.select("doc_id", "rh", "text", F.xxhash64("doc_id", "text").alias("ih"))
    counted = common.cut(leads(docs, length).groupBy("lead").agg(F.count("*").alias("c")).where("c > 1").select("lead"))
    seen = common.filter_bits(counted, "lead")
    groups = common.cut(contexts(docs, seen, length))
    different = common.cut(groups.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min("inst").alias("inst"), F.min("token").alias("token"), F.min("lead").alias("lead"), F.min("l1").alias("l1"), F.min("l2").alias("l2")))
    mixed = different.groupBy("lead").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select("lead")
    mixed = common.cut(mixed)  # a plain side of the join, so that a lead of many contexts can be dealt over several tasks
    sort = common.cut(different.join(mixed, "lead").select("inst", "token", "lead", "d1", "l1", "l2"))
    total = sort.agg(F.sum(F.col("l2") - F.col("l1") + length)).first()[0]
    cover = different.where("c > 1").select("d1", "d2", F.col("l1").alias("lo"), F.col("l2").alias("hi"))
    if total:
        n = max(common.shuffle_parts(docs.sparkSession), -(-total // bucket_bytes))
        split = splitters(sort.select("token", "lead", "d1"), n, total)
        found = common.cut(sorted_buckets(context_bytes(docs, seen, common.filter_bits(sort, "inst"), split, length), split, length))
        edge = found.where("kind = 1")
        twice = edge.groupBy("lead", "l", "s1", "s2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
        across = edge.join(twice, ["lead", "l", "s1", "s2"])
        cover = cover.union(found.where("kind = 0").select("d1", "d2", "lo", "hi")).union(across.select("d1", "d2", "lo", "hi"))
    met = groups.join(cover.distinct(), ["d1", "d2"]).select("doc_id", "rh", F.struct((F.col("q") - F.col("hi")).alias("start"), (F.col("q") - F.col("lo") + length).alias("end")).alias("s"))
    return met.groupBy("doc_id", "rh").agg(F.collect_set("s").alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


ADDED = [T.StructField("n_bytes", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())]


def dedup_strings(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with n_bytes, removed_spans (bytes of the text, apart from each other) and kept (the other bytes)."""
    rh, id_, h, spans_ = common.unused(docs, "rh", "id", "h", "spans")
    keyed = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias(rh))
    spans = repeated_spans(keyed.select("doc_id", F.col(rh).alias("rh"), "text").where("text is not null"), length, bucket_bytes)
    spans = spans.select(F.col("doc_id").alias(id_), F.col("rh").alias(h), F.col("spans").alias(spans_)).hint("shuffle_hash")
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(rh) == F.col(h)) & F.col("text").isNotNull(), "left").drop(id_, h, rh)

    def fn(batch):
        raw = [(x.as_py() or "").encode() for x in common.column(batch, "text")]
        spans = [merged(x or []) for x in common.column(batch, spans_).to_pylist()]
        kept = []
        for text, gone in zip(raw, spans, strict=True):
            edges = [0, *(i for s in gone for i in s), len(text)]
            kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if gone else text)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array([len(x) for x in raw], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind), pa.array(kept, pa.binary())]

    return common.annotate(joined, "text", ADDED, fn).drop(spans_)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: the kept bytes as text; a removed run may cut a character in two, of which U+FFFD is left then."""
    out = dedup_strings(common.documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    text = F.when(F.size("removed_spans") == 0, F.coalesce("text", F.lit(""))).otherwise(F.try_validate_utf8(F.col("kept").cast("string")))
    text = F.coalesce(text, F.make_valid_utf8(F.col("kept").cast("string")))
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


def brute_force(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The contract's rows by counting all strings, for tests."""
    import hashlib
    from collections import Counter

    raw = [(t or "").encode() for _, t in docs]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(docs, raw, strict=True):
        gone, spans, end = bytearray(len(t)), 0, 0
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                spans += i > end or not spans
                gone[i : i + length] = b"\1" * length
                end = i + length
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
