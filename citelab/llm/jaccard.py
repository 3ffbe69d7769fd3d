"""N-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct shingles (five words, hashed to 64 bits). Documents with equal sets
form a class, joined through one representative. All sets are ordered alike, rare shingles first: those that are
frequent in prefixes come last, by the number of documents they were counted in, the others (in OFTEN prefixes at
most) first, by hash. Two sets can only reach the similarity if
they share a shingle in their prefixes, so representatives are joined on prefix shingles; pairs pass
the length and the positional filter in the join and the suffix filter before their sets are
intersected, once per pair.

Connected components don't need every link. Large groups are first joined with one member each, a
few times with another one, and only pairs that these links haven't connected yet are enumerated;
together that finds every component that all links would give.

Ids are integers. Nulls: a null text, and one without words, has the empty set and no link. A row whose doc_id is null
links with nothing and has a null component_id. Rows that share a doc_id are one document: what links
one of them links it. Repeated rows are returned as often as they are given. An empty table gives no
rows. Extra columns aren't read. Ties need no rule: all choices among equals give the same components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.llm import common

WORDS, PERCENT = 5, 80
#: A shingle in more prefixes than this is frequent; at most FREQUENT of them, the most frequent ones,
#: are sent to all executors (12 bytes each). Which ones are doesn't change the result.
OFTEN, FREQUENT = 32, 1 << 22
#: How often groups are joined with one member before the rest is enumerated: the first time all groups,
#: then those of more than LARGE members.
ROUNDS, LARGE = 2, 64
NOT_SPACE = common.class_table(lambda b: b != 32 and not 9 <= b <= 13)


def shingles(values, words: int = WORDS):
    """For each row its distinct shingles, sorted by hash."""
    data, offsets = common.text_bytes(values)
    data = common.lower_table()[data]
    starts, ends, first = common.word_spans(data, offsets, NOT_SPACE)
    hashed = common.span_hash(common.prefix_hash(data, 3), starts, ends, 3)
    full = common.gram_hash(hashed, words, 20 + words)
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = e - s
        if n >= words:
            yield np.unique(full[s : e - words + 1])
        else:  # the whole sequence as one, hashed apart from the shingles of other lengths
            yield common.gram_hash(hashed[s:e], n, 20 + n) if n else np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class Frequent:
    """Frequent shingles, sorted by hash, and their places in the order from the rarest on."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        by_hash = np.argsort(tokens)
        self.tokens = tokens[by_hash]
        self.place = np.empty(len(tokens), np.int32)
        self.place[np.lexsort((self.tokens, counts[by_hash]))] = np.arange(len(tokens), dtype=np.int32)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x are frequent, and where x are among them."""
        if not len(self.tokens):
            return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, x), len(self.tokens) - 1)
        return self.tokens[at] == x, at


def ordered_prefix(x: np.ndarray, frequent: Frequent, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of x: those that aren't frequent by hash, then the frequent ones from the rarest on."""
    p = prefix_length(len(x), percent)
    late, at = frequent.find(x)
    if not late[:p].any():
        return x[:p]
    rare = x[~late][:p]
    if len(rare) == p:
        return rare
    often = x[late]
    return np.concatenate([rare, often[np.argsort(frequent.place[at[late]])][: p - len(rare)]])


def least_overlap(n, m, percent: int = PERCENT):
    """The overlap that sets of n and m need: inter / (n + m - inter) >= percent / 100."""
    return -(-percent * (n + m) // (100 + percent))


def far_apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> int:
    """A lower bound of the number of elements in which sorted x and y differ (the suffix filter)."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    k = len(y) // 2
    i = int(np.searchsorted(x, y[k]))
    same = i < len(x) and x[i] == y[k]
    xr, yr = x[i + same :], y[k + 1 :]
    right = abs(len(xr) - len(yr))
    bound = abs(i - k) + right + (not same)
    if bound > most:
        return bound
    left = far_apart(x[:i], y[:k], most - right - (not same), depth - 1)
    if left + right + (not same) > most:
        return left + right + (not same)
    return left + far_apart(xr, yr, most - left - (not same), depth - 1) + (not same)


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    n, m = len(x), len(y)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    need = least_overlap(n, m, percent)
    if far_apart(x, y, n + m - 2 * need) > n + m - 2 * need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


# --- prefixes ----------------------------------------------------------------------------------


def frequent_shingles(docs: DataFrame, percent: int, words: int, often: int = OFTEN, most: int = FREQUENT) -> Frequent:
    """Shingles that are frequent, at most `most` of them: first those that more than `often` documents have in
    the prefix by hash, then, over all shingles of the documents a quarter of whose prefix are such ones, those that
    more than `often` have (what follows in the order when the first ones go behind is as frequent)."""
    spark = docs.sparkSession

    def top(own) -> Frequent:
        def run(batches):
            for part in common.slices(batches, "text"):
                found = [own(x) for x in shingles(common.column(part, "text"), words)]
                if found:
                    values, counts = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], names=["token", "n"])

        counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        many = common.cut(counts.where(F.col("n") > often))
        # the least count at which no more than `most` are left; counts beyond 4096 are as one
        sizes = many.groupBy(F.least("n", F.lit(4096)).alias("n")).count().orderBy(F.desc("n")).collect()
        least, total = None, 0
        for n, c in sizes:
            total += c
            if total > most:
                break
            least = n
        got = many.where(F.col("n") >= (least or 0)).toPandas() if least else None
        if got is None:
            return Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return Frequent(got["token"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64))

    first = top(lambda x: x[: prefix_length(len(x), percent)])
    if not len(first.tokens):
        return first
    sent = spark.sparkContext.broadcast(first)

    def all_or_frequent(x: np.ndarray) -> np.ndarray:
        head = x[: prefix_length(len(x), percent)]
        found = sent.value.find(head)[0]
        return x if 4 * found.sum() > len(head) else head[found]

    return top(all_or_frequent)


def with_prefixes(docs: DataFrame, frequent: Frequent, percent: int, words: int) -> DataFrame:
    """(doc_id, n, sig, prefix) of every row: the set's size, its digest, its first shingles in order."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for part in common.slices(batches, "text"):
            n, sig, prefix = [], [], []
            for x in shingles(common.column(part, "text"), words):
                n.append(len(x))
                sig.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                prefix.append(ordered_prefix(x, sent.value, percent).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]), pa.int32()), pa.array(np.concatenate(prefix)))
            yield pa.RecordBatch.from_arrays([common.column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists], names=["doc_id", "n", "sig", "prefix"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- pairs -------------------------------------------------------------------------------------


def could_reach(a: str, b: str, percent: int):
    """The length and the positional filter for rows a and b that share a shingle, if it's the first they share."""
    n, m, i, j = (F.col(f"{t}.{c}") for c in ("n", "at") for t in (a, b))
    room = F.least(n - i, m - j)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * room >= percent * (n + m))


def star_pairs(group: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a shingle's group with one leader, where the two aren't known to be connected."""
    order = F.col("node").cast("long") if turn == 0 else F.xxhash64(F.lit(turn), "node")
    lead = group.groupBy("token").agg(F.min(F.struct(order.alias("o"), "node", "n", "at", "comp")).alias("l")).select("token", "l.*")
    a, b = lead.alias("a"), group.alias("b")
    pairs = b.join(a, (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & could_reach("a", "b", percent))
    return pairs.select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct()


def all_pairs(group: DataFrame, percent: int) -> DataFrame:
    a, b = group.alias("a"), group.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & could_reach("a", "b", percent))
    return pairs.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar; each is intersected once."""
    named = pairs.select(F.explode(F.array("x", "y")).alias("node")).select(F.xxhash64("node").alias("h"))
    texts = common.perhaps_in(texts.select("doc_id", "text", F.xxhash64("doc_id").alias("h")), "h", named, "h", common.bits_for(2 * pairs.count()))
    x, y = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))

    def run(batches):
        last, kept = object(), None  # rows of one x tend to follow each other
        for part in common.slices(batches, "ty", common.STEP_BYTES):
            keep = []
            for i, (key, other) in enumerate(zip(common.column(part, "x").to_pylist(), shingles(common.column(part, "ty"), words), strict=True)):
                if key != last:
                    last, kept = key, next(shingles(common.column(part, "tx").slice(i, 1), words))
                keep.append(similar(kept, other, percent))
            yield pa.RecordBatch.from_arrays([common.column(part, "x"), common.column(part, "y"), pa.array(keep, pa.bool_())], names=["x", "y", "ok"])

    both = pairs.join(y, "y").join(x, "x").select("x", "y", "tx", "ty")
    schema = T.StructType([T.StructField("x", x.schema["x"].dataType), T.StructField("y", x.schema["x"].dataType), T.StructField("ok", T.BooleanType())])
    return both.mapInArrow(run, schema).where("ok").select("x", "y").distinct()


# --- components --------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (x, y): comp is the least node of its component.

    Stars are turned towards lesser nodes by turns until nothing changes; all of it stays distributed.
    """
    edges = common.cut(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        # large star: the greater neighbours of u go to the least of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours go to the least of those
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = common.cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def shared_filter(rows: DataFrame) -> np.ndarray:
    """Bits of the prefix shingles that more than one row has."""
    shared = rows.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    return common.filter_bits(common.cut(shared), "token")


def prefix_groups(rows: DataFrame, seen: np.ndarray) -> DataFrame:
    """(token, node, n, at) of the prefix shingles whose bit is set."""
    sent = rows.sparkSession.sparkContext.broadcast(seen)

    def run(batches):
        for part in batches:
            lists = common.column(part, "prefix")
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(part.num_rows), sizes)
            at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(common.in_filter(sent.value, tokens))
            row = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep]), common.column(part, "doc_id").take(row), common.column(part, "n").take(row), pa.array(at[keep], pa.int64())], names=["token", "node", "n", "at"])

    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("node", rows.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("at", T.LongType())])
    return rows.select("doc_id", "n", "prefix").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, often: int = OFTEN, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, sig) for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = common.cut(with_prefixes(docs, frequent_shingles(docs, percent, words, often), percent, words))
    named = rows.where("doc_id is not null and n > 0")
    # only sets that several rows have need a representative; what is cut here is a plain side of the joins below, so
    # that the many rows of one set can be dealt over several tasks
    copies = common.cut(named.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("sig", "rep"))
    first = named.join(copies, "sig", "left").where("rep is null or rep = doc_id")
    group = common.cut(prefix_groups(first, shared_filter(named)))
    texts = docs.where("doc_id is not null and text is not null")
    now, labels, tested = group.withColumn("comp", F.col("node")), None, None
    for turn in range(rounds + 1):
        if labels is not None:
            now = now.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        large = now
        if turn:  # groups that aren't one component yet; before the last turn only large ones
            open_ = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
            now = common.cut(now.join(open_.select("token", "c"), "token"))
            large = now.where(F.col("c") > LARGE) if turn < rounds else now
            now, large = now.drop("c"), large.drop("c")
        pairs = star_pairs(large, turn, percent) if turn < rounds else all_pairs(large, percent)
        pairs = common.cut(pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti"))
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.union(pairs)
        new = verified(pairs, texts, percent, words)
        # the components so far stand for the links that made them
        edges = new if labels is None else new.union(labels.where("node <> comp").select(F.col("node").alias("x"), F.col("comp").alias("y")))
        labels = components(edges)
    # rows of the empty set, which are alike too, join with nothing
    node = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("node")
    out = rows.where("n > 0").join(copies, "sig", "left").select("doc_id", "n", "sig", node)
    if labels is not None:
        out = out.join(common.cut(labels), "node", "left")
    else:
        out = out.withColumn("comp", F.col("node"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "sig")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component_id"), "sig").unionByName(alone)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def brute_force(docs: list[tuple], percent: int = PERCENT, words: int = WORDS) -> list[tuple]:
    """The contract's rows by comparing all pairs, for tests."""
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = {d: d for d, _ in docs if d is not None}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            b = docs[j][0]
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(d, len(s), None if d is None else root(d)) for (d, _), s in zip(docs, sets, strict=True)]


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs without near-duplicates: of each component the row with the least doc_id stays.

    Rows without a doc_id stay. If rows share the doc_id that stays, the one with the least text does.
    """
    found = near_duplicates(docs, percent, words)
    kept, count, row = common.unused(docs, "kept", "count", "row")
    keep = common.cut(found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias(count)).withColumnRenamed("doc_id", kept))
    named = docs.join(keep.select(kept), F.col("doc_id") == F.col(kept), "left_semi")
    if not keep.where(F.col(count) > 1).isEmpty():
        # rows that share an id: their texts' digests are compared, by a combining aggregate
        text = F.struct(F.col("text").isNull().alias("none"), F.col("text").alias("text"))
        several = keep.where(F.col(count) > 1).select(kept)
        alone = named.join(several, F.col("doc_id") == F.col(kept), "left_anti")
        one = named.join(several, F.col("doc_id") == F.col(kept), "left_semi").select("doc_id", text.alias(row), F.struct(*docs.columns).alias(count))
        one = one.groupBy("doc_id").agg(F.min_by(count, row).alias(count)).select(f"{count}.*")
        named = alone.unionByName(one)
    return named.unionByName(docs.where("doc_id is null"))
