"""Quality of texts by votes of their nearest labelled neighbours in a latent-semantic space.

A text's terms are its hashed byte trigrams and the shapes of its words, alone and in twos (a shape is a word with
its runs of capitals, small letters and digits taken together and its signs kept; two equal words in a row differ from two of equal
shape). They weigh by the log of
their count and by how few documents have them, counted over all documents. The space is the span of the leading singular vectors of
the labelled rows' terms. Labelled rows lie in it as unit vectors and are sent to the tasks; every document's cosine with each of
them is computed in blocks of documents, without an index. The NEIGHBOURS nearest vote with their label, weighted by a power of
their cosine; rows as near as the last of them vote too. Votes of labels count by how often they are in all labels, not in the sample.

Training uses a bounded sample: for each label the SAMPLE labelled documents with the least hash of their doc_id (all of
them if there are fewer). A doc_id with several labels has their mean. Of rows that share a doc_id one counts, not an empty one if another is there.

Nulls and empty texts have no terms: their score is the share of label 1. So is every score if nothing is labelled (0.5 then) and
where no labelled row has a positive cosine. Labels with a null doc_id or quality are left out. Repeated rows get equal scores.
An empty table gives no rows. Extra columns are kept by score(); those named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.llm import common

#: Labelled documents of each label that vote; directions of the space; neighbours asked; the power of a cosine that a vote weighs.
SAMPLE, RANK, NEIGHBOURS, POWER = 2000, 96, 25, 8
#: Hashed trigrams and hashed shapes; the weight of a shape, a trigram's being 1.
GRAMS, SHAPES, SHAPE_WEIGHT = 6144, 2048, 2
DIMS = GRAMS + SHAPES
#: From this score on a document counts as good.
GOOD = 0.3
#: Numbers in the largest block of cosines or of term counts.
BLOCK = 1 << 21
#: Cosines closer than this are ties.
TIE = 1e-5
ADDED = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[48:58], table[65:91], table[97:123], table[128:] = ord("0"), ord("A"), ord("a"), ord("a")
    return table


CLASS = _classes()
RUNS = common.class_table(lambda b: chr(b) in "0Aa")
BLANK = common.class_table(lambda b: b <= 32)


def terms(values):
    """(rows, counts): blocks of rows and the counts of their hashed terms."""
    data, offsets = common.text_bytes(values)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = data.astype(np.uint32)
    n = max(0, len(data) - 2)
    grams = (((wide[:n] << np.uint32(8) | wide[1 : n + 1]) << np.uint32(8) | wide[2 : n + 2]) * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(GRAMS)
    inside = row[2 : n + 2] == row[:n]
    # shapes: the first byte of each run within a word
    kind, blank = CLASS[data], BLANK[data]
    new_row = np.append(True, row[1:] != row[:-1])[: len(data)]
    after = np.append(True, blank[:-1])[: len(data)] | new_row
    kept = ~blank & (after | np.append(True, kind[1:] != kind[:-1])[: len(data)] | ~RUNS[kind])
    shape, first = kind[kept], np.flatnonzero(after[kept])
    owner = row[kept][first]
    ends = np.append(first[1:], len(shape))[: len(first)]
    hashed = common.span_hash(common.prefix_hash(shape, 11), first, ends, 11)
    # letters of words, to tell repeated ones
    begin = np.flatnonzero(~blank & after)
    end = np.flatnonzero(~blank & np.append(blank[1:] | new_row[1:], True)[: len(data)]) + 1
    word = common.span_hash(common.prefix_hash(common.lower_table()[data], 13), begin, end, 13)
    again = (word[1:] == word[:-1]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    pairs = common.mix(common.gram_hash(hashed, 2, 12) + again)
    same = owner[1:] == owner[:-1]
    shapes = np.concatenate([hashed, pairs[same[: len(pairs)]]]) % np.uint64(SHAPES) + np.uint64(GRAMS)
    code = np.concatenate([grams[inside].astype(np.int64), shapes.astype(np.int64)])
    of = np.concatenate([row[:n][inside], owner, owner[:-1][same] if len(owner) else owner])
    size = max(1, BLOCK // DIMS)
    if len(offsets) - 1 > size:
        order = np.argsort(of, kind="stable")
        of, code = of[order], code[order]
    for s in range(0, len(offsets) - 1, size):
        e = min(s + size, len(offsets) - 1)
        a, b = (np.searchsorted(of, [s, e]) if len(offsets) - 1 > size else (0, len(of)))
        yield slice(s, e), np.bincount((of[a:b] - s) * DIMS + code[a:b], minlength=(e - s) * DIMS).reshape(e - s, DIMS)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


@dataclass
class Space:
    """Term weights, the directions of the space, the labelled rows in it and their labels."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    vote: np.ndarray
    prior: float

    def place(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts).astype(np.float32) * self.weight) @ self.basis)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
        x, out = self.place(counts), np.full(len(counts), self.prior)
        if not len(self.vectors):
            return out
        k, size = min(neighbours, len(self.vectors)), max(1, BLOCK // len(self.vectors))
        for s in range(0, len(x), size):
            near = x[s : s + size] @ self.vectors.T
            last = np.partition(near, -k, axis=1)[:, -k][:, None]
            votes = np.where((near >= last - TIE) & (near > 0), near, 0).astype(float) ** power * self.vote
            total = votes.sum(1)
            out[s : s + size] = np.where(total > 0, (votes @ self.label) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def fit(counts: np.ndarray, label: np.ndarray, weight: np.ndarray, share: np.ndarray, prior: float, rank: int = RANK) -> Space:
    """A space of labelled rows. share: how many labelled rows each row of the sample stands for."""
    x = np.log1p(counts).astype(np.float32)
    x *= weight
    x = _unit(x)
    rank = min(rank, *x.shape)
    if not rank:
        return Space(weight, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), label, share, prior)
    # leading singular vectors by subspace iteration from fixed directions
    q = np.random.default_rng(5).standard_normal((len(x), rank + 16)).astype(np.float32)
    for _ in range(5):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    return Space(weight, basis, _unit(x @ basis), label, share, prior)


def _weights(docs: DataFrame) -> np.ndarray:
    """The weight of each hashed term by the share of all documents that have it; a vector a task is shuffled."""

    def run(batches):
        have, n = np.zeros(DIMS, np.int64), 0
        for part in common.slices(batches, "text"):
            for rows, counts in terms(common.column(part, "text")):
                have += (counts > 0).sum(0)
                n += rows.stop - rows.start
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(np.append(have, n), pa.int64())], names=["term", "n"])

    got = docs.where("text is not null").select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    have = np.zeros(DIMS + 1)
    have[got["term"]] = got["n"]
    weight = np.log((1 + have[-1]) / (1 + have[:-1])) + 0.1
    weight[GRAMS:] *= SHAPE_WEIGHT
    return weight.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Space:
    """A space from docs (doc_id, text) and labels (doc_id, quality); terms are weighed over all docs."""
    return train_on(docs, docs, labels, sample, rank)


def train_on(docs: DataFrame, taught: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Space:
    """As train(), with the labels of the rows of `taught` only."""
    named = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    named = named.join(taught.where("text is not null and doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    named = named.select("doc_id", "y", (F.col("y") >= 0.5).cast("int").alias("side"), F.xxhash64("doc_id").alias("h"))
    sides = {r.side: (r.n, r.y) for r in named.groupBy("side").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    total = sum(n for n, _ in sides.values())
    prior = sum(y for _, y in sides.values()) / total if total else 0.5
    bound = common.least_by_hash(named, "side", "h", sample, few=True)  # two sides of `sample` rows at most
    rows = taught.where("text is not null").select("doc_id", "text").join(F.broadcast(bound), "doc_id")

    def run(batches):
        for part in common.slices(batches, "text"):
            for at, counts in terms(common.column(part, "text")):
                # a count above 65,535 says no more than that
                packed = [b"".join((np.flatnonzero(c).astype(np.uint16).tobytes(), np.minimum(c[c > 0], 65535).astype(np.uint16).tobytes())) for c in counts]
                these = part.slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([*(common.column(these, n) for n in ("side", "h", "y")), pa.array(packed, pa.binary())], names=["side", "h", "y", "x"])

    made = rows.select("side", "h", "y", "text").mapInArrow(run, "side int, h long, y double, x binary")
    got = made.groupBy("side", "h", "y").agg(F.max("x").alias("x")).orderBy("side", "h").toPandas()
    counts = np.zeros((len(got), DIMS), np.uint16)
    for i, x in enumerate(got.pop("x")):
        code, n = np.frombuffer(x, np.uint16).reshape(2, -1)
        counts[i, code] = n
    side = got["side"].to_numpy(np.int64)
    share = np.array([sides.get(s, (0, 0))[0] for s in (0, 1)]) / np.maximum(1, np.bincount(side, minlength=2))
    return fit(counts, got["y"].to_numpy(float), _weights(docs), share[side], float(prior), rank)


def score(docs: DataFrame, space: Space) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from GOOD on)."""
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def fn(batch):
        got = [sent.value.scores(counts) for _, counts in terms(common.column(batch, "text"))]
        p = np.concatenate(got) if got else np.zeros(0)
        return [pa.array(p, pa.float64()), pa.array((p >= GOOD).astype(np.int32), pa.int32())]

    return common.annotate(docs, "text", ADDED, fn)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    space = train_on(docs, docs.where(~held_out()), common.documents(spark, sf_dir, "labels"))
    return score(docs, space).select("doc_id", held_out().alias("held_out"), "score", "predicted")
