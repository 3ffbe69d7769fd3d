"""Mixing a corpus to target weights with soft membership.

A classifier fitted on the labelled table gives every document a posterior over domains. Each document then gets a
nonnegative rate such that the expected tokens of each domain, the sum of rate x tokens x posterior, come as near as
possible to the targets: least squares over the documents' rates by projected gradient from rate 1. A document's
gradient is its posterior times the domains' errors, so what the steps have moved it by is its posterior times three
numbers, and its rate is the projection of 1 + that on the nonnegative numbers (steps add up before the projection, so
of all rates that meet the targets the nearest to 1 are found). A step is one distributed aggregate over all documents
with their own posteriors; it is measured by the domains' products over the documents that still have a rate, and of
several lengths the best is taken. Steps end when all totals are within TOLERANCE of the mixture, or when no step helps:
then no rates do (converged is false). Rates have no upper limit unless one is given.

Domains are those of the labels: toxic (toxic = 1), else good (quality = 1), else plain. A doc_id with
several labels counts as toxic, then good, if any of its labels says so.

The classifier is fitted on a bounded sample: for each domain the SAMPLE labelled documents with the
least hash of their doc_id. Everything else is over all rows.

Nulls: a null text has no tokens, its posterior is the domains' share among the training rows; labels
with a null doc_id or value are left out; a null doc_id is mixed like others. Repeated rows have equal
rates. Without any labelled document all domains are alike. An empty table gives no rows. Extra columns
are kept by mix(); those named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.llm import common

DOMAINS = ("good", "plain", "toxic")
#: Shares of the mixture's tokens, and the error of a share that ends the steps.
TARGETS, TOLERANCE = {"good": 0.7, "plain": 0.3, "toxic": 0.0}, 2e-3
SAMPLE = 1000
BITS, CHOSEN, GRAM = 18, 1000, 6
WORD = common.class_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
UPPER = common.class_table(lambda b: 65 <= b <= 90)
SIGN = common.class_table(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126)
DIGIT = common.class_table(lambda b: 48 <= b <= 57)
N_DENSE = 8


def features(values):
    """For each row: its number of words, the hashed words and byte pieces of words that it has, and a few ratios."""
    data, offsets = common.text_bytes(values)
    low = common.lower_table()[data]
    starts, ends, first = common.word_spans(low, offsets, WORD)
    prefix = common.prefix_hash(low, 4)
    hashed = common.span_hash(prefix, starts, ends, 4)
    # pieces of GRAM bytes within words
    inside = np.concatenate([[0], np.cumsum(WORD[low])])
    piece = np.arange(max(0, len(low) - GRAM + 1))
    piece = piece[inside[piece + GRAM] - inside[piece] == GRAM] if len(piece) else piece
    grams = (common.span_hash(prefix, piece, piece + GRAM, 4) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    begin = np.searchsorted(piece, offsets[:-1])
    end = np.maximum(begin, np.searchsorted(piece, offsets[1:] - GRAM + 1))
    sums = [np.concatenate([[0], np.cumsum(t[data])]) for t in (UPPER, SIGN, DIGIT)]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    for r in range(len(values)):
        a, b, s, e = first[r], first[r + 1], offsets[r], offsets[r + 1]
        n, size = int(b - a), max(1, int(e - s))
        words = np.unique(hashed[a:b])
        ratios = [*((x[e] - x[s]) / size for x in sums), (lengths[b] - lengths[a]) / max(1, n) / 10, len(words) / max(1, n), np.log1p(n) / 10, (lines[e] - lines[s]) / max(1, n), float(n < 5)]
        yield n, np.concatenate([(words >> np.uint64(64 - BITS)).astype(np.int64), grams[begin[r] : end[r]]]), np.array(ratios, np.float32)


class Classifier:
    """Logistic regression over the words that tell the domains apart best and the ratios."""

    def __init__(self, words: list[np.ndarray], dense: np.ndarray, y: np.ndarray, k: int = len(DOMAINS), steps: int = 300) -> None:
        self.k, self.map = k, np.full(2 << BITS, -1, np.int16)
        share = np.bincount(y, minlength=k).astype(float) + 1e-3
        self.prior = share / share.sum()
        self.w, self.mean, self.sd = None, np.zeros(N_DENSE), np.ones(N_DENSE)
        if len(np.unique(y)) < 2:
            return
        counts = np.zeros((k, 2 << BITS), np.float32)
        for c, idx in zip(y, words, strict=True):
            counts[c, np.unique(idx)] += 1
        total, size = counts.sum(0), np.bincount(y, minlength=k)
        expected = total[None] * (size / len(y))[:, None]
        chi = ((counts - expected) ** 2 / np.maximum(expected, 1e-9)).sum(0) * (total >= 4)
        best = np.argsort(-chi, kind="stable")[:CHOSEN]
        self.map[best] = np.arange(len(best))
        self.mean, self.sd = dense.mean(0), dense.std(0) + 1e-6
        x = np.zeros((len(y), CHOSEN + N_DENSE + 1), np.float32)
        for r, (i, d) in enumerate(zip(words, dense, strict=True)):
            x[r] = self._row(i, d)
        w = np.zeros((x.shape[1], k), np.float32)
        goal, first, second = np.eye(k, dtype=np.float32)[y], np.zeros_like(w), np.zeros_like(w)
        each = (len(y) / (k * np.maximum(size, 1))[y]).astype(np.float32)[:, None]
        for t in range(1, steps + 1):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ ((p - goal) * each) / len(y) + 1e-4 * w
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - np.float32(0.05) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        self.w = w.astype(np.float32)

    def _row(self, idx: np.ndarray, dense: np.ndarray) -> np.ndarray:
        x = np.zeros(CHOSEN + N_DENSE + 1, np.float32)
        at = self.map[idx]
        x[at[at >= 0]] = 1
        x[CHOSEN:-1], x[-1] = np.clip((dense - self.mean) / self.sd, -5, 5), 1
        return x

    def posterior(self, n: int, idx: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if self.w is None or not n:
            return self.prior
        at = self.map[idx]
        at = np.unique(at[at >= 0])
        z = self.w[at].sum(0) + np.clip((dense - self.mean) / self.sd, -5, 5) @ self.w[CHOSEN:-1] + self.w[-1]
        p = np.exp(z - z.max())
        return p / p.sum()


def domain() -> Column:
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    named = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    named = named.select("doc_id", domain().alias("y"), F.xxhash64("doc_id").alias("h"))
    # only labels of documents that are there count; `sample` of a domain are sent to the executors
    there = docs.where("text is not null and doc_id is not null").select("doc_id").distinct()
    bound = common.least_by_hash(named.join(there, "doc_id", "left_semi"), "y", "h", sample, few=True)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(bound), "doc_id")

    def run(batches):
        for part in common.slices(batches, "text"):
            got = list(features(common.column(part, "text")))
            yield pa.RecordBatch.from_arrays([common.column(part, "h"), common.column(part, "y"), pa.array([np.unique(i).astype(np.int32).tobytes() for _, i, _ in got], pa.binary()), pa.array([d.tobytes() for _, _, d in got], pa.binary())], names=["h", "y", "idx", "dense"])

    made = rows.select("h", "y", "text").mapInArrow(run, "h long, y int, idx binary, dense binary")
    # of rows that repeat a doc_id one counts
    got = made.groupBy("y", "h").agg(F.min(F.struct("idx", "dense")).alias("x")).orderBy("y", "h").select("y", "x.*").toPandas()
    dense = np.stack([np.frombuffer(d, np.float32) for d in got["dense"]]) if len(got) else np.zeros((0, N_DENSE), np.float32)
    return Classifier([np.frombuffer(i, np.int32) for i in got["idx"]], dense, got["y"].to_numpy(np.int64))


POSTERIOR = [T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with n_tokens and posterior (in the order of DOMAINS)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch):
        got = list(features(common.column(batch, "text")))
        return [pa.array([n for n, _, _ in got], pa.int64()), pa.array([sent.value.posterior(*x).astype(float).tolist() for x in got], pa.list_(pa.float64()))]

    return common.annotate(docs, "text", POSTERIOR, fn)


def moved(posterior: Column, pull: list[float]) -> Column:
    """What the steps have made of rate 1, before the projection."""
    out = F.lit(1.0)
    for d, x in enumerate(pull):
        out = out + posterior[d] * F.lit(float(x))
    return out


def rate(posterior: Column, pull: list[float], most: float | None = None) -> Column:
    """The rate after the steps: the projection on what rates may be."""
    r = F.greatest(F.lit(0.0), moved(posterior, pull))
    return r if most is None else F.least(F.lit(float(most)), r)


@dataclass
class Fit:
    """The sum of the steps, which rate() takes, the shares of the mixture that they reach, and whether these are the targets."""

    pull: list[float]
    shares: list[float] = field(default_factory=list)
    converged: bool = True


#: Lengths of a step that one pass tries; steps within which the largest error must have shrunk by a hundredth.
LENGTHS, PATIENCE = (1.0, 0.3, 0.1, 0.01), 8


def fit_rates(posteriors: DataFrame, targets: dict[str, float] = TARGETS, most: float | None = None, tokens: float | None = None, tolerance: float = TOLERANCE) -> Fit:
    """posteriors: n_tokens and posterior of every document; tokens: of the mixture (all, if not given)."""
    k = len(DOMAINS)
    rows = posteriors.where("n_tokens > 0").select(F.col("n_tokens").cast("double").alias("t"), F.col("posterior").alias("p"))
    p, t = F.col("p"), F.col("t")

    def totals(pulls: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each pull: the domains' expected tokens, the products of posteriors over the documents that a step moves,
        and the sum whose gradient the totals are."""
        aggs = []
        for pull in pulls:
            z, r = moved(p, pull.tolist()), rate(p, pull.tolist(), most)
            free = z > 0 if most is None else (z > 0) & (z < most)
            aggs += [F.sum(r * t * p[d]) for d in range(k)]
            aggs += [F.sum(F.when(free, t * p[a] * p[b]).otherwise(0.0)) for a in range(k) for b in range(a, k)]
            aggs += [F.sum(t * (r * z - r * r / 2))]
        row = np.array(rows.agg(*aggs).first(), float).reshape(len(pulls), -1)
        out = []
        for x in row:
            products = np.zeros((k, k))
            products[np.triu_indices(k)] = x[k:-1]
            out.append((x[:k], products + np.triu(products, 1).T, float(x[-1])))
        return out

    total = rows.agg(F.sum("t")).first()[0] or 0.0
    pull = np.zeros(k)
    if not total:
        return Fit(pull.tolist())
    share = np.array([targets[d] for d in DOMAINS], float)
    size = tokens or total
    goal = share / share.sum() * size
    ((got, products, value),) = totals([pull])
    # totals need to come as near as the tolerance only: aimed at is a point within it, on the side where they are now
    aim = goal + np.clip(got - goal, -0.8 * tolerance * size, 0.8 * tolerance * size)
    gaps: list[float] = []
    while (gap := float(np.abs(got - aim).max())) > 0.2 * tolerance * size:
        gaps.append(gap)
        if len(gaps) > PATIENCE and gap > 0.99 * min(gaps[:-PATIENCE]):
            break
        # the gradient measured by the products; the little that is added bounds steps where hardly any document has a rate
        move = np.linalg.solve(products + np.eye(k) * (np.trace(products) * 1e-9 + 1e-12), aim - got)
        tried = [pull + length * move for length in LENGTHS]
        gain = [(aim @ new - now[2], new, now) for new, now in zip(tried, totals(tried), strict=True)]
        best, new, now = max(gain, key=lambda g: g[0])
        if not best > aim @ pull - value + 1e-12 * size:
            break
        pull, (got, products, value) = new, now
    return Fit(pull.tolist(), (got / size).tolist(), bool(np.abs(got - goal).max() <= tolerance * size))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float | None = None, tokens: float | None = None, text: bool = True) -> DataFrame:
    """docs with n_tokens, posterior, domain (the likeliest), rate (how often to take the document; 0: not at all) and
    converged (whether the rates meet the targets); without their text if `text` is false. Every text is classified
    once: the fit and the result read what was kept."""
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("domain", "rate", "converged")])
    rows = with_posteriors(base, train(docs, labels))
    rows = common.cut(rows if text else rows.drop("text"))
    fit = fit_rates(rows.select("n_tokens", "posterior"), targets, most, tokens)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return rows.withColumns({"domain": F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), best), "rate": rate(F.col("posterior"), fit.pull, most), "converged": F.lit(fit.converged)})


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(common.documents(spark, sf_dir).select("doc_id", "text"), common.documents(spark, sf_dir, "labels"), text=False)
    return out.select("doc_id", "n_tokens", "domain", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "converged")
