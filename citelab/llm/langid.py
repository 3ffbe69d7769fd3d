"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier over hashed byte n-grams is
trained to predict it (logistic loss). A text gets the language whose codeword has the least
loss-weighted distance from the predicted bits; each bit weighs by how well its classifier does on
the training rows. A text whose best two codewords are about as near as each other is ambiguous.

Training uses a bounded sample: for each language the labelled rows with the least hash of their doc_id,
SAMPLE of them or as many as ROWS allow for all languages together (all of them if there are fewer; one at
least). Rows that share doc_id and lang count as one of them. Every language that a labelled row names is learned. Every text is predicted from all of its bytes.

Nulls: a null text or one without a letter is `und` with score 0. A row with a null doc_id or lang is
predicted and never trained on; its held_out is false if doc_id is null. Repeated rows are predicted
alike and trained on once. Without any labelled row every text is `und`; with one language, every text with a letter has
it. Extra columns are kept by identify(); those named like a result column are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.llm import common

#: Labelled rows that a model is fitted on, for each language and for all of them.
SAMPLE, ROWS = 250, 16_000
BITS, ORDERS = 12, (2, 3, 4)
DIMS = 1 << BITS
#: Texts whose best two languages differ by less in posterior are flagged.
AMBIGUOUS = 0.02
UND = "und"
ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
LETTER = common.class_table(lambda b: 97 <= b <= 122 or b >= 128)


def features(values):
    """For each row the L2-normalised roots of its n-gram counts; None for a row without word bytes."""
    data, offsets = common.text_bytes(values)
    data = common.lower_table()[data]
    data = np.where(LETTER[data], data, np.uint8(32))
    padded = np.concatenate([data, np.full(4, 32, np.uint8)]).astype(np.uint32)
    codes = []
    code = np.zeros(len(data), np.uint32)
    for k in range(max(ORDERS)):
        code = code * np.uint32(257) + padded[k : k + len(data)] + np.uint32(1)
        if k + 1 in ORDERS:
            h = (code ^ np.uint32(k + 1)) * np.uint32(2654435761)
            codes.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    blank = data == 32
    double = np.zeros(len(data), bool)
    double[1:] = blank[1:] & blank[:-1]
    letters = np.concatenate([[0], np.cumsum(~blank)])
    for s, e in itertools.pairwise(offsets.tolist()):
        if letters[e] == letters[s]:
            yield None
            continue
        keep = ~double[s:e]
        counts = np.zeros(DIMS, np.float32)
        for k, code in zip(ORDERS, codes, strict=True):
            part = code[s : max(s, e - k + 1)][keep[: max(0, e - s - k + 1)]]
            counts += np.bincount(part, minlength=DIMS).astype(np.float32)
        root = np.sqrt(counts)
        norm = float(np.sqrt(counts.sum()))
        yield root / norm if norm else root


def code_matrix(n: int) -> np.ndarray:
    """Rows of +1 and -1 for n languages: all splits of up to 5 languages, else fixed random ones, no two alike."""
    if n <= 5:
        rows = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(rows, np.float32).T if rows else np.ones((n, 1), np.float32)
    bits = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(7)
    best, width = None, -1
    for _ in range(50):
        m = rng.choice(np.array([1, -1], np.float32), size=(n, bits))
        near = ((bits - m @ m.T) / 2 + np.eye(n) * bits).min()
        if near > width and (np.abs(m.sum(0)) < n).all():
            best, width = m, near
    return best


class Model:
    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray, steps: int = 200) -> None:
        self.langs, self.code = langs, code_matrix(max(1, len(langs)))
        bits = self.code.shape[1]
        self.w, self.b = np.zeros((DIMS, bits), np.float32), np.zeros(bits, np.float32)
        self.weight = np.ones(bits, np.float32)
        if len(langs) > 1:
            goal = self.code[y]
            share = np.bincount(y, minlength=len(langs))
            row_weight = (len(y) / (len(langs) * share[y])).astype(np.float32)[:, None]
            vw, vb, rate = np.zeros_like(self.w), np.zeros_like(self.b), np.float32(40)
            for _ in range(steps):  # full gradient with momentum
                margin = goal * (x @ self.w + self.b)
                pull = -goal * row_weight / (1 + np.exp(np.clip(margin, -30, 30))) / len(y)
                vw = np.float32(0.9) * vw - rate * (x.T @ pull + np.float32(1e-6) * self.w)
                vb = np.float32(0.9) * vb - np.float32(0.5) * pull.sum(0)
                self.w, self.b = self.w + vw, self.b + vb
            right = ((goal * (x @ self.w + self.b) > 0) * row_weight).mean(0)
            self.weight = np.maximum(np.log(np.maximum(right, 0.5) / np.maximum(1 - right, 1e-3)), 0.01).astype(np.float32)
            self.weight /= self.weight.sum()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, posterior and ambiguity for each row."""
        bits = x @ self.w + self.b
        loss = np.stack([(self.weight * np.logaddexp(0, -row * bits)).sum(1) for row in self.code], axis=1)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)  # of equally near ones, the first in the order of names
        top = np.sort(p, axis=1)[:, ::-1]
        close = top[:, 0] - top[:, 1] < AMBIGUOUS if p.shape[1] > 1 else np.zeros(len(p), bool)
        return best, top[:, 0].astype(float), close


def train(rows: DataFrame, sample: int = SAMPLE, total: int = ROWS) -> Model:
    """A model of the (doc_id, text, lang) rows."""
    named = rows.where("lang is not null and text is not null and doc_id is not null").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    different = named.groupBy("lang", "h").agg(F.count("*").alias("rows")).select("lang", "h")
    languages = different.select("lang").distinct().count()
    each = max(1, min(sample, total // max(1, languages)))
    # `total` names at most, or one for each language
    chosen = named.join(F.broadcast(common.least_by_hash(different, "lang", "h", each, few=languages <= total)), ["lang", "h"])

    def fn(batch):
        return [pa.array([None if x is None else x.astype(np.float16).tobytes() for x in features(common.column(batch, "text"))], pa.binary())]

    made = common.annotate(chosen, "text", [T.StructField("x", T.BinaryType())], fn).where("x is not null")
    got = made.groupBy("lang", "h").agg(F.min("x").alias("x")).orderBy("lang", "h").select("lang", "x").toPandas()
    langs = sorted(got["lang"].unique().tolist())
    place = {v: i for i, v in enumerate(langs)}
    y = np.array([place[v] for v in got["lang"]], np.int64)
    x = np.zeros((len(got), DIMS), np.float32)
    for i, v in enumerate(got.pop("x")):
        x[i] = np.frombuffer(v, np.float16)
    return Model(langs, x, y)


def no_letter(text: str) -> bool:
    return not any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch):
        m, text = sent.value, common.column(batch, "text")
        lang, score, close = [UND] * len(text), np.zeros(len(text)), np.zeros(len(text), bool)
        rows, xs = [], []
        for i, x in enumerate(features(text)):
            if x is not None:
                rows.append(i)
                xs.append(x)
        for at in range(0, len(rows) if m.langs else 0, 256):
            part = rows[at : at + 256]
            best, p, flag = m.decode(np.stack(xs[at : at + 256]))
            for i, b, s, f in zip(part, best.tolist(), p.tolist(), flag.tolist(), strict=True):
                raw = text[i].as_py()
                if not raw[:200].isascii() or not any("a" <= c <= "z" for c in raw[:200].lower()):
                    if no_letter(raw):
                        continue
                lang[i], score[i], close[i] = m.langs[b], s, f
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())]

    return common.annotate(docs, "text", ADDED, fn)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
