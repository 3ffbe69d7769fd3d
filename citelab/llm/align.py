"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and which ids go together.

A byte-level BPE (A, with a space before the text) and a piece model (B, which adds the space itself) cut the same
bytes. The tokens of all documents of an Arrow slice are laid behind each other; the ends of A's and of B's tokens are
counted by byte once, and where both end, both are cut. Between neighbouring ends one token of each covers the bytes,
so the ends are the links (token pairs whose byte ranges overlap), and prefix sums of ends and cuts at the documents'
bounds give each document its links and groups.

tokenised() reads every text once and keeps the ids. pair_counts() counts id pairs over the corpus: each task adds up
what it has, one row a pair and task is shuffled. aligned() gives every document its figures: the SENT most frequent pairs
are sent to the tasks as sorted arrays (a proven bound); what a document has of rarer ones is joined with their counts, a row a
document and rare pair, so results are the same however many pairs there are.

Nulls and empty texts have no tokens: zeros and no groups. So have texts whose joined token bytes differ from the space and the
text, such as those with a character that the piece model normalises. Special tokens' strings in texts are plain text.
Repeated rows are counted as often as they occur and each get their figures. An empty table gives no rows. A null doc_id is a
document like others. Extra columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.llm import common

FOLDER, BYTE_BPE, PIECES = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that are sent to the tasks: 16 bytes each.
SENT = 4_000_000
#: Different pairs that a task holds before it passes their counts on.
HELD = 1_500_000
#: Texts whose characters all lie below this one go through the fast reader of the byte-level BPE.
PLAIN = "̀"
#: How the byte-level BPE splits a text before it merges: fixed values of the published pattern.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

TOKENS = [T.StructField(n, T.BinaryType()) for n in ("a_ids", "b_ids")]
FIGURES = [*[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")], T.StructField("groups_sha256", T.StringType())]
SUMS = [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")]


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level BPE writes for each byte: printable ones stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Table:
    """Bytes of ids: `size` of each, and all of them in `data` from `start` on."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if tokens else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Pair:
    """Both tokenizers, read from their files on first use in a process."""

    def __init__(self, byte_bpe: str, pieces: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(byte_bpe)
        self.slow.encode_special_tokens = True
        with open(byte_bpe, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        extra = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = [b""] * (1 + max([*vocab.values(), *extra.values()]))
        for t, i in vocab.items():
            tokens[i] = t.encode() if t in extra else bytes(letters[c] for c in t)
        for t, i in extra.items():
            tokens[i] = t.encode()
        self.a = Table(tokens)
        self.fast = self._fast(spec, {t: i for i, t in enumerate(tokens) if i not in extra.values()})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        n = self.pieces.get_piece_size()
        self.b = Table([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i in range(n) for p in [self.pieces.id_to_piece(i)]])

    @staticmethod
    def _fast(spec: dict, ranks: dict[bytes, int]):
        """A reader that merges by ids: right if ids follow the order of merges, which is checked."""
        import tiktoken

        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"].get(m.replace(" ", "")) for m in merges]
        kind = spec.get("pre_tokenizer") or {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or None in ids or ids != sorted(ids) or (ids and ids[0] < 256):
            return None
        return tiktoken.Encoding("fast", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def read_a(self, text: str) -> np.ndarray:
        text = " " + text
        if self.fast is not None and max(text) < PLAIN:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def read_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.pieces.encode(texts, num_threads=1)]

    def tokens(self, values) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text, or none if they don't give the text's bytes again."""
        data, offsets = common.text_bytes(values)
        raw = [data[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        none = np.zeros(0, np.int64)
        out = [(none, none)] * len(raw)
        rows = [i for i, r in enumerate(raw) if len(r)]
        texts = [raw[i].tobytes().decode("utf-8", "replace") for i in rows]
        for i, text, b in zip(rows, texts, self.read_b(texts), strict=True):
            want = np.concatenate([np.array([32], np.uint8), raw[i]])
            if np.array_equal(self.b.joined(b), want):
                a = self.read_a(text)
                if np.array_equal(self.a.joined(a), want):
                    out[i] = (a, b)
        return out


@functools.cache
def pair(byte_bpe: str, pieces: str) -> Pair:
    return Pair(byte_bpe, pieces)


class Links:
    """Links and groups of documents laid behind each other; `bounds_a` and `bounds_b` are the documents' first tokens and the end."""

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray, bounds_a: np.ndarray) -> None:
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        total = int(ends_a[-1]) if len(ends_a) else 0
        marks = np.bincount(ends_a, minlength=total + 1) + 2 * np.bincount(ends_b, minlength=total + 1)
        at = np.flatnonzero(marks)
        kind = marks[at]
        #: for each link the token of A and of B, and whether a group ends with it
        self.a = np.cumsum(kind & 1) - (kind & 1)
        self.b = np.cumsum(kind >> 1) - (kind >> 1)
        self.cut = kind == 3
        byte = np.concatenate([[0], ends_a])[bounds_a]
        #: the documents' first links, and the number of groups before them
        self.bounds = np.searchsorted(at, byte, "right")
        self.groups = np.concatenate([[0], np.cumsum(self.cut)])[self.bounds]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each link by document."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.bounds])


_DIGITS = 10


def group_texts(a: np.ndarray, b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray, links: Links) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each document."""
    # the group of each token: that of its last link
    group = np.cumsum(links.cut) - links.cut
    last_a = np.flatnonzero(np.append(links.a[1:] != links.a[:-1], True)) if len(group) else np.zeros(0, np.int64)
    last_b = np.flatnonzero(np.append(links.b[1:] != links.b[:-1], True)) if len(group) else np.zeros(0, np.int64)
    ga, gb = group[last_a], group[last_b]
    n_a, n_b = np.bincount(ga), np.bincount(gb)
    place = np.empty(len(a) + len(b), np.int64)
    before_a, before_b = np.cumsum(n_a), np.concatenate([[0], np.cumsum(n_b)])
    ids, mark = np.empty(len(place), np.int64), np.full(len(place), ord(","), np.uint8)
    at_a, at_b = np.arange(len(a)) + before_b[ga], np.arange(len(b)) + (before_a[gb] if len(gb) else 0)
    ids[at_a], ids[at_b] = a, b
    if len(a):
        mark[at_a[before_a - 1]] = ord("|")
        mark[at_b[before_b[1:] - 1]] = ord(";")
    # digits of all ids, right-aligned, with the mark behind
    powers = 10 ** np.arange(_DIGITS - 1, -1, -1)
    width = max(1, len(str(int(ids.max())))) if len(ids) else 1
    powers = powers[-width:]
    shown = np.empty((len(ids), width + 1), np.uint8)
    shown[:, :width] = ids[:, None] // powers % 10 + 48
    shown[:, width] = mark
    keep = np.ones(shown.shape, bool)
    keep[:, : width - 1] = ids[:, None] >= powers[: width - 1]
    flat = shown[keep].tobytes()
    ends = np.concatenate([[0], np.cumsum(keep.sum(1))])[bounds_a + bounds_b].tolist()
    return [flat[s : max(s, e - 1)] for s, e in zip(ends[:-1], ends[1:], strict=True)]


def _width(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def _laid(column, width: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows behind each other, and the rows' bounds."""
    data, offsets = common.text_bytes(column)
    return np.frombuffer(data.tobytes(), width).astype(np.int64), offsets // np.dtype(width).itemsize


def tokenised(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """docs with the ids of both tokenizers (a_ids, b_ids, as little-endian numbers) and n_a, n_b, n_groups, n_links, groups_sha256."""

    def fn(batch):
        p = pair(byte_bpe, pieces)
        got = p.tokens(common.column(batch, "text"))
        bounds = [np.concatenate([[0], np.cumsum([len(x[k]) for x in got])]) for k in (0, 1)]
        a, b = (np.concatenate([x[k] for x in got]) for k in (0, 1))
        links = Links(p.a.size[a], p.b.size[b], bounds[0])
        texts = group_texts(a, b, *bounds, links)
        ids = [pa.array([x[k].astype(_width(len(t.size))).tobytes() for x in got], pa.binary()) for k, t in ((0, p.a), (1, p.b))]
        counts = [np.diff(bounds[0]), np.diff(bounds[1]), np.diff(links.groups), np.diff(links.bounds)]
        return [*ids, *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())]

    return common.annotate(docs, "text", [*TOKENS, *FIGURES], fn)


def _linked(batch, p: Pair) -> tuple[Links, np.ndarray]:
    """Links of a batch of tokenised documents and their id pairs as numbers."""
    (a, bounds), (b, _) = (_laid(common.column(batch, n), _width(len(t.size))) for n, t in (("a_ids", p.a), ("b_ids", p.b)))
    links = Links(p.a.size[a], p.b.size[b], bounds)
    return links, a[links.a] * len(p.b.size) + b[links.b]


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(tokens: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """(a_id, b_id, pair, n): the links of each id pair in all documents of tokenised()."""

    def run(batches):
        parts, held = [], 0
        for part in common.slices(batches, "a_ids"):
            _, pairs = _linked(part, pair(byte_bpe, pieces))
            parts.append(np.unique(pairs, return_counts=True))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [_added_up(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts[0]], names=["pair", "n"])
                    parts, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _added_up(parts)], names=["pair", "n"])

    counted = tokens.select("a_ids", "b_ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    size = len(pair(byte_bpe, pieces).b.size)
    return counted.select(F.floor(F.col("pair") / size).cast("int").alias("a_id"), (F.col("pair") % size).cast("int").alias("b_id"), "pair", "n")


def with_best(counts: DataFrame) -> DataFrame:
    """counts with `best`: whether a pair is the most frequent one of its B id, ties included. There are as many maxima as ids."""
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b_id").withColumn("best", F.col("n") == F.col("most")).drop("most")


def _bar(counts: DataFrame, limit: int) -> int:
    """The least count from which on no more than `limit` pairs are left: from a histogram of eighths of powers of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    left, bar = limit, 0
    for at, rows in sorted((tuple(r) for r in counts.groupBy(step.alias("step")).agg(F.count("*")).collect()), reverse=True):
        left -= rows
        if left < 0:
            bar = at + 1
            break
    return int(np.ceil(2 ** (bar / 8))) if bar else 0


def aligned(docs: DataFrame, byte_bpe: str = f"{FOLDER}/{BYTE_BPE}", pieces: str = f"{FOLDER}/{PIECES}", sent: int = SENT, ids: bool = True) -> DataFrame:
    """docs but for their text, with TOKENS (unless ids is false), FIGURES and n_best (links whose pair is the most frequent of its B id), count_sum (the counts of all links)."""
    names = {f.name for f in (*TOKENS, *FIGURES, *SUMS)}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    row, rest = common.unused(docs, "row", "rest")
    with common.scratch(docs.sparkSession) as keep:
        tokens = keep(tokenised(docs.withColumn(row, F.monotonically_increasing_id()), byte_bpe, pieces).drop("text"))
        counts = keep(with_best(keep(pair_counts(tokens, byte_bpe, pieces))))
        out = _with_sums(tokens, counts, row, rest, byte_bpe, pieces, sent)
        return common.cut(out.drop(row, *([] if ids else ["a_ids", "b_ids"])))


def _with_sums(tokens: DataFrame, counts: DataFrame, row: str, rest: str, byte_bpe: str, pieces: str, sent: int) -> DataFrame:
    bar = _bar(counts, sent)
    got = counts.where(F.col("n") >= bar).select("pair", "n", "best").toArrow()
    key, n, best = (got.column(i).to_numpy() for i in range(3))
    order = np.argsort(key)
    known = tokens.sparkSession.sparkContext.broadcast((key[order], n[order], best[order].astype(bool)))

    def fn(batch):
        links, pairs = _linked(batch, pair(byte_bpe, pieces))
        key, n, best = known.value
        at = np.minimum(np.searchsorted(key, pairs), max(0, len(key) - 1))
        there = key[at] == pairs if len(key) else np.zeros(len(pairs), bool)
        n_best, total = (links.sums(np.where(there, x[at], 0) if len(key) else np.zeros(len(pairs), np.int64)) for x in (best, n))
        others = [pairs[s:e][~there[s:e]].astype("<i8").tobytes() if bar else None for s, e in zip(links.bounds[:-1], links.bounds[1:], strict=True)]
        return [pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), pa.array(others, pa.binary())]

    out = common.annotate(tokens, "a_ids", [*SUMS, T.StructField(rest, T.BinaryType())], fn)
    if not bar:
        return out.drop(rest)

    def spread(batches):
        for batch in batches:
            rows, others = batch.column(0).to_numpy(), batch.column(1)
            data, offsets = common.text_bytes(others)
            for r, s, e in zip(rows, offsets[:-1], offsets[1:], strict=True):
                if e > s:
                    key, n = np.unique(np.frombuffer(data[s:e].tobytes(), "<i8"), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), r), pa.int64()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["row", "pair", "times"])

    # each of these pairs is rare, so no key of the join is large; text-free rows only
    rare = out.select(row, rest).mapInArrow(spread, "row long, pair long, times long").join(counts.where(F.col("n") < bar).select("pair", "n", "best"), "pair")
    more = rare.groupBy(F.col("row").alias(row)).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    joined = out.drop(rest).join(more, row, "left")
    return joined.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}).drop("more_best", "more")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aligned(common.documents(spark, sf_dir).select("doc_id", "text"), ids=False)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
