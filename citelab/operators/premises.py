"""The window of a source that supports a claim best, found without scoring every window.

A source's windows are indexed by token. A claim's tokens are looked up from the rarest in the source on, which counts what each
window shares with it; what a window may still share bounds its score from above. Windows are scored from the
highest bound on, until no bound reaches the best score. Of equal scores the first window counts.

If what a claim and a window share is the score itself, there is nothing to bound: all claims of a source are counted at once, by a row of windows
for each token. Sources that are small together are sent to the claims; others meet them in a shuffle.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Collection, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.lineage import cut

#: Claims of one source that one task takes; sources and characters of their tokens that are sent to the claims at most.
CLAIMS, SENT, SENT_CHARS = 20_000, 4096, 4 << 20
#: Windows that a source may have for its claims to be counted at once; counts that are held at a time.
DENSE, HELD = 4096, 1 << 22
ADDED = [T.StructField("score", T.DoubleType()), T.StructField("window", T.LongType()), T.StructField("scored", T.LongType()), T.StructField("windows", T.LongType())]


def shared(claim: Collection[str], window: frozenset[str]) -> float:
    """How many tokens a claim and a window have in common."""
    return float(sum(t in window for t in claim))


class Source:
    """Windows of one source, given as their tokens, and the windows that each token is in."""

    def __init__(self, windows: Sequence[Collection[str]]) -> None:
        self.windows = [frozenset(w) for w in windows]
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.windows):
            for t in w:
                self.places.setdefault(t, []).append(i)

    def best(self, claim: Sequence[str], score: Callable = shared, bound: Callable[[int], float] = float) -> tuple[float, int, int]:
        """(score, window, windows scored) for distinct tokens of a claim. bound(n) is the most that a window with n of them can score;
        a window without any scores bound(0)."""
        lists = sorted((self.places[t] for t in claim if t in self.places), key=len)
        counts: dict[int, int] = {}
        most, left = 0, len(lists)
        for places in lists:
            if bound(most) > bound(left):
                break  # what no token has led to yet can't reach what is there
            for w in places:
                counts[w] = n = counts.get(w, 0) + 1
                most = max(most, n)
            left -= 1
        waiting = [(-bound(n + left), w) for w, n in counts.items()]
        heapq.heapify(waiting)
        value, window, scored = bound(0), 0, 0
        found = False
        while waiting:
            limit, w = heapq.heappop(waiting)
            if found and (-limit, -w) < (value, -window):
                break
            got = score(claim, self.windows[w])
            scored += 1
            if not found or (got, -w) > (value, -window):
                value, window, found = got, w, True
        if found and value <= bound(0):
            first = next((w for w in range(len(self.windows)) if w not in counts), window)
            if (bound(0), -first) > (value, -window):
                value, window = bound(0), first
        return value, window, scored


class Asked:
    """A source's windows (an Arrow array of token lists), and the best of them for many claims."""

    def __init__(self, windows: pa.Array, score: Callable, bound: Callable[[int], float]) -> None:
        self.windows, self.score, self.bound = windows, score, bound
        self.source: Source | None = None
        self.known: dict[tuple, tuple] = {}
        tokens = windows.flatten()
        self.at_once = score is shared and bound is float and len(windows) <= DENSE and not tokens.null_count
        if self.at_once:
            coded = tokens.dictionary_encode()
            self.vocabulary = coded.dictionary
            self.hits = np.zeros((len(coded.dictionary), len(windows)), np.uint8)
            self.hits[coded.indices.to_numpy(), pc.list_parent_indices(windows).to_numpy()] = 1

    def __len__(self) -> int:
        return len(self.windows)

    def best(self, claims: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, window, windows scored) of each claim, an array of distinct tokens."""
        if self.at_once and not (tokens := claims.flatten()).null_count:
            return self._counted(claims, tokens)
        self.source = self.source or Source(self.windows.to_pylist())
        rows = []
        for got in claims.to_pylist():
            claim = tuple(got or ())
            if claim not in self.known:
                self.known[claim] = self.source.best(claim, self.score, self.bound)
            rows.append(self.known[claim])
        return tuple(np.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (float, np.int64, np.int64), strict=True))

    def _counted(self, claims: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = pc.index_in(tokens, value_set=self.vocabulary)
        there = ids.is_valid().to_numpy(zero_copy_only=False)
        ids, owner = ids.drop_null().to_numpy(), pc.list_parent_indices(claims).to_numpy()[there]
        best, window, scored = np.zeros(len(claims)), np.zeros(len(claims), np.int64), np.zeros(len(claims), np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        each = max(1, HELD // max(1, len(self)) // 8)  # claims at a time
        for k in range(0, len(first), each):
            own = first[k : k + each]
            end = first[k + each] if k + each < len(first) else len(ids)
            counts = np.add.reduceat(self.hits[ids[own[0] : end]], own - own[0], axis=0, dtype=np.int32)
            w, who = counts.argmax(1), owner[own]
            best[who], window[who], scored[who] = counts[np.arange(len(own)), w], w, 1
        return best, window, scored


def _runs(*columns: np.ndarray) -> list[int]:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    differ = np.zeros(max(0, n - 1), bool)
    for c in columns:
        differ |= c[1:] != c[:-1]
    return [0, *(np.flatnonzero(differ) + 1).tolist(), n]


def _codes(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


class _Found:
    """What is found for the rows of a batch; rows without a source go."""

    def __init__(self, n: int) -> None:
        self.score, self.ints, self.there = np.zeros(n), np.zeros((3, n), np.int64), np.zeros(n, bool)

    def put(self, at, source: Asked, claims: pa.Array) -> None:
        self.score[at], self.ints[0, at], self.ints[1, at] = source.best(claims)
        self.ints[2, at], self.there[at] = len(source), True

    def batch(self, kept: list[pa.Array], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*kept, pa.array(self.score), *map(pa.array, self.ints)], names=names).filter(pa.array(self.there))


def best_first(claims: DataFrame, sources: DataFrame, key: str, score: Callable = shared, bound: Callable[[int], float] = float, each: int = CLAIMS, send: int = SENT) -> DataFrame:
    """claims (key, tokens and others) without their tokens, with score, window, scored and windows (of the source) added.

    sources: key, windows (an array of tokens for each); one row a key. Claims of a source without windows go. Up to `send` sources of few tokens
    are sent to the claims, which then aren't shuffled. Of others, one with more than `each` claims is sent to several tasks, each
    with a part of the claims; there are no more such sources than claims / each."""
    kept = [c for c in claims.columns if c != "tokens"]
    schema = T.StructType([*(claims.schema[c] for c in kept), *ADDED])
    chars = F.aggregate(F.flatten("windows"), F.lit(0).cast("long"), lambda n, t: n + F.length(t) + 1)
    few = send > 0 and sources.limit(send + 1).count() <= send and (sources.agg(F.sum(chars)).first()[0] or 0) <= SENT_CHARS
    if few:
        return _sent(claims.select(*kept, "tokens"), sources.select(key, "windows").toArrow(), key, score, bound, schema)
    many = cut(claims.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > each).select(key, F.ceil(F.col("_n") / each).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = claims.join(F.broadcast(many), key, "left").withColumn("_part", F.pmod(F.xxhash64("tokens", *kept), parts).cast("long"))
    right = sources.join(F.broadcast(many), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = right.select(*[F.col(c) if c == key else nothing(claims, c) for c in kept], "_part", F.lit(0).alias("_claim"), "windows", nothing(claims, "tokens"))
    rows = rows.unionByName(left.select(*kept, "_part", F.lit(1).alias("_claim"), nothing(sources, "windows"), "tokens"))

    def run(batches):
        at, source = None, None
        for b in batches:
            if not b.num_rows:
                continue
            part, claim, windows, tokens = (b.column(c) for c in ("_part", "_claim", "windows", "tokens"))
            isnt, found = claim.to_numpy(), _Found(b.num_rows)
            for s, e in itertools.pairwise(_runs(_codes(b.column(key)), part.to_numpy())):
                if (here := (b.column(key)[s].as_py(), part[s].as_py())) != at:
                    at, source = here, None
                own = s + int(np.count_nonzero(isnt[s:e] == 0))  # a source comes before its claims
                if own > s and windows[s].is_valid and len(windows[s].values):
                    source = Asked(windows[s].values, score, bound) if source is None else source
                if source is not None and own < e:
                    found.put(slice(own, e), source, tokens.slice(own, e - own))
            yield found.batch([b.column(c) for c in kept], schema.names)

    return rows.repartition(key, "_part").sortWithinPartitions(key, "_part", "_claim").mapInArrow(run, schema)


def _sent(claims: DataFrame, sources: pa.Table, key: str, score: Callable, bound: Callable[[int], float], schema: T.StructType) -> DataFrame:
    """best_first() by a broadcast of the sources: claims stay where they are."""
    sent = claims.sparkSession.sparkContext.broadcast(sources)

    def run(batches):
        known: dict = {}
        for k, w in zip(sent.value.column(key).to_pylist(), sent.value.column("windows"), strict=True):
            if w.is_valid and len(w.values):
                known.setdefault(k, w.values)
        made: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            codes, found = _codes(b.column(key)), _Found(b.num_rows)
            order = np.argsort(codes, kind="stable")
            for s, e in itertools.pairwise(_runs(codes[order])):
                at = order[s:e]
                k = b.column(key)[int(at[0])].as_py()
                if k not in known:
                    continue
                if k not in made:
                    made[k] = Asked(known[k], score, bound)
                found.put(at, made[k], b.column("tokens").take(pa.array(at)))
            yield found.batch([b.column(c) for c in schema.names[: -len(ADDED)]], schema.names)

    return claims.mapInArrow(run, schema)
