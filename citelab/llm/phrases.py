"""Collocations: phrases of two or three words that occur together more often than their parts would.

Texts are cut into pieces at punctuation and line ends, pieces into words. Every task puts what it reads into a count trie of
bounded depth and size (language, first word, second word, third word; children in byte order) and serialises it
in sorted fragments, one for each range of prefixes; splitters of the ranges come from a sample, which decides nothing but who merges
what. The fragments of a range are merged (a stable sort of sorted runs), which gives exact counts. A node above a splitter goes to all
ranges that its subtree reaches into, so each range can walk up to its ancestors' counts.

Two rounds: words and pairs first, then triples, of which only those are put into tries whose two pairs may be
frequent (a membership filter of bounded size; the counts behind it are exact). The left parts of a triple are its ancestors in the
merged trie; its right part is where its suffix link leads, a join by the pair behind its first word.

Languages: null is `und`. Null and empty texts have no words. Repeated rows count as often as they occur. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citelab.llm import common

#: The least count of a phrase, and the percentage of a phrase's count from which on a longer one stands for it.
LEAST, COVERS = 10, 50
#: Phrases reported of each language.
TOP = 2000
#: Bytes of text behind each range of prefixes; bytes of text, and phrases, that splitters are taken from.
RANGE_BYTES, SAMPLE_BYTES, SAMPLE_PHRASES = 8 << 20, 32 << 20, 200_000
#: Leaves of a task's trie before it is passed on.
LEAVES = 1_000_000
UND = b"und"
#: Groups in which the best phrases are looked for first, from the finest on.
LEVELS = (256, 16, 1)

END = common.class_table(lambda b: chr(b) in ".,;:!?\n\x0b\x0c\r")
WORD = common.class_table(lambda b: chr(b) not in " \t.,;:!?\n\x0b\x0c\r")


# --- words of a slice --------------------------------------------------------------------------------


@dataclass
class Words:
    """Words of some texts in order, as ids into a sorted dictionary that holds the languages too."""

    names: pa.Array
    lang: np.ndarray
    word: np.ndarray
    #: Whether the word after it is in the same piece.
    goes_on: np.ndarray


def _sorted_names(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different values in byte order, and the place of each value among them."""
    coded = values.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def words(batch) -> Words:
    data, offsets = common.text_bytes(common.column(batch, "text"))
    low = common.lower_table()[data]
    starts, ends, first = common.word_spans(low, offsets, WORD)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(low[WORD[low]])])
    langs = pc.fill_null(common.column(batch, "lang").cast(pa.large_binary()), UND)
    names, place = _sorted_names(pa.concat_arrays([langs, found]))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    stops = np.cumsum(END[low])
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = (row[1:] == row[:-1]) & (stops[starts[1:]] == stops[ends[:-1] - 1])
    return Words(names, place[: len(langs)][row], place[len(langs) :], goes_on)


def _hashes(names: pa.Array) -> np.ndarray:
    data, offsets = common.text_bytes(names)
    return common.span_hash(common.prefix_hash(data, 21), offsets[:-1], offsets[1:], 21)


def pair_hash(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of a language and two words from their hashes."""
    a, b, c = common.seeded(23, 3) | np.uint64(1)
    return common.mix(lang * a + first * b + second * c)


# --- tries -------------------------------------------------------------------------------------------


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, their sums, and the place of each key among them."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(key)]
    at = np.flatnonzero(new)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[at], np.add.reduceat(n[order], at) if len(at) else n[:0], place


def _small(x: np.ndarray) -> np.ndarray:
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def _pack(arrays) -> bytes:
    return b"".join(itertools.chain.from_iterable((a.dtype.char.encode(), len(a).to_bytes(8, "little"), a.tobytes()) for a in arrays))


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind = np.dtype(chr(data[at]))
        n = int.from_bytes(data[at + 1 : at + 9], "little")
        out.append(np.frombuffer(data, kind, n, at + 9))
        at += 9 + n * kind.itemsize
    return out


class _View:
    """Names as a sequence for bisect."""

    def __init__(self, names: pa.Array) -> None:
        self.names = names

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, i: int) -> bytes:
        return self.names[i].as_py()


class Trie:
    """Levels of nodes in order of their paths: the parent's place in the level above, the name's place in `names`, and a count."""

    def __init__(self, names: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.names, self.levels = names, levels

    @property
    def size(self) -> int:
        return len(self.levels[-1][0])

    @classmethod
    def of(cls, names: pa.Array, path: list[np.ndarray], counts: list[np.ndarray]) -> Trie:
        """A trie of paths (an array of names' places for each level); counts[d] is what a path adds at level d."""
        levels, at = [], np.zeros(len(path[0]), np.int64)
        for step, n in zip(path, counts, strict=True):
            key, total, at = _added(at << 32 | step, n)
            levels.append((key >> 32, key & 0xFFFFFFFF, total))
        return cls(names, levels)

    @classmethod
    def of_words(cls, w: Words) -> Trie:
        """Languages, words and pairs with their counts."""
        ones = np.ones(len(w.word), np.int64)
        _, n, at = _added(w.lang, ones)
        langs = np.unique(w.lang)
        levels = [(np.zeros(len(langs), np.int64), langs, n)]
        key, n, at = _added(at << 32 | w.word, ones)
        levels.append((key >> 32, key & 0xFFFFFFFF, n))
        i = np.flatnonzero(w.goes_on)
        key, n, _ = _added(at[i] << 32 | w.word[i + 1], ones[: len(i)])
        levels.append((key >> 32, key & 0xFFFFFFFF, n))
        return cls(w.names, levels)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        if len(tries) == 1:
            return tries[0]
        names, place = _sorted_names(pa.concat_arrays([t.names for t in tries]))
        starts = np.cumsum([0, *[len(t.names) for t in tries]])
        maps, levels = None, []
        for d in range(len(tries[0].levels)):
            parent = [t.levels[d][0] if maps is None else m[t.levels[d][0]] for t, m in zip(tries, maps or tries, strict=True)]
            name = [place[s : s + len(t.names)][t.levels[d][1]] for s, t in zip(starts, tries, strict=False)]
            key = np.concatenate(parent) << 32 | np.concatenate(name)
            key, n, at = _added(key, np.concatenate([t.levels[d][2] for t in tries]))
            levels.append((key >> 32, key & 0xFFFFFFFF, n))
            ends = np.cumsum([0, *[len(p) for p in parent]])
            maps = [at[s:e] for s, e in itertools.pairwise(ends)]
        return cls(names, levels)

    def _before(self, splitter: tuple[bytes, ...]) -> tuple[list[int], list[bool]]:
        """For each level how many nodes lie before the splitter's path of that length, and whether the next one is that path."""
        view, here, there, exact = _View(self.names), [], [], True
        start, end = 0, len(self.levels[0][0])
        for d, part in enumerate(splitter):
            parent, name, _ = self.levels[d]
            if d:
                start = int(np.searchsorted(parent, here[-1]))
                end = int(np.searchsorted(parent, here[-1] + 1)) if exact else start
            if exact:
                rank = bisect.bisect_left(view, part)
                start += int(np.searchsorted(name[start:end], rank))
                exact = start < end and int(name[start]) == rank and view[rank] == part
            here.append(start)
            there.append(exact)
        return here, there

    def fragments(self, splitters: list[tuple[bytes, ...]]):
        """(range, bytes) for each range that has a node; a node goes to all ranges that its subtree reaches into."""
        depth = len(self.levels)
        starts = [0] * depth
        for r in range(len(splitters) + 1):
            if r < len(splitters):
                here, there = self._before(splitters[r])
                reach = [h + (t and any(splitters[r][d + 1 :])) if d < depth - 1 else h for d, (h, t) in enumerate(zip(here, there, strict=True))]
            else:
                here = reach = [len(x[0]) for x in self.levels]
            if any(e > s for s, e in zip(starts, reach, strict=True)):
                yield r, self._part(starts, reach)
            starts = here

    def _part(self, starts: list[int], ends: list[int]) -> bytes:
        cut = [tuple(x[s:e] for x in level) for level, s, e in zip(self.levels, starts, ends, strict=True)]
        used, place = np.unique(np.concatenate([name for _, name, _ in cut]), return_inverse=True)
        data, offsets = common.text_bytes(self.names.take(pa.array(used)))
        out, at = [_small(np.diff(offsets)), data], 0
        for d, (parent, name, n) in enumerate(cut):
            children = np.bincount(parent - starts[d - 1], minlength=ends[d - 1] - starts[d - 1]) if d else np.array([len(name)])
            out += [_small(children), _small(place[at : at + len(name)]), _small(n)]
            at += len(name)
        return _pack(out)

    @classmethod
    def read(cls, data: bytes) -> Trie:
        sizes, letters, *rest = _unpack(data)
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        levels = [(np.repeat(np.arange(len(c)), c), name.astype(np.int64), n.astype(np.int64)) for c, name, n in zip(rest[::3], rest[1::3], rest[2::3], strict=True)]
        return cls(names, levels)

    def path(self, level: int, nodes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Names' places and counts of some nodes of a level and of all above them, from the root."""
        out = []
        for d in range(level, -1, -1):
            parent, name, n = self.levels[d]
            out.append((name[nodes], n[nodes]))
            nodes = parent[nodes]
        return out[::-1]


def range_of(splitters: list[tuple[bytes, ...]], path: tuple[bytes, ...]) -> int:
    return bisect.bisect_right(splitters, path)


def _passed_on(tries, splitters):
    """Batches of the fragments of tries, merged while they have fewer than LEAVES leaves."""
    held: list[Trie] = []

    def out():
        got = list(Trie.merged(held).fragments(splitters))
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["part", "trie"])

    for trie in tries:
        held.append(trie)
        if sum(t.size for t in held) > LEAVES:
            held = [Trie.merged(held)]
            if held[0].size > LEAVES // 2:
                yield out()
                held = []
    if held:
        yield out()


# --- rounds ------------------------------------------------------------------------------------------


def _splitters(phrases: DataFrame, n: int) -> list[tuple[bytes, ...]]:
    """n - 1 paths at even distances among sampled ones, no two alike."""
    got = sorted(tuple(bytes(x) for x in r) for r in phrases.limit(SAMPLE_PHRASES).collect())
    return sorted({got[len(got) * k // n] for k in range(1, n)}) if got else []


def _sampled(docs: DataFrame, take) -> DataFrame:
    """Paths take(words) of some documents, for splitters."""
    names = ["lang", "w1", "w2", "w3"]

    def run(batches):
        for part in common.slices(batches, "text"):
            w = words(part)
            path = take(w)
            yield pa.RecordBatch.from_arrays([w.names.take(pa.array(p)).cast(pa.binary()) for p in path], names=names[: len(path)])

    depth = 3 if take is _some_pairs else 4
    return docs.mapInArrow(run, ", ".join(f"{n} binary" for n in names[:depth]))


#: One in so many phrases of the sampled text is looked at.
STEP = 32


def _some_pairs(w: Words):
    i = np.flatnonzero(w.goes_on)[::STEP]
    return [w.lang[i], w.word[i], w.word[i + 1]]


def _triples(w: Words, bits: np.ndarray) -> np.ndarray:
    """Positions of triples both of whose pairs pass the filter."""
    h = _hashes(w.names)
    i = np.flatnonzero(w.goes_on)
    fine = np.zeros(len(w.word) + 1, bool)
    fine[i] = common.in_filter(bits, pair_hash(h[w.lang[i]], h[w.word[i]], h[w.word[i + 1]]))
    return np.flatnonzero(fine[:-1] & fine[1:])


def _named(names: pa.Array, at: np.ndarray) -> pa.Array:
    return names.take(pa.array(at)).cast(pa.binary())


def counted(docs: DataFrame, ranges: int, sample: float, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, n, n1, h) from docs (lang, text): languages with all their words (w1 null), words (w2 null) and pairs that
    occur `least` times. n1 is the count of a pair's first word, h its hash."""
    some = docs.sample(sample, seed=3) if sample < 1 else docs
    splitters = docs.sparkSession.sparkContext.broadcast(_splitters(_sampled(some, _some_pairs), ranges))

    def run(batches):
        yield from _passed_on((Trie.of_words(words(part)) for part in common.slices(batches, "text")), splitters.value)

    def merge(table: pa.Table) -> pa.Table:
        r = table.column("part")[0].as_py()
        trie = Trie.merged([Trie.read(x.as_py()) for x in table.column("trie")])
        from_ = splitters.value[r - 1] if r else (b"", b"", b"")
        view, h = _View(trie.names), _hashes(trie.names)
        langs, firsts = trie.levels[0], trie.levels[1]
        # what begins before this range is told where it begins
        own_langs = np.arange(len(langs[0]))
        own_langs = own_langs[int(len(own_langs) > 0 and (view[int(langs[1][0])], b"", b"") < from_) :]
        own = np.flatnonzero(firsts[2] >= least)
        if len(own) and own[0] == 0 and (view[int(langs[1][firsts[0][0]])], view[int(firsts[1][0])], b"") < from_:
            own = own[1:]
        pairs = np.flatnonzero(trie.levels[2][2] >= least)
        none = lambda k: pa.nulls(k, pa.binary())
        (lang, n), = trie.path(0, own_langs)
        parts = [[_named(trie.names, lang), none(len(n)), none(len(n)), n, n, n * 0]]
        (lang, _), (w1, n) = trie.path(1, own)
        parts.append([_named(trie.names, lang), _named(trie.names, w1), none(len(n)), n, n, n * 0])
        (lang, _), (w1, n1), (w2, n) = trie.path(2, pairs)
        parts.append([*(_named(trie.names, x) for x in (lang, w1, w2)), n, n1, pair_hash(h[lang], h[w1], h[w2]).view(np.int64)])
        return pa.concat_tables([pa.table([pa.array(x) for x in p], names=["lang", "w1", "w2", "n", "n1", "h"]) for p in parts])

    return docs.mapInArrow(run, "part int, trie binary").groupBy("part").applyInArrow(merge, "lang binary, w1 binary, w2 binary, n long, n1 long, h long")


def triples(docs: DataFrame, pairs: DataFrame, ranges: int, sample: float, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, w3, n, n1, n12): triples that occur `least` times and the counts of their left parts. pairs: the frequent
    pairs of counted()."""
    sc = docs.sparkSession.sparkContext
    bits = sc.broadcast(common.filter_bits(pairs, "h"))

    def take(w: Words):
        i = _triples(w, bits.value)[::STEP]
        return [w.lang[i], w.word[i], w.word[i + 1], w.word[i + 2]]

    some = docs.sample(sample, seed=4) if sample < 1 else docs
    splitters = sc.broadcast(_splitters(_sampled(some, take), ranges))

    def run(batches):
        def tries():
            for part in common.slices(batches, "text"):
                w = words(part)
                i = _triples(w, bits.value)
                if len(i):
                    none = np.zeros(len(i), np.int64)
                    yield Trie.of(w.names, [w.lang[i], w.word[i], w.word[i + 1], w.word[i + 2]], [none, none, none, none + 1])

        yield from _passed_on(tries(), splitters.value)

    def sent(batches):
        """Pairs to all ranges that triples of theirs may be in."""
        for batch in batches:
            rows, parts = [], []
            for i, path in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                first, last = range_of(splitters.value, (*path, b"")), bisect.bisect_left(splitters.value, (*path[:2], path[2] + b"\0"))
                rows += [i] * (last - first + 1)
                parts += range(first, last + 1)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.take(pa.array(rows, pa.int64())).columns], names=["part", *batch.schema.names])

    def merge(fragments: pa.Table, pairs: pa.Table) -> pa.Table:
        out = ["lang", "w1", "w2", "w3", "n", "n1", "n12"]
        tries = [Trie.read(x.as_py()) for x in fragments.column("trie")]
        if not tries:
            return pa.table([pa.array([], pa.binary())] * 4 + [pa.array([], pa.int64())] * 3, names=out)
        trie = Trie.merged(tries)
        # what pairs count goes to the nodes above the leaves: no leaf has less than that
        columns = [pairs.column(n).combine_chunks().cast(pa.large_binary()) for n in ("lang", "w1", "w2")]
        names, place = _sorted_names(pa.concat_arrays(columns)) if len(pairs) else (pa.array([], pa.large_binary()), np.zeros(0, np.int64))
        path = list(place.reshape(3, -1))
        n, n1 = (pairs.column(c).to_numpy() for c in ("n", "n1"))
        first = _added(path[0] << 32 | path[1], n)[2]
        once = np.zeros(len(n), bool)
        once[np.unique(first, return_index=True)[1]] = True
        above = Trie.of(names, path, [n * 0, np.where(once, n1, 0), n])
        none = np.zeros(0, np.int64)
        trie = Trie.merged([trie, Trie(names, [*above.levels, (none, none, none)])])
        (lang, _), (w1, n1), (w2, n12), (w3, n) = trie.path(3, np.flatnonzero(trie.levels[3][2] >= least))
        return pa.table([*(_named(trie.names, x) for x in (lang, w1, w2, w3)), *(pa.array(x, pa.int64()) for x in (n, n1, n12))], names=out)

    made = docs.mapInArrow(run, "part int, trie binary").groupBy("part")
    above = pairs.select("lang", "w1", "w2", "n", "n1").mapInArrow(sent, "part int, lang binary, w1 binary, w2 binary, n long, n1 long").groupBy("part")
    return made.cogroup(above).applyInArrow(merge, "lang binary, w1 binary, w2 binary, w3 binary, n long, n1 long, n12 long")


# --- scores ------------------------------------------------------------------------------------------


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exact up to counts of 10**16."""
    return F.expr(f"(cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)) * 1000000BD) div (cast({left} as decimal(16,0)) * cast({right} as decimal(16,0)))")


def phrases(docs: DataFrame, least: int = LEAST, covers: int = COVERS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a, l, r, score) of all candidates that no longer one stands for, and (lang, n), from docs with
    lang and text."""
    spark = docs.sparkSession
    docs = docs.where("text is not null").select("lang", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, sample = max(common.shuffle_parts(spark), -(-size // RANGE_BYTES)), min(1.0, SAMPLE_BYTES / max(1, size))
    with common.scratch(spark) as keep:
        counts = keep(counted(docs, ranges, sample, least))
        single = counts.where("w1 is not null and w2 is null").select("lang", F.col("w1").alias("w2"), F.col("n").alias("n2"))
        # suffix links of pairs: the word behind the first
        pairs = keep(counts.where("w2 is not null").join(single, ["lang", "w2"]).select("lang", "w1", "w2", "n", "n1", "n2", "h"))
        three = keep(triples(docs, pairs, ranges, sample, least))
        # suffix links of triples: the pair behind the first word, and its own
        behind = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("n23"), F.col("n2").alias("n3"))
        three = three.join(behind, ["lang", "w2", "w3"])
        one, two = cut_score("n", "n1", "n23"), cut_score("n", "n12", "n3")
        three = three.withColumns({"one": one, "two": two})
        first = F.col("one") <= F.col("two")
        space = F.lit(b" ")
        long = three.select("lang", F.concat("w1", space, "w2", space, "w3").alias("phrase"), F.lit(3).alias("words"), F.col("n").alias("a"), F.when(first, F.col("n1")).otherwise(F.col("n12")).alias("l"), F.when(first, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("one", "two").alias("score"))
        inside = three.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), F.col("n").alias("longer"))
        most = inside.groupBy("lang", "p.w1", "p.w2").agg(F.max("longer").alias("longer"))
        kept = pairs.join(most, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * covers))
        short = kept.select("lang", F.concat("w1", space, "w2").alias("phrase"), F.lit(2).alias("words"), F.col("n").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"), cut_score("n", "n1", "n2").alias("score"))
        both = long.unionByName(short)
        totals = counts.where("w1 is null").select("lang", "n")
        text = lambda df: df.withColumns({c: F.col(c).cast("string") for c in ("lang", "phrase") if c in df.columns})
        return common.cut(text(both)), common.cut(text(totals))


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` rows of each language with their rank, in groups of phrases first so that no task ranks them all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for groups in LEVELS:
        group = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", group).orderBy(*order))).where(F.col("rank") <= top)
    return found


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, totals = phrases(common.documents(spark, sf_dir))
    out = best(found).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long"), "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")])
