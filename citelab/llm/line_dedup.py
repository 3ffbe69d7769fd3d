"""Line dedup by joining what deletions leave of lines, with DataFrame functions only.

A line is what a newline ends, without spaces at its ends; its words are what single spaces separate.
Of equal lines only the earliest occurrence stays; a line also goes if an earlier one is within the edit bound: words put in,
taken out or replaced, one for every TENTH words of the shorter line (the last one from eight tenths on; so lines of up to 7
words have a bound of 0, which is equality). "Earlier" is by doc_id (an integer), then by line number; whether the earlier
line stays itself doesn't matter. Blank lines always stay.

All variants of a line of 58 words within its bound of 6 deletions are 41 million, so only those are emitted that deletions
leave one piece of, and of these as few as can't miss: a line falls into pieces after words that end in a character of
ENDS. An edit changes two pieces at most, so a line and any other within d edits share all but 2 d of its pieces, and the
2 d + 1 longest pieces of both (of equal length those of the least hash) have one in common. A line with no more than 2 d
pieces emits all of them, and for other such lines the 4 d + 1 least hashes of its runs of 4 words, of which an edit breaks
4 at most. Variants are joined by hashes, so nothing within the bound is lost.

Each different line emits its variants once, at its earliest occurrence. A variant goes on only where its neighbours by number of
words are within the bound in length. Per variant a line is compared with the variant's earliest line, first with the one that it
shares most variants with. Only lines that no such line is near to are compared with other earlier lines of their variants, of those
whose number of words is in a band that the bound reaches, so lines that share a passage are not paired at large. Pairs whose sketches (a bit for each word, of 512, and how often the middle word occurs) differ by more
than edits can change are ruled out within the join; the distance of the others is verified on their words, which are told apart by 64 bits.

Nulls: a null text has no lines and stays null. A null doc_id is earlier than all others. Rows that
share a doc_id are the same document: they lose no line to the same line at the same place in another.
An empty table gives no rows. Extra columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelab.llm import common

#: Words for each edit, and words of a run.
TENTH, GRAM = 10, 4
#: How often lines are compared with one other line of each of their variants before they are with all earlier ones.
ROUNDS = 1
#: The ratio between the ends of a band of lengths. Wider bands hold more lines, narrower ones deal a line to more of them.
BAND = 1.3
#: After a character of these and before a space a piece ends: those of even code up to U+00FF, and about half of some alphabets.
ENDS = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x22, 0x100, 2) if chr(c).isprintable()) + "\\x{3b1}-\\x{3bb}\\x{430}-\\x{43d}\\x{5d0}-\\x{5dc}\\x{627}-\\x{634}]"
ORDER = "decimal(38,0)"
LINE = ["h1", "h2"]  # of lines that are equal; for the search of near ones, whose pairs are verified, h1 names a line


def occurrences(docs: DataFrame) -> DataFrame:
    """(h1, h2, at, doc_id, rh, pos, line) of every line that isn't blank; `at` orders them."""
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("rh"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    at = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)")) * F.lit(1 << 32).cast("decimal(11,0)") + F.col("pos")
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), at.cast(ORDER).alias("at"), "doc_id", "rh", "pos", "line")


def n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def bound(n: Column) -> Column:
    """The edits that a line of n words may have."""
    return F.floor((n + 2) / TENTH).cast("int")


def band(n: Column) -> Column:
    return F.floor(F.log((n + 2).cast("double")) / math.log(BAND)).cast("int")


def bands(n: Column) -> Column:
    """The bands of all lengths that are within the bound of a line of n words."""
    return F.sequence(band(n - bound(n)), band(n + bound(n)))


def with_variants(lines: DataFrame) -> DataFrame:
    """lines (line and others) whose bound isn't 0, with n, and a row for each variant: k."""
    rows = lines.withColumn("n", n_words(F.col("line"))).where(bound(F.col("n")) > 0)
    rows = rows.withColumn("pieces", F.split("line", f" (?<={ENDS} )"))
    d = bound(F.col("n"))
    # the number of a piece: its length, then bits of its hash; the greatest come first
    long_first = F.slice(F.sort_array(F.array_distinct(F.transform("pieces", lambda p: F.shiftleft(F.least(F.length(p), F.lit(127)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(p), 8)))), False), F.lit(1), 2 * d + 1)
    # the words of lines of few pieces, split once and not for every run
    rows = rows.withColumns({"long": long_first, "words": F.when(F.size("pieces") <= 2 * d, F.split("line", " "))})
    runs = F.transform(F.sequence(F.lit(1), F.col("n") - GRAM + 1), lambda i: F.xxhash64(F.lit(GRAM), F.slice("words", i, F.lit(GRAM))))
    least = F.slice(F.sort_array(F.array_distinct(runs)), F.lit(1), GRAM * d + 1)
    keys = F.when(F.col("words").isNull(), F.col("long")).otherwise(F.concat("long", least))
    return rows.select(*lines.columns, "n", F.explode(keys).alias("k")).drop("line")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, first, c) for each different line."""
    return lines.groupBy(*LINE).agg(F.min("at").alias("first"), F.count("*").alias("c"))


def earliest(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """lines (h1, at, line) at the first occurrences of firsts (h1, first); by chance, a few others too."""
    return common.perhaps_in(lines.select("h1", "line", "at", F.xxhash64("h1", "at").alias("o")), "o", firsts.select(F.xxhash64("h1", "first").alias("o")), "o").drop("o")


def placed(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """lines (at and others) with at as a number of 64 bits in the same order, if those of distinct (first) fit into one; lines that are
    beyond all of these go."""
    doc = lambda c: F.floor(c / F.lit(1 << 32).cast("decimal(11,0)")).cast(ORDER)
    pos = lambda c: (c - doc(c) * F.lit(1 << 32).cast("decimal(11,0)")).cast("long")
    low, high, last = distinct.agg(F.min(doc(F.col("first"))), F.max(doc(F.col("first"))), F.max(pos(F.col("first")))).first()
    if low is None or int(high - low).bit_length() + int(last).bit_length() > 62:
        return lines
    within = lines.where((doc(F.col("at")) <= F.lit(high).cast(ORDER)) & (pos(F.col("at")) <= last))
    return within.withColumn("at", (doc(F.col("at")) - F.lit(low).cast(ORDER)).cast("long") * (1 << int(last).bit_length()) + pos(F.col("at")))


def shared_variants(lines: DataFrame) -> DataFrame:
    """(k, h1, n, first) of the variants that different lines (h1, at, line) share whose lengths are within the bound."""
    w = Window.partitionBy("k").orderBy("n", "h1")
    beside = with_variants(lines).withColumns({"h0": F.lag("h1").over(w), "n0": F.lag("n").over(w), "h2": F.lead("h1").over(w), "n2": F.lead("n").over(w)})
    before = (F.col("h0") != F.col("h1")) & (F.col("n") - F.col("n0") <= bound(F.col("n0")))
    after = (F.col("h2") != F.col("h1")) & (F.col("n2") - F.col("n") <= bound(F.col("n")))
    # rows of a line that are there by chance are beside its earliest
    again = (F.col("h0") == F.col("h1")) | (F.col("h2") == F.col("h1"))
    near = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    rows = beside.where(near | again).groupBy("k", "h1", "n").agg(F.min("at").alias("first"), F.max(near).alias("near"))
    return rows.where("near").drop("near")


#: Numbers of 64 bits in a line's sketch, in which each of its words sets one bit; one more tells the bit of the line's middle word
#: (the lowest PLACE bits) and how often the line has it, which tells lines of a word that repeats apart.
SKETCH, PLACE = 8, 9


def sketches(texts: DataFrame) -> DataFrame:
    """(h1, s0, s1, ...) of texts (h1, x), in which a line may repeat."""
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(64 * SKETCH))
    split = texts.select("h1", F.explode(F.array(F.split("x", " "))).alias("words")).withColumn("w", F.get("words", F.floor(F.size("words") / 2).cast("int")))
    middle = F.call_function("shiftleft", (F.size("words") - F.size(F.array_remove("words", F.col("w")))).cast("long"), F.lit(PLACE)).bitwiseOR(place(F.col("w")))
    # of its own before words are dealt out, so it is found once a line
    split = split.select("h1", "words", middle.alias("middle"))
    words = split.select("h1", "middle", F.explode("words").alias("w")).select("h1", "middle", place(F.col("w")).cast("int").alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63))
    bits = [F.bit_or(F.when(F.shiftright("p", 6) == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{j}") for j in range(SKETCH)]
    return words.groupBy("h1").agg(*bits, F.max("middle").alias(f"s{SKETCH}"))


def gone(a: list[Column], b: list[Column]) -> Column:
    """How many bits of one sketch the other doesn't have."""
    return sum((F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in zip(a[:SKETCH], b[:SKETCH], strict=True)), F.lit(0))


def may_be_near(n: Column, m: Column, s: list[Column], t: list[Column]) -> Column:
    """What lines within the bound fulfil: an edit adds or takes one word, so it takes at most one bit from each side, and a word that is in
    one of them more often than edits can change is in the other."""
    most = bound(F.least(n, m))

    def middle(a: list[Column], b: list[Column]) -> Column:
        p = a[SKETCH].bitwiseAND(64 * SKETCH - 1).cast("int")
        there = F.call_function("shiftright", F.get(F.array(*b[:SKETCH]), F.shiftright(p, 6)), p.bitwiseAND(63)).bitwiseAND(1) == 1
        return (F.shiftright(a[SKETCH], PLACE) <= most) | there

    return (F.abs(n - m) <= most) & (gone(s, t) <= most) & (gone(t, s) <= most) & middle(s, t) & middle(t, s)


def within_bound(pairs: DataFrame) -> DataFrame:
    """The pairs (x, y, most and others) of lines whose edit distance in words is at most `most`."""
    code = lambda c: F.transform(F.split(c, " "), lambda w: F.xxhash64(w))
    # generators of one row: what they give is computed once, and no filter is moved before them
    once = lambda df, c, name: df.select("*", F.explode(F.array(c)).alias(name))
    rows = once(once(pairs, code("x"), "cx"), code("y"), "cy")
    # an edit takes one word at most from what only one of them has
    rows = rows.where((F.size(F.array_except("cx", "cy")) <= F.col("most")) & (F.size(F.array_except("cy", "cx")) <= F.col("most")))
    rows = once(rows, F.array_distinct(F.concat("cx", "cy")), "names")

    def written(c: str) -> Column:
        """Each word as a character that stands for it within the pair."""
        place = lambda w: F.array_position("names", w)
        few = F.array_join(F.transform(c, lambda w: F.char(place(w))), "")
        # beyond 255 different words, by code points without the surrogates
        wide = lambda p: F.lpad(F.hex(F.when(p >= 0xD800, p + 0x800).otherwise(p)), 8, "0")
        many = F.decode(F.unhex(F.array_join(F.transform(c, lambda w: wide(place(w))), "")), "UTF-32")
        return F.when(F.size("names") < 256, few).otherwise(many)

    return once(rows, F.call_function("levenshtein", written("cx"), written("cy"), F.col("most")), "gap").where("gap >= 0")


def likely(pairs: DataFrame, drawn: DataFrame, keep) -> DataFrame:
    """(h1, b1, n, m) of the different pairs whose sketches may be near. drawn: the sketches (h1, s0, s1, ...)."""
    pairs = keep(pairs.distinct())
    own, other = ([F.col(f"{x}{j}") for j in range(SKETCH + 1)] for x in "st")
    # only the lines of pairs are dealt
    left, right = (common.perhaps_in(drawn, "h1", pairs.select(F.col(c).alias("h1")).distinct(), "h1") for c in ("h1", "b1"))
    right = right.withColumnsRenamed({"h1": "b1", **{f"s{j}": f"t{j}" for j in range(SKETCH + 1)}})
    return pairs.join(left, "h1").join(right, "b1").where(may_be_near(F.col("n"), F.col("m"), own, other)).select("h1", "b1", "n", "m")


def verified(pairs: DataFrame, texts: DataFrame, keep) -> DataFrame:
    """(h1) of the different pairs (h1, b1, n, m) that are within the bound. texts: (h1, x) of their lines."""
    pairs = keep(pairs.distinct())
    left, right = (common.perhaps_in(texts, "h1", pairs.select(F.col(c).alias("h1")).distinct(), "h1") for c in ("h1", "b1"))
    both = pairs.select("h1", "b1", bound(F.least("n", "m")).alias("most")).join(right.withColumnsRenamed({"h1": "b1", "x": "y"}), "b1").join(left, "h1")
    return within_bound(both).select("h1").distinct()


def near_lines(lines: DataFrame, distinct: DataFrame, keep) -> DataFrame:
    """(h1) of the different lines (h1, first) that have an earlier one within the bound. keep: writes what is read several times.

    Rows of variants hold no more than names, lengths and places: sketches and words meet pairs, or the lines that are left in the end."""
    own, other = ([F.col(f"{x}{j}") for j in range(SKETCH + 1)] for x in "su")
    shared = shared_variants(placed(earliest(lines, distinct), distinct))
    w = Window.partitionBy("k").orderBy("first", "h1")
    least = F.first(F.struct("first", "h1", "n")).over(w).alias("l")
    met = keep(shared.select("k", "h1", "n", "first", least, F.row_number().over(w).alias("r")).select("k", "h1", "n", "first", F.col("l.first").alias("f"), F.col("l.h1").alias("b1"), F.col("l.n").alias("m"), "r"))
    firsts = keep(distinct.join(met.select("h1").distinct(), "h1", "left_semi").select("h1", "first"))
    texts = keep(earliest(lines, firsts).select("h1", F.col("line").alias("x")))
    drawn = keep(sketches(texts))
    fits = F.abs(F.col("n") - F.col("m")) <= bound(F.least("n", "m"))
    # one pair a line: with the line that it shares most variants with; then, for those it doesn't settle, the others
    led = keep(met.where((F.col("f") < F.col("first")) & fits).groupBy("h1", "b1").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m")))
    best = led.groupBy("h1").agg(F.max(F.struct("c", "b1", "n", "m")).alias("l")).select("h1", "l.b1", "l.n", "l.m")
    found = keep(verified(likely(best, drawn, keep), texts, keep))
    rest = led.join(found, "h1", "left_anti").join(best, ["h1", "b1"], "left_anti").select("h1", "b1", "n", "m")
    found = keep(found.unionByName(verified(likely(rest, drawn, keep), texts, keep)))
    # what the earliest lines don't settle; the second line of a variant has no other before it
    open_ = keep(met.where("r > 2").join(found, "h1", "left_anti").select("k", "h1", "n", "first"))
    earlier = met.where("f < first").select("k", F.col("h1").alias("b1"), F.col("n").alias("m"), F.col("first").alias("g"))
    for turn in range(ROUNDS):
        # one other line of each variant first, so that groups of lines that are near to each other are settled without their pairs
        some = earlier.groupBy("k").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "b1").alias("o"), "b1", "m", "g")).alias("l")).select("k", "l.b1", "l.m", "l.g")
        met_some = open_.join(some, "k").where((F.col("g") < F.col("first")) & fits).select("h1", "b1", "n", "m")
        more = keep(verified(likely(met_some, drawn, keep), texts, keep))
        found = found.unionByName(more)
        open_ = keep(open_.join(more, "h1", "left_anti"))
    # the rest with all lines between, of the bands of lengths that are within the bound; only these rows take their sketches along
    banded = open_.join(drawn, "h1").select("*", F.explode(bands(F.col("n"))).alias("band"))
    earlier = common.perhaps_in(earlier, "k", open_.select("k").distinct(), "k").join(drawn.select(F.col("h1").alias("b1"), *[c.alias(f"u{j}") for j, c in enumerate(own)]), "b1").withColumn("band", band(F.col("m")))
    between = banded.join(earlier, ["k", "band"]).where((F.col("g") < F.col("first")) & may_be_near(F.col("n"), F.col("m"), own, other))
    pairs = keep(between.select("h1", "b1", "n", "m", (gone(own, other) + gone(other, own)).alias("gap")).distinct())
    # the pair of each line whose sketches differ least is verified first: lines of large groups that are near to each other need no other
    best = pairs.groupBy("h1").agg(F.min(F.struct("gap", "b1", "n", "m")).alias("l")).select("h1", "l.b1", "l.n", "l.m")
    more = keep(verified(best, texts, keep))
    rest = pairs.join(more, "h1", "left_anti").join(best, ["h1", "b1"], "left_anti").select("h1", "b1", "n", "m")
    return found.unionByName(more).unionByName(verified(rest, texts, keep)).distinct()


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, rh, removed): the numbers of the lines to go, in order."""
    lines = occurrences(docs)
    distinct = common.cut(distinct_lines(lines))
    with common.scratch(docs.sparkSession) as keep:
        near = common.cut(near_lines(lines, distinct, keep)).withColumn("near", F.lit(True))
    going = common.cut(distinct.join(near, "h1", "left").where("c > 1 or near"))
    met = common.perhaps_in(lines.select("h1", "h2", "at", "doc_id", "rh", "pos"), "h1", going, "h1")
    gone = met.join(going, LINE).where("near or at <> first")
    return gone.groupBy("doc_id", "rh").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines gone from text, and n_removed."""
    out = [c for c in docs.columns if c.lower() != "n_removed"]
    id_, digest, gone_, h, lines_ = common.unused(docs, "id", "digest", "gone", "h", "lines")
    gone = removals(docs.select("doc_id", "text")).select(F.col("doc_id").alias(id_), F.col("rh").alias(digest), F.col("removed").alias(gone_))
    keyed = docs.select(*out, F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias(h))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(digest)), "left")
    size = F.size(gone_)

    def between(j: Column) -> Column:
        start = F.when(j == 0, F.lit(0)).otherwise(F.try_element_at(gone_, j) + 1)
        end = F.when(j == size, F.size(lines_)).otherwise(F.try_element_at(gone_, j + 1))
        return F.slice(lines_, start + 1, F.greatest(end - start, F.lit(0)))

    kept = F.flatten(F.transform(F.sequence(F.lit(0), size), between))
    joined = joined.withColumn(lines_, F.when(F.col(gone_).isNotNull(), F.split("text", "\n")))
    text = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c.lower() == "text" else F.col(c) for c in out], F.when(F.col(gone_).isNull(), F.lit(0)).otherwise(size).cast("long").alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", "n_removed")


def brute_force(docs: list[tuple]) -> list[tuple]:
    """(doc_id, text, n_removed) by comparing all lines, for tests; doc_ids are different numbers or null."""
    seen: list[list[str]] = []
    out = {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        kept, n = [], 0
        for line in text.split("\n") if text is not None else ():
            w = line.strip(" ").split(" ") if line.strip(" ") else []
            if w and any(v == w or _near(v, w) for v in seen):
                n += 1
            else:
                kept.append(line)
            if w:
                seen.append(w)
        out[doc_id] = (doc_id, None if text is None else "\n".join(kept), n)
    return [out[d] for d, _ in docs]


def _near(a: list[str], b: list[str]) -> bool:
    most = (min(len(a), len(b)) + 2) // TENTH
    if abs(len(a) - len(b)) > most or not most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return False
    return row[-1] <= most
