"""Quality by neighbours, alignment of tokenizers and collocations against plain computations and edge cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelab.llm import align, common, phrases, quality

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def same(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))


# --- alignment -------------------------------------------------------------------------------------


class PlainPair:
    """Tokens by the two libraries themselves, and their bytes."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{align.FOLDER}/{align.BYTE_BPE}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.PIECES}")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.a_bytes = lambda i: bytes(letters[c] for c in self.a.id_to_token(i))
        self.b_bytes = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        want = (" " + text).encode()
        return (a, b) if b"".join(map(self.a_bytes, a)) == want == b"".join(map(self.b_bytes, b)) else ([], [])

    def rows(self, docs):
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by walking both token lists."""
        made, total = [], Counter()
        for doc_id, text in docs:
            a, b = self.tokens(text)
            links, groups, i, j, at_a, at_b, of_a, of_b = [], [], 0, 0, 0, 0, [], []
            while i < len(a):
                if not of_a or of_a[-1][0] != i:
                    of_a.append((i, a[i]))
                if not of_b or of_b[-1][0] != j:
                    of_b.append((j, b[j]))
                links.append((a[i], b[j]))
                end_a, end_b = at_a + len(self.a_bytes(a[i])), at_b + len(self.b_bytes(b[j]))
                if end_a <= end_b:
                    i, at_a = i + 1, end_a
                if end_b <= end_a:
                    j, at_b = j + 1, end_b
                if end_a == end_b:
                    groups.append(",".join(str(x) for _, x in of_a) + "|" + ",".join(str(x) for _, x in of_b))
                    of_a, of_b = [], []
            total.update(links)
            made.append((doc_id, a, b, groups, links))
        most = {}
        for (_, b), n in total.items():
            most[b] = max(n, most.get(b, 0))
        for doc_id, a, b, groups, links in made:
            text = ";".join(groups)
            yield doc_id, len(a), len(b), len(groups), len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""


@pytest.fixture(scope="module")
def plain():
    return PlainPair()


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op12_query_against_brute_force(spark, plain):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(align.op12_align(spark, SF).select(*COLUMNS).collect(), plain.rows(docs))


ODD = [(1, "<|endoftext|> is <s>plain</s> <unk> text"), (2, None), (3, ""), (4, "a▁b"), (5, "  two  spaces\n\n\ttabs "), (6, "naïve ﬁ ﬂ ｆｕｌｌ 東京 🙂 é  x"), (7, "x" * 3000), (8, "same text"), (8, "same text"), (None, "same text"), (9, "\x00 \x1c\x85 end"), (10, "don't we'll 12345 ...!!! a1b2"), (11, " "), (12, "مرحبا привет नमस्ते")]


@pytest.mark.parametrize("sent", [0, 5, 4_000_000])
def test_alignment_of_odd_texts(spark, plain, sent):
    """Whatever number of pairs is sent; the rest is joined."""
    df = spark.createDataFrame([(*r, "kept", 7) for r in ODD], "doc_id long, text string, lang string, N_LINKS int")
    got = align.aligned(df.repartition(3), sent=sent)
    assert sorted(got.columns) == sorted(["doc_id", "lang", "a_ids", "b_ids", *COLUMNS[1:]]) and {r.lang for r in got.collect()} == {"kept"}
    same(got.select(*COLUMNS).collect(), plain.rows(ODD))
    ids = {r.doc_id: r for r in got.collect()}
    assert np.frombuffer(ids[10].a_ids, "<u2").tolist() == plain.tokens(ODD[11][1])[0] and ids[2].b_ids == b""


def test_alignment_of_a_text_longer_than_a_step(spark, plain):
    text = ("Some words of a long text, é and 12. " * 30_000)[: common.STEP_BYTES + 1000]
    docs = [(1, text), (2, "Some words"), (3, None)]
    same(align.aligned(spark.createDataFrame(docs, "doc_id long, text string")).select(*COLUMNS).collect(), plain.rows(docs))


def test_alignment_of_nothing(spark):
    assert align.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert {r.n_links for r in align.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()} == {0}


def test_both_readers_of_the_byte_tokenizer_agree():
    """On every character that the fast one is used for, alone and between others."""
    import random

    p = align.pair(f"{align.FOLDER}/{align.BYTE_BPE}", f"{align.FOLDER}/{align.PIECES}")
    assert p.fast is not None
    letters = [chr(c) for c in range(ord(align.PLAIN))]
    rng = random.Random(6)
    texts = ["".join(x) for c in letters for x in (c, (c, c), ("a", c, "b"), (" ", c, " "), ("1", c, "2"), (c, " ", c, "'s"))] + ["".join(rng.choices(letters + [" "] * 80 + list("abcde'"), k=40)) for _ in range(4000)]
    for text in texts:
        assert p.read_a(text).tolist() == p.slow.encode(" " + text, add_special_tokens=False).ids, repr(text)


def test_pair_counts_are_passed_on_in_parts(spark, monkeypatch, plain):
    monkeypatch.setattr(align, "HELD", 10)
    docs = [(i, f"word{i % 7} and some others {i}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    files = (f"{align.FOLDER}/{align.BYTE_BPE}", f"{align.FOLDER}/{align.PIECES}")
    got = align.pair_counts(align.tokenised(df, *files), *files)
    assert got.groupBy("pair").count().where("count > 1").count() == 0
    same(align.aligned(df).select(*COLUMNS).collect(), plain.rows(docs))


# --- collocations ----------------------------------------------------------------------------------


def collocations(docs, least, top=phrases.TOP):
    """The contract in plain Python."""
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            score, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            inside = [b for h, b in found.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if not any(100 * b >= 50 * a for b in inside):
                rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return out


def found_by(df, least, top=phrases.TOP):
    found, totals = phrases.phrases(df, least=least)
    return [tuple(r) for r in phrases.best(found, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


def talk(seed, n=150):
    import random

    rng = random.Random(seed)
    vocab = ["The", "of", "a\x00", "a", "É", "zoë", "x1", " ", "%%", "b", "c", "dd"]
    out = [(" ".join(rng.choices(vocab, [8, 6, 2, 4, 2, 2, 1, 1, 1, 3, 3, 3], k=rng.randint(0, 30))).replace(" b", rng.choice([". b", "\tb", "\nb", "  b", " B,"])), rng.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(n)]
    return [*out, (None, "en"), ("", "fr"), ("...", "it"), out[0], out[0]]


@pytest.mark.parametrize("leaves", [3, 1_500_000])
def test_collocations_against_plain_counts(spark, monkeypatch, leaves):
    """Whatever the partitions, the ranges and the sizes of tries."""
    monkeypatch.setattr(phrases, "LEAVES", leaves)
    docs = talk(3)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(docs)], DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, ranges in ((1, 1), (5, 23)):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            assert sorted(found_by(df.repartition(parts), 4)) == sorted(collocations(docs, 4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(found_by(df, 4, 5)) == sorted(collocations(docs, 4, 5))


def test_counts_beyond_64_bits_are_exact(spark):
    rows = [(a, x, y) for a in (10**12 + 7, 10, 3 * 10**13) for x in (10**12 + 7, 10**13 + 9, 5 * 10**15) for y in (10**12 + 9, 4 * 10**15 + 1)]
    df = spark.createDataFrame(rows, "a long, x long, y long").select("*", phrases.cut_score("a", "x", "y").alias("s"))
    assert all(r.s == 1_000_000 * r.a * r.a // (r.x * r.y) for r in df.collect())


def test_collocations_of_a_text_longer_than_a_step_and_of_nothing(spark):
    docs = [("one two three four. " * 60_000, "en"), ("one two", "en")]
    assert len(docs[0][0]) > common.STEP_BYTES
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(docs)], DOCS).withColumn("w1", F.lit(1)).withColumn("part", F.lit("x"))
    assert sorted(found_by(df, 10)) == sorted(collocations(docs, 10))
    assert found_by(df.limit(0), 10) == [] and found_by(df.where("doc_id = 1"), 10) == [] and found_by(df.withColumn("text", F.lit(None).cast("string")), 1) == []


def test_fragments_of_a_trie_are_the_trie(spark):
    """Cut by any splitters and read again, each node is in all ranges that its subtree reaches into, with its whole count."""
    import random

    import pyarrow as pa

    rng = random.Random(2)
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for t, _ in talk(9)]), pa.array([v for _, v in talk(9)])], names=["text", "lang"])
    trie = phrases.Trie.of_words(phrases.words(batch))
    name = lambda t, i: t.names[int(i)].as_py()

    def nodes(t):
        paths, out = [()], []
        for level, (parent, word, n) in enumerate(t.levels):
            at = [(*paths[int(p) if level else 0], name(t, w)) for p, w in zip(parent, word, strict=True)]
            out.append(dict(zip(at, n.tolist(), strict=True)))
            paths = at
        return out

    whole = nodes(trie)
    leaves = sorted(whole[2])
    for _ in range(20):
        cuts = sorted({rng.choice(leaves) if rng.random() < 0.7 else (b"en", rng.choice([b"a", b"zz", b"of"]), bytes([rng.randrange(97, 123)])) for _ in range(rng.randint(0, 9))})
        parts = {r: nodes(phrases.Trie.read(b)) for r, b in trie.fragments(cuts)}
        got = {}
        for r, levels in parts.items():
            for p, n in levels[2].items():
                assert phrases.range_of(cuts, p) == r and p not in got
                got[p] = n
            for d in (0, 1):
                assert all(whole[d][p] == n for p, n in levels[d].items())
        assert got == whole[2]
        for p in whole[1]:
            first, last = phrases.range_of(cuts, (*p, b"")), phrases.range_of(cuts, (*p, b"\xff" * 9))
            assert all(p in parts[r][1] for r in range(first, last + 1))
    again = phrases.Trie.merged([phrases.Trie.read(b) for _, b in trie.fragments([leaves[3], leaves[len(leaves) // 2]])])
    assert nodes(again)[2] == whole[2]


# --- quality ---------------------------------------------------------------------------------------


def area(label, score):
    good, bad = score[label == 1], score[label == 0]
    return float(np.mean((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None])))


def test_op11_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op11_quality(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got["score"].between(0, 1).all() and ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    import zlib

    assert all((zlib.crc32(str(d).encode()) % 5 == 0) == h for d, h in zip(got["doc_id"], got["held_out"], strict=True))
    rows = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    rows = rows[rows["held_out"]]
    assert len(rows) > 50 and area(rows["quality"].to_numpy(), rows["score"].to_numpy()) > 0.97 and (rows["predicted"] == rows["quality"]).mean() > 0.95
    assert (rows["predicted"][rows["quality"] == 1] == 1).mean() > 0.98


def test_op11_learns_nothing_from_held_out_labels(spark, tmp_path):
    """Scores stay when the labels of held-out rows are turned around, and when the ids of unlabelled documents change."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    for name, d, y in (("a", docs, labels), ("b", docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))))):
        d.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        y.coalesce(1).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    a, b = (sorted((r.doc_id, r.score) for r in quality.op11_quality(spark, f"{tmp_path}/{n}").collect()) for n in "ab")
    assert a == b


def test_votes_against_plain_cosines(spark):
    """Scores from the space's own vectors by loops over all labelled rows."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    space = quality.train(docs, labels)
    assert space.vectors.shape[0] == labels.join(docs.where("text is not null"), "doc_id").count() and abs(space.prior - labels.join(docs.where("text is not null"), "doc_id").agg(F.avg("quality")).first()[0]) < 1e-9
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), space).collect()}
    import pyarrow as pa

    for doc_id, text in [tuple(r) for r in docs.select("doc_id", "text").limit(60).collect()]:
        (_, counts), = quality.terms(pa.array([text], pa.string()))
        x = np.log1p(counts[0]) * space.weight
        x = (x / (np.linalg.norm(x) or 1)) @ space.basis
        cosines = [float(x @ v / (np.linalg.norm(x) or 1)) for v in space.vectors]
        last = sorted(cosines)[-quality.NEIGHBOURS]
        votes = [(max(0, c) ** quality.POWER * w, y) for c, w, y in zip(cosines, space.vote, space.label, strict=True) if c >= last - quality.TIE]
        total = sum(v for v, _ in votes)
        assert abs(got[doc_id] - (sum(v * y for v, y in votes) / total if total else space.prior)) < 2e-3


def test_terms_are_counted_by_row():
    """Blocks of rows don't change what a row has."""
    import pyarrow as pa

    texts = ["Some WORDS!! here", None, "", "a", "ab", "é é é 12,5", "x" * 50, "Some WORDS!! here", "\n\t "] * 60
    alone = {t: next(iter(quality.terms(pa.array([t], pa.string()))))[1][0] for t in set(texts)}
    got = np.concatenate([c for _, c in quality.terms(pa.array(texts, pa.string()))])
    assert len(got) == len(texts) and all((got[i] == alone[t]).all() for i, t in enumerate(texts))
    assert alone["a"].sum() == 1 and alone["ab"].sum() == 1 and alone["Some WORDS!! here"].sum() == 15 + 3 + 2 and not alone[None].any()
    assert (alone["é é é 12,5"] > 0).sum() > 3


def test_quality_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "good text of words"), (2, None), (3, ""), (3, "another text"), (None, "no id"), (4, "good text of words")], "doc_id long, text string").withColumn("Score", F.lit("x")).withColumn("h", F.lit(1))
    kind = "doc_id long, quality int"
    none = quality.score(docs, quality.train(docs, spark.createDataFrame([], kind)))
    assert none.columns == ["doc_id", "text", "h", "score", "predicted"] and {r.score for r in none.collect()} == {0.5}
    one = quality.score(docs, quality.train(docs, spark.createDataFrame([(1, 1), (None, 0), (3, None), (99, 0)], kind)))
    assert {r.score for r in one.collect()} == {1.0}
    two = {(r.doc_id, r.text): r.score for r in quality.score(docs, quality.train(docs, spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, 0), (4, 1)], kind))).collect()}
    assert two[1, "good text of words"] == two[4, "good text of words"] and two[2, None] == two[3, ""] == 0.5 and two[3, "another text"] < 0.1
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), spark.createDataFrame([], kind))).count() == 0


def test_quality_of_a_text_longer_than_a_step(spark):
    docs = spark.createDataFrame([(1, "LOUD!! " * (common.STEP_BYTES // 6)), (2, "LOUD!! NOISE!!"), (3, "a quiet line of words"), (4, "some other quiet words")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, quality int"))).collect()}
    assert got[1] < 0.3 < got[4]


def test_sample_bounds_the_labelled_rows(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "good words ").otherwise("BAD!! "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    space = quality.train(docs, labels, sample=20)
    assert len(space.vectors) == 40 and space.label.sum() == 20 and np.allclose(space.vote, 10) and space.prior == 0.5
    assert quality.score(docs, space).where("(score > 0.5) <> (doc_id % 2 = 0)").count() == 0
