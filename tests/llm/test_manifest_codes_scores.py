"""Merkle manifest, vector codes and suffix tree against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import core, merkle, queries, suffix_tree, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return text.translate(str.maketrans(UP, LOW))


# ---- manifest --------------------------------------------------------------------------------


def leaf(doc_id, text, lang, source, n_chars):
    told = (None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text))
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in told))


def tree(hashes):
    """All levels of a tree, the lowest first."""
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i):
    for level in levels[:-1]:
        a = i // 8 * 8
        yield level[a:i], level[i + 1 : a + 8]
        i //= 8


def manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([leaf(*r) for r in sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))]) for x in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, x in enumerate(order):
        for i, r in enumerate(sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))):
            steps = [*path(trees[k], i), *path(top, k)]
            h = leaf(r[0], r[1] if r[1] is None else lowered(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(*r)
            for a, b in steps:
                h = sha("".join(a) + h + "".join(b))
            out.append((r[0], leaf(*r), trees[k][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in steps)), h, h == top[-1][0]))
    return out


@pytest.fixture()
def saved(spark, tmp_path):
    def save(name, df):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save


LANGS = [None, "", "en", "é", "EN", "日本", *(f"l{i}" for i in range(14))]
ODD = [
    (i, random.Random(i).choice(["Abc", "abc", "", None, "É x" * 40, "Z" * 70_000]), LANGS[i % 20], [None, "web", "a:b"][i % 3], [None, 3][i % 2]) for i in range(300)
] + [(None, "A", "en", "x", 1), (None, None, None, None, None), (7, "Abc", "en", "w", 3), (7, "Abc", "en", "w", 3)]


@pytest.mark.parametrize("rows", [ODD, [(i, f"Text {i}", "en" if i else "de", "s", i) for i in range(4700)], [(5, "One", None, None, 3)], [(i, "x", "en", None, 1) for i in range(9)]], ids=["odd", "two buckets", "one", "nine"])
def test_manifest_is_that_of_plain_python(spark, saved, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit("x")).withColumn("Hash", F.lit(1))
    got = queries.op11_merkle_manifest(spark, saved("documents", docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(manifest(rows), key=repr)


def test_manifest_of_an_empty_table(spark, saved):
    assert queries.op11_merkle_manifest(spark, saved("documents", spark.createDataFrame([], DOCS))).count() == 0


def test_proofs_lead_to_the_root_and_a_changed_row_shows(spark):
    rows = [(i, f"Text {i}", ["en", "de"][i % 5 == 0], "s", i) for i in range(5000)]
    docs = spark.createDataFrame(rows, DOCS)
    built = merkle.build(docs)
    hashes = {(r.tree, r.place): r.hash for r in built.leaves.collect()}
    for p in built.proofs().collect():
        h = hashes[p.tree, p.place]
        for a, b in zip(p.before, p.after, strict=True):
            h = sha(a + h + b)
        assert h == built.root == p.root
    changed = merkle.build(docs.withColumn("text", F.when(F.col("doc_id") == 17, "other").otherwise(F.col("text"))))
    assert changed.root != built.root
    claimed = merkle.build(docs, claim=F.when(F.col("doc_id") == 17, F.sha2(F.lit("other").cast("binary"), 256))).audit()
    assert [r.id for r in claimed.where("folded_root <> root").collect()] == [17]


# ---- vector codes ------------------------------------------------------------------------------


def codes(rows, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    book = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(8)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        fresh = []
        for p in range(8):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[nearest(v, p)[1]].append(part(v, p))
            fresh.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(book[p])])
        book = fresh
    told = [(i, [nearest(v, p) for p in range(8)], lab) for i, v, lab in kept]
    error = Counter()
    for _, n, lab in told:
        error[lab] += sum(d for d, _ in n)
    digest = sha(",".join(str(x) for p in book for e in p for x in e))
    return [(i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), error[lab], digest) for i, n, lab in told]


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, seed, width=16):
    draw = random.Random(seed)
    value = lambda: float(np.float32(draw.choice([draw.gauss(0, 1), 0.25, -0.5, draw.randint(-3, 3) / 4096])))
    return [(draw.randrange(10**6), [value() for _ in range(width)], draw.choice([None, 0, 1, 1, 1, 2])) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 5, 16, 700])
def test_codes_are_those_of_plain_python(spark, saved, n):
    rows = vectors(n, n)
    rows += [rows[0], rows[-1], (1, None, 1), (2, [1.0, None] * 8, 1), (3, [float("nan")] * 16, None), (4, [float("-inf")] + [0.0] * 15, 2), (None, [0.5] * 16, None)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("x")).withColumn("code", F.lit(0)).repartition(5)
    got = queries.op13_vector_codes(spark, saved("embeddings", df)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(codes(rows), key=repr)


def test_codes_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(none).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [], 2), (3, [1.0] * 7, 2)], VECTORS)).count() == 0
    short = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1), (3, [2.0] * 8, 1)], VECTORS)
    assert sorted(r.id for r in vector_codes.compress(short).collect()) == [1, 3]
    with pytest.raises(Exception, match="component is beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], VECTORS))


def test_decoded_vectors_are_near(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 1.0]) * (1 + k) for k in range(8)], 0) for i in range(600)]
    books, held = vector_codes.fit(spark.createDataFrame(rows, VECTORS))
    for r in vector_codes.encode(held, books).collect():
        off = books.decode(r.code) - np.array(rows[r.id][1])
        assert (off * off).sum() * 4096**2 <= r.error + 8 * 4096


# ---- suffix tree -------------------------------------------------------------------------------


def split(text):
    return [lowered(w) for w in re.findall("[^\x20\x09-\x0d]+", text or "")] + [None]


class PlainTree:
    """The docstring of suffix_tree in plain Python."""

    def __init__(self, texts, depth, share, divergence, discount=0.75):
        self.c = Counter(w for t in texts for w in split(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.discount, self.follow, self.depth = discount, defaultdict(Counter), depth
        for t in texts:
            ws = split(t)
            for i, w in enumerate(ws):
                for k in range(1, min(depth, i) + 1):
                    self.follow[tuple(ws[i - k : i])][w] += 1
        support = max(suffix_tree.LEAST, share * self.n)
        self.states = {s for s, f in self.follow.items() if sum(f.values()) >= support}
        wanted = {s for s in self.states if self.divergence(s) >= divergence}
        self.kept = {s[k:] for s in wanted for k in range(len(s))}

    def escape(self, s):
        f = self.follow[s]
        return 1 - sum(n - self.discount for n in f.values() if n > 1) / sum(f.values())

    def p(self, x, s):
        if not s:
            return (self.c[x] + 1) / (self.n + self.v + 1)
        f = self.follow[s]
        return (f[x] - self.discount if f[x] > 1 else 0) / sum(f.values()) + self.escape(s) * self.p(x, s[1:])

    def divergence(self, s):
        every = sum(self.p(x, s) * math.log(self.p(x, s) / self.p(x, s[1:])) for x in self.c)
        rest = 1 - sum(self.p(x, s[1:]) for x in self.c)
        return every + self.escape(s) * rest * math.log(self.escape(s))

    def score(self, text):
        ws, out = split(text), 0.0
        for i, w in enumerate(ws):
            s = ()
            while len(s) < min(self.depth, i) and tuple(ws[i - len(s) - 1 : i]) in self.kept:
                s = tuple(ws[i - len(s) - 1 : i])
            out += math.log10(self.p(w, s))
        return out


@pytest.mark.parametrize("depth, share, divergence", [(1, 0.0, 0.0), (3, 0.002, 0.05), (3, 0.0, 0.3), (4, 0.01, 0.0)])
def test_scores_are_those_of_a_plain_tree(spark, monkeypatch, depth, share, divergence):
    draw = random.Random(depth + share)
    lines = ["the cat sat on the mat", "A dog sat on a log", "the cat ate", "no Cat sat", "über den wolken"]
    texts = [" ".join(draw.choice(lines) for _ in range(draw.randrange(6))) + draw.choice(["", "\n x" + str(draw.randrange(40))]) for _ in range(150)]
    texts += [None, "", " \n", "THE CAT", "new words only", "the cat sat " * 3000, texts[0], texts[0]]
    rows = [(i, t, i % 7 != 2) for i, t in enumerate(texts)]
    docs = core.cut(spark.createDataFrame(rows, "doc_id long, text string, use boolean").withColumn("row", F.lit("x")).withColumn("score_", F.lit(1)).repartition(3), "docs")
    monkeypatch.setattr(suffix_tree, "WORD_SHARE", 0.02)  # most words' counts go by the join
    model = suffix_tree.train(docs, F.col("use"), depth, share, divergence)
    plain = PlainTree([t for _, t, use in rows if use], depth, share, divergence)
    assert (model.n, model.v) == (plain.n, plain.v)
    assert int(model.known["kept"].sum()) == len(plain.kept) and len(model.known) == len(plain.states)
    got = {r.doc_id: r for r in suffix_tree.score(docs, model).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ws = split(t)
        assert (got[i].n_tokens, got[i].n_known) == (len(ws), sum(plain.c[w] > 0 for w in ws))
        assert got[i].base_score == pytest.approx(sum(math.log10(plain.p(w, ())) for w in ws), abs=1e-4)
        assert got[i].score == pytest.approx(plain.score(t), abs=1e-4)


def test_a_tree_holds_all_shorter_contexts_and_sums_to_one():
    plain = PlainTree(["a b c a b d", "a b c a b c", "b c a"] * 4, 3, 0.0, 0.1)
    for s in plain.kept:
        assert not s[1:] or s[1:] in plain.kept
        assert sum(plain.p(x, s) for x in plain.c) + plain.p("never met", s) == pytest.approx(1)


def test_scores_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = core.cut(spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string"), "docs")
    assert suffix_tree.score(empty, suffix_tree.train(docs)).count() == 0
    untrained = suffix_tree.score(docs, suffix_tree.train(empty)).collect()
    assert sorted((r.n_tokens, r.n_known, r.score) for r in untrained) == [(1, 0, 0.0), (3, 0, 0.0), (3, 0, 0.0)]
    assert suffix_tree.train(docs, F.lit(None).cast("boolean")).n == 0


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    from ..conftest import DATA

    got = queries.op12_suffix_tree(spark, str(DATA / "sf0.001")).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert got[1] > got[0] and got[2] > 0


def test_tokens_of_a_slice():
    for t in core.slices(pa.array(["a b", None, "", " c\n"])):
        got = suffix_tree.tokens([suffix_tree.piece(t)])
        assert got.doc.tolist() == [0, 0, 0, 1, 2, 3, 3] and got.place.tolist() == [0, 1, 2, 0, 0, 0, 1]
        assert (got.words[got.code] == suffix_tree.END).tolist() == [False, False, True, True, True, False, True]
