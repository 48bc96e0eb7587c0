"""Toxicity, quality, counts, mixing, encoding: brute force, round trips and held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import mixing, quadratic, quality_rules, token_counts, toxicity
from threadloom.llm.core import n_words, slices, words
from threadloom.llm.pieces import MergeVocabulary, encode_texts

from ..conftest import DATA

DOCS = "doc_id long, text string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "é 日本 \U0001f600", "x" * 3000, "a  b\t\tc\n\nd ", "</s> <unk> <0x41>", "▁▁a ▁", "ab " * 700]


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@given(st.lists(st.text(alphabet="ab \n\t\r\x0b\xa0é", max_size=12), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_of_a_batch(texts):
    got = []
    for t in slices(pa.array([*texts, None], pa.string()), 8):
        w = words(t)
        whole = [t.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
        got += [whole[a:b] for a, b in zip(w.doc_first[:-1], w.doc_first[1:])]
    assert got == [split(t) for t in [*texts, None]]


def test_n_words(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), DOCS)
    assert {r.doc_id: r.n for r in df.select("doc_id", n_words().alias("n")).collect()} == {i: len(split(t)) for i, t in enumerate(ODD)}


# ---- toxicity -------------------------------------------------------------------------------


def edit_distance(a, b):
    """Letters more, less, other, and two neighbours swapped."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(rows[-1][j] + 1, now[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], rows[-2][j - 2] + 1)
        rows.append(now)
    return rows[-1][-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_automaton_in_trie_is_edit_distance(edits):
    r = random.Random(edits)
    terms = sorted({"".join(r.choices("abc", k=r.randrange(2, 7))) for _ in range(30)})
    trie = toxicity.Trie(terms)
    for _ in range(600):
        word = "".join(r.choices("abc", k=r.randrange(0, 8)))
        near = min((edit_distance(word, t), i) for i, t in enumerate(terms))
        found = trie.within(word, edits)
        assert found == ((near[1], near[0]) if near[0] <= edits else None)
        if found and edits == 1:
            assert trie.survives(word)


def test_quotation_weighs_less():
    lexicon = toxicity.Lexicon(["scoundrel"], [6.0], {}, [3.0])
    texts = ["you are a scoundrel", 'he wrote "what a scoundrel" there', "sc0undrel indeed", "scoundrle indeed", "scondrel indeed", "nothing here", "", '"' * 90 + "scoundrel", "x" * 300 + " scoundrel$$$", "you,scoundrel,you", "a" * 5000 + "!scuondrel"]
    known = toxicity._Known()
    w = words(next(slices(pa.array(texts))))
    x = toxicity.evidence(w, known.look_up(w, lexicon.weight), known)
    assert x[0, 0] > x[2, 0] > 0 and x[1, 0] < x[0, 0] and x[1, 3] == 1 and x[4, 0] > 0 and x[5, 0] == x[6, 0] == 0
    assert x[3, 0] > 0 and (x[7:, 0] > 0).all()


def test_toxicity_on_held_out_rows(spark):
    base = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    fold = quadratic.fold(F.col("doc_id"), 4)
    out = toxicity.score(docs, toxicity.train(docs, labels, fold != 2))
    rows = out.join(labels, "doc_id").where(fold == 2).select("score", "toxic").collect()
    said = Counter((r.toxic, r.score >= toxicity.THRESHOLD) for r in rows)
    assert said[1, True] / (said[1, True] + said[1, False]) > 0.92 and said[0, True] / (said[0, True] + said[0, False]) < 0.02
    assert out.count() == docs.count()


def test_copies_of_a_toxic_text_drop_no_term(spark):
    r = random.Random(8)
    plain, terms = [f"word{i}" for i in range(200)], [f"slur{c}{c}" for c in "abcdefghij"]
    texts = [(" ".join(r.choices(plain, k=30)), 0) for _ in range(900)]
    for i in range(300):
        own = r.choices(plain, k=30)
        own[i % 30] = terms[i % 10]
        texts.append((" ".join(own), 1))
    learn = lambda rows: toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    alone = set(learn(texts).terms)
    assert alone >= set(terms)
    hot = " ".join(f"{t} filler{i}" for i, t in enumerate(terms))
    copied = set(learn(texts + [(hot, 1)] * 400).terms)
    near = set(learn(texts + [(f"{hot} copy {i}", 1) for i in range(400)]).terms)
    for found in (copied, near):
        assert found >= set(terms) and not any(x.startswith("filler") for x in found)


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([*enumerate(ODD), (None, "some text")], DOCS).selectExpr("*", "'z' as toxic", "1.0D as score")
    none = toxicity.train(docs, spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int"))
    assert none.lexicon.terms == [] and all(0 <= r.score < 0.3 for r in toxicity.score(docs, none).collect())
    assert toxicity.reject(docs, none).columns == docs.columns and toxicity.reject(docs, none).count() == docs.count()
    assert toxicity.score(docs.limit(0), none).collect() == []


# ---- quality --------------------------------------------------------------------------------


def brute_base(text):
    w = split(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_rules_match_brute_force(spark):
    r = random.Random(4)
    texts = ["".join(r.choices(["a ", "b ", "é", "\n", "a b\n", "#", " "], k=r.randrange(80))) for _ in range(120)] + ODD + ["x\n", "\nx\nx", "a\n\n\na"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "9 as n_words", "true as kept")
    got = quality_rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(texts)
    for x in got:
        want = brute_base(texts[x.doc_id])
        assert tuple(x[k] for k in quality_rules.BASE) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (x.base_failed, x.kept) == (failed, not failed)


def test_scores_do_not_hang_on_neighbours(spark):
    """The same bits in any order and partitioning: no gram reaches into the next text, and sums are of whole numbers."""
    r = random.Random(6)
    weights, platt = np.random.default_rng(1).normal(0, 1, (2 << quality_rules.BITS) + 1).astype(np.float32), np.array([0.1, 0.0])
    texts = ["".join(r.choices("abc é日\U0001f600 \n", k=r.randrange(60))) for _ in range(80)] + ODD

    def score(order, limit):
        out = {}
        for t in slices(pa.array([texts[i] for i in order]), limit):
            for k, p in enumerate(quality_rules.scores(t, words(t), weights, platt).tolist()):
                out[order[t.first + k]] = p
        return out

    base = score(list(range(len(texts))), 1 << 20)
    for limit in (1, 100, 1 << 20):
        order = list(range(len(texts)))
        r.shuffle(order)
        assert score(order, limit) == base
    assert base[texts.index(None)] == base[texts.index("")]


def test_grams_are_of_code_points():
    t = next(slices(pa.array(["é日\U0001f600ab", "ab", "é日\U0001f600a"])))
    (_, _), (grams, bounds) = quality_rules.hashed(t, words(t))
    assert bounds.tolist() == [0, 2, 2, 3] and grams[0] == grams[2] != grams[1]


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = quadratic.fold(F.col("doc_id"), 3)
    out = quadratic.classify(docs, labels, fold != 1).join(labels, "doc_id").where(fold == 1).collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in out) / len(out) > 0.95
    rules = quality_rules.quality_rules(docs, labels).join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id")
    rate = rules.where("not base_failed").groupBy("good").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {r.good: r.kept for r in rate}[1] > 0.97


def test_quadratic_is_a_gaussian_log_ratio():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (500, quadratic.D)), rng.normal(0.5, 2, (400, quadratic.D))])
    y = np.repeat([0, 1], [500, 400])
    one = np.column_stack([x, np.ones(len(x))])
    model = quadratic.Quadratic.of({c: one[y == c].T @ one[y == c] for c in (0, 1)})
    assert ((model.logit(x) > 0) == y).mean() > 0.9
    (m0, f0, d0), (m1, f1, d1) = model.parts
    s0, s1 = f0 @ f0.T, f1 @ f1.T
    z = x[7]
    want = -0.5 * ((z - m1) @ np.linalg.solve(s1, z - m1) + np.linalg.slogdet(s1)[1]) + 0.5 * ((z - m0) @ np.linalg.solve(s0, z - m0) + np.linalg.slogdet(s0)[1]) + model.prior
    assert model.logit(x[7:8])[0] == pytest.approx(want)


def test_quadratic_of_odd_tables(spark):
    docs = spark.createDataFrame([*enumerate(ODD), (None, "t"), (0, None)], DOCS).selectExpr("*", "1 as x", "2 as y")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = quadratic.classify(docs, none, F.lit(True)).collect()
    assert len(out) == len(ODD) + 2 and {r.score for r in out} == {0.5}
    assert quadratic.classify(docs.limit(0), none, F.lit(True)).collect() == []


# ---- mixing ---------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / rest for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix(spark):
    r = random.Random(9)
    rows = [(i, r.choice(["a", "b", "c", "dd", "é", None]) if i % 3 else "a", " w" * int(r.paretovariate(1) * 5)) for i in range(900)]
    rows += [(900, "tiny", "one two"), (901, "empty", None), (902, "empty", " "), (None, "b", "w w w"), (903, "b", "w w"), (903, "b", "w w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as copies")
    plan = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(split(t))
    want = brute_targets(sizes)
    taken = Counter()
    for x in plan:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source]) and 0 <= x.copies <= 3
        taken[x.source] += x.size * x.copies
    assert len(plan) == len(rows) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.02 * t), s
    again = mixing.mix_plan(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.where("doc_id < 900").count() == sum(x.copies for x in plan if x.doc_id is not None and x.doc_id < 900)
    assert mixing.mix_plan(docs.limit(0)).collect() == []


def test_multipliers_solve_the_dual(spark):
    size, count = np.array([1, 5, 40, 3000]), np.array([100, 50, 20, 1])
    total = int((size * count).sum())
    wanted = {"a": 10.0, "b": 900.0, "c": float(total), "d": 9000.0, "e": 12000.0, "f": 3.0 * total, "g": 0.0, None: 4150.0}
    hist = spark.createDataFrame([(s, int(x), int(n)) for s in wanted for x, n in zip(size, count)], "source string, size long, n long")
    sources = spark.createDataFrame([(s, total, t) for s, t in wanted.items()], "source string, source_size long, target double")
    found = {r.of: r for r in mixing.multipliers(hist, sources).collect()}
    assert found["f"].m == float("inf") and found["g"].m == float("-inf") and found["c"].m == 0
    for s, t in wanted.items():
        if s not in ("f", "g"):
            w = np.minimum(3, np.exp(np.minimum(found[s].m * size / found[s].mean, 50)))
            assert (size * count * w).sum() == pytest.approx(t, rel=1e-4), s


def test_targets_by_levels(spark):
    sizes = {"a": 100, "b": 1, "c": 2, "d": 5, "é": 900, None: 3, "zz": 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))
    assert mixing.targets(spark.createDataFrame([("a", 0)], "source string, source_size long")).first().target == 0


def test_mixing_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "w w w"), (None, None, "x"), (2, "b", None)], "doc_id long, source string, text string").selectExpr("*", "1 as id_", "2 as of", "3 as copies", "4 as COPY", "5 as of_", "6 as copies_")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.where("copies <> 3 or of <> 2 or COPY <> 4").isEmpty()


# ---- token counts ---------------------------------------------------------------------------

CHANGES = "op string, doc_id long, source string, lang string, text string"


def test_rollup_follows_inserts_revisions_and_deletes(spark):
    roll = token_counts.TokenRollup(spark, {"words": None, "bpe": (public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.tiktoken"))})
    assert roll.totals().collect() == []
    first = [("insert", 1, "s", "en", "a b c"), ("insert", 2, "s", "en", "d"), ("insert", 3, None, "fr", None), ("insert", None, "s", "en", "x y"), ("insert", 4, "t", "en", "q\x0br")]
    assert roll.commit("one", spark.createDataFrame(first, CHANGES))
    assert not roll.commit("one", spark.createDataFrame(first, CHANGES))
    second = [("revise", 1, "s", "de", "a b"), ("delete", 2, None, None, None), ("delete", 77, None, None, None), ("insert", 5, "t", "en", "z"), ("insert", 5, "t", "en", "z z")]
    assert roll.commit("two", spark.createDataFrame(second, CHANGES))
    words_ = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in roll.totals().where("tokenizer_version = 'words'").collect()}
    assert words_ == {("s", "en"): (1, 2), ("s", "de"): (1, 2), (None, "fr"): (1, 0), ("t", "en"): (3, 5)}
    assert roll.commit("three", spark.createDataFrame([("delete", i, None, None, None) for i in (1, 3, 4, 5)], CHANGES))
    assert {(r.source, r.n_docs) for r in roll.totals().collect()} == {("s", 1)}
    assert roll.commit("four", spark.createDataFrame([], CHANGES))


def test_a_broken_batch_does_not_count(spark, tmp_path):
    roll = token_counts.TokenRollup(spark, path=f"file://{tmp_path}/state")
    rows = spark.createDataFrame([("insert", 1, "s", "en", "a b")], CHANGES)
    roll.commit("one", rows)
    spark.createDataFrame([("s", "en", "words", 9, 9)], token_counts.DELTAS).write.parquet(f"{roll.path}/data/1-broken/deltas")
    assert roll.totals().first().n_tokens == 2
    roll.commit("two", spark.createDataFrame([("insert", 2, "s", "en", "c")], CHANGES))
    assert roll.totals().first().n_tokens == 3
    again = token_counts.TokenRollup(spark, path=roll.path, buckets=5)
    assert again.buckets == token_counts.BUCKETS and not again.commit("two", rows)
    again.commit("three", spark.createDataFrame([("delete", 1, None, None, None)], CHANGES))
    assert roll.totals().first().n_tokens == 1


def test_odd_ops_and_columns(spark):
    roll = token_counts.TokenRollup(spark, buckets=2)
    rows = [(" INSERT", 1, "s", "en", "a b"), (None, 2, "s", "en", "c"), ("upsert", 3, "s", "en", "d"), ("delete", None, "s", "en", None), ("Insert", None, None, None, "q")]
    roll.commit("one", spark.createDataFrame(rows, CHANGES).selectExpr("*", "1 as bucket", "2 as docs", "3 as tokens", "4 as hit"))
    assert {(r.source, r.lang, r.n_docs, r.n_tokens) for r in roll.totals().collect()} == {("s", "en", 1, 2), (None, None, 1, 1)}


def test_random_batches_equal_a_count_of_what_is_left(spark):
    """Signed deltas against a plain recount after each batch; byte-level tokens against the library."""
    import tiktoken
    import tiktoken.load

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(path), special_tokens={})
    count = {"words": lambda t: len(split(t)), "bpe": lambda t: len(lib.encode_ordinary(t or ""))}
    roll = token_counts.TokenRollup(spark, {"words": None, "bpe": (public_tokenizers.PATTERN, path)}, buckets=3)
    r, held = random.Random(5), {}
    for k in range(4):
        batch = []
        for i in r.sample(range(25), 12):
            op = r.choice(token_counts.OPS)
            source, lang, text = r.choice(["s", "t", None]), r.choice(["en", "de"]), r.choice(ODD)
            batch.append((op, i, source, lang, text))
            if op == "delete":
                held.pop(i, None)
            else:
                held[i] = source, lang, text
        for _ in range(2):
            roll.commit(f"b{k}", spark.createDataFrame(batch, CHANGES))
        want = Counter()
        for source, lang, text in held.values():
            for v, n in count.items():
                want[source, lang, v, "docs"] += 1
                want[source, lang, v, "tokens"] += n(text)
        got = Counter()
        for x in roll.totals().collect():
            got[x.source, x.lang, x.tokenizer_version, "docs"], got[x.source, x.lang, x.tokenizer_version, "tokens"] = x.n_docs, x.n_tokens
        assert +got == +want


def test_the_query_counts_the_documents(spark):
    from threadloom.llm import queries

    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.op4_token_counts(spark, f"{DATA}/sf0.001").where("tokenizer_version = 'words'").collect()}
    want = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").groupBy("source", "lang").agg(F.count("*").alias("d"), F.sum(n_words()).alias("n")).collect()
    assert got == {(r.source, r.lang): (r.d, r.n) for r in want}


# ---- SentencePiece --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as f:
        return MergeVocabulary(f.read())


@given(st.text(alphabet=st.sampled_from("abcdehilnorst ▁\n\t\x00.,éß日\U0001f600<>/s0x"), max_size=90))
@settings(max_examples=250, deadline=None)
def test_encoding_is_the_librarys(vocabulary, text):
    ids, n, decoded = vocabulary.encode(text)
    want = vocabulary.library.encode(text, add_eos=True)
    assert ids == " ".join(map(str, want)) and n == len(want)
    assert decoded == vocabulary.library.decode(want) == vocabulary.decode(want)
    vocabulary.check(text, ids, decoded)


def test_long_parts_are_held_against_the_library(vocabulary):
    vocabulary.fresh = []
    vocabulary.encode("x" * 200)
    assert [len(p) for p, _ in vocabulary.fresh] == [201]
    vocabulary.refuse_others()
    vocabulary.fresh = [("▁ab", "1 2")]
    with pytest.raises(ValueError):
        vocabulary.check("a", *(vocabulary.encode("a")[k] for k in (0, 2)))
    vocabulary.fresh = []


def test_both_agendas_agree(vocabulary):
    r = random.Random(2)
    for _ in range(300):
        part = "▁" + "".join(r.choices("abcdefghilmnorstu", k=r.randrange(1, 40)))
        assert vocabulary._merge_short(part) == vocabulary._merge_long(part)


def test_encode_texts(spark, vocabulary):
    texts = [*ODD, "word " * 5000, "y" * 20000]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a"), (1, "")], DOCS).selectExpr("*", "'c' as ids")
    got = encode_texts(docs, MODEL).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        text = "a" if x.doc_id is None else texts[x.doc_id] or ""
        want = vocabulary.library.encode(text, add_eos=True)
        assert (x.ids, x.n_tokens, x.decoded) == (want, len(want), vocabulary.library.decode(want))
    assert encode_texts(docs.limit(0), MODEL, as_text=True).collect() == []


def test_repeated_labels_and_rows_train_as_one(spark):
    """The sample bounds what the training task gets, whatever repeats: labels of an id, rows of an id, or both."""
    docs = spark.createDataFrame([(i, f"good plain words {i} here " * 20 if i % 2 else f"zz qq {i} xx ww " * 20) for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    many = docs
    for _ in range(4):
        many = many.union(docs.where("doc_id < 10"))
    plain, repeated = quality_rules.train(docs, labels), quality_rules.train(many, labels.union(labels).union(labels))
    assert (plain[0] == repeated[0]).all() and (plain[1] == repeated[1]).all()
