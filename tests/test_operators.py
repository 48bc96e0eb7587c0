"""Operators against brute force and pinned small cases."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions.rates import wilson
from threadloom.operators import classify, gate, graph, metrics, modelcall, retrieval, sampling, similarity, stores, threads
from threadloom.plans import fixtures as X
from threadloom.plans import relational_queries as Q


def test_components_join_through_absent_ids(spark):
    edges = spark.createDataFrame([(10, 999), (20, 999), (30, 40)], "a long, b long")
    got = {r.node: r.component_id for r in graph.connected_components(edges).collect()}
    assert got == {10: 10, 20: 10, 999: 10, 30: 30, 40: 30}


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component_id for r in graph.connected_components(path).collect()} == {0}
    assert graph.connected_components(path.limit(0), spark.createDataFrame([(5,)], "node long")).collect() == [(5, 5)]


def test_chains(spark):
    rows = X.rows(spark, X.CHAINS, X.CHAIN_COLUMNS)
    got = {r.id: (r.path, r.missing_parent, r.cycle, r.timestamp_conflict) for r in graph.ancestor_chains(rows, rows.select("id")).collect()}
    assert got[3] == ([1, 2], False, False, False)
    assert got[10][1:] == (False, True, False) and got[21] == ([20], True, False, False) and got[31] == ([], False, False, True)
    assert len(got) == len(X.CHAINS)


def _walk(links, start):
    path, seen, at = [], {start}, start
    while (up := links[at][0]) is not None:
        flags = (up not in seen and up not in links, up in seen, up not in seen and up in links and links[up][1] > links[at][1])
        if any(flags):
            return (path, *flags)
        path, at = [up, *path], up
        seen.add(up)
    return path, False, False, False


def test_chains_match_a_walk(spark):
    r = random.Random(5)
    links = {i: (r.choice([None, *range(40), 999]), r.choice([1, 1, 1, 1, 2])) for i in range(30)} | {100 + i: (100 + (i + 1) % 7, 1) for i in range(7)}
    links |= {200: (201, 2), 201: (202, 3), 202: (200, 1), 300: (300, 1), 301: (300, 1)}
    rows = spark.createDataFrame([(i, *x) for i, x in links.items()], "id long, parent long, ts long")
    got = {x.id: tuple(x)[1:] for x in graph.ancestor_chains(rows, rows.select("id")).collect()}
    assert got == {i: _walk(links, i) for i in links}


def test_chains_of_over_1000_ancestors(spark):
    rows = spark.range(1500).selectExpr("id", "nullif(id, 0) - 1 as parent", "id as ts")
    got = {x.id: tuple(x)[1:] for x in graph.ancestor_chains(rows, rows.where("id in (0, 999, 1001, 1499)").select("id")).collect()}
    assert got == {i: (list(range(i)), False, False, False) for i in (0, 999, 1001, 1499)}


def test_turns_of_a_long_conversation_meet_no_other(spark, tmp_path):
    turns = [(1, t) for t in range(1203)] + [(2, t) for t in range(3)]
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c}-{t}") for c, t in turns]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    depths = sorted(tuple(x) for x in Q.thread_depth(spark, str(tmp_path)).collect())
    assert depths == sorted((c * 1000 + t, t) for c, t in turns)
    pairs = sorted((x.customer_text, x.support_text) for x in Q.reply_pairs(spark, str(tmp_path)).collect())
    assert pairs == sorted((f"{c}-{t - 1}", f"{c}-{t}") for c, t in turns if t % 2)
    cited = sorted(tuple(x) for x in Q.evidence_resolve(spark, str(tmp_path)).collect())
    shown = lambda c, t: f"{c * 1000 + t}:{hashlib.md5(f'{c}-{t}'.encode()).hexdigest()}"
    assert cited == sorted((c * 1000 + t, ",".join(shown(c, t + k) for k in (-1, 1, 7) if (c, t + k) in set(turns))) for c, t in turns if t % 2 == 0)


def _texts(n, seed=3):
    r = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    base = [r.choices(words, k=14) for _ in range(6)]
    out = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = r.choice(words)
        out.append((i, " ".join(t)))
    return [*out, (n, ""), (n + 1, "one two"), (n + 2, "one two!")]


def _brute(rows):
    import re

    def grams(t):
        w = re.findall(r"\w+", t.lower())
        return {"short:" + " ".join(w)} if len(w) < 4 else {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}

    s = {i: grams(t) for i, t in rows}
    return {(a, b) for a in s for b in s if a < b and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])}


def test_pairs_and_greedy_match_brute_force(spark):
    rows = _texts(40)
    docs = spark.createDataFrame(rows, "id long, text string")
    classes = similarity.similar_classes(docs)
    member = {r.id: r.class_id for r in classes.members.collect()}
    between = {(r.a, r.b) for r in classes.pairs.collect()}
    got = {(i, j) for i in member for j in member if i < j and (member[i] == member[j] or tuple(sorted((member[i], member[j]))) in between)}
    assert got == _brute(rows)
    assert {r.id: r.n_links for r in classes.links().collect()} == {i: sum(i in p for p in got) for i in member}
    ranked = sampling.hash_rank(docs.select("id"), "id")
    order = [r.id for r in ranked.orderBy("rank").collect()]
    taken = []
    for i in order:
        if not any((min(i, j), max(i, j)) in got for j in taken):
            taken.append(i)
    chosen = {r.id for r in similarity.greedy_dedupe(docs, ranked).where("accepted").collect()}
    assert chosen == set(taken)


@pytest.mark.parametrize("stars", [0, 1, 4])
def test_components_and_greedy_by_stars_match_brute_force(spark, monkeypatch, stars):
    monkeypatch.setattr(similarity, "STARS", stars)
    draw = random.Random(stars)
    base = [f"w{i}" for i in range(24)]
    rows = _texts(30)
    for i in range(100, 150):  # chains of small changes, so that ends of a component are not similar
        base[draw.randrange(24)] = f"v{draw.randrange(9)}"
        rows.append((i, " ".join(base)))
    rows += [(200, None), (201, ""), (202, " ".join(base))]
    pairs = _brute([(i, t or "") for i, t in rows])
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(rows, "id long, text string")
    assert {r.id: r.component_id for r in similarity.near_components(docs).collect()} == root
    ranked = sampling.hash_rank(docs.select("id"), "id")
    taken = []
    for r in ranked.orderBy("rank").collect():
        if not any((min(r.id, j), max(r.id, j)) in pairs for j in taken):
            taken.append(r.id)
    assert {r.id for r in similarity.greedy_dedupe(docs, ranked).where("accepted").collect()} == set(taken)


def test_near_copies_make_as_many_links_as_texts(spark, monkeypatch):
    """3,000 texts that differ in one word are some 4.5 million similar pairs; none of them is held against all others."""
    seen, plain = [], similarity._verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(similarity, "_verified", counted)
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{text} own{i} " + text[::-1]) for i in range(3000)] + [(9000, "a text by itself that nothing is like")], "id long, text string")
    got = similarity.near_components(docs).groupBy("component_id").count().collect()
    assert sorted((r.component_id, r["count"]) for r in got) == [(0, 3000), (9000, 1)]
    chosen = similarity.greedy_dedupe(docs, sampling.hash_rank(docs.select("id"), "id")).where("accepted").count()
    assert chosen == 2 and sum(seen) < 3 * 3000


def test_signatures_lose_no_similar_sets():
    draw = np.random.default_rng(5)
    seen = 0
    for _ in range(4000):
        a = draw.integers(-(2**63), 2**63 - 1, int(draw.integers(1, 300)))
        both = len(a) - int(draw.integers(0, len(a) // 5 + 1))
        b = np.concatenate([a[:both], draw.integers(-(2**63), 2**63 - 1, int(draw.integers(0, len(a) // 5 + 1)))])
        if both * 100 < (len(a) + len(b) - both) * 80:
            continue
        size = np.array([len(a), len(b)])
        row, sign, sketch = similarity._signatures(np.repeat([0, 1], size), np.concatenate([a, b]), size, 80)
        x, y = (dict(zip(sign[row == i].tolist(), sketch[row == i].tolist())) for i in (0, 1))
        apart = min(((x[k] ^ y[k]) & 0xFFFFFFFF).bit_count() for k in x.keys() & y.keys())
        assert apart < similarity.BLOCK and apart <= size.sum() - 2 * both
        seen += 1
    assert seen > 1000


def test_components_hold_few_texts_of_frequent_passages_against_each_other(spark, monkeypatch):
    """300 texts of eight out of 60 passages, and each once more with another word at its end: most share passages, few are similar."""
    tried, plain = [], similarity._verified

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(similarity, "_verified", counted)
    monkeypatch.setattr(similarity, "STARS", 1)
    draw = random.Random(3)
    texts = [" ".join(f"p{p}w{k}" for p in draw.sample(range(60), 8) for k in range(12)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"{t} more") for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.component_id for r in similarity.near_components(docs).collect()}
    assert got == {i: i % 1000 for i in (*range(300), *range(1000, 1300))}
    assert 300 <= sum(tried) < 4 * 300


def test_hard_quotas_take_rows_with_a_reason_in_a_second_pass(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(8))
    rows = [(i, words(i), "why" if i % 4 == 0 else None) for i in range(40)] + [(50, words(0) + " more", "why"), (51, words(4), "why")]
    docs = spark.createDataFrame(rows, "id long, text string, reason string")
    ranks = docs.select("id", F.when(F.col("id") >= 50, F.col("id") - 50.5).otherwise(F.col("id")).alias("rank"))
    got = {r.id: (r.split, r.reason) for r in similarity.two_passes(docs, ranks, {"dev": 3, "test": 4}, {"hard": 5}).collect()}
    order = [50, 51, *range(40)]  # 0 is like 50 and 4 like 51, so neither is taken
    plain = [i for i in order if i not in (0, 4)][:7]
    hard = [i for i in order if i not in (0, 4, *plain) and i % 4 == 0][:5]
    assert got == {i: ("dev" if k < 3 else "test", None) for k, i in enumerate(plain)} | {i: ("hard", "why") for i in hard}
    with pytest.raises(ValueError):
        similarity.two_passes(docs, ranks, {"dev": 3}, {"hard": 30})


def test_many_copies_make_no_pairs(spark):
    rows = [(i, "one and the same long text") for i in range(300)] + [(i, None) for i in range(300, 400)] + [(500, "another text of its own")]
    classes = similarity.similar_classes(spark.createDataFrame(rows, "id long, text string"))
    assert classes.pairs.count() == 0 and {r.n_links for r in classes.links().where("id < 300").collect()} == {299}
    none = similarity.similar_classes(spark.createDataFrame([], "id long, text string"))
    assert none.links().collect() == [] and none.pairs.collect() == []


def test_pairs_of_two_tables_and_scrub(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "q r s t u", "x"), (3, "l m n o p", "y")], "id long, text string, component string")
    taken = spark.createDataFrame([(9, "A b @me c d e f!")], "id long, text string")
    assert [r.id for r in similarity.dissimilar(docs, taken).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in similarity.scrub_components(docs, taken).collect()] == [3]


def test_numbers_and_quotas_do_not_follow_partitions(spark):
    df = spark.range(100).repartition(7)
    got = {r.id: r.n for r in sampling.numbered(df, "id", name="n").collect()}
    assert got == {i: i + 1 for i in range(100)}
    one, other = ({r.id for r in sampling.hash_rank(spark.range(50).repartition(k), "id").where("rank <= 10").collect()} for k in (2, 5))
    assert one == other
    assert {r.split: r.n for r in sampling.quota(df, "id", {"a": 5, "b": 7}).groupBy("split").agg(F.count("*").alias("n")).collect()} == {"a": 5, "b": 7}
    assert [r.batch for r in sampling.batches(spark.range(5), "id", 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_metrics_null_and_zero(spark):
    rows = spark.createDataFrame([("a", "a", "escalate", "escalate")], "truth string, predicted string, route string, gold_route string")
    r = metrics.routing(rows).first()
    assert r.disagreement_rate is None and r.escalation_recall == 1 and r.wilson_low is None
    report = metrics.per_class(rows, spark.createDataFrame([("a",), ("b",)], "class string"))
    assert {x["class"]: (x.f1, x.support) for x in report.collect()} == {"a": (1.0, 1), "b": (0.0, 0)}
    assert metrics.macro_f1(report).first().macro_f1 == 0.5


def test_wilson(spark):
    low, high = wilson(F.lit(0), F.lit(3))
    r = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert r.low == 0 and 0.5 < r.high < 0.6


SCORES = "rating_id string, correctness int, grounding int, usefulness int, routing_privacy int, critical_failure boolean"


def test_agreement(spark):
    human = spark.createDataFrame([("a", 0, None, None, None, True)], SCORES)
    judge = spark.createDataFrame([("a", 2, 1, None, None, False)], SCORES)
    got = {r.dimension: r for r in metrics.agreement(human, judge).collect()}
    assert (got["correctness"].n, got["correctness"].exact_agreement, got["correctness"].weighted_kappa) == (1, 0.0, None)
    assert (got["grounding"].n, got["grounding"].exact_agreement) == (0, None)
    c = metrics.critical_agreement(human, judge).first()
    assert (c.missed, c.human_critical, c.recall, c.exact_agreement) == (1, 1, 0.0, 0.0)


def test_kappa_by_hand(spark):
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (2, 0), (1, 1)]
    make = lambda k: spark.createDataFrame([(str(i), p[k], 0, 0, 0, True) for i, p in enumerate(pairs)], SCORES)
    seen = sum(abs(a - b) for a, b in pairs) / 6
    chance = sum(abs(a - b) for a, _ in pairs for _, b in pairs) / 36
    got = {r.dimension: r.weighted_kappa for r in metrics.agreement(make(0), make(1)).collect()}
    assert got["correctness"] == pytest.approx(1 - seen / chance) and got["grounding"] is None


def test_pass_rule_and_blank_ratings(spark):
    raw = spark.createDataFrame([("a", "2", "1", "1", "2", "false"), ("b", "0", "2", "2", "2", "false"), ("c", "2", "2", "2", "2", "true"), ("d", "", "2", "2", "2", "")], "rating_id string, correctness string, grounding string, usefulness string, routing_privacy string, critical_failure string")
    typed = metrics.typed_ratings(raw)
    assert {r.rating_id: r.p for r in typed.select("rating_id", metrics.overall_pass().alias("p")).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert metrics.complete(typed).count() == 3
    with pytest.raises(ValueError):
        metrics.fresh_report(typed, 4)


def test_gold_is_required_and_training_is_guarded(spark):
    with pytest.raises(ValueError):
        metrics.joined_gold(spark.createDataFrame([("1",)], "k string"), spark.createDataFrame([("2",)], "k string"), "k")
    with pytest.raises(ValueError):
        classify.train_guard(spark.createDataFrame([("test",)], "split string"))


def test_classifier_learns_two_words(spark):
    rows = [(i, "red apple fruit" if i % 2 else "blue sky weather", "a" if i % 2 else "b", "dev") for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, text string, label string, split string")
    got = classify.IntentClassifier(docs).predict(docs).join(docs, "id")
    assert got.where("intent <> label").count() == 0


def test_tfidf_ranks_ties_by_id(spark):
    docs = spark.createDataFrame([(1, "common word"), (2, "rare thing here"), (3, "rare thing here"), (4, "")], "id long, text string")
    top = retrieval.TfIdf.fit(docs).top_k(spark.createDataFrame([(7, "rare thing here")], "id long, text string"), 3).orderBy("rank").collect()
    assert [(r.id, round(r.similarity, 9)) for r in top] == [(2, 1.0), (3, 1.0)]


@pytest.mark.parametrize("shard, group", [(50, 40), (10**6, 10**6), (30, 10**6)])
def test_top_k_in_cells_is_brute_force(spark, monkeypatch, shard, group):
    """Queries are as many as documents; shards and groups of a few rows each."""
    monkeypatch.setattr(retrieval, "SHARD", shard)
    monkeypatch.setattr(retrieval, "GROUP", group)
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 4)).round(1)
    x[20:30] = x[20]
    x[5] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0])]
    items = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {(t.query, t.rank): t.id for t in retrieval.dense_top_k(items.where("id % 3 = 0"), items, 4).collect()}
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    for q in range(0, 60, 3):
        if q != 5:
            best = sorted((i for i in range(60) if i not in (q, 5)), key=lambda i: (-round(float(unit[i] @ unit[q]), 9), i))[:4]
            assert [got[q, k + 1] for k in range(4)] == best
    words = [" ".join(np.char.add(r.choice(list("abcdefgh"), 6), "x")) + " common" for _ in range(40)] + ["common", "common"]
    docs = spark.createDataFrame(list(enumerate(words)), "id long, text string").repartition(3)
    space = retrieval.TfIdf.fit(docs)
    vectors = {t.id: {y.t: y.w for y in t.v} for t in space.weights.collect()}
    top = {(t.query, t.rank): t.id for t in space.top_k(docs, 3).collect()}
    for q, v in vectors.items():
        best = sorted(vectors, key=lambda i: (-round(sum(w * vectors[i].get(t, 0) for t, w in v.items()), 9), i))[:3]
        assert [top[q, k + 1] for k in range(3)] == best
    keyed = docs.withColumn("id", F.struct(F.lit(1).alias("a"), (100 - F.col("id")).alias("b")))
    other = {(t.query.b, t.rank): t.id.b for t in retrieval.TfIdf.fit(keyed).top_k(keyed, 3).collect()}
    for q, v in vectors.items():
        best = sorted(vectors, key=lambda i: (-round(sum(w * vectors[i].get(t, 0) for t, w in v.items()), 9), -i))[:3]
        assert [100 - other[100 - q, k + 1] for k in range(3)] == best
    assert space.top_k(docs.limit(0), 3).collect() == []


def test_shards_below_the_threshold_are_left_out_and_frequent_lists_unread(spark, monkeypatch):
    """Texts of their own words: a shard without them cannot reach a query's threshold, and gets no cell."""
    monkeypatch.setattr(retrieval, "SHARD", 200)
    texts = [f"own{i // 4} word{i // 4} and{i // 4} the the of" for i in range(200)]
    space = retrieval.TfIdf.fit(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), ngrams=1)
    cells, plain = [], retrieval._sparse
    monkeypatch.setattr(retrieval, "_sparse", lambda asked, items, k: cells.append(asked.count()) or plain(asked, items, k))
    got = space.top_k(spark.createDataFrame([(i, texts[i]) for i in range(0, 200, 10)], "id long, text string"), 1)
    assert {(r.query, r.id) for r in got.collect()} == {(i, i // 4 * 4) for i in range(0, 200, 10)}
    assert cells[0] == 20 and cells[1] <= 20 * 4


def test_term_counts_are_those_of_the_words(spark):
    import re
    from collections import Counter

    texts = [None, "", "a", "ab", "ab ab cd", "Ab ab\ncd ab, ab cd x yz", "é_1 é_1 " * 30]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", retrieval.term_counts(F.col("text")).alias("v")).collect()
    for r in got:
        w = re.findall(r"\b\w\w+\b", (texts[r.id] or "").lower())
        assert {x.term: x.tf for x in r.v} == Counter(w) + Counter(" ".join(p) for p in zip(w, w[1:]))


def test_evidence_keeps_its_order(spark):
    cited = spark.createDataFrame([("q", ["b", "zz", "a"]), ("r", [])], "id string, evidence_ids array<string>")
    history = spark.createDataFrame([("a", "A"), ("b", "B")], "evidence_id string, text string")
    got = {r.id: [e.evidence_id for e in r.evidence] for r in threads.resolve_evidence(cited, history).collect()}
    assert got == {"q": ["b", "a"], "r": []}


def test_model_chain_and_fallback():
    assert modelcall.model_chain("m3, m2", ("m1", "m2")) == ["m3", "m2", "m1"]
    with pytest.raises(ValueError):
        modelcall.model_chain("bad name", ())
    log = []

    def client(model, body):
        log.append(model)
        if model == "a":
            raise modelcall.CallError(503, "retry in 2s")
        return {"x": 1}, {"model": model}

    waits = []
    assert modelcall.call_one(client, ["a", "b"], "", sleep=waits.append)[:2] == ({"x": 1}, "b")
    assert log == ["a", "a", "a", "b"] and waits == [2.0, 2.0]
    assert modelcall.call_one(lambda m, b: (_ for _ in ()).throw(modelcall.CallError(404)), ["a"], "")[2]


def test_calls_fail_into_rows(spark):
    def client(model, body):
        if "bad" in body:
            raise ValueError("no")
        return modelcall.offline_stub(model, body)

    asked = modelcall.with_fingerprint(spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "good")], "id string, body string"), "m")
    out = modelcall.call_misses(asked, client, ["m"], partitions=2)
    assert out.count() == 2 and out.where("api_error is not null and parsed is null").count() == 1


def test_batched_answers_have_exact_ids(spark):
    def client(model, body):
        answer, meta = modelcall.offline_batch_stub(model, body)
        ids = [r["id"] for r in answer["results"]]
        if "b3" in ids:
            answer["results"][0]["id"] = "unknown"
        elif "b5" in ids:
            answer["results"].append(answer["results"][0])
        return answer, meta

    asked = spark.createDataFrame([(f"b{i}", f"body {i}") for i in range(9)], "id string, body string")
    out = {r.id: r for r in modelcall.call_batches(asked, client, ["m"], 2, partitions=3).collect()}
    assert len(out) == 9 and {i for i, r in out.items() if r.api_error} == {"b2", "b3", "b4", "b5"}
    assert all((r.parsed is None) == (r.api_error is not None) for r in out.values())
    for wrong in (None, {"results": "x"}, {"results": [{"id": "a"}, {"id": "a"}]}, {"results": [{"id": "a"}]}):
        with pytest.raises(ValueError):
            modelcall.exact_answers(["a", "b"], wrong)


def test_a_run_is_recovered(spark):
    packet = spark.createDataFrame([(f"i{i}", i, f"body {i}") for i in range(25)], "id string, ord int, body string")
    accepted = spark.createDataFrame([(f"i{i}", "{}", "m") for i in range(11)], "id string, parsed string, model string")
    out = modelcall.recover(packet, accepted, modelcall.offline_batch_stub, ["m"]).orderBy("ord").collect()
    assert [r.id for r in out] == [f"i{i}" for i in range(25)] and [r.recovered for r in out] == [i >= 11 for i in range(25)]
    for bad in (accepted.union(accepted.limit(1)), spark.createDataFrame([("zz", "{}", "m")], "id string, parsed string, model string")):
        with pytest.raises(ValueError):
            modelcall.recover(packet, bad, modelcall.offline_batch_stub, ["m"])


def test_judge_scores_are_typed(spark):
    good = {"correctness": 2, "grounding": 1, "usefulness": 0, "routing_privacy": 2, "critical_failure": False, "rationale": "r"}
    rows = [good, good | {"correctness": 2.0}, good | {"grounding": "1"}, good | {"usefulness": 3}, good | {"critical_failure": 0}, good | {"routing_privacy": True}, {k: v for k, v in good.items() if k != "grounding"}]
    answers = spark.createDataFrame([(str(i), json.dumps(x, sort_keys=True), None) for i, x in enumerate(rows)] + [("e", None, "HTTP 500")], "id string, parsed string, api_error string")
    got = {r.rating_id: r for r in modelcall.judge_scores(answers).collect()}
    assert got["0"].correctness == 2 and got["0"].critical_failure is False and got["0"].api_error is None
    assert all(got[str(i)].correctness is None and got[str(i)].api_error == "invalid judge scores" for i in range(1, 7)) and got["e"].api_error == "HTTP 500"
    items = spark.createDataFrame([("a", "m", "d", "escalate", [])], "rating_id string, message string, draft string, route string, evidence array<string>")
    one = modelcall.judge(items, modelcall.offline_judge, ["m"], "rubric").first()
    assert one.api_error is None and one.correctness in (0, 1, 2)


def test_secrets_never_show(spark):
    secret = "s3cret-key"
    assert secret not in str(modelcall.CallError(403, "x" * 380 + secret, (secret,))) and len(str(modelcall.CallError(403, "y" * 900))) == 400

    def client(model, body):
        raise ValueError(f"bad key {secret}")

    asked = modelcall.with_fingerprint(spark.createDataFrame([("1", "x")], "id string, body string"), "m")
    error = modelcall.call_misses(asked, client, ["m"], 1, secrets=(secret,)).first().api_error
    assert secret not in error and "[redacted]" in error


def test_pages_and_the_next_open_row(spark):
    paged = threads.pages(spark.range(45), "id")
    assert {(r.page, r.place) for r in paged.where("id in (0, 19, 20, 44)").collect()} == {(0, 1), (0, 20), (1, 1), (2, 5)}
    rows = spark.createDataFrame([(1, False), (2, True), (3, None), (4, True)], "n int, done boolean")
    assert threads.next_open(rows, 1).first().n == 3 and threads.next_open(rows, 3).first().n == 1
    assert threads.next_open(rows.where("done"), 0).collect() == []


def test_fresh_candidates(spark):
    rows = [(1, None, True, "a b c d", 1), (2, 1, False, "x", 1), (3, None, True, "a b", 2), (4, 3, False, "x", 2), (5, None, True, "a b c d e", 3), (6, 5, False, "x", 3), (7, None, True, "never answered at all", 4), (8, None, True, None, None)]
    table = spark.createDataFrame(rows, "id long, parent_id long, inbound boolean, text string, component_id long")
    of = lambda *c: spark.createDataFrame([(x,) for x in c], "component_id long")
    assert [tuple(r) for r in threads.fresh_candidates(table, [of(99)], of(3)).collect()] == [(1, 1)]
    assert threads.fresh_candidates(table, [of(1), of(2)], of(3)).collect() == []


def test_a_packet_is_made_again(spark):
    items = [
        ("r1", "model", "1", "The app stops", None, "auto_handle", "fine", "old!!", False, [("e1", "t"), ("e2", "u")]),
        ("r2", "trivial", "2", "I was charged twice", None, "escalate", "", "old", False, []),
        ("r3", "simple", "3", "hello there", None, "auto_handle", "", "Good  day!! /TB", False, [("e1", "t")]),
        ("r4", "model", "4", "The app stops", None, "auto_handle", "fine", "old", False, [("e1", "t")]),
    ]
    kinds = "rating_id string, system string, id string, message string, intent string, route string, reason string, draft string, context_flagged boolean, evidence array<struct<id:string,text:string>>"
    raw = [("1", "playback_app", "auto_handle", "fine", "Which device?", ["e2"], "clarification"), ("4", "playback_app", "auto_handle", "fine", "We've issued a refund", ["e1"], "answer")]
    raw = spark.createDataFrame(raw, "id string, intent string, route string, reason string, draft string, evidence_ids array<string>, reply_kind string")
    packet, key, changes = gate.packet_again(spark.createDataFrame(items, kinds), raw)
    source = {r.rating_id: r.source_rating_id for r in key.collect()}
    got = {source[r.rating_id]: r for r in packet.collect()}
    assert len(source) == 4 and "system" not in packet.columns
    assert got["r1"].draft == "Which device?" and [e.id for e in got["r1"].evidence] == ["e2"]
    assert "privately" in got["r2"].draft and got["r3"].draft == "Good day!" and got["r4"].route == "escalate" and not got["r4"].evidence
    edits = {source[r.rating_id]: r.adjustments for r in changes.collect()}
    assert edits["r2"] == ["generic baseline handoff"] and "safety gate" in edits["r4"] and set(edits) == {"r1", "r2", "r3", "r4"}


def test_stores(spark, tmp_path):
    events = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "z", 2)], "k string, v string, updated_at int")
    assert {r.k: r.v for r in stores.latest(events, "k").collect()} == {"a": "y", "b": "z"}
    path = str(tmp_path / "manifest")
    stores.freeze(spark, path, {"model": "m", "n": 1}, ("model",))
    stores.freeze(spark, path, {"model": "m", "n": 2}, ("model",))
    with pytest.raises(ValueError):
        stores.freeze(spark, path, {"model": "other"}, ("model",))
    target = str(tmp_path / "table")
    stores.publish(spark.range(3), target)
    stores.publish(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5 and spark.read.parquet(target + ".bak").count() == 3


def _written(monkeypatch):
    """All tables that similarity writes, by name."""
    seen, plain = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1])
    return seen


def test_whole_sets_are_made_for_candidates_only(spark, monkeypatch):
    seen = _written(monkeypatch)
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(200)]
    rows = [*enumerate(texts), (300, texts[7] + " more"), (301, texts[7] + " other")]
    classes = similarity.similar_classes(spark.createDataFrame(rows, "id long, text string"))
    assert {(r.a, r.b) for r in classes.pairs.collect()} == {(7, 300), (7, 301), (300, 301)}
    assert sum(df.count() for _, df in seen if "grams" in df.columns) == 3


@pytest.mark.parametrize("frequent,shared", [(1, 1), (500_000, 100)])
def test_no_order_of_grams_and_no_early_bound_loses_pairs(spark, monkeypatch, frequent, shared):
    monkeypatch.setattr(similarity, "FREQUENT", frequent)
    monkeypatch.setattr(similarity, "SHARED", shared)
    rows = _texts(60, 5)
    docs = spark.createDataFrame(rows, "id long, text string")
    found = similarity.similar_classes(docs)
    member = {r.id: r.class_id for r in found.members.collect()}
    between = {(r.a, r.b) for r in found.pairs.collect()}
    assert between == {(a, b) for a, b in _brute(rows) if member[a] == a and member[b] == b}
    both = [(i, t) for i, t in rows if i % 2], [(i, t) for i, t in rows if i % 2 == 0]
    near = {a for a, b in _brute(rows) if a % 2 > b % 2} | {b for a, b in _brute(rows) if b % 2 > a % 2}
    assert {r.id for r in similarity.similar_ids(*(spark.createDataFrame(x, "id long, text string") for x in both)).collect()} == near


def test_first_of_a_greedy_selection_looks_at_low_ranks_first(spark, monkeypatch):
    tried, plain = [], similarity.greedy_dedupe
    monkeypatch.setattr(similarity, "greedy_dedupe", lambda docs, ranks, percent: tried.append(docs.count()) or plain(docs, ranks, percent))
    rows = [(i, " ".join(f"w{max(i, 14)}x{k}" for k in range(9)), i) for i in range(400)]  # the first fifteen are copies
    got = similarity._first(spark.createDataFrame(rows, "id long, text string, rank int"), 2, 80)
    assert [r.id for r in got.orderBy("rank").collect()] == [0, 15] and tried == [12, 48]


def test_overlap_with_a_small_table_writes_no_table_of_the_large_one(spark, monkeypatch):
    seen = _written(monkeypatch)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x c d e y"), (3, "b c x d"), (4, "q r"), (5, None)], "id long, text string")
    bench = spark.createDataFrame([(1, "c d e f"), (2, "Q r!"), (3, "C d e g")], "id long, text string")
    assert sorted(r.id for r in similarity.overlapping(docs, bench).collect()) == [1, 2, 4]
    assert [(name, df.count()) for name, df in seen] == [("known", 4)]


def test_predictions_are_sums_over_no_gathered_vectors(spark, monkeypatch):
    rows = [(i, ("cold rain " if i % 2 else "warm sun ") * (i % 3 + 1) + f"word{i % 5}", "wet" if i % 2 else "dry", "dev") for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, text string, label string, split string")
    model = classify.IntentClassifier(docs)
    asked = docs.select("id", "text").union(spark.createDataFrame([(90, "nothing known"), (91, None)], "id long, text string"))
    vectors = {r.id: [(x.t, x.w) for x in r.v] for r in model.space.transform(asked).collect()}
    pull = {r.t: r.pull for r in model.pull.collect()}
    monkeypatch.setattr(retrieval.TfIdf, "_weigh", None)
    for r in model.predict(asked).collect():
        z = [b + sum(w * pull[t][k] for t, w in vectors.get(r.id, [])) for k, b in enumerate(model.start)]
        assert r.intent == model.classes[int(np.argmax(z))] and abs(r.confidence - 1 / sum(np.exp(x - max(z)) for x in z)) < 1e-9


@pytest.mark.parametrize("ngrams, asked_terms, buckets", [(2, 10**6, (20, 60)), (1, 10**6, (10**6, 10**6)), (2, 0, (20, 60))])
def test_open_space_is_brute_force_in_slices_and_buckets(spark, monkeypatch, ngrams, asked_terms, buckets):
    """Few terms of queries or too many to broadcast; several buckets, and slices of a few texts."""
    import re
    from collections import Counter
    from math import log, sqrt

    monkeypatch.setattr(retrieval, "ASKED_TERMS", asked_terms)
    monkeypatch.setattr(retrieval, "BUCKET", buckets)
    monkeypatch.setattr(retrieval, "SLICE_WORDS", 25)
    r = np.random.default_rng(5)
    texts = [" ".join(np.char.add(r.choice(list("abcdefghij"), r.integers(1, 14)), "x")) + " the the" * (i % 3) for i in range(50)] + [None, "", "a b", "own words " * 60, "ax ax ax"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    asked = spark.createDataFrame([(100, "ax bx cx"), (101, "the the ax, unseen bx"), (102, "unseen"), (103, None), (104, "own words own")], "id long, text string")

    def counts(text):
        w = [x for x in re.findall(r"\w+", (text or "").lower()) if len(x) > 1]
        return Counter(w + [" ".join(p) for p in zip(w, w[1:])] * (ngrams - 1))

    df = Counter(t for x in texts for t in counts(x))
    vector = lambda x: {t: (1 + log(n)) * (log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in counts(x).items() if t in df}
    unit = lambda v: {t: w / sqrt(sum(y * y for y in v.values())) for t, w in v.items()}
    known = {i: unit(vector(x)) for i, x in enumerate(texts)}
    want = []
    for q, text in ((r.id, r.text) for r in asked.collect()):
        v = unit(vector(text))
        near = sorted((-round(sum(w * known[i].get(t, 0) for t, w in v.items()), 9), i) for i in known)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near[:4]) if s < 0]
    space = retrieval.TfIdf.fit(docs, ngrams)
    got = sorted((t.query, t.rank, t.id, round(t.similarity, 9)) for t in space.top_k(asked, 4).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 1e-8 for x, y in zip(got, want, strict=True))
    assert {t.id: round(t.norm, 9) for t in space.norms.collect()} == {i: round(sqrt(sum(w * w for w in vector(x).values())), 9) for i, x in enumerate(texts) if counts(x)}


def test_open_space_writes_only_terms_that_queries_hold(spark, monkeypatch):
    seen, plain = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df, name: seen.append((name, out := plain(df, name))) or out)
    docs = spark.createDataFrame([(i, f"shared word{i} " + " ".join(f"own{i}x{k}" for k in range(40))) for i in range(30)], "id long, text string")
    asked = spark.createDataFrame([(1, "shared word3 other"), (2, "word9")], "id long, text string")
    got = retrieval.TfIdf.fit(docs).top_k(asked, 2)
    assert {(r.query, r.rank): r.id for r in got.collect()} == {(1, 1): 3, (1, 2): 0, (2, 1): 9}
    terms = {name: sum(len(r.v) for r in df.collect()) for name, df in seen if "v" in df.columns}
    assert terms == {"asked": 6, "weights": 30 + 2 + 1, "queries": 3 + 1}
    assert max(df.count() for _, df in seen) == 30
