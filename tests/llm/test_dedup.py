"""Dedup operators against brute force: near copies, exact copies, lines, passages."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from threadloom.llm import exact_dedup, line_dedup, minhash, substring_dedup
from threadloom.llm.components import components
from threadloom.llm.cuckoo import CuckooFilter

from ..conftest import DATA

DOCS = "doc_id long, text string"
SPACE = "[^\x20\x09-\x0d]+"


def words(text):
    return re.findall(SPACE, text or "")


def near_texts(n, seed=1):
    """Groups of near copies whose similarities lie on both sides of the threshold."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(60)] for _ in range(3)]
    out = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice((0, 1, 1, 2, 3, 4))):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        out.append((i, (" " if i % 2 else "\n").join(t)))
    more = [None, "", " \t", "one two", "ONE two", "one", "a b c d e", "a b c d f"]
    return [*out, *((n + k, t) for k, t in enumerate(more))]


def brute_components(rows, percent):
    sets = {}
    for i, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block, size", [(1024, 8 << 20), (8, 8 << 20), (1024, 2000)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block, size):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    rows = near_texts(60)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 85)


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS), 85).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], DOCS).selectExpr("*", "1 as bucket", "'x' as component")
    got = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(odd, 85).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 2), (None, None)]


def test_several_texts_of_one_id(spark):
    """Each text of an id is looked at: the id links what its texts link, though one of them is an exact copy of another document."""
    a, b = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    rows = [(5, a), (5, b), (3, a), (9, b + " more"), (7, "q w e r t y"), (7, None)]
    got = sorted({(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 85).collect()})
    assert got == [(3, 3), (5, 3), (7, 7), (9, 3)]


def test_recall_on_the_tables_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 80).collect()} == want


def test_blocks_find_links_between_components():
    r = random.Random(5)
    base = [f"t{k}" for k in range(80)]
    texts = []
    for _ in range(14):
        t = list(base)
        for _ in range(r.randrange(4)):
            t[r.randrange(80)] = f"x{r.randrange(999)}"
        texts.append(" ".join(t))
    batch = pa.RecordBatch.from_arrays([pa.array(range(14), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    feats = next(minhash._features(iter([batch]))).to_pylist()
    short = next(minhash._short_sets(iter([batch]))).to_pylist()
    bucket = feats[0]["bands"][0]
    rows = [(bucket, 0, 0, asks, i, i, i != 0, short[i]["size"], feats[i]["sig"], feats[0]["keys"], short[i]["short"]) for asks in (False, True) for i in range(14) if not asks or i]
    names = ["bucket", "block", "chunk", "asks", "doc_id", "component", "outside", "size", "sig", "keys", "short"]
    block = pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows]) for k in range(len(names))], names=names)
    links = next(minhash._links(minhash.least_agreement(0.85), 85)(iter([block]))).to_pylist()
    want = brute_components(list(enumerate(texts)), 85)
    root = {i: i for i in range(14)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in links:
        a, b = find(x["u"]), find(x["v"])
        root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in range(14)} == {i: c for i, (_, c) in want.items()}


def test_components_by_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (50, 51), (51, 50), (60, 60), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 0, 50: 50, 51: 50}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rows_without_a_rival_join_nothing(spark):
    """Texts that their prefix tells apart have no digest, and must not meet in the task of the missing one."""
    rows = [(i, f"{i} stands alone") for i in range(3000)] + [(5000 + i, "copies " * 5 + str(i // 2)) for i in range(60)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("false", "-1", "8"), strict=True):
            spark.conf.set(k, v)
        got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS).repartition(6))
        parts = got.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 1200 and sum(r["count"] for r in parts) == 3060
        assert got.where("group_size = 2 and text_sha256 is not null").count() == 60 and got.where("text_sha256 is null and kept and group_size = 1").count() == 3000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_exact_duplicates(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (4, None), (5, ""), (6, " "), (7, "abc"), (None, "q"), (8, "q"), (9, "x" * 500), (10, "x" * 499 + "y"), (11, "\x0b\x0c x" + "x" * 499)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' as sha", "1 as n")
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, hash_all=True).collect()}
    want = {}
    for i, text in rows:
        want.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), i is None, i))
    for normal, group in want.items():
        keep = min(group, key=lambda g: (g[0], g[1], g[2] or 0))[2]
        for _, _, i in group:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), i == keep)
            assert r.text_sha256 == hashlib.sha256(normal.encode()).hexdigest()
    unhashed = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_duplicates(docs).collect()}
    assert unhashed[7] is None and unhashed[1] and unhashed[9]
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []


def test_hot_digests_are_met_by_a_broadcast(spark, monkeypatch):
    rows = [(i, "the same text") for i in range(40)] + [(i, f"own {i // 2}") for i in range(100, 120)] + [(200, None)]
    plain = sorted(map(tuple, exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS)).collect()))
    monkeypatch.setattr(exact_dedup, "HOT", 10)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS)).collect())) == plain
    assert [r[:4] for r in plain if r[0] in (0, 39, 101, 200)] == [(0, 0, 40, True), (39, 0, 40, False), (101, 100, 2, False), (200, 200, 1, True)]


def brute_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


LINES = [
    (5, "Shared line here\nown line of five\nshort"), (2, "shared LINE here \nown line of two\nshort\n"), (9, "\tShared line here\nShared line here\nown line of five"),
    (7, None), (8, ""), (4, "ééééééééé\nÉéééééééééé"), (3, "Éééééééééé"), (1, "last line alone"),
]


def test_line_dedup(spark):
    got = line_dedup.dedup_lines(spark.createDataFrame(LINES, DOCS).selectExpr("*", "1 as drop", "2 as shard"))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == brute_lines(LINES)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("shard_keys, few", [(1 << 18, 10), (2, 10), (2, 0)])
def test_line_filters_are_used_by_shards_and_in_groups(spark, monkeypatch, shard_keys, few):
    """However many shards there are, filters tell unique lines; a shard with a very frequent line is dealt over groups."""
    monkeypatch.setattr(line_dedup, "PROBE_ROWS", 3)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(line_dedup, "FEW_SHARDS", few)
    got = line_dedup.dedup_lines(spark.createDataFrame(LINES, DOCS))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == brute_lines(LINES)
    rows = [(i, f"the line that all have\nunique line number {i}\npair of lines {i // 2}") for i in range(120)]
    index = line_dedup.LineIndex(spark)
    index.add(spark.createDataFrame(rows, DOCS), "all")
    last = index.commits()[-1]
    keys = index._keys_of(None, "all")
    probed = index._probed(keys, last.shards, index._stored(last.filters))
    assert keys.count() == 360 and 240 <= probed.count() <= 250
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in index.dedup(spark.createDataFrame(rows, DOCS)).collect()} == brute_lines(rows)
    with pytest.raises(ValueError):
        index.drops(spark.createDataFrame(rows, DOCS), "unknown batch")


def test_line_index_can_be_undone(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    a, b = spark.createDataFrame(LINES[:4], DOCS), spark.createDataFrame(LINES[4:] + [(0, "own line of two\nshared line here")], DOCS)
    index = line_dedup.LineIndex(spark)
    index.add(a, "a")
    first = sorted(map(tuple, index.counts().collect()))
    index.add(b, "b")
    index.add(b, "b")
    both = {r.doc_id: r.text for r in index.dedup(a).collect()}
    assert both[2] == "short\n" and both[5] == "own line of five\nshort"
    # Opened again by its path, as another process would: the batch is known, the state is there.
    again = line_dedup.LineIndex(spark, index.path)
    again.add(b, "b")
    assert [c.batch_id for c in again.commits()] == ["a", "b"]
    assert {r.doc_id: r.text for r in again.dedup(a).collect()} == both
    again.remove(spark.createDataFrame([(99, "shared line here\nnever added before")], DOCS), "nothing")
    assert {r.doc_id: r.text for r in again.dedup(a).collect()} == both
    again.remove(b, "undo b")
    assert sorted(map(tuple, index.counts().collect())) == first
    assert {r.doc_id: r.text for r in index.dedup(a).collect()} == {i: t for i, (_, _, t) in brute_lines(LINES[:4]).items()}


def test_line_index_keeps_up_with_many_batches(spark, monkeypatch):
    """Inserts and deletions in random batches; filters are changed in place, grow and are made anew."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    r = random.Random(11)
    text = lambda: "\n".join(f"a line of number {r.randrange(60)}" for _ in range(r.randrange(6)))
    index, held = line_dedup.LineIndex(spark), {}
    for k in range(5):
        if k in (2, 4):
            gone = r.sample(sorted(held), 12)
            index.remove(spark.createDataFrame([(i, held.pop(i)) for i in gone], DOCS), f"batch {k}")
        else:
            new = {100 * k + i: text() for i in range(30)}
            held |= new
            index.add(spark.createDataFrame(list(new.items()), DOCS), f"batch {k}")
        got = {x.doc_id: x.text for x in index.dedup(spark.createDataFrame(list(held.items()), DOCS)).collect()}
        assert got == {i: t for i, (_, _, t) in brute_lines(list(held.items())).items()}
        shared = {x.key_lo for x in index.counts().where("refs > 1").collect()}
        done = index.commits()[-1]
        assert done.keys == len(shared)
        filters = {x.shard: CuckooFilter.from_bytes(x.filter) for x in index._stored(done.filters).collect()}
        assert sum(int(np.count_nonzero(f.table)) for f in filters.values()) == len(shared)


def test_an_index_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    index = line_dedup.LineIndex(spark)
    assert [r.text for r in index.dedup(spark.createDataFrame([(1, "a line that is long")], DOCS)).collect()] == ["a line that is long"]
    index.remove(spark.createDataFrame(LINES, DOCS), "r")
    index.add(empty, "e")
    assert index.counts().collect() == [] and index.dedup(empty).collect() == []


def test_rewriting_keeps_nulls_and_columns_of_any_name(spark):
    docs = spark.createDataFrame(LINES, DOCS).selectExpr("*", "1 as line_id", "2 as drop", "3 as LINE_DROP", "null as n", "'x' as id_", "'y' as drop_").withColumn("n", F.lit(None).cast("int"))
    index = line_dedup.LineIndex(spark)
    index.add(docs, "all")
    out = index.rewrite(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got.pop(7) is None and got == {i: t for i, (_, _, t) in brute_lines(LINES).items() if i != 7}
    assert out.where("drop <> 2 or line_id <> 1 or LINE_DROP <> 3 or id_ <> 'x'").isEmpty()


def test_rows_of_one_id_count_as_one_document(spark):
    rows = [(1, "the same long line"), (1, "the same long line"), (None, "the same long line")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert [r.n_dropped for r in got] == [0, 0, 0]


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50_000)
    assert CuckooFilter.of(keys[:1000]).add_all(np.zeros(0, np.int64))
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all()
    assert f.contains(np.random.default_rng(2).integers(0, 1 << 63, 50_000)).mean() < 0.002
    for k in keys[:200].tolist():
        assert f.remove(k)
    assert f.contains(keys[200:]).all() and f.contains(keys[:200]).mean() < 0.05
    assert CuckooFilter.from_bytes(f.to_bytes()).contains(keys[200:]).all()
    assert not CuckooFilter.of(np.zeros(0, np.uint64)).contains(keys[:10]).any()


def brute_repeats(rows, window):
    seen = {}
    for k, (_, text) in enumerate(rows):
        w = words(text)
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((k, i))
    gone = {(k, i + j) for at in seen.values() if len(at) > 1 for k, i in at for j in range(window)}
    return sorted((i, len(words(t)), sum((k, j) in gone for j in range(len(words(t)))), " ".join(x for j, x in enumerate(words(t)) if (k, j) not in gone)) for k, (i, t) in enumerate(rows))


@pytest.mark.parametrize("window", [5, 9, 20, 35])
def test_repeated_passages_match_brute_force(spark, window):
    r = random.Random(window)
    rows = []
    passages = [[r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(60)] for _ in range(4)]
    for i in range(40):
        w = [f"u{r.randrange(40)}" for _ in range(r.randrange(40))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(30)
            w[r.randrange(len(w) + 1) : 0] = p[a : a + r.randrange(3, 50)]
        rows.append((i, "  ".join(w)))
    rows += [(50, "x " * 70), (51, "x y " * 40), (52, "y x " * 30), (53, None), (54, ""), (55, rows[0][1]), (56, "É é " * 3)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as name", "2 as spans").repartition(4), window)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()) == brute_repeats(rows, window)


def test_repeats_in_one_text_and_of_one_row_twice(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (1, " ".join(f"a{i}" for i in range(40))), (None, " ".join(f"b{i % 37}" for i in range(111)))]
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(40, 40), (40, 40), (111, 111)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_a_name_may_go_on_over_batches():
    """The reducer keeps what it has seen of a name when its rows are split between batches."""
    text = " ".join(f"w{i}" for i in range(50))
    part = next(substring_dedup.slices(pa.array([text])))
    rows = [substring_dedup._slice(part, np.array([k]), np.array([k]), 35) for k in (1, 2, 3)]
    table = pa.Table.from_batches(rows).sort_by("name")
    out = pa.Table.from_batches(list(substring_dedup._reduce(35)(iter(table.to_batches(max_chunksize=1))))).to_pylist()
    for k in (1, 2, 3):
        covered = set().union(*(range(r["first"], r["end"]) for r in out if r["id"] == k)) if any(r["id"] == k for r in out) else set()
        assert covered == set(range(50))


def test_a_frequent_phrase_is_divided_by_window(spark, monkeypatch):
    """Nine common words within other words are one anchor of many windows; they go by names of their own, and repeats among them are found all the same."""
    draw = random.Random(8)
    phrase = "we use cookies to make this page work well".split()
    text = lambda k: " ".join([*(f"a{k}x{i}" for i in range(40)), *phrase, *(f"b{k}x{i}" for i in range(40))])
    rows = [(k, text(k)) for k in range(300)] + [(1000 + k, text(draw.randrange(300)) + f" end {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    monkeypatch.setattr(substring_dedup, "ONE_OF", 1)
    assert len(substring_dedup.frequent_anchors(docs)) == 0  # so few are not divided
    plain = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup, "LEAST_WINDOWS", 1000)
    frequent = substring_dedup.frequent_anchors(docs)
    assert 1 <= len(frequent) <= 12
    divided = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(docs).collect()]
    assert divided == plain and sorted(got) == brute_repeats(rows, 35)
    most = lambda known: max(r["count"] for r in substring_dedup._keyed(docs).select("id", "text_hash", "text").mapInArrow(substring_dedup._map(35, known), substring_dedup.ROWS).where("first >= 0").groupBy("name").count().collect())
    assert most(np.zeros(0, np.uint64)) >= 250 and most(frequent) <= 30


def test_a_task_ships_a_repeated_window_once():
    """What a task has found repeated is settled in later slices without being shipped again."""
    hot, texts = substring_dedup._Hot(), pa.array([" ".join(f"w{i}" for i in range(50))] * 2)
    ids = np.arange(2)
    rows = [substring_dedup._slice(next(substring_dedup.slices(texts)), ids + k, ids, 35, hot).to_pylist() for k in (0, 10, 20)]
    assert [sum(r["first"] >= 0 for r in x) > 0 for x in rows] == [True, False, False]
    for x in rows:
        assert sum(r["first"] < 0 for r in x) == 2


def test_windows_of_one_hash_are_told_apart_by_their_words():
    h = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], np.uint64)
    got = substring_dedup.verified(np.array([7, 7, 7], np.uint64), h, np.array([0, 3, 6]), 3)
    assert got[0] == got[1] != got[2]
