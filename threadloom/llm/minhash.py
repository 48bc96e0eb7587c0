"""MinHash near-duplicates: universal hash minima in bands, signature check, exact check, components.

1. Each text becomes its set of distinct five-word shingles (64-bit hashes), 128 minima of universal
   hashes x -> (a*x + b) mod 2**64 and, from them, 32 band keys of four minima each. Equal sets, told
   by a 128-bit BLAKE2b digest of the whole set, are collapsed to their smallest doc_id first, so
   copies make no pairs.
2. Star round: within a band bucket each member is held against the bucket's smallest id only.
   Pairs whose signatures agree far too little are dropped, the rest are confirmed on full sets.
3. Rest round: buckets whose members still lie in several components. Members outside a bucket's
   largest component are held against all its members, in blocks of about ``BLOCK`` by ``BLOCK`` rows and
   ``BLOCK_BYTES`` of their sets (a longer set is in a block of its own size): a
   pair of different components is looked at in the first bucket that it shares, on signatures and
   then on its full sets in 32 bits, which never understates a pair. Only links leave a block, one
   fewer than the components that they join at most, and are confirmed once more on 64 bits. So no
   bucket has a cap, pairs are never expanded, and no link that a band shows is lost.

A pair at the threshold t misses all 32 bands with probability (1 - t**4)**32: 5e-8 at 0.80 and
6e-11 at 0.85. A signature check drops a pair at the threshold with probability below 1e-6.

Defined cases: a null or wordless text has no shingles and is linked with nothing; with fewer than
five words the whole sequence is the one shingle; rows with a null doc_id are returned unlinked;
rows of one doc_id are one node, linked with all that any of their texts is linked with; an empty
table gives no rows. Other columns are not read. Memory follows the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from .components import components
from .core import U64, binary_array, cut, discard, lean, mix, only_ids, slices, words

SHINGLE = 5
ROWS, BANDS = 4, 32
BLOCK, BLOCK_BYTES = 1024, 8 << 20

_RNG = np.random.default_rng(5_0_85)
_A = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=U64) * U64(2) + U64(1)
_B = _RNG.integers(0, 1 << 64, ROWS * BANDS, dtype=U64)
_STEP = _RNG.integers(0, 1 << 63, SHINGLE, dtype=U64) * U64(2) + U64(1)
_ROW = _RNG.integers(0, 1 << 63, ROWS, dtype=U64) * U64(2) + U64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, dtype=U64)

FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>, keys binary"


def shingle_sets(texts) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow array of texts, in order."""
    for part in slices(texts):
        w = words(part)
        h = w.hashes(lower=True)
        n = len(h) - SHINGLE + 1
        if n > 0:
            s = h[:n] * _STEP[0]
            for k in range(1, SHINGLE):
                s += h[k : k + n] * _STEP[k]
            s = mix(s)
        for a, b in zip(w.doc_first[:-1].tolist(), w.doc_first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(s[a : b - SHINGLE + 1])
            elif b > a:
                yield mix((h[a:b] * _STEP[: b - a]).sum(keepdims=True) + U64(b - a))
            else:
                yield np.zeros(0, U64)


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), U64(2**64 - 1))
    for a in range(0, len(s), 1024):
        x = s[a : a + 1024, None] * _A
        x += _B
        np.minimum(out, x.min(axis=0), out=out)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for part in range(0, batch.num_rows, 1000):
            n, low, bands = [], [], []
            for s in shingle_sets(batch.column("text").slice(part, 1000)):
                m = minima(s)
                low.append((m >> U64(40)).astype(np.uint8))
                bands.append(mix((mix(m).reshape(BANDS, ROWS) * _ROW).sum(axis=1) ^ _BAND).view(np.int64) if len(s) else m[:0].view(np.int64))
                n.append((len(s), *np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()))
            sizes = np.array([len(b) for b in bands])
            stat = np.array(n, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(part, 1000),
                    *(pa.array(stat[:, k]) for k in range(3)),
                    binary_array(np.concatenate(low), np.full(len(low), len(_A))),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(bands))),
                    binary_array(np.concatenate(bands).astype(np.uint32), sizes * 4),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "sig", "bands", "keys"],
            )


def features(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_features), FEATURES)


def least_agreement(threshold: float) -> int:
    """Equal bytes of two signatures below which a pair at the threshold is one in a million.

    The bytes come from the fifteen-bit range below the top of each minimum, so two different minima
    agree by chance in one byte of 256, which only raises the count.
    """
    k = len(_A)
    return int(k * threshold - 4.9 * (k * threshold * (1 - threshold)) ** 0.5)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            keep = np.zeros(len(u), bool)
            for i, other in enumerate(shingle_sets(batch.column("text_u"))):
                if v[i] != last:
                    last, mine = v[i], next(shingle_sets(batch.column("text_v").slice(i, 1)))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(mine) + len(other) - both)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("u").take(at), batch.column("v").take(at)], names=["u", "v"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full shingle sets reach percent/100; v is the side that repeats."""
    pairs = cut(pairs, "pairs")
    ids = cut(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "ids")
    texts = cut(only_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ids).dropDuplicates(["doc_id"]), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    out = cut(both.mapInArrow(lean(_confirm(percent)), "u long, v long"), "links")
    for x in (pairs, ids, texts):
        discard(x)
    return out


def _short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        short = [np.unique(x.astype(np.uint32)).tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(short, pa.binary())], names=["doc_id", "size", "short"])


def _links(least: int, percent: int):
    """Links between components within one block of one bucket; rows come sorted by block."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        _, _, _, asks, ids, comp, out, size, sig, keys, short = (list(x) for x in zip(*rows, strict=True))
        bucket = rows[0][0] & 0xFFFFFFFF
        every, queries = [i for i, q in enumerate(asks) if not q], [i for i, q in enumerate(asks) if q]
        if not every or not queries:
            return
        sigs = np.stack([np.frombuffer(sig[i], np.uint8) for i in every])
        bands = np.stack([np.frombuffer(keys[i], np.uint32) for i in every])
        n, c, d = (np.array([x[i] for i in every]) for x in (size, comp, ids))
        outside = np.array([out[i] for i in every])
        sets = [None] * len(every)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        for q in queries:
            agree = (sigs == np.frombuffer(sig[q], np.uint8)).sum(axis=1)
            ok = (c != comp[q]) & (agree >= least) & (100 * np.minimum(n, size[q]) >= percent * np.maximum(n, size[q])) & (~outside | (d < ids[q]))
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            same = bands[at] == np.frombuffer(keys[q], np.uint32)
            first = bands[at, same.argmax(axis=1)]
            at = at[same.any(axis=1) & (first == bucket)]
            mine = np.frombuffer(short[q], np.uint32)
            for i in at[np.argsort(-agree[at], kind="stable")].tolist():
                a, b = find(comp[q]), find(int(c[i]))
                if a == b:
                    continue
                if sets[i] is None:
                    sets[i] = np.frombuffer(short[every[i]], np.uint32)
                both = len(np.intersect1d(mine, sets[i], assume_unique=True)) + size[q] - len(mine)
                if 100 * both >= percent * (size[q] + int(n[i]) - both):
                    root[max(a, b)] = min(a, b)
                    yield max(ids[q], int(d[i])), min(ids[q], int(d[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        names = ["bucket", "block", "chunk", "asks", "doc_id", "component", "outside", "size", "sig", "keys", "short"]
        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if r[:3] != key:
                    if rows:
                        out.extend(links(rows))
                    key, rows = r[:3], []
                rows.append(r)
        if rows:
            out.extend(links(rows))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _rest(placed: DataFrame, feats: DataFrame, docs: DataFrame, least: int, percent: int) -> DataFrame:
    """Links that the star round had not looked for, from placed (bucket, n, doc_id, component)."""
    sizes = placed.where("n > 2").groupBy("bucket", "component").agg(F.count("*").alias("m"), (F.sum("size") * 4).alias("b"))
    main = F.max(F.struct("m", (-F.col("component")).alias("c"), "b")).alias("main")
    open_ = sizes.groupBy("bucket").agg(main, F.sum("m").alias("n"), F.sum("b").alias("b"), F.count("*").alias("k")).where("k > 1")
    parts = lambda n, b: F.greatest(F.ceil(n / BLOCK), F.ceil(b / BLOCK_BYTES))
    open_ = open_.select("bucket", (-F.col("main.c")).alias("main"), parts(F.col("n"), F.col("b")).alias("chunks"), parts(F.col("n") - F.col("main.m"), F.col("b") - F.col("main.b")).alias("blocks"))
    rest = placed.drop("n", "size").join(open_, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    rest = cut(rest.select("bucket", "doc_id", "component", "outside", "chunks", "blocks"), "rest")
    ids = cut(rest.select("doc_id").distinct(), "ids")
    n = ids.count()
    texts = only_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ids, n=n)
    short = texts.mapInArrow(lean(_short_sets), "doc_id long, size long, short binary").dropDuplicates(["doc_id"])
    known = cut(only_ids(feats.select("doc_id", "sig", "keys"), ids, n=n).dropDuplicates(["doc_id"]).join(short, "doc_id"), "known")
    discard(ids)
    h = F.xxhash64("doc_id")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    every = rest.select("bucket", F.explode(upto("blocks")).alias("block"), F.pmod(h, "chunks").alias("chunk"), F.lit(False).alias("asks"), "doc_id", "component", "outside")
    asking = rest.where("outside").select("bucket", F.pmod(h, "blocks").alias("block"), F.explode(upto("chunks")).alias("chunk"), F.lit(True).alias("asks"), "doc_id", "component", "outside")
    rows = every.union(asking).join(known, "doc_id").repartition("bucket", "block", "chunk").sortWithinPartitions("bucket", "block", "chunk")
    out = cut(rows.mapInArrow(lean(_links(least, percent)), "u long, v long").distinct(), "more")
    for x in (rest, known):
        discard(x)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), one row for each row of docs.

    Texts are linked if 100 * |A & B| >= percent * |A | B| of their shingle sets; component_id is the
    smallest doc_id reachable over links. See the module's text for nulls, short texts and ties.
    """
    feats = cut(features(docs), "features")
    sets = feats.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n_shingles", "d1", "d2")).alias("a"), F.max(F.struct("n_shingles", "d1", "d2")).alias("b"))
    if sets.where("a <> b").isEmpty():
        comp = _components(feats, docs, percent)
    else:
        comp = _components_of_texts(docs, percent)
    out = feats.select("doc_id", "n_shingles").join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _components_of_texts(docs: DataFrame, percent: int) -> DataFrame:
    """(node, component) of doc_ids some of which have several texts: each text is a node, numbered in the order of ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").withColumn("mark", F.sha2(F.coalesce("text", F.lit("")), 256))
    nodes = cut(numbered(rows.groupBy("id", "mark").agg(F.lit(1).alias("one")).drop("one"), "id", "mark", name="doc_id"), "nodes")
    texts = cut(rows.groupBy("id", "mark").agg(F.max("text").alias("text")).join(nodes, ["id", "mark"]).select("doc_id", "text"), "texts")
    first = nodes.groupBy("id").agg(F.min("doc_id").alias("v"))
    same = nodes.join(first, "id").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
    comp = _components(cut(features(texts), "features"), texts, percent, same)
    named = comp.join(nodes.select(F.col("doc_id").alias("node"), "id"), "node").join(nodes.select(F.col("doc_id").alias("component"), F.col("id").alias("root")), "component")
    return cut(named.select(F.col("id").alias("node"), F.col("root").alias("component")).distinct(), "named")


def _components(feats: DataFrame, docs: DataFrame, percent: int, known: DataFrame | None = None) -> DataFrame:
    """(node, component) over links of one text for each doc_id, and over known links (u, v)."""
    least = least_agreement(percent / 100)
    full = feats.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = cut(full.join(classes, ["n_shingles", "d1", "d2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct(), "copies")
    reps = full.join(copies.select(F.col("u").alias("doc_id")), "doc_id", "left_anti")
    members = cut(reps.select("doc_id", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket")), "members")
    buckets = cut(members.groupBy("bucket").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = cut(members.join(buckets, "bucket").select("bucket", "v", "n", "size", F.col("doc_id").alias("u")), "shared")
    ids = cut(shared.select(F.col("u").alias("doc_id")).distinct(), "ids")
    sigs = cut(only_ids(feats.select("doc_id", "sig"), ids).dropDuplicates(["doc_id"]), "sigs")
    for x in (members, buckets, ids):
        discard(x)

    star = shared.where("u <> v").select("u", "v").distinct()
    star = star.join(sigs.select(F.col("doc_id").alias("u"), F.col("sig").alias("su")), "u").join(sigs.select(F.col("doc_id").alias("v"), F.col("sig").alias("sv")), "v")
    links = confirmed(star.mapInArrow(lean(_near(least)), "u long, v long"), docs, percent)
    comp = cut(components(links), "components")

    placed = shared.join(comp.select(F.col("node").alias("u"), "component"), "u", "left").select("bucket", "n", "size", F.col("u").alias("doc_id"), F.coalesce("component", "u").alias("component"))
    placed = cut(placed, "placed")
    for x in (shared, sigs, comp):
        discard(x)
    links = links.union(confirmed(_rest(placed, feats, docs, least, percent), docs, percent)).union(copies)
    discard(placed)
    return components(links if known is None else links.union(known))


def _near(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(_A)
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, k) for c in ("su", "sv"))
            at = pa.array(np.flatnonzero((a == b).sum(axis=1) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("u", "v")], names=["u", "v"])

    return run
