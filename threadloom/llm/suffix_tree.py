"""A probabilistic suffix tree over words, and log probabilities of texts under it.

A state is a context of one to `depth` words that has at least a share `share` of all training tokens
behind it, so there are at most 1 / share states of a length whatever the corpus; they are broadcast.
Counts of what follows a state grow with the corpus and stay in tables. In a state s, symbols met twice
or more keep their counts less `discount`; the rest of the mass, escape(s), goes to the distribution of
the next shorter context, down to add-one frequencies of words:

    P(x|s) = (n(s,x) - discount) / n(s) + escape(s) * P(x | shorter s)

A state is retained if the divergence (Kullback-Leibler, in nats) of its distribution from that of the next
shorter context is at least `divergence`, or if a retained state ends with it. A token is scored by the
longest retained state that the words before it end with.

A log probability is a sum: the word's own, the escapes on the way to the state, and a correction for each
pair (state, symbol) with a count. What hangs on broadcast tables is added where the text is read. For the
rest a slice of texts sends each pair once, with the places of its documents in the slice, packed into a row
for each bucket of keys, where it meets the table of corrections; a frequent pair is one entry a slice, and
what a bucket gives goes back to the slice as one row. Sums
are whole numbers of 2**-32, so they do not follow the order of tasks. Keys are hashes of 64 bits.

Defined cases: a null or empty text is one end token; contexts do not reach beyond a text's beginning; a null
`training` leaves a row out of training; repeated rows are scored, and counted, each; without training rows
every word is unknown; an empty table gives none. A long text is a slice by itself. Rows are told by their
place in docs, which must give the same rows in the same order each time (a table does); ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

SLICE_BYTES = 8 << 20
#: Words with this share of all tokens have their counts broadcast: half a million at most.
WORD_SHARE = 2e-6
#: A state has been met so often at least, however small the corpus.
LEAST = 5
FIXED = 1 << 32
END = np.uint64(0xD6E8FEB86659FD93)
_LN10 = float(np.log(10))


@dataclass
class States:
    """Contexts by length: level k holds, for a first word (its number) and a shorter state, the state's number; 0 is no context."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes of words in states, sorted
    keys: list[np.ndarray] = field(default_factory=list)  # level 1: number of the word; others: first word << 32 | shorter state
    ids: list[np.ndarray] = field(default_factory=list)

    def at(self, tokens: Tokens) -> list[np.ndarray]:
        """For each level the state before each token, 0 where there is none."""
        number = _found(self.words, tokens.words, np.arange(len(self.words)), -1)[tokens.code]
        out: list[np.ndarray] = []
        for k, (keys, ids) in enumerate(zip(self.keys, self.ids, strict=True), 1):
            before = np.full(len(number), -1, np.int64)
            before[k:] = number[:-k]
            before[tokens.place < k] = -1
            state = np.zeros(len(number), np.int64)
            ok = np.flatnonzero((before >= 0) & (out[-1] > 0) if out else before >= 0)
            state[ok] = _found(keys, before[ok] if k == 1 else before[ok] << 32 | out[-1][ok], ids, 0)
            out.append(state)
        return out


def _found(keys: np.ndarray, asked: np.ndarray, values: np.ndarray, default: int) -> np.ndarray:
    """values of sorted keys, and a default for keys that are not there."""
    if not len(keys):
        return np.full(len(asked), default, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)


@dataclass
class Tokens:
    """Tokens of a slice, each text closed by END: an index into distinct hashes, the text it is of, and its place there."""

    words: np.ndarray
    code: np.ndarray
    doc: np.ndarray
    place: np.ndarray


def piece(texts: core.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, how many each text has)."""
    w = core.words(texts)
    return w.hashes(lower=True), np.diff(w.doc_first)


def tokens(pieces: list[tuple[np.ndarray, np.ndarray]]) -> Tokens:
    many = np.concatenate([n for _, n in pieces])
    doc = np.repeat(np.arange(len(many)), many + 1)
    all_ = np.full(len(doc), END)
    all_[np.arange(many.sum()) + np.repeat(np.arange(len(many)), many)] = np.concatenate([h for h, _ in pieces])
    code, distinct = pd.factorize(all_)
    return Tokens(distinct, code, doc, np.arange(len(doc)) - (np.cumsum(many + 1) - many - 1)[doc])


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Rows of a batch and their tokens, of about SLICE_BYTES of text; words are hashed in smaller pieces, as that takes some tens of bytes a byte."""
    pieces, first, rows, size = [], 0, 0, 0
    for t in core.slices(batch.column("text")):
        pieces.append(piece(t))
        rows, size = rows + len(t), size + len(t.data)
        if size >= SLICE_BYTES:
            yield batch.slice(first, rows), tokens(pieces)
            pieces, first, rows, size = [], first + rows, 0, 0
    if rows:
        yield batch.slice(first, rows), tokens(pieces)


def _per_slice(run, schema: str, docs: DataFrame) -> DataFrame:
    """run(batch of the slice's rows, tokens) -> columns, over all slices of docs (.., text)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in _slices(batch):
                yield pa.RecordBatch.from_arrays(run(part, t), names=names)

    return docs.mapInArrow(core.lean(whole), schema)


# ---- training ----------------------------------------------------------------------------------


def _counted(columns: list[np.ndarray], most: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of small whole numbers, in order, and how often each one is there."""
    key = columns[0].astype(np.int64)
    for c, m in zip(columns[1:], most[1:], strict=True):
        key = key * m + c
    key, n = np.unique(key, return_counts=True)
    out = []
    for m in reversed(most[1:]):
        out.append(key % m)
        key = key // m
    return [key, *reversed(out)], n


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (text) -> (x, c): words by hash and their counts, END among them."""

    def run(batch: pa.RecordBatch, t: Tokens) -> list[pa.Array]:
        return [_signed(t.words), pa.array(np.bincount(t.code, minlength=len(t.words)))]

    return _per_slice(run, "x long, c long", docs).groupBy("x").agg(F.sum("c").alias("c"))


def followers(docs: DataFrame, states: States) -> DataFrame:
    """docs (text) -> (s, x, n): how often each symbol follows each state of the last level."""
    held = docs.sparkSession.sparkContext.broadcast(states)

    def run(batch: pa.RecordBatch, t: Tokens) -> list[pa.Array]:
        s = held.value.at(t)[-1]
        ok = np.flatnonzero(s)
        (code, s), n = _counted([t.code[ok], s[ok]], [0, int(s.max(initial=0)) + 1])
        return [pa.array(s.astype(np.int32)), _signed(t.words[code]), pa.array(n)]

    return _per_slice(run, "s int, x long, n long", docs).groupBy("s", "x").agg(F.sum("n").alias("n"))


@dataclass
class SuffixTree:
    """A trained tree. counts (x, c) of words; corrections (s, x, more) of retained states, natural logarithms; known: all states as a table on the driver."""

    n: int
    v: int
    counts: DataFrame
    corrections: DataFrame | None
    states: States
    escape: np.ndarray  # natural logarithm by state, 0 at 0
    known: pd.DataFrame  # s, level, up (the next shorter state), n, escape, divergence, kept
    frequent: tuple[np.ndarray, np.ndarray]  # hashes, sorted, and counts


def _arrays(df: DataFrame, **types) -> list[np.ndarray]:
    table = df.toArrow()
    return [table.column(c).to_numpy().astype(t, copy=False) for c, t in types.items()]


def train(docs: DataFrame, training: Column | None = None, depth: int = 3, share: float = 1e-5, divergence: float = 0.05, discount: float = 0.75) -> SuffixTree:
    """A tree of the rows of docs (text, ...) where training holds (all by default)."""
    spark = docs.sparkSession
    texts = (docs if training is None else docs.where(training)).select("text")
    counts = core.cut(word_counts(texts), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(total[0]), int(total[1])
    support = max(LEAST, share * n)
    often = counts.where(F.col("c") >= min(support, max(2, WORD_SHARE * n)))
    x, c = _arrays(often, x=np.int64, c=np.int64)
    order = np.argsort(x.view(np.uint64))
    frequent = x.view(np.uint64)[order], c[order]
    ahead = (frequent[1] >= support) & (frequent[0] != END)
    states = States(frequent[0][ahead], [np.arange(int(ahead.sum()))], [np.arange(1, int(ahead.sum()) + 1)])
    level = pd.DataFrame({"s": states.ids[0], "up": 0, "n": frequent[1][ahead]})
    shorter = counts.select(F.lit(0).alias("up"), "x", F.log((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("less"))
    paths: dict[tuple[int, ...], int] = {(i,): i + 1 for i in range(len(level))}  # by numbers of words
    last = dict(paths)
    levels, tables = [], []
    for k in range(1, depth + 1):
        if not len(level):
            states.keys, states.ids = states.keys[: k - 1], states.ids[: k - 1]
            break
        met = core.cut(followers(texts, states).where("n >= 2"), "followers")
        held = _weighed(spark, met, level, discount)
        weight = F.broadcast(spark.createDataFrame(held[["s", "up", "m", "escape"]]))
        p = (F.col("n") - discount) / F.col("m") + F.col("escape") * F.exp("less")
        pairs = met.join(weight, "s").join(shorter, ["up", "x"]).select("s", "x", F.log(p).alias("p"), "less", "escape")
        pairs = core.cut(pairs.withColumn("more", F.col("p") - F.log("escape") - F.col("less")), "pairs")
        gains = pairs.groupBy("s").agg(F.sum(F.exp("p") * (F.col("p") - F.col("less"))).alias("gain"), F.sum(F.exp("less")).alias("seen"))
        held = held.merge(gains.toPandas(), "left", "s").fillna({"gain": 0.0, "seen": 0.0})
        held["divergence"] = held["gain"] + held["escape"] * np.log(held["escape"]) * (1 - held["seen"].clip(upper=1))
        levels.append(held.assign(level=k))
        tables.append(pairs)
        shorter = pairs.select(F.col("s").alias("up"), "x", F.col("p").alias("less"))
        if k < depth:
            level, last = _longer(spark, met, states, support, paths, last)
        core.discard(met)
    return _kept(spark, n, v, counts, frequent, states, levels, tables, divergence)


def _weighed(spark: SparkSession, met: DataFrame, level: pd.DataFrame, discount: float) -> pd.DataFrame:
    """The level's states (s, up, m) with the share of their mass that escapes."""
    own = met.groupBy("s").agg(F.sum(F.col("n") - discount).alias("own")).toPandas()
    out = level.rename(columns={"n": "m"}).merge(own, "left", "s").fillna({"own": 0.0})
    return out.assign(escape=1 - out["own"] / out["m"])


def _longer(spark: SparkSession, met: DataFrame, states: States, support: float, paths: dict, last: dict) -> tuple[pd.DataFrame, dict]:
    """States of one word more: pairs (state, word) with support, as the words of the state and that word."""
    inside = F.broadcast(spark.createDataFrame(pd.DataFrame({"x": states.words.view(np.int64)}), "x long"))
    s, x, n = _arrays(met.where(F.col("n") >= support).join(inside, "x", "left_semi"), s=np.int64, x=np.int64, n=np.int64)
    word = np.searchsorted(states.words, x.view(np.uint64))
    by_id = {i: path for path, i in last.items()}
    base = max(paths.values(), default=0)
    whole = sorted((*by_id[a], int(b), int(m)) for a, b, m in zip(s.tolist(), word.tolist(), n.tolist(), strict=True))
    found = {path[:-1]: base + 1 + i for i, path in enumerate(whole)}
    up = np.array([paths[p[1:]] for p in found], np.int64)
    keys = np.array([p[0] for p in found], np.int64) << 32 | up
    ids = np.array(list(found.values()), np.int64)
    order = np.argsort(keys)
    states.keys.append(keys[order])
    states.ids.append(ids[order])
    paths.update(found)
    return pd.DataFrame({"s": ids, "up": up, "n": np.array([p[-1] for p in whole], np.int64)}), found


def _kept(spark, n, v, counts, frequent, states: States, levels: list[pd.DataFrame], tables: list[DataFrame], divergence: float) -> SuffixTree:
    """The tree of retained states: those that diverge, and all that they end with."""
    known = pd.concat(levels, ignore_index=True) if levels else pd.DataFrame({c: pd.Series(dtype=float) for c in ("s", "up", "m", "escape", "divergence", "level")})
    kept: set[int] = set()
    for held in reversed(levels):  # a state's next shorter one is a level below
        wanted = held[(held["divergence"] >= divergence) | held["s"].isin(kept)]
        kept.update(wanted["s"].tolist())
        kept.update(int(u) for u in wanted["up"] if u)
    known = known.assign(kept=known["s"].isin(kept)).rename(columns={"m": "n"})
    escape = np.zeros(int(known["s"].max()) + 1 if len(known) else 1)
    if len(known):
        escape[known["s"].to_numpy(np.int64)] = np.log(known["escape"])
    alive = np.zeros(len(escape), bool)
    alive[list(kept)] = True
    stays = [alive[i] for i in states.ids]
    states = States(states.words, [k[a] for k, a in zip(states.keys, stays, strict=True)], [i[a] for i, a in zip(states.ids, stays, strict=True)])
    corrections = None
    if kept:
        few = F.broadcast(spark.createDataFrame(pd.DataFrame({"s": sorted(kept)}), "s int"))
        for t in tables:
            own = t.select("s", "x", "more")
            corrections = own if corrections is None else corrections.union(own)
        corrections = corrections.join(few, "s", "left_semi")
    return SuffixTree(n, v, counts, corrections, states, escape, known[["s", "level", "up", "n", "escape", "divergence", "kept"]], frequent)


# ---- scoring -------------------------------------------------------------------------------------


def _fixed(log10: np.ndarray) -> np.ndarray:
    return np.rint(log10 * FIXED).astype(np.int64)


#: Bytes of text whose pairs make a bucket of the join, on average.
BUCKET_BYTES = 6 << 20
_SENT = "bucket int, kind int, first long, keys binary, counts binary, data binary"
_SUMS = ("n_tokens", "n_known", "base", "score")


def _key(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A number for a state and a symbol's hash; as _key_of has it."""
    return x.view(np.int64) ^ (s << 44) ^ (s << 20) ^ s


def _key_of(s: Column, x: Column) -> Column:
    s = s.cast("long")
    return x.bitwiseXOR(F.shiftleft(s, 44)).bitwiseXOR(F.shiftleft(s, 20)).bitwiseXOR(s)


def _sent(docs: DataFrame, model: SuffixTree, buckets: int) -> DataFrame:
    """docs (row, text) -> for each slice its documents' sums of what is known at hand (kind -1), and for each bucket the keys to be looked
    up, each with the places of the documents that hold it: words whose count is not broadcast (kind 0), pairs of a state and a symbol (kind 1)."""
    words, c = model.frequent
    own = _fixed(np.log10((c + 1) / (model.n + model.v + 1)))
    held = docs.sparkSession.sparkContext.broadcast((model.states, words, own, _fixed(model.escape / _LN10)))

    def packed(kind: int, s: np.ndarray, code: np.ndarray, doc: np.ndarray, t: Tokens) -> Iterator[tuple]:
        pair = code.astype(np.int64) * (int(s.max(initial=0)) + 1) + s
        order = np.argsort(pair, kind="stable")  # of a pair in the order of documents
        begins = np.flatnonzero(np.diff(pair[order], prepend=-1))
        first = order[begins]
        key = _key(s[first], t.words[code[first]])
        counts = np.diff(np.append(begins, len(order)))
        doc = doc[order].astype(np.uint16)
        bucket = key % buckets
        by = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(ends)):
            at = by[ends[b] : ends[b + 1]]
            n = counts[at]
            docs_ = doc[np.repeat(begins[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            yield int(b), kind, key[at].tobytes(), n.astype(np.uint32).tobytes(), docs_.tobytes()

    def run(batch: pa.RecordBatch, t: Tokens) -> list[pa.Array]:
        states, words, own, escape = held.value
        first = batch.column("row")[0].as_py()
        value = _found(words, t.words, own, 1)[t.code]  # logarithms are not above 0
        base = np.where(value <= 0, value, 0)
        levels = states.at(t)
        score = base.copy()
        for s in levels:
            score += escape[s]
        sums = np.zeros((len(_SUMS), batch.num_rows), np.int64)
        np.add.at(sums[0], t.doc, 1)
        np.add.at(sums[1], t.doc, value <= 0)
        np.add.at(sums[2], t.doc, base)
        np.add.at(sums[3], t.doc, score)
        out = [(first % buckets, -1, b"", b"", sums.tobytes())]
        at = np.flatnonzero(value > 0)
        out += packed(0, np.zeros(len(at), np.int64), t.code[at], t.doc[at], t)
        for s in levels:
            at = np.flatnonzero(s)
            out += packed(1, s[at], t.code[at], t.doc[at], t)
        bucket, kind, keys, counts, data = zip(*out, strict=True)
        return [pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array([first] * len(out), pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, counts, data))]

    return _per_slice(run, _SENT, docs)


def _table(model: SuffixTree, buckets: int) -> DataFrame:
    """(bucket, kind, key, base, more): corrections of pairs, and logarithms of words whose count is not broadcast, as whole numbers."""
    fixed = lambda c: F.rint(c * FIXED).cast("long")
    log = fixed(F.log10((F.col("c") + 1) / F.lit(float(model.n + model.v + 1))))
    least = int(model.frequent[1].min()) if len(model.frequent[1]) else None
    rare = model.counts if least is None else model.counts.where(F.col("c") < least)
    out = rare.select(F.lit(0).alias("kind"), F.col("x").alias("key"), log.alias("base"), log.alias("more"))
    if model.corrections is not None:
        out = out.union(model.corrections.select(F.lit(1), _key_of(F.col("s"), F.col("x")), F.lit(0).cast("long"), fixed(F.col("more") / _LN10)))
    return out.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))


def score(docs: DataFrame, model: SuffixTree) -> DataFrame:
    """docs (text, ...) -> docs without text, with n_tokens, n_known, base_score and score (log10 probabilities of whole texts)."""
    row, = core.clear_of(docs.columns, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    buckets = -(-(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 1) // BUCKET_BYTES)
    unknown = int(_fixed(np.array([-np.log10(model.n + model.v + 1)]))[0])

    def run(sent: pa.Table, known: pa.Table) -> pa.Table:
        kinds, keys, base, more = (known.column(c).to_numpy() for c in ("kind", "key", "base", "more"))
        tables = []
        for kind in (0, 1):
            own = np.flatnonzero(kinds == kind)
            own = own[np.argsort(keys[own])]
            tables.append((keys[own], base[own], more[own]))
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for r in range(sent.num_rows):
            kind, first, data = sent.column("kind")[r].as_py(), sent.column("first")[r].as_py(), sent.column("data")[r].as_py()
            if kind < 0:
                sums = np.frombuffer(data, np.int64).reshape(len(_SUMS), -1)
                held.setdefault(first, []).append((np.arange(sums.shape[1]), sums))
                continue
            asked = np.frombuffer(sent.column("keys")[r].as_py(), np.int64)
            counts, doc = np.frombuffer(sent.column("counts")[r].as_py(), np.uint32), np.frombuffer(data, np.uint16)
            names, low, high = tables[kind]
            place = _found(names, asked, np.arange(len(names)), -1)
            met = place >= 0
            if kind:
                doc, counts, place = doc[np.repeat(met, counts)], counts[met], place[met]
                values = np.stack([np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), low[place], high[place]])
            else:
                values = np.full((4, len(asked)), unknown)
                values[0], values[1] = 0, met
                values[2, met], values[3, met] = low[place[met]], high[place[met]]
            held.setdefault(first, []).append(_summed([(doc.astype(np.int64), np.repeat(values, counts, axis=1))]))
        out = [(first, *_summed(parts)) for first, parts in held.items()]
        return pa.table({"first": pa.array([f for f, _, _ in out], pa.int64()), "docs": pa.array([d.astype(np.uint16).tobytes() for _, d, _ in out], pa.binary()), "sums": pa.array([v.tobytes() for _, _, v in out], pa.binary())})

    def of_slice(parts: pa.Table) -> pa.Table:
        held = [(np.frombuffer(d, np.uint16).astype(np.int64), np.frombuffer(v, np.int64).reshape(len(_SUMS), -1)) for d, v in zip(parts["docs"].to_pylist(), parts["sums"].to_pylist(), strict=True)]
        docs_, sums = _summed(held)
        return pa.table({"row": parts["first"][0].as_py() + docs_, **dict(zip(_SUMS, map(np.ascontiguousarray, sums), strict=True))})

    sent, known = _sent(placed.select(F.col(row).alias("row"), "text"), model, buckets), _table(model, buckets)
    met = sent.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, "first long, docs binary, sums binary")
    sums = met.groupBy("first").applyInArrow(of_slice, "row long, " + ", ".join(f"{c} long" for c in _SUMS))
    told = sums.select(F.col("row").alias(row), "n_tokens", "n_known", (F.col("base") / FIXED).alias("base_score"), (F.col("score") / FIXED).alias("score"))
    return placed.drop("text", *told.columns[1:]).join(told, row).drop(row)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by row, of some lists of rows and values."""
    rows = np.concatenate([r for r, _ in held])
    values = np.concatenate([v for _, v in held], axis=1)
    if not len(rows):
        return rows, values
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    begins = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1))
    return rows[begins], np.add.reduceat(values[:, order], begins, axis=1)
