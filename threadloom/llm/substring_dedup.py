"""Removal of long passages that occur twice, found by recompression of the word sequences.

Each text is a sequence of word names (64-bit hashes, equal everywhere). In each round a symbol's
coin, a bit of the hash of its name, tells left from right; every adjacent (left, right) pair is
replaced by the name of the pair, one hash of both names. Names and coins hang on content only, so
all tasks name alike without talking: equal substrings get equal interior symbols. A run of equal
symbols has equal coins and so stays as it is: a name for the run as a whole would hang on where it
ends, outside a window, and equal windows would no longer share it.

Whether a boundary between symbols survives r rounds hangs on ``REACH[r]`` words at either side, so
a window of w words holds a symbol that is fixed by the window alone. Of these symbols the one
spanning most words (then by hash, then leftmost) is the window's anchor: equal windows have equal
anchors. Rows keyed by the anchor's name carry the hashes of its windows; a name that occurs once
has no repeat, and in a shared name equal window hashes verify the repeats. Windows that repeat in
one slice are settled there, after their words are held against each other one by one, and shipped
once; what a task has found repeated it remembers (up to ``REMEMBERED``; beyond, it ships again) and
settles from then on. So a passage that a third of all texts share sends its windows once for each
task, not for each text, and its name's rows grow with the tasks only. A short frequent phrase gives one
anchor to many windows that differ; such names, found in a sample of the texts before, are divided by
window: each of their windows goes by a name of its own, made of the anchor's name and its hash.

Defined cases: null or wordless texts and texts shorter than a window lose nothing; repeated rows
are repeats of each other; a null doc_id is a text like any other; an empty table gives no rows.
Other columns are not read. Between tasks windows are told by 64-bit anchor names together with 64-bit
window hashes. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import U64, _powers, binary_array, cut, discard, mix, slices, text_at, words

WINDOW = 35
#: Bytes of a slice: larger than elsewhere, as repeats within one are settled there.
SLICE = 4 << 20
#: By rounds: words at either side that decide a boundary, and the most words of a symbol.
REACH, SPAN = (0, 1, 3, 7), (1, 2, 4, 8)
_COIN = np.random.default_rng(8).integers(0, 1 << 64, 4, dtype=U64)
_LEFT, _RIGHT = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
#: Window hashes that a task keeps of what it has found repeated: 32 MB.
REMEMBERED = 4 << 20
#: Texts that are looked at for frequent anchors (one of so many, by hash), the share of all windows that makes an anchor frequent
#: (so there are 10,000 at most, which are broadcast), and the least windows. They change the plan only, never a result.
ONE_OF, FREQUENT, LEAST_WINDOWS = 64, 10_000, 20_000
ROWS = "name long, id long, text_hash long, first int, windows binary"


def rounds_for(window: int) -> int:
    """Most rounds after which each window still holds a symbol that it fixes alone."""
    return max(r for r in range(len(REACH)) if 2 * REACH[r] + 2 * SPAN[r] - 1 <= window)


def recompress(names: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, names) of the symbols after so many rounds; first: where texts begin."""
    start = np.arange(len(names))
    for r in range(rounds):
        coin = (mix(names ^ _COIN[r]) & U64(1)).astype(bool)
        joins = np.zeros(len(names), bool)
        joins[1:] = ~coin[:-1] & coin[1:] & ~first[1:]
        at = np.flatnonzero(joins)
        names = names.copy()
        names[at - 1] = mix(names[at - 1] * _LEFT + names[at] * _RIGHT)
        keep = ~joins
        start, names, first = start[keep], names[keep], first[keep]
    return start, names


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words i .. i+window-1 for each i."""
    up, down = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[window:] - sums[:-window]) * down[: len(h) - window + 1])


def anchors(h: np.ndarray, doc_first: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows starting at words `at`: the anchor's symbol (an index), and the names of all symbols."""
    rounds = rounds_for(window)
    reach = REACH[rounds]
    first = np.zeros(len(h), bool)
    first[doc_first[:-1][doc_first[:-1] < len(h)]] = True
    start, names = recompress(h, first, rounds)
    span = np.diff(np.append(start, len(h)))
    key = ((U64(15) - span.astype(U64)) << U64(60)) | (mix(names ^ _COIN[3]) >> U64(4))
    before = np.zeros(len(h) + 2, np.int64)  # starts below a word
    flags = np.zeros(len(h) + 1, np.int64)
    flags[start] = 1
    flags[len(h)] = 1
    np.cumsum(flags, out=before[1:])
    low = before[at + reach]
    high = before[at + window - reach + 1] - 2
    best = [np.arange(len(start))]
    for k in range(int(np.max(high - low, initial=0) + 1).bit_length() - 1):
        a, b = best[-1][: -(1 << k)], best[-1][1 << k :]
        best.append(np.where(key[b] < key[a], b, a))
    length = high - low + 1
    level = np.zeros(len(at), np.int64)
    for k in range(1, len(best)):
        level[length >= (1 << k)] = k
    out = np.empty(len(at), np.int64)
    for k, table in enumerate(best):
        own = np.flatnonzero(level == k)
        a, b = table[low[own]], table[high[own] - (1 << k) + 1]
        out[own] = np.where(key[b] < key[a], b, a)
    return out, names


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which are the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, firsts = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    firsts[order[1:]] = ~same
    return twice, firsts


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs, given where a new one begins."""
    begin = np.flatnonzero(change)
    return begin, np.append(begin[1:], len(change))


class _Hot:
    """Windows that a task has shipped and knows to be repeated."""

    def __init__(self):
        self.keys = np.zeros(0, U64)

    def holds(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashed), bool)
        at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return self.keys[at] == hashed

    def add(self, hashed: np.ndarray) -> None:
        self.keys = np.unique(np.concatenate([self.keys if len(self.keys) + len(hashed) <= REMEMBERED else self.keys[:0], hashed]))


def _map(window: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _Hot()
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_hash"))
            for part in slices(batch.column("text"), SLICE):
                yield _slice(part, ids[part.first : part.first + len(part)], hashes[part.first : part.first + len(part)], window, hot, frequent)

    return run


def verified(hashed: np.ndarray, h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """hashed, where two windows of one hash have other words made different; at: the windows' first words."""
    order = np.argsort(hashed, kind="stable")
    same = np.flatnonzero(hashed[order[1:]] == hashed[order[:-1]])
    a, b = at[order[same]], at[order[same + 1]]
    equal = np.ones(len(same), bool)
    for k in range(window):
        equal &= h[a + k] == h[b + k]
    if equal.all():
        return hashed
    out = hashed.copy()
    for i in np.unique(hashed[order[same[~equal]]]).tolist():
        own = np.flatnonzero(hashed == U64(i))
        kinds: dict[bytes, int] = {}
        for w in own.tolist():
            n = kinds.setdefault(h[at[w] : at[w] + window].tobytes(), len(kinds))
            out[w] = mix(np.array([i], U64) + U64(n))[0] if n else U64(i)
    return out


def _slice(part, ids: np.ndarray, hashes: np.ndarray, window: int, hot: _Hot | None = None, frequent: np.ndarray = np.zeros(0, U64)) -> pa.RecordBatch:
    """frequent: sorted names of anchors whose windows go by names of their own."""
    hot = hot or _Hot()
    w = words(part)
    h = w.hashes()
    n = np.maximum(np.diff(w.doc_first) - window + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = w.doc_first[:-1][doc] + offset
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())], names=["name", "id", "text_hash", "first", "windows"])
    anchor, names = anchors(h, w.doc_first, at, window)
    hashed = verified(window_hashes(h, window)[at], h, at, window)
    twice, firsts = repeated(hashed)
    old = hot.holds(hashed)
    hot.add(hashed[twice & firsts & ~old])
    twice, firsts = twice | old, firsts & ~old
    new_doc = np.ones(len(at), bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    change = new_doc.copy()
    change[1:] |= anchor[1:] != anchor[:-1]
    alone = np.isin(names, frequent)[anchor]
    change |= alone
    change[1:] |= alone[:-1]
    begin, end = _runs(change)
    ship = np.add.reduceat(firsts, begin) > 0
    begin, end = begin[ship], end[ship]
    shipped = np.repeat(ship, np.diff(np.append(np.flatnonzero(change), len(at))))
    data = np.ascontiguousarray(hashed[shipped]).view(np.uint8)
    name = np.where(alone[begin], mix(names[anchor[begin]] ^ hashed[begin]), names[anchor[begin]])
    # What is settled here: covered words as (first, end), carried in the same columns under a name that spreads.
    change = new_doc.copy()
    change[1:] |= twice[1:] != twice[:-1]
    b, e = _runs(change)
    done = twice[b]
    b, e = b[done], e[done]
    spans = np.stack([offset[b], offset[e - 1] + window], axis=1).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([name.view(np.int64), mix(hashes[doc[b]].astype(U64)).view(np.int64)])),
            pa.array(np.concatenate([ids[doc[begin]], ids[doc[b]]])),
            pa.array(np.concatenate([hashes[doc[begin]], hashes[doc[b]]])),
            pa.array(np.concatenate([offset[begin], np.full(len(b), -1)]).astype(np.int32)),
            binary_array(np.concatenate([data.reshape(-1), spans.reshape(-1).view(np.uint8)]), np.concatenate([(end - begin) * 8, np.full(len(b), 8)])),
        ],
        names=["name", "id", "text_hash", "first", "windows"],
    )


class _Seen:
    """Windows of a name that goes on in the next batch: one row for each window, settled or not."""

    def __init__(self):
        self.name, self.keys = None, np.zeros(0, U64)
        self.id = self.hash = self.at = np.zeros(0, np.int64)


def _reduce(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            first = batch.column("first").to_numpy()
            ids, hashes, name = (batch.column(c).to_numpy() for c in ("id", "text_hash", "name"))
            raw = batch.column("windows")
            offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
            data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) and raw.buffers()[2] is not None else np.zeros(0, np.uint8)
            settled = first < 0
            spans = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(settled)] or [data[:0]]).view(np.int32).reshape(-1, 2)
            out = [(ids[settled], hashes[settled], spans[:, 0], spans[:, 1])]
            rows = np.flatnonzero(~settled)
            if len(rows):
                size = (offsets[1:] - offsets[:-1])[rows]
                n = size // 8
                take = np.repeat(offsets[:-1][rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
                keys = np.ascontiguousarray(data[take]).view(U64)
                row = np.repeat(np.arange(len(rows)), n)
                at = first[rows][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                ident, texts = ids[rows][row], hashes[rows][row]
                group = np.zeros(len(rows), np.int64)
                own = name[rows]
                group[1:] = np.cumsum(own[1:] != own[:-1])
                if seen.name is not None and own[0] == seen.name:
                    keys, ident, texts, at = (np.concatenate([a, b]) for a, b in ((seen.keys, keys), (seen.id, ident), (seen.hash, texts), (seen.at, at)))
                    row = np.concatenate([np.zeros(len(seen.keys), np.int64), row])
                both = keys ^ mix(group[row].astype(U64) + U64(1))
                twice, firsts = repeated(both)
                hit = np.flatnonzero(twice & (at >= 0))
                begin = np.ones(len(hit), bool)
                begin[1:] = (np.diff(hit) != 1) | (ident[hit[1:]] != ident[hit[:-1]]) | (texts[hit[1:]] != texts[hit[:-1]]) | (np.diff(at[hit]) != 1)
                b, e = _runs(begin) if len(hit) else (hit, hit)
                out.append((ident[hit[b]], texts[hit[b]], at[hit[b]], at[hit[e - 1]] + window))
                goes_on = (group[row] == group[-1]) & firsts
                seen.name, seen.keys, seen.id, seen.hash = own[-1], keys[goes_on], ident[goes_on], texts[goes_on]
                seen.at = np.where(twice[goes_on], -1, at[goes_on])
            a, b, c, d = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32))], names=["id", "text_hash", "first", "end"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        for part in slices(batch.column("text")):
            w = words(part)
            out, total, gone = [], [], []
            for i in range(len(part)):
                a, b = int(w.doc_first[i]), int(w.doc_first[i + 1])
                keep = np.ones(b - a, bool)
                for s in spans[part.first + i] or ():
                    keep[s["first"] : s["end"]] = False
                total.append(b - a)
                gone.append(int(b - a - keep.sum()))
                own = text_at(part, i)
                base = int(part.offsets[i])
                at = np.flatnonzero(keep) + a
                out.append(b" ".join([own[x:y] for x, y in zip((w.start[at] - base).tolist(), (w.end[at] - base).tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(part.first, len(part)), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                names=["doc_id", "text", "n_words", "n_removed"],
            )


def frequent_anchors(docs: DataFrame, window: int = WINDOW) -> np.ndarray:
    """Sorted names of anchors with so many windows in a sample of docs that a task should not get all of them."""
    few = _keyed(docs).where(F.pmod("text_hash", F.lit(ONE_OF)) == 0).select("id", "text_hash", "text")
    rows = few.mapInArrow(_map(window, np.zeros(0, U64)), ROWS).where("first >= 0")
    counts = cut(rows.groupBy("name").agg(F.sum(F.length("windows") / 8).cast("long").alias("n")), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > max(total // FREQUENT, LEAST_WINDOWS // ONE_OF)).select("name").collect()
    discard(counts)
    return np.sort(np.array([r.name for r in found], np.int64).view(U64))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, text_hash, first, end): word spans covered by repeated windows; they may overlap."""
    rows = _keyed(docs).select("id", "text_hash", "text").mapInArrow(_map(window, frequent_anchors(docs, window)), ROWS)
    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(_reduce(window), "id long, text_hash long, first int, end int")


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumns({"id": F.coalesce("doc_id", F.lit(-(1 << 63))), "text_hash": F.xxhash64("text")})


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text, n_words, n_removed), one row for each row of docs.

    text holds the kept words joined by one space; a word goes if a window of so many words that
    covers it has its word sequence start anywhere else in docs as well.
    """
    spans = repeated_spans(docs, window).groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    joined = _keyed(docs).join(cut(spans, "spans"), ["id", "text_hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, "doc_id long, text string, n_words long, n_removed long")
