"""Counts of whole texts, vectorised over a slice: the base rules' counts and the classifier's statistics."""

from __future__ import annotations

import numpy as np

from .core import U64, Texts, Words, _powers, _BYTE, mix
from .substring_dedup import repeated

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CLASS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "symbol": b"#*$%&|<>",
    "stop": b".?!", "comma": b",;:", "bang": b"!", "bracket": b"(){}[]=_/\\+@~^\"'", "line": b"\n",
}
_TABLE = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASS.items()}
_TABLE["begin"] = (np.arange(256) & 0xC0) != 0x80
_TABLE["wide"] = np.arange(256) >= 0xC0


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive bounds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _salt(doc: np.ndarray) -> np.ndarray:
    return mix(doc.astype(U64) + U64(77))


def base_counts(t: Texts, w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_distinct of each text."""
    n = np.diff(w.doc_first)
    doc = np.repeat(np.arange(len(n)), n)
    h = w.hashes()
    begin = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_TABLE["begin"][t.data], out=begin[1:])
    chars = begin[w.end] - begin[w.start]
    # words in three-word windows that the text has twice
    covered = np.zeros(len(h), bool)
    m = len(h) - 2
    if m > 0:
        at = np.flatnonzero(doc[:m] == doc[2:])
        key = h[at] * U64(0x9E3779B97F4A7C15) + h[at + 1] * U64(0xC2B2AE3D27D4EB4F) + h[at + 2] * U64(0x165667B19E3779F9)
        twice, _ = repeated(mix(key) ^ _salt(doc[at]))
        hit = at[twice]
        for k in range(3):
            covered[hit + k] = True
    _, first = repeated(h ^ _salt(doc))
    # lines that hold a word and are equal to an earlier one
    new = np.flatnonzero(t.data == 10)
    # A line that is empty at its text's end starts where the next text does, so its text comes from its \n.
    of = np.concatenate([np.arange(len(t)), np.searchsorted(t.offsets[1:], new, "right")])
    start = np.concatenate([t.offsets[:-1], new + 1])
    order = np.lexsort((start, of))
    of, start = of[order], start[order]
    end = np.append(start[1:], len(t.data))
    last = np.append(of[1:] != of[:-1], True)
    end = np.where(last, t.offsets[1:][of], end - 1)
    up, down = _powers(len(t.data) + 1)
    sums = np.zeros(len(t.data) + 1, U64)
    np.cumsum(_BYTE[t.data] * up[: len(t.data)], out=sums[1:])
    line = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64)) ^ _salt(of)
    held = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    _, fresh = repeated(line)
    dup = np.bincount(of[held & ~fresh], minlength=len(t))
    return {
        "n_words": n, "word_chars": per_text(chars, w.doc_first), "n_symbols": per_text(SYMBOLS[t.data], t.offsets), "n_dup_lines": dup,
        "n_repeat_words": per_text(covered, w.doc_first), "n_lines": np.bincount(of, minlength=len(t)), "n_distinct": per_text(first, w.doc_first),
    }


#: Names of the transformed statistics, in order.
NAMES = (
    "words", "word_length", "length_spread", "upper", "digits", "symbols", "stops", "commas", "bangs", "brackets",
    "wide", "distinct", "repeats", "dup_lines", "line_words", "capital_words", "same_next",
)


def transformed(t: Texts, w: Words) -> np.ndarray:
    """A row of transformed statistics for each text: logarithms of counts, square roots of shares."""
    c = base_counts(t, w)
    n = np.maximum(c["n_words"], 1)
    by = {k: per_text(table[t.data], t.offsets) for k, table in _TABLE.items()}
    size = np.maximum(by["begin"], 1)
    letters = np.maximum(by["upper"] + by["lower"], 1)
    length = (w.end - w.start).astype(np.float64)
    sums = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0], np.cumsum(length**2)])
    mean, square = ((s[w.doc_first[1:]] - s[w.doc_first[:-1]]) / n for s in sums)
    first = t.data[w.start] if len(w.start) else t.data[:0]
    capital = per_text(_TABLE["upper"][first], w.doc_first)
    h = w.hashes()
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    inner = w.doc_first[:-1][w.doc_first[:-1] < len(h)]
    same[inner] = False
    share = lambda x, of: np.sqrt(np.clip(x / of, 0, 1))
    return np.stack(
        [
            np.log1p(c["n_words"]), np.log1p(mean), np.log1p(np.sqrt(np.maximum(square - mean**2, 0))), share(by["upper"], letters), share(by["digit"], size),
            share(c["n_symbols"], size), share(by["stop"], n), share(by["comma"], n), share(by["bang"], n), share(by["bracket"], size), share(by["wide"], size),
            c["n_distinct"] / n**0.9, share(c["n_repeat_words"], n), share(c["n_dup_lines"], np.maximum(c["n_lines"], 1)), np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)),
            share(capital, n), share(per_text(same, w.doc_first), n),
        ],
        axis=1,
    )
