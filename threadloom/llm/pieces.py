"""SentencePiece encoding and decoding for merge-type vocabularies: a score-ordered agenda.

A text is written with U+2581 for each space and one in front, and cut where no piece can reach
across: before U+2581 after another character, and around control characters that no piece holds.
In each part the adjacent symbol pairs that are pieces wait in an agenda ordered by score, then
position; the best is merged and its new neighbours enter, until none is left. Symbols outside the
vocabulary become byte pieces. Parts are remembered, and each part that is new to a batch is checked
against the sentencepiece library, as is one whole text of each batch; a difference is an error.

Defined cases: a null text is empty, and an empty text has the end id only; long parts are checked
each time and not remembered; memory follows the longest text; an empty table gives no rows; doc_id is passed through, null or repeated as it may be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import KEPT, lean

SPACE = "▁"
LONG_PART, SHORT_PART = 48, 40
#: Bytes of remembered parts, of which there are two generations, and about what an entry takes besides its characters.
REMEMBERED_BYTES, ENTRY_BYTES = 48 << 20, 240


class MergeVocabulary:
    """Encoder and decoder of one model; refuse_others() tells models with other normalisers or user symbols."""

    def __init__(self, model: bytes):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        self.piece = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(size)]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.cost = {p: -lib.get_score(i) for p, i in self.id.items()}
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.shown = ["" if lib.is_control(i) else p.replace(SPACE, " ") for i, p in enumerate(self.piece)]
        self.end = lib.eos_id()
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece reaches over a word's end")
        held = set("".join(self.id))
        alone = "".join(re.escape(c) for c in map(chr, range(32)) if c not in held)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[{alone}]|[^{SPACE}{alone}]+").findall
        self.probe = "\n" if "\n" not in held else None
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.held = 0
        self.altered = False
        self.fresh: list[tuple[str, str]] = []

    def refuse_others(self) -> None:
        """Raises where the library does not encode like an agenda of merges: other normalisers, dummy prefixes or user symbols."""
        probes = ["", " ", "a", " a  b ", "\t\n", "ﬁ Ａ① ｶﾞ é e\u0301", "ABC abc", "\u3000x\u200b", *(p.replace(SPACE, " ") for p in self.piece)]
        for text, theirs in zip(probes, self.library.encode(probes, add_eos=True), strict=True):
            if [*map(int, self.encode(text)[0].split())] != theirs:
                raise ValueError(f"the model encodes {text!r} in another way than by merges of its pieces")
        self.fresh = []

    def merge(self, part: str) -> list[int]:
        """Ids of one part: by a list of costs while it is short, else by a heap. Both take the best, leftmost pair."""
        return self._ids(self._merge_short(part) if len(part) <= SHORT_PART else self._merge_long(part))

    def _merge_short(self, part: str) -> list[str]:
        symbols, cost, none = list(part), self.cost.get, float("inf")
        agenda = [cost(part[i : i + 2], none) for i in range(len(part) - 1)]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            p = symbols[i] + symbols.pop(i + 1)
            symbols[i] = p
            del agenda[i]
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + p, none)
            if i < len(agenda):
                agenda[i] = cost(p + symbols[i + 1], none)
        return symbols

    def _merge_long(self, part: str) -> list[str]:
        symbol: list[str | None] = list(part)
        n, cost = len(part), self.cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[p], i, i + 1, p) for i in range(n - 1) if (p := part[i : i + 2]) in cost]
        heapify(agenda)
        while agenda:
            _, i, j, p = heappop(agenda)
            if symbol[i] is None or symbol[j] is None or after[i] != j or len(symbol[i]) + len(symbol[j]) != len(p):
                continue
            symbol[i], symbol[j] = p, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                q = p + symbol[k]
                if q in cost:
                    heappush(agenda, (cost[q], i, k, q))
            h = before[i]
            if h >= 0:
                q = symbol[h] + p
                if q in cost:
                    heappush(agenda, (cost[q], h, i, q))
        return [s for s in symbol if s is not None]

    def _ids(self, symbols: list[str]) -> list[int]:
        ids: list[int] = []
        for s in symbols:
            i = self.id.get(s)
            if i is None:
                ids.extend([self.byte_id[b] for b in s.encode("utf-8", "replace")])
            else:
                ids.append(i)
        return ids

    def pieces_text(self, ids: list[int]) -> str:
        """The text of ids, with the space that stands in front of each text."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.shown[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if text[:1] == " " else text

    def _entry(self, part: str) -> str:
        """Decimal ids of a part. One that decodes to other text than its own is not remembered, and marks the text as altered."""
        found = self.older.get(part)
        if found is None:
            ids = self.merge(part)
            found = " ".join(map(str, ids))
            self.fresh.append((part, found))
            faithful = self.pieces_text(ids) == part.replace(SPACE, " ")
            self.altered |= not faithful
            if len(part) > LONG_PART or not faithful:
                return found
        self.known[part] = found
        self.held += ENTRY_BYTES + 2 * len(part) + len(found)
        return found

    def encode(self, text: str) -> tuple[str, int, str]:
        """Ids as decimal text, their number, and the text they decode to; the end id included."""
        if not text:
            return str(self.end), 1, ""
        known, self.altered = self.known, False
        ids = " ".join([known.get(p) or self._entry(p) for p in self.parts(SPACE + text.replace(" ", SPACE))])
        if self.held > REMEMBERED_BYTES:
            self.known, self.older, self.held = {}, known, 0
        # Parts hold whole characters, so a text whose parts decode to themselves decodes to itself.
        decoded = self.decode(list(map(int, ids.split()))) if self.altered else text.replace(SPACE, " ")
        return f"{ids} {self.end}", ids.count(" ") + 2, decoded

    def check(self, text: str, ids: str, decoded: str) -> None:
        """Holds one text, and all parts new since the last check, against the library."""
        parts, self.fresh = self.fresh, []
        if self.probe:
            front = self.library.encode(self.probe)
            texts = [self.probe + p.replace(SPACE, " ") for p, _ in parts]
            for (part, ours), theirs in zip(parts, self.library.encode(texts, num_threads=1) if texts else [], strict=True):
                if front + [int(i) for i in ours.split()] != theirs:
                    raise ValueError(f"the library encodes {part!r} otherwise: {theirs}")
        theirs = self.library.encode(text, add_eos=True)
        if " ".join(map(str, theirs)) != ids or self.library.decode(theirs) != decoded:
            raise ValueError(f"the library encodes or decodes a text otherwise: {text[:200]!r}")


_MODELS: dict[int, MergeVocabulary] = {}
KEPT[__name__] = _MODELS.clear
BYTES = 1 << 20


def _encode(model, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(model.value)
        if key not in _MODELS:
            _MODELS[key] = MergeVocabulary(model.value)
        own = _MODELS[key]
        for batch in batches:
            ids, counts, decoded, start, held = [], [], [], 0, 0
            for k, text in enumerate(batch.column("text"), 1):
                text = text.as_py() or ""
                i, n, d = own.encode(text)
                ids.append(i)
                counts.append(n)
                decoded.append(d)
                held += len(text)
                if held > BYTES or k == batch.num_rows:
                    short = min(range(len(ids)), key=lambda x: (abs(len(decoded[x]) - 2000), x))
                    own.check(batch.column("text")[start + short].as_py() or "", ids[short], decoded[short])
                    if as_text:
                        col = pa.array(ids, pa.string())
                    else:
                        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                        col = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.fromstring(" ".join(ids), np.int32, sep=" ")))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(ids)), col, pa.array(counts, pa.int64()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])
                    ids, counts, decoded, start, held = [], [], [], k, 0

    return run


def encode_texts(docs: DataFrame, model_path: str, as_text: bool = False) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids, n_tokens, decoded): ids with the end id, and the text they decode to.

    ids is an array of int, or with as_text the decimal ids joined by one space. The model file is
    read on the driver and sent to the executors (a vocabulary, about 0.5 MB).
    """
    spark: SparkSession = docs.sparkSession
    with open(model_path, "rb") as f:
        data = f.read()
    MergeVocabulary(data).refuse_others()
    model = spark.sparkContext.broadcast(data)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "string" if as_text else "array<int>"
    return rows.mapInArrow(lean(_encode(model, as_text)), f"doc_id long, ids {kind}, n_tokens long, decoded string")
