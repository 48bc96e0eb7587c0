"""Toxicity: a lexicon in a trie, met by Levenshtein automata, and context windows around each hit.

Training (labelled rows only, a sample of at most about ``SAMPLE`` of them chosen by hash):
1. Terms: words that toxic texts hold far more often than clean ones and in many different
   neighbourhoods (so that words of one often-copied toxic text are none) become the lexicon, with
   their log-odds as weights. Equal texts of a label count once; of near copies, neighbourhoods that
   suffice by themselves make a term, however many copies hold it beside them. Beginnings that many such words share become stems, which stand for
   their words that are too rare to be terms.
2. Misspellings: all words of training texts within the edit bound of a term are counted by class,
   which tells ordinary words that happen to be near a term from disguised terms.
3. Evidence of a text (best hit, sum, kinds of terms, quoted share, length) is fitted to the labels.

Scoring: each distinct word runs as a Levenshtein automaton through the trie (letters that stand in
for others, as 0 for o, are folded first). A hit's weight falls where quotation marks stand around it or
a reporting verb stands near, and rises near words of address. Words are told by hash, so that each
distinct word of a worker is looked up once. Words of any length are looked up; marks at their ends go first,
and words with marks inside are looked up by parts as well. One edit (a letter more, less, other, or two
swapped) is borne for terms of five letters or more; shorter terms and stems must be spelt right.

Defined cases: null and empty texts have no hits and the score of such a text; labels other than 0
and 1 are none; without toxic labelled rows the lexicon is empty and the score is the base rate;
repeated rows are scored each, and of rows with one id the least text is learnt from; a null doc_id is
passed through; an empty table gives no rows; memory follows the longest text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import cut, discard, lean, slices, text_at, words
from .linear import newton_logistic, sigmoid

SAMPLE = 24_000
MIN_TERM, MIN_FUZZY, REMEMBERED = 3, 5, 300_000
HEADS = (2, 3, 4, 5, 6)
STEM_WORDS = 4  # different words that a stem must have; texts that let a word of a stem speak for itself
THRESHOLD = 0.3
WINDOW = 8
#: Signs that stand in for letters, marks of quotation, verbs of reporting, words of address.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
QUOTES = "\"'`“”„‟‘’‚«»‹›"
REPORTING = frozenset("said says wrote writes called calls quoted quotes reported term word insult dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your you're u du dich dein tu te toi vous votre usted ustedes tus".split())
_EDGE = QUOTES + ".,;:?!()[]{}<>*#%&|_-+=~^/\\"


_INNER = re.compile(f"[{re.escape(_EDGE)}]+")


def plain(word: str) -> str:
    """A word in lower case without marks at its ends."""
    return word.lower().strip(_EDGE)


_FOLD = str.maketrans(STAND_INS)
_SIGNS = "".join(STAND_INS)


def folded(word: str) -> str:
    return word.translate(_FOLD)


class Trie:
    """A lexicon; within() intersects the Levenshtein automaton of a word with it. Two letters swapped are one edit."""

    def __init__(self, terms: list[str], shortest: int = 0):
        """Terms below `shortest` letters are not in the trie, but count for the numbers of the others."""
        self.root: dict = {}
        for i, term in enumerate(terms):
            if len(term) < shortest:
                continue
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = i
        self.terms = terms
        self.alive: dict[str, bool] = {}

    def within(self, word: str, edits: int = 1) -> tuple[int, int] | None:
        """(term, distance) of the nearest term at so many edits at most; ties go to the first in the lexicon.

        States of the automaton are bit sets of positions in the word, one set for each count of edits;
        beside them stand the positions whose next letter but one was met, half of a swap.
        """
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        best: tuple[int, int] | None = None
        full = (1 << (n + 1)) - 1
        start = [1]
        for _ in range(edits):
            start.append((start[-1] | start[-1] << 1) & full)
        stack = [(self.root, start, [0] * (edits + 1))]
        while stack:
            node, sets, half = stack.pop()
            end = node.get("")
            if end is not None:
                for d, s in enumerate(sets):
                    if s >> n & 1:
                        if best is None or (d, end) < best[::-1]:
                            best = end, d
                        break
            for c, child in node.items():
                if c == "":
                    continue
                hit = masks.get(c, 0)
                after, begun = [(sets[0] & hit) << 1], [0]
                for d in range(1, edits + 1):
                    after.append(((sets[d] & hit) << 1 | sets[d - 1] | sets[d - 1] << 1 | after[d - 1] << 1 | (half[d] & hit) << 2) & full)
                    begun.append(sets[d - 1] & hit >> 1)
                if after[-1] or any(begun):
                    stack.append((child, after, begun))
        return best

    def survives(self, word: str, edits: int = 1) -> bool:
        """Whether some term can still be reached after the word's first two, three, ... letters; remembered by these."""
        for n in HEADS:
            head = word[:n]
            found = self.alive.get(head)
            if found is None:
                if len(self.alive) > REMEMBERED:
                    self.alive.clear()
                found = self.alive[head] = self._survives(head, edits)
            if not found:
                return False
        return True

    def _survives(self, head: str, edits: int) -> bool:
        n = len(head)
        # Rows of edit distances between head's beginnings and the path, the row before, and the path's last letter.
        stack = [(self.root, list(range(n + 1)), None, "")]
        while stack:
            node, row, before, last = stack.pop()
            if row[n] <= edits:
                return True
            for c, child in node.items():
                if c == "":
                    continue
                after = [row[0] + 1]
                for i in range(1, n + 1):
                    least = min(row[i] + 1, after[-1] + 1, row[i - 1] + (head[i - 1] != c))
                    if before and i > 1 and head[i - 1] == last and head[i - 2] == c:
                        least = min(least, before[i - 2] + 1)
                    after.append(least)
                if min(after) <= edits:
                    stack.append((child, after, row, c))
        return False


@dataclass
class Lexicon:
    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    near: dict[str, float] = field(default_factory=dict)  # words of the training texts that are near a term
    unseen: list[float] = field(default_factory=list)  # by term: weight of a near word that no training text holds
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.index = {t: i for i, t in enumerate(self.terms)}
        self.lengths = sorted({len(x) for x in self.stems}, reverse=True)
        self.stem_number = {x: len(self.terms) + i for i, x in enumerate(self.stems)}
        self.trie = Trie(self.terms, MIN_FUZZY)

    def match(self, raw: str) -> tuple[int, int, str] | None:
        """(term, distance, word) of a raw word; where the whole says nothing, of the part between inner marks that weighs most."""
        word = plain(raw)
        found = self._match(word)
        if found or not _INNER.search(word):
            return found
        parts = [f for x in dict.fromkeys(_INNER.split(word)) if (f := self._match(x))]
        return max(parts, key=lambda f: (self._weight(*f), -f[0]), default=None)

    def _match(self, word: str) -> tuple[int, int, str] | None:
        i = self.index.get(word)
        if i is not None:
            return i, 0, word
        for n in self.lengths:
            if word[:n] in self.stems:
                return self.stem_number[word[:n]], 1, word
        if len(word) < MIN_FUZZY - 1 or not self.terms:
            return None
        spelt = word
        if not word.isalpha():
            for spelt in (word.strip(_SIGNS), folded(word)):
                if (i := self.index.get(spelt)) is not None:
                    return i, 1, word
        if not self.trie.survives(spelt):
            return None
        found = self.trie.within(spelt)
        return (found[0], max(1, found[1]), word) if found else None

    def _weight(self, term: int, distance: int, word: str) -> float:
        if not distance:
            return self.weights[term]
        if term >= len(self.terms):
            return self.near.get(word, self.stems[word[: next(n for n in self.lengths if word[:n] in self.stems)]])
        return self.near.get(word, self.unseen[term])

    def weight(self, raw: str) -> tuple[int, float] | None:
        found = self.match(raw)
        w = self._weight(*found) if found else 0
        return (found[0], w) if w > 0 else None


class _Known:
    """What each distinct word is, by the hash of its bytes; kept while a worker lives."""

    def __init__(self):
        self.codes: dict[int, int] = {}
        self.found: list = [None]

    def look_up(self, w, find) -> np.ndarray:
        """For each word the index of what find() says of it, 0 for nothing."""
        h = w.hashes()
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.codes) > REMEMBERED:
            self.codes.clear()
            self.found = [None]
        codes, data, out = self.codes, w.texts.data, np.zeros(len(distinct), np.int32)
        begin, end = w.start[first].tolist(), w.end[first].tolist()
        for k, key in enumerate(distinct.tolist()):
            code = codes.get(key)
            if code is None:
                hit = find(data[begin[k] : end[k]].tobytes().decode("utf-8", "replace"))
                code = 0
                if hit:
                    code = len(self.found)
                    self.found.append(hit)
                codes[key] = code
            out[k] = code
        return out[back]


EVIDENCE = 5


def evidence(w, codes: np.ndarray, known: _Known) -> np.ndarray:
    """A row for each text: best hit, log of the sum, kinds of terms, quoted share, log of words."""
    n = np.diff(w.doc_first)
    out = np.zeros((len(n), EVIDENCE))
    out[:, 4] = np.log1p(n) / 10
    at = np.flatnonzero(codes)
    if not len(at):
        return out
    doc = np.searchsorted(w.doc_first, at, "right") - 1
    for d in np.unique(doc).tolist():
        best = total = quoted = 0.0
        kinds = set()
        a, b = int(w.doc_first[d]), int(w.doc_first[d + 1])
        own = at[doc == d] if len(at) < 5000 else at[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
        for p in own.tolist():
            term, weight = known.found[codes[p]]
            lo, hi = max(a, p - WINDOW), min(b, p + WINDOW + 1)
            near = [w.texts.data[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace") for i in range(lo, hi)]
            left, self_, right = near[: p - lo], near[p - lo], near[p - lo + 1 :]
            opened = self_[:1] in QUOTES or any(x[:1] in QUOTES for x in left)
            closed = self_.rstrip(".,;:?!")[-1:] in QUOTES or any(x.rstrip(".,;:?!")[-1:] in QUOTES for x in right)
            said = any(plain(x) in REPORTING for x in left + right)
            factor = (0.25 if said else 0.5) if opened and closed else 0.8 if said else 1.0
            if any(plain(x) in ADDRESS for x in left + right):
                factor *= 1.25
            quoted += opened and closed
            kinds.add(term)
            best = max(best, factor * weight)
            total += factor * weight
        out[d, :4] = best / 5, math.log1p(total), math.log1p(len(kinds)), quoted / len(own)
    return out


# ---- training -------------------------------------------------------------------------------


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, texts, contexts): of clean texts by batch how many hold a word, of toxic ones each neighbourhood."""
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for t in slices(batch.column("text")):
            clean: dict[str, int] = {}
            rows: list[tuple[str, int, int]] = []
            for i in range(len(t)):
                own = [plain(x) for x in text_at(t, i).decode("utf-8", "replace").split()]
                if not toxic[t.first + i]:
                    for x in set(own):
                        clean[x] = clean.get(x, 0) + 1
                    continue
                seen = set()
                for k, x in enumerate(own):
                    if x not in seen:
                        seen.add(x)
                        # Not by hash(), which differs between Python workers.
                        around = f"{own[k - 1] if k else ''}\0{own[k + 1] if k + 1 < len(own) else ''}"
                        rows.append((x, 1, xxhash.xxh3_64_intdigest(around.encode("utf-8", "replace")) >> 1))
            every = [(x, n, 0) for x, n in clean.items()]
            out = [(x, 0, n, c) for x, n, c in every] + [(x, 1, n, c) for x, n, c in rows]
            out = [r for r in out if len(r[0]) >= MIN_TERM]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["word", "toxic", "texts", "context"])


def _evidence(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            for t in slices(batch.column("text")):
                w = words(t)
                x = evidence(w, known.look_up(w, lexicon.weight), known)
                bounds = pa.array(np.arange(0, x.size + 1, EVIDENCE), pa.int32())
                cols = [batch.column(c).slice(t.first, len(t)) for c in ("doc_id", "toxic")]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(bounds, pa.array(x.reshape(-1)))], names=["doc_id", "toxic", "x"])

    return run


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def _near(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, term = [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                found = lexicon._match(word)
                if found and found[1]:
                    keep.append(i)
                    term.append(found[0])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("word", "c0", "c1")), pa.array(term, pa.int32())], names=["word", "c0", "c1", "term"])

    return run


def _learn_stems(counts: DataFrame) -> dict[str, float]:
    """Beginnings of four to ten letters whose words, taken together, speak for toxic texts. None begins another.

    Words with a longer beginning in common have its first ten letters in common, so no length of words is left out.
    """
    all1, all0 = (x or 0 for x in counts.agg(F.sum("c1"), F.sum("c0")).first())
    if not all1:
        return {}
    heads = counts.where(F.length("word") > 4).withColumn("n", F.explode(F.sequence(F.lit(4), F.least(F.lit(10), F.length("word") - 1))))
    heads = heads.groupBy(F.col("word").substr(F.lit(1), F.col("n")).alias("head")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.count_if(F.col("c1") > 0).alias("kinds"))
    heads = cut(heads.where((F.col("kinds") >= STEM_WORDS) & (F.col("c1") >= 2 * STEM_WORDS)), "heads")
    base = all1 / (all0 + all1)
    q = F.col("c1") / (F.col("c0") + F.col("c1"))
    entropy = F.col("c1") * F.log(q / base) + F.when(F.col("c0") > 0, F.col("c0") * F.log((1 - q) / max(1 - base, 1e-9))).otherwise(0)
    # A text holds several words of a stem, so texts are fewer than counts: the bound is thrice that of terms.
    good = heads.withColumn("e", entropy).where((q > base) & (F.col("e") > 3 * (math.log(max(2, heads.count())) + 2)))
    w = F.log((F.col("c1") + 0.5) / (all1 + 1)) - F.log((F.col("c0") + 0.5) / (all0 + 1))
    stems: dict[str, float] = {}
    for r in good.withColumn("w", w).where("w > 2.5").orderBy(F.desc("e"), F.desc(F.length("head")), "head").collect():
        if not any(r["head"].startswith(x) or x.startswith(r["head"]) for x in stems):
            stems[r["head"]] = r["w"]
    return stems


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """rows (text, toxic) -> terms and weights. The sample bounds both, and what is collected.

    A term's share of toxic texts must exceed the base rate by more than the number of distinct words
    lets chance do (relative entropy times texts), and its neighbourhoods must be as varied as a
    word's that many texts use by themselves, or exceed chance when they are counted instead of texts.
    Equal texts of a label are one text here.
    """
    rows = cut(rows.select("text", "toxic").distinct(), "distinct")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n1:
        return Lexicon()
    pairs = rows.mapInArrow(lean(_tokens), "word string, toxic int, texts long, context long")
    of = lambda y: F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("texts"))), F.lit(0))
    counts = cut(pairs.groupBy("word").agg(of(0).alias("c0"), of(1).alias("c1"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("context"))).alias("contexts")), "words")
    chance = math.log(max(2, counts.count())) + 2
    base = n1 / (n0 + n1)

    def speaks(c1: Column) -> Column:
        q = c1 / (F.col("c0") + c1)
        entropy = c1 * F.log(q / base) + F.when(F.col("c0") > 0, F.col("c0") * F.log((1 - q) / max(1 - base, 1e-9))).otherwise(0)
        return (c1 > 1) & (q > base) & (entropy > chance)

    varied = (F.col("contexts") >= 0.3 * F.col("c1")) | speaks(F.col("contexts"))
    terms = counts.where(speaks(F.col("c1")) & (F.col("contexts") >= 2) & varied)
    terms = terms.withColumn("w", F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))).where("w > 2").orderBy(F.desc("w"), "word").collect()
    lexicon = Lexicon([r.word for r in terms], [r.w for r in terms], {}, [0.0] * len(terms), _learn_stems(counts))
    odds = lambda a, b: math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    near, rare = {}, [[0, 0] for _ in terms]
    for r in counts.select("word", "c0", "c1").mapInArrow(lean(_near(lexicon)), "word string, c0 long, c1 long, term int").collect():
        if r.term < len(terms) or r.c0 + r.c1 >= STEM_WORDS:
            near[r.word] = odds(r.c1, r.c0)
        if r.term < len(terms) and r.c0 + r.c1 <= 2:
            rare[r.term][0] += r.c0
            rare[r.term][1] += r.c1
    unseen = [min(w, odds(c1, c0)) for w, (c0, c1) in zip(lexicon.weights, rare, strict=True)]
    return Lexicon(lexicon.terms, lexicon.weights, near, unseen, lexicon.stems)


def train(docs: DataFrame, labels: DataFrame, training: Column | None = None, sample: int = SAMPLE) -> ToxicityModel:
    """Learns from rows of labels (doc_id, toxic) for which `training` holds."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if training is not None:
        rows = rows.where(training)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.distinct()
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n))))
    # Written once, for three passes; one text for each label, so that rows are as bounded as labels are.
    texts = cut(_plain(docs).join(F.broadcast(chosen), "doc_id"), "sample")
    if texts.groupBy("doc_id", "toxic").count().where("count > 1").take(1):
        texts = cut(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    lexicon = learn_lexicon(texts)
    # Sorted here, as Spark would run the map twice to find the ranges of a sort; rows are as bounded as the sample.
    found = sorted(texts.mapInArrow(lean(_evidence(lexicon)), "doc_id long, toxic int, x array<double>").collect(), key=lambda r: (r.doc_id, r.toxic))
    discard(texts)
    y = np.array([r.toxic for r in found], float)
    if not len(y) or not y.any():
        return ToxicityModel(lexicon, np.append(np.zeros(EVIDENCE), -6.0))
    return ToxicityModel(lexicon, newton_logistic(np.array([r.x for r in found]), y, ridge=1e-4))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            for t in slices(batch.column("text")):
                w = words(t)
                x = evidence(w, known.look_up(w, model.lexicon.weight), known)
                rest = [batch.column(c).slice(t.first, len(t)) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(model.score(x)), pa.array(np.expm1(x[:, 2]).round().astype(np.int64))], names=[*batch.schema.names, "score", "n_terms"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, score, n_terms), one row for each row of docs."""
    return _plain(docs).mapInArrow(lean(_score(model)), "doc_id long, text string, score double, n_terms long").select("doc_id", "score", "n_terms")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    return docs.mapInArrow(lean(_keep(model, threshold)), docs.schema)


def _keep(model: ToxicityModel, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for t in slices(batch.column("text")):
                w = words(t)
                x = evidence(w, known.look_up(w, model.lexicon.weight), known)
                keep[t.first : t.first + len(t)] = model.score(x) < threshold
            yield batch.filter(pa.array(keep))

    return run
