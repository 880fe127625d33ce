"""Toxicity: a learned lexicon, matched with spelling errors, and scores from the words around each match.

The lexicon comes from labelled rows: words and word beginnings (stems) that toxic documents have far more often than
others.  It is kept as a trie.  A word of a text is matched by walking the trie with the states of the word's
Levenshtein automaton, so one walk finds whether a whole term lies within one error; stems match words that
begin with them.  The words around a match tell quotation from abuse: quotation marks around it and
words of reporting weaken it.  A logistic regression over the counts of plain, misspelled and quoted matches
and their density gives the score.

Fitting takes at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the id; scoring is one pass over whole
texts.  Null labels are left out, of several labels of one id the largest counts.  Null and empty texts have no
match and get the score of such texts; without labels of both classes every score is 0; repeated rows get
equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .near_dups import shingle_sets, sketch
from .text import ALNUM, as_bytes, chunks

#: Most labelled rows that the lexicon and the regression are fitted on.
SAMPLE_ROWS = 24_000
#: A term must be so many times as frequent in toxic documents of the sample, and be so by more than chance gives one of
#: a million candidates (log-likelihood ratio).
LEAST_LIFT, LEAST_EVIDENCE = 6.0, 30.0
#: Terms from this length on may have one error: a character missing, added or replaced, or two neighbours swapped.
ERROR_LENGTH = 5
#: Stems have so many characters; a stem matches a word that begins with it.
STEM_LENGTHS = range(4, 9)
#: Coordinates of the sketch that finds copies in the sample, and how many equal ones make a copy.
BRIEF, COPY = 24, 8
#: Words on either side of a match that are looked at.
CONTEXT = 6
#: Words of reporting, which mark a quoted term.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes term word words phrase insult insults slur reported".split())
#: How much a reporting word nearby weakens a match.
REPORTED = 0.5
#: Accents and vowel signs, which are part of the word although ``\\w`` leaves them out.
_SIGNS = re.escape("".join(c for c in map(chr, (*range(0x80, 0x20000), *range(0xE0100, 0xE01F0))) if unicodedata.category(c)[0] == "M"))
_TOKEN = re.compile(rf"(?:[^\W_]|[{_SIGNS}])+|[\"“”„«»]")
#: Non-ASCII characters that are in no word: punctuation, symbols, blanks.
_OTHER = re.compile(rf"[^\x00-\x7F\w{_SIGNS}]+")
_MARKS = frozenset("\"“”„«»")
N_FEATURES = 5
#: Distinct words that a task remembers.
REMEMBERED = 400_000


def _words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: what ``_TOKEN`` finds without the quotation marks."""
    text = text or ""
    return (text if text.isascii() else _OTHER.sub(" ", text)).encode().translate(ALNUM).split()


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    least: int = 1 << 30  # lengths of the terms below
    most: int = 0
    term: bool = False


@dataclass
class Lexicon:
    """Terms as a trie, and stems; ``match`` gives 2 for a term or stem as written, 1 for a misspelled term, 0 for none."""

    terms: list[str]
    stems: list[str]

    def __post_init__(self):
        self.exact, self.beginnings, self.root = set(self.terms), set(self.stems), Node()
        self.heads = {(len(t), t[:(len(t) - 1) // 2]) for t in self.terms if len(t) >= ERROR_LENGTH}
        self.tails = {(len(t), t[-((len(t) - 1) // 2):]) for t in self.terms if len(t) >= ERROR_LENGTH}
        for term in self.terms:
            if len(term) >= ERROR_LENGTH:
                path = [self.root]
                for c in term:
                    path.append(path[-1].children.setdefault(c, Node()))
                for node in path:
                    node.least, node.most = min(node.least, len(term)), max(node.most, len(term))
                path[-1].term = True

    def match(self, word: str) -> int:
        if word in self.exact or any(word[:n] in self.beginnings for n in STEM_LENGTHS):
            return 2
        # One error leaves the first or the last half of a term, without its middle, as it is.
        for size in (len(word) - 1, len(word), len(word) + 1):
            half = (size - 1) // 2
            if half > 0 and ((size, word[:half]) in self.heads or (size, word[-half:]) in self.tails):
                return int(self._within_one_error(word))
        return 0

    def _within_one_error(self, word: str) -> bool:
        """Walk the trie with the states of the word's automaton: the sets (as bits) of positions in the word
        reached without an error, with one, and half-way through two swapped characters."""
        size = len(word)
        end = 1 << size
        inside = 2 * end - 1
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        stack = [(self.root, 1, 2, 0)]
        while stack:
            node, clean, wrong, swapped = stack.pop()
            if node.term and (clean | wrong) & end:
                return True
            for c, child in node.children.items():
                if size < child.least - 1 or size > child.most + 1:
                    continue
                here = places.get(c, 0)
                step = (clean & here) << 1
                # in order: the character read, missing in the word, replaced, followed by one too many, swapped
                off = ((wrong & here) << 1 | clean | clean << 1 | step << 1 | (swapped & here) << 2) & inside
                if step or off:
                    stack.append((child, step, off, clean & (here >> 1)))
        return False


class Scorer:
    """Features of texts under a lexicon; remembers the words it has matched."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}

    def _kind(self, word: bytes) -> int:
        kind = self.known.get(word)
        if kind is None:
            kind = self.known[word] = self.lexicon.match(word.decode("utf-8", "replace").lower())
        return kind

    def features(self, text: str | None) -> tuple[float, ...]:
        words = _words(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if not any([self._kind(w) for w in set(words)]):
            return (0.0,) * N_FEATURES
        counts = [0.0, 0.0, 0.0]  # plain, misspelled, quoted
        found = {w.decode("utf-8", "replace"): k for w in set(words) if (k := self.known[w])}
        tokens = _TOKEN.findall(text.translate(_ASCII_LOWER))
        for i, token in enumerate(tokens):
            kind = found.get(token)
            if kind:
                before, after = tokens[max(0, i - CONTEXT):i], tokens[i + 1:i + 1 + CONTEXT]
                quoted = 1.0 if not _MARKS.isdisjoint(before) and not _MARKS.isdisjoint(after) else 0.0
                if not quoted and not REPORTING.isdisjoint((*before, *after)):
                    quoted = REPORTED
                counts[0 if kind == 2 else 1] += 1 - quoted
                counts[2] += quoted
        density = 1000 * counts[0] / max(20, len(words))
        return (*(math.log1p(c) for c in counts), math.log1p(density), math.log1p(1000 * counts[1] / max(20, len(words))))


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray | None  # bias first; None: not fitted, scores are 0

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -35, 35)))


def learn_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 40) -> np.ndarray | None:
    """Logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        return None
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _candidates(text: str | None) -> set[str]:
    """Whole words as they are, stems with ``*`` behind them."""
    out: set[str] = set()
    for b in set(_words(text)):
        w = b.decode("utf-8", "replace").lower()
        out.add(w)
        out.update(w[:n] + "*" for n in STEM_LENGTHS if n <= len(w))
    return out


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms of a sample with ``text`` and ``toxic``; tasks count for themselves, Spark adds the counts up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                (toxic if label else clean).update(_candidates(text))
        terms = list(toxic | clean)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())],
                                         names=["term", "toxic", "clean"])

    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon([], [])
    counts = sample.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = n_toxic / (n_toxic + n_clean)
    t, c = F.col("toxic"), F.col("clean")
    lift = (t + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1))
    evidence = 2 * (t * F.ln(t / ((t + c) * share)) + F.when(c > 0, c * F.ln(c / ((t + c) * (1 - share)))).otherwise(0.0))
    found = counts.where((t > 0) & (lift >= LEAST_LIFT)).where(evidence >= LEAST_EVIDENCE).select("term")
    # The sample's bound is the bound of its terms.
    terms = {r["term"] for r in found.collect()}
    stems: set[str] = set()
    for s in sorted((x[:-1] for x in terms if x.endswith("*")), key=lambda s: (len(s), s)):
        if not any(s[:n] in stems for n in STEM_LENGTHS if n < len(s)):
            stems.add(s)
    # Terms that begin with a stem stay too: only they find their misspellings.
    return Lexicon(sorted(x for x in terms if not x.endswith("*")), sorted(stems))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text`` and ``toxic`` of at most ``rows`` labelled documents; ``usable`` is a condition on ``doc_id``."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # An id that many rows carry is one row here.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _brief(text: Column) -> Column:
    """A small similarity sketch; empty for texts without words."""
    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            sets = [s for _, part in chunks(texts) for s in shingle_sets(as_bytes(part), 3)]
            yield pa.array([sketch(s, BRIEF).view(np.int64).tolist() if len(s) else [] for s in sets], type=pa.list_(pa.int64()))

    return F.arrow_udf(batches, T.ArrayType(T.LongType()), F.ArrowUDFType.SCALAR_ITER)(text)


def without_copies(sample: DataFrame) -> DataFrame:
    """The bounded sample without near copies, which would make the words of one text look like evidence from many."""
    holders: dict[tuple[int, int], list[int]] = {}
    kept: list[int] = []
    for doc_id, brief in sample.select("doc_id", _brief(F.col("text"))).orderBy("doc_id").collect():
        shared = Counter(k for place in enumerate(brief) for k in holders.get(place, ()))
        if not shared or max(shared.values()) < COPY:
            for place in enumerate(brief):
                holders.setdefault(place, []).append(doc_id)
            kept.append(doc_id)
    ids = sample.sparkSession.createDataFrame([(k,) for k in kept], "doc_id long")
    return sample.join(F.broadcast(ids), "doc_id", "left_semi")


def _features(text: Column, lexicon: Lexicon) -> Column:
    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(lexicon)
        for texts in columns:
            yield pa.array([scorer.features(t.as_py()) for t in texts], type=pa.list_(pa.float64()))

    return F.arrow_udf(batches, T.ArrayType(T.DoubleType()), F.ArrowUDFType.SCALAR_ITER)(text)


def fit(sample: DataFrame) -> Model:
    """Lexicon and weights from a bounded sample with ``doc_id``, ``text`` and ``toxic``."""
    sample = cut_lineage(sample)
    sample = cut_lineage(without_copies(sample))
    lexicon = learn_lexicon(sample)
    rows = sample.select(_features(F.col("text"), lexicon).alias("x"), "toxic").collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), N_FEATURES)
    return Model(lexicon, learn_weights(x, np.array([r["toxic"] for r in rows], dtype=float)))


def toxicity(text: Column, model: Model) -> Column:
    """Score of a text column, rounded to six digits."""

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model.lexicon)
        for texts in columns:
            x = np.array([scorer.features(t.as_py()) for t in texts], dtype=float).reshape(len(texts), N_FEATURES)
            yield pa.array(np.round(model.score(x), 6))

    return F.arrow_udf(batches, T.DoubleType(), F.ArrowUDFType.SCALAR_ITER)(text)
