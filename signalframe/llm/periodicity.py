"""Periodic runs of words: Lyndon arrays under both orders of the words, and their roots extended into runs.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends.  Every run has a
Lyndon root: under one of the two orders (words ascending or descending) the longest Lyndon word at any place
inside it where a root starts, but for the run's own first word, is one period long.  The first phase of Baier's suffix
sorter groups the suffixes by their longest Lyndon word.  It takes the groups from the greatest to the smallest and
appends each to the group of the nearest earlier suffix that is still open; how long a group's common word is when
its turn comes is the Lyndon array, with no suffix array made.  Roots that repeat are extended to both sides by the
longest common extension of a place and the place one period later.

A run of ``times`` periods repeats each of its three-word windows three times at least.  So only stretches of words
inside such windows are looked at, with nothing lost: a run lies in one stretch as a whole, and no word outside could
extend it.  Texts are handled in Arrow batches, a few megabytes at a time; a longer text is handled alone and whole.

Null and empty texts have no words and no runs; equal rows get equal results; an empty table gives an empty table.
``with_runs`` adds one column and keeps all others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_bytes, chunks, covered, mix, window_hashes

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words of the windows that point to stretches, and how often one must occur in its text.
WINDOW, OFTEN = 3, 3

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
SCHEMA = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
_ARROW_RUN = pa.struct([(c, pa.int64()) for c in _RUN.names])

Run = tuple[int, int, int]


def lyndon_lengths(word: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by grouping suffixes."""
    letters = sorted(set(word))
    rank = {v: k for k, v in enumerate(letters)}
    group = [rank[v] for v in word]
    members: list[list[int]] = [[] for _ in letters]
    for place, g in enumerate(group):
        members[g].append(place)
    size = [1] * len(letters)
    # neighbours of a group in the order of all groups
    lower, upper = list(range(-1, len(letters) - 1)), [*range(1, len(letters)), -1]
    # the nearest earlier place that is open, once the links over done places are followed
    earlier = list(range(-1, len(word) - 1))
    out = [0] * len(word)
    top = len(letters) - 1
    while top >= 0:
        length = size[top]
        here = [place for place in members[top] if group[place] == top]
        for place in here:
            out[place] = length
        appended: dict[int, int] = {}
        for place in here:
            at = earlier[place]
            if at >= 0 and out[at]:
                passed = [place]
                while at >= 0 and out[at]:
                    passed.append(at)
                    at = earlier[at]
                for p in passed:
                    earlier[p] = at
            if at >= 0:
                appended[at] = appended.get(at, 0) + 1
        made: dict[tuple[int, int], int] = {}
        # more copies make the greater word, so they come first and stay above
        for at, copies in sorted(appended.items(), key=lambda x: -x[1]) if len(appended) > 1 else appended.items():
            old = group[at]
            new = made.get((old, copies))
            if new is None:
                new = made[old, copies] = len(size)
                size.append(size[old] + copies * length)
                members.append([])
                above = upper[old]
                lower.append(old)
                upper.append(above)
                upper[old] = new
                if above >= 0:
                    lower[above] = new
            group[at] = new
            members[new].append(at)
        top = lower[top]
    return out


def common_extension(word: np.ndarray, a: int, b: int, step: int) -> int:
    """Equal words from places a < b onwards, to the right (step 1) or to the left (step -1)."""
    room = len(word) - b if step > 0 else a + 1
    done, block = 0, 64
    while done < room:
        n = min(block, room - done)
        x, y = a + step * done, b + step * done
        same = word[x:x + n] == word[y:y + n] if step > 0 else (word[x - n + 1:x + 1] == word[y - n + 1:y + 1])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done, block = done + n, 2 * block
    return done


def runs_of(word: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[Run]:
    """(start, length, period) of every run of at least ``least`` words and ``times`` periods, three of them or more; by start, then period."""
    if least < 3 or times < 3:
        raise ValueError("runs of fewer than three words or periods are not looked for")
    found: set[Run] = set()
    for ordered in (word, -word):
        lyndon = np.array(lyndon_lengths(ordered.tolist()), dtype=np.int64)
        place = np.arange(len(word))
        # times - 1 roots follow each other, the first within a period of the run's start
        for k in range(1, times - 1):
            place = place[place + (k + 1) * lyndon[place] <= len(word)]
            place = place[lyndon[place + k * lyndon[place]] == lyndon[place]]
        place = place[word[place] == word[place + lyndon[place]]]
        reached: dict[int, int] = {}
        for i in place.tolist():
            p = int(lyndon[i])
            if reached.get(p, 0) >= i + p:
                continue
            end = i + p + common_extension(word, i, i + p, 1)
            start = i - common_extension(word, i - 1, i + p - 1, -1)
            reached[p] = end
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(ids: np.ndarray, owner: np.ndarray, n_texts: int, least: int) -> Iterator[tuple[int, int]]:
    """(first word, end) of the stretches inside windows that their text has ``OFTEN`` times."""
    if len(ids) < max(WINDOW, least):
        return
    salt = mix(np.arange(n_texts, dtype=np.uint64), 11)
    keys = window_hashes(mix(ids), WINDOW) ^ salt[owner[:len(ids) - WINDOW + 1]]
    places = np.flatnonzero(owner[WINDOW - 1:] == owner[:len(ids) - WINDOW + 1])
    order = places[np.argsort(keys[places], kind="stable")]
    sorted_keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])[:len(order)])
    counts = np.diff(np.concatenate([first, [len(order)]]))
    mask = covered(len(ids), np.sort(order[np.repeat(counts >= OFTEN, counts)]), WINDOW)
    change = np.ones(len(ids) + 1, bool)
    change[1:-1] = (mask[1:] != mask[:-1]) | (owner[1:] != owner[:-1])
    edges = np.flatnonzero(change)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if mask[a] and b - a >= least:
            yield a, b


def measure(texts: list[bytes], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> Iterator[tuple[int, list[Run], bytes]]:
    """Words, runs and collapsed text of every text: of each run the first period stays, and words are joined by one space."""
    if least < 6 or times < 4:
        raise ValueError("the windows only point to runs of at least six words and four periods")
    lists = [t.split() for t in texts]
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    coded = pa.array([w for ws in lists for w in ws], type=pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), counts)
    starts = np.cumsum(counts) - counts
    runs: dict[int, list[Run]] = {}
    for a, b in _stretches(ids, owner, len(lists), least):
        text = int(owner[a])
        at = a - int(starts[text])
        runs.setdefault(text, []).extend((at + s, n, p) for s, n, p in runs_of(ids[a:b], least, times))
    for k, words in enumerate(lists):
        own = runs.get(k, [])
        if own:
            begin, length, period = np.array(own).T
            drop = covered(len(words), begin + period, length - period)
            yield len(words), own, b" ".join(w for w, d in zip(words, drop.tolist()) if not d)
        else:
            yield len(words), own, b" ".join(words)


def runs(text: Column, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> Column:
    """Struct of ``n_words``, ``runs`` (start and length in words, period; by start, then period) and ``collapsed`` text."""

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = [row for _, part in chunks(column) for row in measure(as_bytes(part), least, times)]
            found = [[dict(zip(_RUN.names, r)) for r in own] for _, own, _ in rows]
            collapsed = pa.array([c for *_, c in rows], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.StructArray.from_arrays([pa.array([n for n, *_ in rows], pa.int64()), pa.array(found, pa.list_(_ARROW_RUN)), collapsed], names=SCHEMA.names)

    return F.arrow_udf(batches, SCHEMA, F.ArrowUDFType.SCALAR_ITER)(text)


def longest(found: Column) -> Column:
    """The run of greatest length in an array of runs, ties by smallest start, then period; null if there is none."""
    best = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period")))


def run_text(found: Column) -> Column:
    """``start,length,period`` of every run, a line each."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in _RUN.names)), F.lit("\n"))), "")


def with_runs(docs: DataFrame, text: str = "text", name: str = "periodic_runs", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """``docs`` with one more struct column ``name``; see ``runs``."""
    return docs.withColumn(name, runs(F.col(text), least, times))
