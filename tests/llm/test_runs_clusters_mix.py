"""Periodic runs, centroid clusters and source mixes against plain versions, and their behaviour on odd rows."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalframe.llm import clustering, mixing, packing, periodicity, queries

words_of_few = st.lists(st.integers(0, 2), max_size=40)


# ---- periodic runs

def brute_lyndon(word):
    n = len(word)

    def is_lyndon(x):
        return all(x < x[k:] for k in range(1, len(x)))

    return [max(e - i for e in range(i + 1, n + 1) if is_lyndon(word[i:e])) for i in range(n)]


def brute_runs(word, least=6, times=4):
    n, found = len(word), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if word[i] != word[i + p]:
                i += 1
                continue
            end = i
            while end + p < n and word[end] == word[end + p]:
                end += 1
            length = end - i + p
            smallest = next(q for q in range(1, p + 1) if all(word[k] == word[k + q] for k in range(i, i + length - q)))
            if smallest == p and length >= max(least, times * p):
                found.append((i, length, p))
            i = end
    return sorted(found, key=lambda r: (r[0], r[2]))


@given(words_of_few)
@settings(max_examples=200, deadline=None)
def test_lyndon_lengths(word):
    assert periodicity.lyndon_lengths(word) == brute_lyndon(word)
    assert periodicity.lyndon_lengths([-x for x in word]) == brute_lyndon([-x for x in word])


@given(words_of_few, st.integers(3, 5), st.integers(3, 8))
@settings(max_examples=200, deadline=None)
def test_runs_of_any_word(word, times, least):
    assert periodicity.runs_of(np.array(word, dtype=np.int64), least, times) == brute_runs(word, least, times)


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_runs_of_texts_of_repeats(parts):
    word = [x for unit, k in parts for x in unit * k]
    (n, runs, collapsed), = periodicity.measure([" ".join(f"w{x}" for x in word).encode()])
    assert n == len(word) and runs == brute_runs(word)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    assert collapsed.decode() == " ".join(f"w{x}" for k, x in enumerate(word) if k not in gone)


def test_fibonacci_and_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    for word in (b, [0] * 70, list(range(20)) * 9, [k * k % 7 for k in range(200)]):
        assert periodicity.runs_of(np.array(word), 6, 4) == brute_runs(word)
    assert len(periodicity.lyndon_lengths(list(range(200_000)))) == 200_000


TEXTS = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "a b a b a b a b", "x a b c a b c a b c a b c a z", "é ü é ü é ü é ü ", "the same line\n" * 30 + "end",
         " ".join(f"w{k}" for k in range(120)), "q " * 40_000]


def docs_of(spark, texts):
    rows = [(i, t, "x", 1, [9]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, collapsed string, n_words int, runs array<int>").repartition(3)


def test_runs_of_odd_rows(spark):
    out = periodicity.with_runs(docs_of(spark, TEXTS + TEXTS)).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "collapsed", "n_words", "runs", "periodic_runs"}
    for r in out:
        words = (r["text"] or "").encode().split()
        found = r["periodic_runs"]
        assert found["n_words"] == len(words)
        want = brute_runs(words) if len(words) < 10_000 else [(0, 40_000, 1)]
        assert [tuple(x) for x in found["runs"]] == want
        gone = {k for s, n, p in want for k in range(s + p, s + n)}
        assert found["collapsed"] == b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
    assert periodicity.with_runs(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        list(periodicity.measure([b"a"], 6, 3))


def test_longest_run_breaks_ties(spark):
    df = spark.sql("SELECT array(named_struct('start', 9L, 'length', 8L, 'period', 1L), named_struct('start', 2L, 'length', 8L, 'period', 2L), "
                   "named_struct('start', 2L, 'length', 8L, 'period', 1L)) AS r UNION ALL SELECT array() AS r")
    rows = {tuple(r[0]) if r[0] else None for r in df.select(periodicity.longest(F.col("r"))).collect()}
    assert rows == {(2, 8, 1), None}


def test_texts_made_periodic(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 9, 60])))) for i in range(300)] + [(None, "a b c"), (7, None), (3, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", queries.made_periodic(F.col("doc_id"), F.col("text")).alias("made")).collect()
    changed = 0
    for r in got:
        h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        words = (r["text"] or "").split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            assert r["made"].split() == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += r["made"] != r["text"]
        else:
            assert r["made"] == r["text"]
    assert changed > 5


# ---- centroid clusters

def brute_clusters(rows, k=8, rounds=10, scale=1024):
    whole = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows]
    order = sorted((n for n in range(len(rows)) if rows[n][0] is not None), key=lambda n: (hashlib.sha256(f"3:{rows[n][0]}".encode()).hexdigest(), rows[n][1]))
    centroids = [whole[n][1] for n in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, x in whole:
            groups[near(x)[1]].append(x)
        centroids = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(groups, centroids)]
    found = [(i, *near(x)[::-1]) for i, x in whole]
    per = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    return sorted(((i, j, d, per[j], sum(per.values()), tuple(centroids[j])) for i, j, d in found), key=repr)


def clusters_of(df, **options):
    return sorted((tuple(r[:5]) + (tuple(r["centroid"]),) for r in clustering.cluster(df, **options).collect()), key=repr)


VECTORS = "vec_id long, embedding array<float>, id int, x string, key int, cluster int"


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (5, 6))
    made = [(int(i), [float(x) for x in (centres[i % 5] + rng.normal(0, 0.2, 6)).astype(np.float32)]) for i in range(400)]
    made += [(1000 + i, [0.5] * 6) for i in range(300)] + [made[3]] * 5 + [(None, made[9][1]), (7, made[8][1])]
    bad = [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0] * 7), (5, [float("nan")] * 6), (6, [float("inf")] + [0.0] * 5), (8, [None] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in made + bad], VECTORS).repartition(5)
    assert clusters_of(df, width=6) == brute_clusters(made)
    few = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in made[:3]], VECTORS)
    assert clusters_of(few, width=6) == brute_clusters(made[:3])
    none = clustering.cluster(df.where("false"), width=6)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    made = [(i, [float(x) for x in rng.integers(-120_000, 120_000, 3) + rng.random(3)]) for i in range(60)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    assert clusters_of(df, width=3) == brute_clusters(made)
    beyond = spark.createDataFrame([(1, [1e9, 0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(beyond, width=3).collect()


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = clustering.hilbert_keys(cells, 3)
    walk = cells[sorted(range(len(cells)), key=lambda k: keys[k])]
    assert len(set(keys)) == 512
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_boxes_lose_no_centroid(seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(-9, 9, (int(rng.integers(1, 6)), 4)) + rng.integers(-40, 40, 4) for _ in range(6)]
    centroids = rng.integers(-40, 40, (5, 4))
    open_to = clustering.candidates(np.array([b.min(0) for b in blocks]), np.array([b.max(0) for b in blocks]), centroids)
    for block, may in zip(blocks, open_to):
        d = ((block[:, None, :] - centroids) ** 2).sum(2)
        assert all(may[c] for c in np.flatnonzero((d == d.min(1)[:, None]).any(0)))
        best, far = clustering.nearest(block, centroids, np.flatnonzero(may))
        assert best.tolist() == d.argmin(1).tolist() and far.tolist() == d.min(1).tolist()


# ---- mixes

def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, held = {}, share * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in held)
        target = {s: Fraction(most * sizes[s]) if s in held else weight[s] * left / rest for s in names}
        above = {s for s in names if s not in held and target[s] > most * sizes[s]}
        if not above:
            return target
        held |= above
        left -= sum(most * sizes[s] for s in above)


def brute_mix(rows, **options):
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + max(n or 0, 0)
    targets, out = brute_targets(sizes, **options), []
    for s, whole in sizes.items():
        budget = math.floor(targets[s])
        epochs = budget // whole if whole else 0
        before = 0
        mine = sorted(((hashlib.md5(f"13:{'null' if i is None else i}".encode()).hexdigest(), i is not None, i, max(n or 0, 0)) for i, t, n in rows if t == s), key=lambda x: (x[0], x[1], x[2] or 0, x[3]))
        for _, _, i, n in mine:
            out.append((i, s, n, whole, round(float(targets[s]), 6), epochs * n + max(0, min(n, budget - epochs * whole - before))))
            before += n
    return sorted(out, key=repr)


MIXED = "doc_id long, source string, n int, name string, size int, key int, part string, target int"


def mixed(spark, rows, parts=4, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], MIXED).repartition(parts)
    out = mixing.mix(df, F.col("n"), **options).select("doc_id", "source", "size", "source_size", F.round("target", 6), "taken")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_mix_against_brute_force(spark):
    rng = random.Random(8)
    names = ["a", "b", "B", "é", "zz", "", "=", None]
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(names), rng.choice([0, 1, 5, 50, 900])) for i in range(600)]
    rows += [(None, "hot", 7)] * 40 + [rows[5]] * 3 + [(9001, "a", None), (9002, "a", -4), (9003, "empty", 0), (9004, "small", 1)]
    got = mixed(spark, rows)
    assert got == brute_mix(rows) == mixed(spark, rows, parts=7)
    by_source = {}
    for _, s, n, whole, target, taken in got:
        assert taken <= 2 * n
        by_source.setdefault(s, [target, 0])[1] += taken
    assert all(math.floor(t) == taken for t, taken in by_source.values())
    assert any(t == 2 * w for *_, w, t, _ in got) and any(t < 2 * w for *_, w, t, _ in got)


def test_mix_of_few_rows(spark):
    for rows in ([], [(1, None, 5)], [(1, "a", 0), (2, None, 0)], [(1, "a", 10), (2, "b", 10), (3, "c", 10), (4, "d", 10)]):
        assert mixed(spark, rows) == brute_mix(rows)
    rows = [(i, "abc"[i % 3], 10 + i) for i in range(30)]
    assert mixed(spark, rows, share=(2, 1)) == brute_mix(rows, share=Fraction(2))
    assert mixed(spark, rows, weights=(1,), share=(1, 2), most=1) == brute_mix(rows, weights=(1,), share=Fraction(1, 2), most=1)


def test_mix_counts_words(spark):
    df = spark.createDataFrame([(1, "a", "x y z \n w"), (2, "a", None), (3, None, "")], "doc_id long, source string, text string")
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df, packing.word_count(F.col("text"))).collect()} == {1: 3, 2: 0, 3: 0}
