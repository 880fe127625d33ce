"""The corpus operators against plain brute-force versions, and their behaviour on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalframe.llm import contamination, lm_scoring, near_dups, packing, repeats, repetition, secret_scan, token_counts, toxicity, url_filter
from signalframe.llm.components import components
from signalframe.llm.text import ALNUM, LOWER, row_key
from signalframe.session import cut_lineage

DOCS = "doc_id long, text string, source string, row string, unit long, c int"
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, parts=3):
    """Documents with columns whose names clash with those used inside the operators."""
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "x", 7, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWERED))


ODD = [None, "", "   \n\t", "one", "Ünïcode Ä wörd\u00a0kept\u2003whole", "a\nb\na\n\n\na", "#*$%&|<> |||", "x" * 30_000, "same text here\n" * 40]


def test_byte_tables():
    every = bytes(range(256))
    assert every.translate(LOWER) == bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b for b in range(256))
    assert [b for b in every if bytes([b]).translate(ALNUM).strip()] == [b for b in range(256) if chr(b).isascii() and chr(b).isalnum() or b > 127]


# ---- quality rules

def brute_quality(text):
    words = ascii_words(text)
    total = sum(map(len, words))

    def inside(n):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        seen = Counter(grams)
        hit = {k for i, g in enumerate(grams) if seen[g] > 1 for k in range(i, i + n)}
        return len(hit), sum(len(words[k]) for k in hit)

    earlier, lines, line_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if ascii_words(line):
            if line in earlier:
                lines += 1
                line_chars += sum(map(len, ascii_words(line)))
            earlier.add(line)
    repeat = inside(3)[0]
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    good = not failed and (100 * line_chars <= 20 * total or line_chars <= 120)
    limits = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
    good = good and all(100 * inside(n)[1] <= limit * total or inside(n)[1] <= 240 for n, limit in limits.items())
    return len(words), total, len(re.findall(r"[#*$%&|<>]", text or "")), lines, repeat, failed, good


def test_quality_rules(spark):
    rng = random.Random(1)
    texts = ODD + [prose(rng, n, v) for n in (49, 50, 200, 900) for v in (5, 40, 3000)] * 2
    passage = prose(rng, 12, 9000)
    texts += [f"{prose(rng, 100, 9000)} {passage} {prose(rng, k, 9000)} {passage}" for k in (0, 20, 60, 120, 200, 400)]
    out = repetition.with_quality(docs_of(spark, texts)).select("doc_id", "quality_report.*").collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in out}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert {g[-1] for g in got.values()} == {True, False}
    assert repetition.keep_good(docs_of(spark, texts)).count() == sum(g[-1] for g in got.values())
    assert repetition.keep_good(docs_of(spark, [])).columns == docs_of(spark, []).columns


def test_long_texts_with_a_fifth_repeated_fail_and_short_ones_may_say_a_line_twice():
    rng = random.Random(31)
    line = prose(rng, 10, 90000)
    page = " ".join(prose(rng, 40, 90000) + " " + passage + " " + prose(rng, 40, 90000) + " " + passage for passage in (prose(rng, 12, 90000) for _ in range(20)))
    texts = [f"{line}\n{prose(rng, 45, 90000)}\n{line}", page]
    found = repetition.measure([t.encode() for t in texts], repetition.WINDOW_LIMITS, repetition.LINE_LIMIT)
    assert found["kept"].tolist() == [True, False] == [brute_quality(t)[-1] for t in texts]
    assert 10 < 100 * found["dup_chars"][1][-1] / found["word_chars"][1] < 30


# ---- secrets

def brute_class(window):
    """The class of a window by its own characters."""
    digits = re.search("[0-9]", window)
    letters = re.findall("[A-Za-z]", window)
    if not digits or not letters:
        turns = len(re.findall("(?=[a-z][A-Z]|[A-Z][a-z])", window))
        return "mixed" if re.search("[a-z]", window) and re.search("[A-Z]", window) and 4 * turns >= len(window) else None
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", window):
        return "hex"
    return "mixed" if re.search("[a-z]", window) and re.search("[A-Z]", window) else "lower" if re.search("[a-z]", window) else "upper"


def brute_spans(text):
    text = text or ""
    out = []
    for kind, pattern, group, least in secret_scan.BASE:
        flags = re.A | re.I if kind == "assign" else 0
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if any(re.fullmatch(a, m[0]) for a in secret_scan.ALLOWED_RUNS):
            continue
        public = {i for g in re.finditer("[^/=]+", m[0]) if any(re.fullmatch(a, g[0]) for a in secret_scan.ALLOWED) for i in range(*g.span())}
        hit = set()
        for i in range(len(m[0]) - secret_scan.WINDOW + 1):
            window = m[0][i:i + secret_scan.WINDOW]
            kind = brute_class(window)
            if kind is None or public & set(range(i, i + secret_scan.WINDOW)):
                continue
            entropy = -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())
            if entropy >= secret_scan.LIMITS[kind] - 1e-9:
                hit.update(range(i, i + secret_scan.WINDOW))
        edges = sorted(hit)
        starts = [k for k in edges if k - 1 not in hit]
        ends = [k + 1 for k in edges if k + 1 not in hit]
        out += [("entropy", m.start() + a, m.start() + b) for a, b in zip(starts, ends)]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]), s[2]))


def secret_texts():
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    hexa = hashlib.sha1(b"x").hexdigest()
    return ODD + [
        f'token = "{hexa}" and password:abc', "PASSWORD='longenough' passwd: x Secret=aaaaaa", f"é {key}; {hexa}", "AKIA" + "A1B2C3D4E5F6G7H8", "AKIAABC AKIA" + "Z" * 40,
        "api-key=abcdef api_key: 'abcdefgh' APIKEY=secret=abcdefg", "123e4567-e89b-12d3-a456-426614174000", "the-quick-brown-fox-jumps-over", "ſecret=abcdefgh toKen=abcdefgh",
        f"{'a' * 50}{key}{'b' * 50}", "example" + key, "abcdefghijklmnopqrstuvwxyz0123", "0" * 24 + " " + "a" * 23, key * 200, f"x={key[:19]} y={key[:20]}",
        f"id={hexa[:20]}", f"KEY={hexa.upper()[:32]}", f"/your-app/hooks/{key}", f"id=123e4567-e89b-12d3-a456-426614174000/{key}", f"Docs/UserGuide/example/{key}/sampleFiles",
    ]


def test_secret_scan(spark):
    texts = secret_texts()
    rows = secret_scan.with_spans(docs_of(spark, texts)).select("doc_id", "secret_spans", secret_scan.base_digest(F.col("secret_spans")).alias("sha")).collect()
    for r in rows:
        want = brute_spans(texts[r["doc_id"]])
        assert [(s["kind"], s["start"], s["end"]) for s in r["secret_spans"]] == want, texts[r["doc_id"]]
        assert r["sha"] == secret_scan.digest(want)
    found = {s[0] for t in texts for s in brute_spans(t)}
    assert found == set(secret_scan.KINDS)


def test_glue_and_public_neighbours_do_not_hide_a_key():
    rng = random.Random(8)
    allowed = re.compile("|".join(f"(?:{a})" for a in secret_scan.ALLOWED))
    spans = lambda t: {s for s in secret_scan.scan(t, secret_scan.LIMITS, allowed) if s[0] == "entropy"}
    alone = glued = 0
    for _ in range(200):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(20))
        alone += bool(spans(key))
        glued += bool(spans(f"id={key}"))
    assert glued >= alone > 180
    secret = "".join(rng.sample("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 40))
    (kind, start, end), = spans(f"/your-app/hooks/{secret}")
    assert 9 <= start <= 16 and end == 56
    assert not spans(f"example{secret}") and not spans("123e4567-e89b-12d3-a456-426614174000")


def test_redaction_masks_each_union_once(spark):
    texts = secret_texts()
    got = {r[0]: r[1] for r in docs_of(spark, texts).select("doc_id", secret_scan.redacted(F.col("text"), "\0")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        hidden = {k for _, a, b in brute_spans(t) for k in range(a, b)}
        assert got[i].replace("\0", "") == "".join(c for k, c in enumerate(t) if k not in hidden)


# ---- token counts

def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    points = [c for c in (chr(rng.randrange(0x110000)) for _ in range(4000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ODD + ["I'll don't WE'RE\u2019s 12ab  \n\n  x\t y", "<|endoftext|> a<|endoftext|>b <|endof text|>", "日本語 テキスト 🎉🎉", "\u00a0\u3000 x\u200b\u0000y",
                   *("".join(points[k:k + 40]) for k in range(0, 2000, 40)), *("a".join(points[k:k + 40]) for k in range(2000, 3900, 40))]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.with_token_count(docs_of(spark, texts), path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) if t else 0 for i, t in enumerate(texts)}


def test_token_counts_of_documents(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = token_counts.with_token_count(docs, path).select("text", "n_tokens").collect()
    assert [r["n_tokens"] for r in rows] == [len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows]


# ---- decontamination

def brute_contamination(texts, items, window=13):
    wins = {}
    for name, t in items:
        w = alnum_words(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[i:i + window]), set()).add(name)
    out = {}
    for d, t in enumerate(texts):
        w, hit, names = alnum_words(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found
        out[d] = (len(w), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_WORDS", block)
    rng = random.Random(4)
    items = [(1, prose(rng, 40, 60)), (20, prose(rng, 13, 60)), (3, "Rare-phrase Only"), (4, ""), (5, None), (6, "w1 " * 20), (7, prose(rng, 12, 60)), (7, "twice 1 2")]
    passage = [alnum_words(t) for _, t in items]
    texts = ODD + [prose(rng, 400, 60) for _ in range(8)] + ["w1 " * 60, "rare phrase! only", "RARE_phrase only. rare phrase only"]
    texts += [prose(rng, 20) + " " + " ".join(passage[0][a:a + 13]).upper() + " " + prose(rng, 20) for a in (0, 5, 27)] * 2
    texts += [" ".join(passage[0]), " ".join(passage[0][:12]), "x, ".join(passage[1]), "; ".join(passage[1] + passage[6]), "Twice (1) 2"]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination.with_contamination(docs_of(spark, texts), frame).collect()
    got = {r["doc_id"]: (r["contamination"]["n_words"], r["contamination"]["n_hit"], list(r["contamination"]["items"])) for r in rows}
    want = brute_contamination(texts, [(str(i), t) for i, t in items])
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) >= 12
    for r in rows:
        spans = r["contamination"]["spans"]
        assert sum(s["end"] - s["start"] for s in spans) == r["contamination"]["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:]))


def test_decontamination_without_rows(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    rows = contamination.with_contamination(docs_of(spark, ["a b", None]), nothing).select("contamination.*").collect()
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in rows) == [(0, 0, []), (2, 0, [])]
    assert contamination.with_contamination(docs_of(spark, []), nothing).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.integers(1, 6))
def test_fm_index(symbols, length):
    text = np.array([*symbols, 0], dtype=np.int64)
    index = contamination.FMIndex(text, sample=4)
    patterns = np.array(sorted({tuple(int(x) for x in text[i:i + length]) for i in range(len(text) - length + 1) if 0 not in text[i:i + length]} | {(9,) * length, (1,) * length}))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns.tolist(), low, high):
        want = [i for i in range(len(text) - length + 1) if text[i:i + length].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ---- packing

def brute_pack(rows, capacity):
    """Best fit by looking at every open bin: number of bins and their loads."""
    bins = []
    for size, source, cluster in sorted(rows, key=lambda r: -r[0]):
        full, need = divmod(size, capacity)
        bins += [[0, {source}, {cluster}] for _ in range(full)]
        if full and not need:
            continue
        fits = [b for b in bins if b[0] >= need and b[0] > 0 - 1 and not (source is not None and source in b[1]) and not (cluster is not None and cluster in b[2])]
        fits = [b for b in fits if len(b) == 3]
        best = min(fits, key=lambda b: b[0], default=None)
        if best is None:
            best = [capacity, set(), set()]
            bins.append(best)
        best[0] -= need
        best[1].add(source)
        best[2].add(cluster)
    return sorted(b[0] for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 45), st.sampled_from([None, "a", "b", "c", "d"]), st.sampled_from([None, 1, 2, 3, 4, 5, 6])), max_size=60))
def test_pack_shard(rows):
    placed = packing.pack_shard([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], 20)
    pieces, members = Counter(), {}
    for row, start, length, number, position in placed:
        pieces[row] += length
        members.setdefault(number, []).append((position, length, row, start))
    assert pieces == Counter({i: r[0] for i, r in enumerate(rows)})
    for found in members.values():
        at = 0
        for position, length, _, _ in sorted(found):
            assert position == at
            at += length
        assert at <= 20
        for k in (1, 2):
            values = [rows[r][k] for _, _, r, _ in found if rows[r][k] is not None]
            assert len(values) == len(set(values))
    # the loads are those of a search through all bins; full pieces of long documents are never reopened
    assert sorted(20 - sum(x[1] for x in f) for f in members.values()) == brute_pack(rows, 20)


def test_packing_keeps_every_word(spark):
    rng = random.Random(5)
    texts = ODD + [prose(rng, rng.randrange(1, 300)) for _ in range(200)]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, texts[:3]))
    out = packing.pack(docs, packing.word_count(F.col("text")), cluster=F.col("text"), capacity=100, shard_rows=50).collect()
    want = Counter({i: len(ascii_words(t)) for i, t in enumerate(texts)})
    for i in range(3):
        want[i] += len(ascii_words(texts[i]))
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == want and {r["doc_id"] for r in out} == set(range(len(texts)))
    load = Counter()
    for r in out:
        load[r["bin"]] += r["length"]
    assert max(load.values()) <= 100
    assert packing.pack(docs_of(spark, []), packing.word_count(F.col("text"))).count() == 0


# ---- URL filter

def test_url_filter(spark):
    rules = [url_filter.Rule.parse("allow", "org/"), url_filter.Rule.parse("block", "example.org/es/"), url_filter.Rule.parse("block", "com/de/")]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Bad.NET/x/?q#f", "http://bad.net/x.html", "http://m.bad.net/x", "http://bad.net/y", "https://a.org", "https://a.org/",
            "https://x.EXAMPLE.org/es/1", "https://example.org/es", "http://notorg/", "http://a.com/de/1?x", "http://a.com/fr/://b.org/", "x://bad.net/x://y", "http://bad.net/x#a"]
    listed = ["https://bad.net/x/", "http://other.net/", None, "junk", "https://bad.net/x"]
    pages = spark.createDataFrame([(i, u, "k", "b") for i, u in enumerate(urls)], "page_id long, url string, key string, block string")
    lists = spark.createDataFrame([(u,) for u in listed], "url string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, lists, rules).collect()}

    def parts(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return (m[1].translate(LOWERED), m[2]) if m else ("", "")

    def key(u):
        host, path = parts(u)
        return host and re.sub(r"^(www|m)\.", "", host) + re.sub(r"(\.html)?/*$", "", path)

    keys = {key(u) for u in listed} - {""}
    for i, u in enumerate(urls):
        host, path = parts(u)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        verdict = best.verdict if best else "block" if key(u) in keys else "allow"
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, best and best.text, verdict), u
        assert rows[i]["key"] == "k" and rows[i]["block"] == "b"
    assert [rows[i]["verdict"] for i in (4, 5, 6, 7)] == ["block", "block", "block", "allow"]
    assert url_filter.judge(pages, lists.limit(0), []).where("verdict = 'block'").count() == 0
    assert url_filter.judge(pages.limit(0), lists, rules).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.bloom_blocks(keys, "key", 300)
    probe = lambda df: url_filter.bloom_probe(df, "key", bloom, 300).where("possible").count()
    assert probe(keys) == 5000
    assert probe(spark.range(5000).select(F.concat(F.lit("other"), "id").alias("key"))) < 250


# ---- language models

def test_lm_scores_prefer_the_target(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["red", "green", "blue"]) for _ in range(60)) for _ in range(30)]
    bad = [" ".join(rng.choice(["one", "two", "three"]) for _ in range(60)) for _ in range(30)]
    docs = docs_of(spark, good + bad + [None, "", "unseen", "red green", "RED green"])
    ids = spark.createDataFrame([(i,) for i in range(20)] + [(0,), (None,)], "doc_id long")
    rows = {r["doc_id"]: r["lm"] for r in lm_scoring.with_score(docs, ids).collect()}
    assert max(rows[i]["score"] for i in range(30)) < min(rows[i]["score"] for i in range(30, 60))
    assert rows[60]["score"] is None and rows[61]["score"] is None and rows[61]["n_tokens"] == 0
    assert rows[63]["loss_units"] == rows[64]["loss_units"]
    assert lm_scoring.with_score(docs.limit(0), ids).count() == 0
    flat = lm_scoring.with_score(docs, ids.limit(0)).select("lm.score").collect()
    assert all(r["score"] is None or math.isfinite(r["score"]) for r in flat)


def brute_units(texts, targets):
    """Loss units of every text from the counts of all words and all bigrams."""
    words = [alnum_words(t) for t in texts]
    base, goal, pairs, good = Counter(), Counter(), Counter(), Counter()
    for i, ws in enumerate(words):
        for count, ours in ((base, ws), (pairs, list(zip(ws, ws[1:])))):
            count.update(ours)
        if i in targets:
            goal.update(ws)
            good.update(zip(ws, ws[1:]))
    n, m, size = sum(base.values()), sum(goal.values()), len(base)
    p = {w: (base[w] + 1) / (n + size + 1) for w in base}
    q = {w: (goal[w] + 1) / (m + size + 1) for w in base}
    unit = lambda bits: math.floor(bits * 1e6 + 0.5)
    out = []
    for ws in words:
        units = unit(np.log2(p[ws[0]]) - np.log2(q[ws[0]])) if ws else 0
        for c, w in zip(ws, ws[1:]):
            units += unit(np.log2((pairs[c, w] + 200 * p[w]) / (base[c] + 200)) - np.log2((good[c, w] + 200 * q[w]) / (goal[c] + 200)))
        out.append(units)
    return out


def test_lm_keeps_rare_words_and_bigrams_of_large_corpora(spark, monkeypatch):
    # Several chunks in a task, and more parts of the key range than chunks.
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 200_000)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 50_000)
    rng = random.Random(16)
    # More than 2^19 words: one occurrence is below any share of them.
    texts = [prose(rng, 5000, 200) for _ in range(110)] + ["rare words stand here once", "other seldom seen terms", None, "", "w1 rare"]
    targets = {0, 1, 2, 110, 114}
    ids = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    rows = {r["doc_id"]: r["lm"] for r in lm_scoring.with_score(docs_of(spark, texts, 4), ids).collect()}
    want = brute_units(texts, targets)
    assert [rows[i]["loss_units"] for i in range(len(texts))] == want
    assert [rows[i]["n_tokens"] for i in range(len(texts))] == [len(alnum_words(t)) for t in texts]


def shuffled_bytes(spark):
    """Bytes that the session has written to exchanges so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_lm_texts_are_in_no_exchange(spark):
    # Few words in any order: the texts are large when compressed, and their bigrams are few.
    rng = random.Random(17)
    words = [prose(rng, 1, 10 ** 6) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(100_000)) for _ in range(4)]
    least = sum(len(zlib.compress(t.encode(), 9)) for t in texts)
    docs, ids = cut_lineage(docs_of(spark, texts, 2)), spark.createDataFrame([(0,)], "doc_id long")
    before = shuffled_bytes(spark)
    rows = {r["row"].split(":")[0]: r["loss_units"] for r in lm_scoring.loss_differences(docs, ids).collect()}
    assert shuffled_bytes(spark) - before < least / 4
    assert [rows[str(i)] for i in range(4)] == brute_units(texts, {0})


def test_lm_blobs_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 5, 4000):
        columns = rng.integers(-2 ** 62, 2 ** 62, (3, n))
        columns[2] = 1
        assert (lm_scoring._unpack(lm_scoring._pack(*columns), 3) == columns).all()


# ---- near copies

def brute_groups(texts, k, up, down):
    sets = []
    for t in texts:
        w = ascii_words((t or "").translate(LOWERED))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common * down >= (len(sets[i]) + len(sets[j]) - common) * up:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in range(len(texts))}


def varied(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("shingle,up,down", [(3, 85, 100), (5, 4, 5)])
def test_near_copies(spark, shingle, up, down):
    rng = random.Random(7)
    texts = ODD + ["a b", "A B", "a b c", "One"] + [prose(rng, 200, 5000) for _ in range(10)]
    for base in texts[-10:-5]:
        texts += [varied(rng, base, c) for c in (0, 1, 2, 3, 4, 5, 6, 8, 10, 14)]
    chain = texts[-1]
    for _ in range(25):  # each is near the one before, the ends are far apart
        chain = varied(rng, chain, 2)
        texts.append(chain)
    hot = prose(rng, 300, 5000)
    texts += [varied(rng, hot, rng.randrange(1, 7)) for _ in range(120)] + [hot.upper()] * 30
    shared = prose(rng, 80, 5000)  # a common passage that is too short to link
    texts += [f"{shared} {prose(rng, 60, 5000)}" for _ in range(60)]
    rng.shuffle(texts)
    rows = near_dups.groups(docs_of(spark, texts), shingle=shingle, up=up, down=down).collect()
    want = brute_groups(texts, shingle, up, down)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == want
    kept = {r["doc_id"] for r in near_dups.keep_one(docs_of(spark, texts), shingle=shingle, up=up, down=down).collect()}
    assert kept == {i for i, w in want.items() if w[2]}


def test_near_copies_of_loose_groups_are_never_listed_as_pairs(spark, monkeypatch):
    """Many texts just below the threshold, in blocks that meet: right groups, and no table of pairs that outgrows the texts."""
    rng = random.Random(17)
    base = prose(rng, 200, 5000)
    texts = [varied(rng, base, 5) for _ in range(150)]
    texts += [varied(rng, t, 1) for t in texts[:20]] + [prose(rng, 100, 5000) for _ in range(5)]
    written = []

    def counted(df):
        out = cut_lineage(df)
        if df.columns[:2] == ["a", "b"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(near_dups, "BLOCK", 16)
    monkeypatch.setattr(near_dups, "cut_lineage", counted)
    rows = near_dups.groups(docs_of(spark, texts), shingle=3, up=85, down=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == brute_groups(texts, 3, 85, 100)
    assert max(written) <= 2 * len(texts)


def test_near_copies_of_odd_tables(spark):
    assert near_dups.groups(docs_of(spark, [])).count() == 0
    assert near_dups.keep_one(docs_of(spark, [])).count() == 0
    twice = docs_of(spark, ["a b c", "a b c", None, ""])
    twice = twice.unionByName(twice).unionByName(twice.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    rows = near_dups.groups(twice).collect()
    assert len(rows) == 9 and {r["component_id"] for r in rows if r["doc_id"] in (0, 1, None)} == {0}
    stay = near_dups.keep_one(twice)
    assert stay.columns == twice.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in stay.collect()) == [0, 2, 2, 3, 3]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(8)
    for n, same in ((1, 1), (3, 2), (50, 40), (400, 300), (5000, 4000)):
        common = rng.integers(0, 1 << 63, same, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - same, dtype=np.uint64)])) for _ in range(2))
        found = np.mean(near_dups.sketch(a, 1024) == near_dups.sketch(b, 1024))
        assert abs(found - same / (2 * n - same)) < 0.1


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for pair in links if pair[0] != pair[1] for n in pair}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# ---- repeated passages

def brute_removed(texts, length):
    places = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        places.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if places[b[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        out.append(bytes(c for c, m in zip(b, mask) if not m))
    return out


def test_repeats(spark):
    rng = random.Random(10)
    passages = [prose(rng, n, 4000) for n in (60, 75, 78, 90, 150, 300)]
    texts = ODD + ["z" * 399, "z" * 400, "ab" * 300, "q" * 900]
    for _ in range(60):
        parts = [prose(rng, rng.randrange(0, 120), 4000)]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 60)
            parts += [p[a:len(p) - rng.randrange(0, 60)], prose(rng, rng.randrange(0, 100), 4000)]
        texts.append("é".join(parts))
    texts += texts[-3:]
    got = {r["row"]: r["kept"] for r in repeats.removals(docs_of(spark, texts), with_text=True).collect()}
    names = {r["doc_id"]: r["name"] for r in docs_of(spark, texts).select("doc_id", row_key("doc_id", "text").alias("name")).collect()}
    want = brute_removed(texts, repeats.LENGTH)
    changed = 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert bytes(got.get(names[i], b)) == want[i], i
        changed += want[i] != b
    assert changed > 30 and changed < len(texts)


def test_a_unit_holds_equal_rows_once(spark, monkeypatch):
    seen = []

    def spy(units, *rest, ask=repeats.shared_asks):
        seen.append(units.agg(F.max(F.size("texts") - F.size(F.array_distinct("texts.row")))).first()[0])
        return ask(units, *rest)

    monkeypatch.setattr(repeats, "shared_asks", spy)
    rows = [(7, "the same long row " * 60)] * 300 + [(i, prose(random.Random(i), 200)) for i in range(5)]
    assert [r["row"][:2] for r in repeats.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()] == ["7:"]
    assert seen == [0]


def test_training_rows_take_an_id_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(500)] + [(2, "other"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.training_rows(docs, labels, F.lit(True)).collect())) == [(1, "text 0", 1), (2, "other", 0)]


def test_repeated_rows_repeat_each_other(spark):
    text = prose(random.Random(11), 120, 4000)
    one = docs_of(spark, [text])
    assert repeats.removals(one).count() == 0
    both = repeats.removals(one.unionByName(one), with_text=True).collect()
    assert [bytes(r["kept"]) for r in both] == [b""]
    assert repeats.removals(docs_of(spark, [])).count() == 0


# ---- toxicity

def one_error(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        wrong = [i for i in range(len(a)) if a[i] != b[i]]
        return len(wrong) == 1 or len(wrong) == 2 and wrong[1] == wrong[0] + 1 and a[wrong[0]] == b[wrong[1]] and a[wrong[1]] == b[wrong[0]]
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=5, max_size=8), min_size=1, max_size=6), st.text("abcd", max_size=10))
def test_lexicon_finds_misspelled_terms(terms, word):
    lexicon = toxicity.Lexicon(terms, [])
    want = 2 if word in terms else int(any(one_error(t, word) for t in terms))
    assert lexicon.match(word) == want


def test_quoted_terms_count_less():
    model = toxicity.Scorer(toxicity.Lexicon(["idiot"], ["achli"]))
    plain, quoted = model.features("you are an idiot and that is all"), model.features('they wrote "what an idiot" in the report')
    assert plain[0] > quoted[0] and quoted[2] > plain[2] == 0
    assert model.features("an idoit or id1ot")[1] > 0
    assert model.features("ACHLIchkeit")[0] > 0
    assert model.features(None) == model.features("") == model.features("nice words") == (0.0,) * toxicity.N_FEATURES


@pytest.mark.parametrize("text", ["“idiot”", "idiot…", "¡idiota!", "idiot—you", "an\u00a0idiot\u00a0here", "you—idoit…"])
def test_terms_next_to_unicode_punctuation_count(text):
    model = toxicity.Scorer(toxicity.Lexicon(["idiot", "idiota"], []))
    assert sum(model.features(text)[:3]) > 0
    assert {"idiot", "idiota", "idoit"} & toxicity._candidates(text)
    assert model.features("they wrote “idiot” in it") == model.features('they wrote "idiot" in it')


@settings(max_examples=200, deadline=None)
@given(st.text("aB1_ é\u0301ü—…“”\"¡¿\u00a0\u200b😀कि.", max_size=20))
def test_words_are_the_tokens(text):
    tokens = toxicity._TOKEN.findall(text.translate(toxicity._ASCII_LOWER))
    assert [w.decode() for w in toxicity._words(text)] == [t for t in tokens if t not in toxicity._MARKS]


def test_rare_inflections_of_a_stem_keep_their_misspellings(spark):
    forms = ["grumbler", "grumbling", "grumbles"]
    rows = [(i, f"{forms[i % 3]} here{i}", 1) for i in range(120)] + [(i, f"calm here{i}", 0) for i in range(120, 360)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert [lexicon.match(w) for w in ("grumbler", "gurmbler", "grmbling", "grumbels", "gurmbles")] == [2, 1, 1, 2, 1]


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(toxicity.training_rows(docs, labels, ~held_out))
    rows = docs.join(labels, "doc_id").where(held_out).select("toxic", toxicity.toxicity(F.col("text"), model).alias("score")).collect()
    caught = [r["score"] >= 0.7 for r in rows if r["toxic"]]
    blamed = [r["score"] >= 0.7 for r in rows if not r["toxic"]]
    assert np.mean(caught) > 0.85 and np.mean(blamed) < 0.01


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a b", None, ""])
    model = toxicity.fit(toxicity.training_rows(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)))
    assert {r[0] for r in docs.select(toxicity.toxicity(F.col("text"), model)).collect()} == {0.0}
