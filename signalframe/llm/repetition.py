"""Quality rules: how much of a text lies inside repeated word windows and repeated lines.

Rolling hashes of several window lengths over the words of a batch of texts find the windows that occur
twice in the same text; the characters inside such windows, over all characters inside words, must stay
under a limit per length.  A few repeated characters are no fault, however short the text.  A window of n words can only repeat where its leading short window repeats, so
the longer lengths look at those places alone.

Null and empty texts have no words and fail; a text of any length is handled whole; equal rows get equal
results; an empty table gives an empty table.  ``with_quality`` adds one column and keeps all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Words, as_bytes, chunks, covered, hash_words, mix, sums, window_hashes

#: Percent of the characters inside words that repeated windows of so many words may hold.
WINDOW_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of the characters inside words that repeated lines (all but the first of each) may hold.
LINE_LIMIT = 20
#: Characters that may repeat in any text, so that a short one may say one line twice: as much in repeated lines, and twice as
#: much in repeated windows, which count the first occurrence too.
FREE_CHARS = 120
#: Fixed rule: fewer words fail, and more than this percent of words in repeated windows of BASE_WINDOW words.
BASE_WORDS, BASE_REPEATS, BASE_WINDOW = 50, 50, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
SCHEMA = T.StructType([
    *[T.StructField(c, T.LongType()) for c in COUNTS],
    T.StructField("dup_chars", T.ArrayType(T.LongType())),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
])
_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def _points(b: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(b) if b.isascii() else len(b.decode("utf-8", "replace"))


def _lines(b: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the code points of their words."""
    seen: set[bytes] = set()
    n = chars = 0
    for line in b.split(b"\n"):
        if line in seen:
            n += 1
            chars += _points(line.translate(None, _SPACES))
        elif line and not line.isspace():
            seen.add(line)
    return n, chars


def measure(texts: list[bytes], limits: dict[int, int], line_limit: int) -> dict[str, np.ndarray | list]:
    """Counts and verdict of every text; see the module's text."""
    n = len(texts)
    w = Words(texts)
    hashes = hash_words(w.vocabulary)[w.ids] if len(w.ids) else np.zeros(0, np.uint64)
    chars = np.fromiter(map(_points, w.vocabulary), dtype=np.int64, count=len(w.vocabulary))[w.ids]
    out: dict = {"n_words": w.counts, "word_chars": sums(chars, w.owner, n)}
    out["n_symbols"] = np.fromiter((len(t) - len(t.translate(None, _SYMBOLS)) for t in texts), dtype=np.int64, count=n)
    lines = [_lines(t) for t in texts]
    out["n_dup_lines"] = np.array([a for a, _ in lines], dtype=np.int64)
    out["dup_line_chars"] = np.array([b for _, b in lines], dtype=np.int64)
    ends = w.starts + w.counts
    salt = mix(np.arange(n, dtype=np.uint64), 7)

    def repeated(length: int, places: np.ndarray, rolled: np.ndarray) -> np.ndarray:
        """The places whose window lies in its text and occurs there twice."""
        places = places[places + length <= ends[w.owner[places]]]
        keys = rolled[places] ^ salt[w.owner[places]]
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        return np.sort(places[order[same[:-1] | same[1:]]])

    base = repeated(BASE_WINDOW, np.arange(max(0, len(hashes) - BASE_WINDOW + 1)), window_hashes(hashes, BASE_WINDOW))
    mask = covered(len(hashes), base, BASE_WINDOW)
    out["n_repeat_words"] = sums(mask, w.owner, n)
    failed = (w.counts < BASE_WORDS) | (100 * out["n_repeat_words"] > BASE_REPEATS * w.counts)
    good = ~failed & ((100 * out["dup_line_chars"] <= line_limit * out["word_chars"]) | (out["dup_line_chars"] <= FREE_CHARS))
    shares = []
    for length, limit in sorted(limits.items()):
        rolled = window_hashes(hashes, length)
        start = base if length >= BASE_WINDOW else np.arange(len(rolled))
        inside = covered(len(hashes), repeated(length, start[start < len(rolled)], rolled), length)
        dup = sums(chars * inside, w.owner, n)
        shares.append(dup)
        good &= (100 * dup <= limit * out["word_chars"]) | (dup <= 2 * FREE_CHARS)
    out["dup_chars"] = np.stack(shares, 1) if shares else np.zeros((n, 0), np.int64)
    out["base_failed"], out["kept"] = failed, good
    return out


def quality(text: Column, limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT) -> Column:
    """Struct of counts and verdict for a text column; ``dup_chars`` follows the window lengths in order."""
    limits = dict(WINDOW_LIMITS if limits is None else limits)

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            parts = [measure(as_bytes(part), limits, line_limit) for _, part in chunks(texts)] or [measure([], limits, line_limit)]
            joined = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            joined["dup_chars"] = joined["dup_chars"].tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(joined[f.name], type=pa.list_(pa.int64()) if f.name == "dup_chars" else None) for f in SCHEMA.fields], names=SCHEMA.names)

    return F.arrow_udf(batches, SCHEMA, F.ArrowUDFType.SCALAR_ITER)(text)


def with_quality(docs: DataFrame, text: str = "text", name: str = "quality_report", **options) -> DataFrame:
    """``docs`` with one more struct column ``name``."""
    return docs.withColumn(name, quality(F.col(text), **options))


def keep_good(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    return docs.where(quality(F.col(text), **options)["kept"])
