"""Secret scans: fixed patterns plus sliding-window entropy over candidate strings.

Spans are (kind, start, end) in code points, end exclusive:

* ``assign``, ``access``, ``hex``: the fixed patterns of ``BASE``, leftmost and non-overlapping per kind.
* ``entropy``: inside a candidate string, every run of windows of ``WINDOW`` characters whose Shannon entropy
  reaches the limit of the window's own character class, so that what is glued to a key does not hide it.  Entropy
  and class of a window follow from counts that are updated by one character in and one out per step.  Plain words,
  numbers and paths have no class.  The allow list is held against the segments between ``/`` and ``=``: no window
  touches an allow-listed segment, while its neighbours are judged as ever.

Null and empty texts have no spans; texts of any length are scanned whole; rows are independent, so equal
rows get equal results and an empty table gives an empty table.  ``redact`` replaces spans in the text and
leaves all other columns as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns: kind, expression, group that is measured, least length.
BASE = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Order in which kinds at one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits per character that a window must reach, by its class.  A window of 20 characters has 4.32 at most.
LIMITS = {"hex": 3.0, "lower": 3.6, "upper": 3.6, "mixed": 3.9}
#: Segments that are never reported: identifiers that look random but are public by their form.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i:.*(?:example|sample|placeholder|changeme|your[_-]).*)",
    r"(?i:.*(?:abcdefgh|01234567|12345678|qwertyui).*)",
)
#: Whole candidates that are never reported: words of letters, joined.
ALLOWED_RUNS = (r"(?:[A-Za-z]+[-_/+=])+[A-Za-z]+",)
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SPANS = T.ArrayType(SPAN)

_ASSIGN = re.compile(BASE[0][1], re.A | re.I)
_ACCESS = re.compile(BASE[1][1])
_HEX = re.compile(r"[0-9a-f]{%d,}" % BASE[2][3])  # a maximal run that is long enough is the fixed pattern's match
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_SEGMENT = re.compile(r"[^/=]+")
_RUNS = re.compile("|".join(ALLOWED_RUNS))
#: Texts without any of these have no span; this form is what the linear-time matcher of Arrow takes.
_ANY = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_=-]{%d}" % WINDOW
_GAIN = [0.0, *(k * math.log2(k) for k in range(1, WINDOW + 2))]  # one more: a character comes in before one goes out


def _traits(c: str) -> tuple[int, int, int, int, int]:
    """Digit, lower case, upper case, no lower-case hex digit, no upper-case hex digit."""
    return c in "0123456789", "a" <= c <= "z", "A" <= c <= "Z", c not in "0123456789abcdef", c not in "0123456789ABCDEF"


_TRAITS = {c: _traits(c) for c in map(chr, range(128))}


def _class_of(digits: int, lower: int, upper: int, no_lower_hex: int, no_upper_hex: int, turns: int) -> str | None:
    """The class of a window from its counts; None for words and numbers, which are no secrets."""
    if not digits or not (lower or upper):
        # Letters alone are words unless the case changes again and again, as it does in random keys.
        return "mixed" if lower and upper and 4 * turns >= WINDOW else None
    if not no_lower_hex or not no_upper_hex:
        return "hex"
    return "mixed" if lower and upper else "lower" if lower else "upper"


def _turns(a: str, b: str) -> bool:
    """Two letters of different case."""
    return a.isalpha() and b.isalpha() and a.isupper() != b.isupper()


def entropy_spans(candidate: str, limits: dict[str, float], allowed: re.Pattern) -> list[tuple[int, int]]:
    """Maximal unions of windows that reach the limit of their class and touch no allow-listed segment."""
    if _RUNS.fullmatch(candidate):
        return []
    # entropy >= limit, as sum of k log2 k <= need
    need = {kind: (math.log2(WINDOW) - limit) * WINDOW + 1e-9 for kind, limit in limits.items()}
    easiest = max(need.values())
    public = [s.span() for s in _SEGMENT.finditer(candidate) if allowed.fullmatch(s[0])]
    counts: dict[str, int] = {}
    traits, turns = [0] * 5, 0
    total, out, free = 0.0, [], 0  # no window may start before ``free``
    for i, c in enumerate(candidate):
        k = counts.get(c, 0)
        total += _GAIN[k + 1] - _GAIN[k]
        counts[c] = k + 1
        traits = [x + y for x, y in zip(traits, _TRAITS[c])]
        turns += i > 0 and _turns(candidate[i - 1], c)
        start = i - WINDOW + 1
        if start > 0:
            old = candidate[start - 1]
            k = counts[old]
            total += _GAIN[k - 1] - _GAIN[k]
            counts[old] = k - 1
            traits = [x - y for x, y in zip(traits, _TRAITS[old])]
            turns -= _turns(old, candidate[start])
        while public and public[0][0] <= i:
            free = public.pop(0)[1]
        if start >= free and total <= easiest:
            kind = _class_of(*traits, turns)
            if kind is not None and total <= need[kind]:
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
    return out


def scan(text: str, limits: dict[str, float], allowed: re.Pattern) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= BASE[0][3]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= BASE[1][3]]
    for m in _CANDIDATE.finditer(text):
        out += [("entropy", m.start() + a, m.start() + b) for a, b in entropy_spans(m[0], limits, allowed)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(text: Column, limits: dict[str, float] | None = None, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Array of spans for a text column, never null."""
    limits, allow = dict(LIMITS if limits is None else limits), "|".join(f"(?:{a})" for a in allowed) or r"(?!)"

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pattern = re.compile(allow)
        for texts in columns:
            rows: list[list[dict]] = [[] for _ in range(len(texts))]
            hits = pc.fill_null(pc.match_substring_regex(texts, _ANY), False)
            for i in pc.indices_nonzero(hits).to_pylist():
                rows[i] = [{"kind": k, "start": a, "end": b} for k, a, b in scan(texts[i].as_py(), limits, pattern)]
            yield pa.array(rows, type=pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(batches, SPANS, F.ArrowUDFType.SCALAR_ITER)(text)


def with_spans(docs: DataFrame, text: str = "text", name: str = "secret_spans", **options) -> DataFrame:
    """``docs`` with one more column ``name``."""
    return docs.withColumn(name, secret_spans(F.col(text), **options))


def redacted(text: Column, mask: str = "[REDACTED]", limits: dict[str, float] | None = None, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """The text with every maximal union of spans replaced by ``mask``; a null stays null.  One Python worker per task."""
    limits, allow = dict(LIMITS if limits is None else limits), "|".join(f"(?:{a})" for a in allowed) or r"(?!)"

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pattern = re.compile(allow)
        for texts in columns:
            out = texts.to_pylist()
            hits = pc.fill_null(pc.match_substring_regex(texts, _ANY), False)
            for i in pc.indices_nonzero(hits).to_pylist():
                parts, end = [], 0
                for _, start, stop in scan(out[i], limits, pattern):
                    if start >= end:
                        parts += [out[i][end:start], mask]
                    end = max(end, stop)
                out[i] = "".join([*parts, out[i][end:]])
            yield pa.array(out, type=texts.type)

    return F.arrow_udf(batches, T.StringType(), F.ArrowUDFType.SCALAR_ITER)(text)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_digest(spans: Column) -> Column:
    """SHA-256 of the spans of the fixed patterns, in hex."""
    return F.sha2(span_text(F.filter(spans, lambda s: s["kind"] != "entropy")), 256)


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The same for spans in Python."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "entropy").encode()).hexdigest()
