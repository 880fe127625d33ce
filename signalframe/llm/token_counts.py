"""Token counts with a whole-token shortcut.

A byte-level BPE tokenizer splits a text into pre-tokens and merges each for itself.  Which vocabulary strings
come out as one token when encoded alone is proved once, by encoding every one of them; a pre-token among them
counts 1 without merging.  Only the other pre-tokens are merged, once per distinct pre-token and task.

The split is done by a regular expression.  Whether it classes every code point as the tokenizer does is also
proved, by comparing both code point by code point; texts with a code point where they differ are given to
the tokenizer as a whole.  Special strings inside a text are cut out first, as the library does.

The tokenizer file must exist at the same path on every executor.  Null and empty texts count 0; texts of
any length are counted whole; equal rows get equal counts; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the split of this tokenizer family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points from here on are not compared; texts that have one are given to the tokenizer.
PROVED = 0x30000
#: Distinct merged pre-tokens that a task remembers; beyond it the memory starts anew.
REMEMBERED = 600_000


@lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _specials(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that alone encode as exactly one token: the proof that the shortcut is right."""
    tokenizer = _load(path)
    special = set(_specials(path))
    strings = [s for s in {tokenizer.decode([i]) for i in range(tokenizer.get_vocab_size())} if s and s not in special and "�" not in s]
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    return sorted(s for s, e in zip(strings, found) if len(e.ids) == 1)


def doubtful_points(path: str) -> str:
    """Code points that the tokenizer's split and ``SPLIT`` class differently, below ``PROVED``."""
    import regex

    tokenizer, split = _load(path), regex.compile(SPLIT)

    def agree(text: str) -> bool:
        return [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in split.finditer(text)]

    def differing(points: list[str]) -> list[str]:
        # Next to a letter and a digit, the cuts show whether a code point is letter, digit, blank or other.
        if not points or agree("".join(f"a{c}1{c}\n" for c in points)):
            return []
        half = len(points) // 2
        return points if half == 0 else differing(points[:half]) + differing(points[half:])

    points = [chr(p) for p in range(PROVED) if not 0xD800 <= p < 0xE000]
    return "".join(c for k in range(0, len(points), 512) for c in differing(points[k:k + 512]))


def _ranges(points: str) -> str:
    """A character class of the given code points for the regular expressions of Arrow and Python."""
    out, codes = [], sorted(map(ord, points))
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in [*out, (PROVED, 0x10FFFF)]) + "]"


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    """Tokens of a text column, as the library gives them without begin, end or added special tokens.

    What is broadcast is bounded by the vocabulary: the whole-token strings and a character class.
    """
    odd = doubtful_points(path)
    model = spark.sparkContext.broadcast((whole_tokens(path), _ranges(odd), _specials(path)))

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        whole, doubtful, specials = model.value
        tokenizer, find = _load(path), regex.compile(SPLIT).findall
        parts = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")
        proved = dict.fromkeys(whole, 1)
        known = dict(proved)

        def count(piece: str) -> int:
            nonlocal known
            tokens = find(piece)
            numbers = list(map(known.get, tokens))
            if None not in numbers:
                return sum(numbers)
            missing = list({t for t, n in zip(tokens, numbers) if n is None})
            if len(known) > len(proved) + REMEMBERED:
                known = dict(proved)
            merged = dict(zip(missing, (len(e.ids) for e in tokenizer.encode_batch_fast(missing, add_special_tokens=False))))
            known.update(merged)
            return sum(merged[t] if n is None else n for t, n in zip(tokens, numbers))

        for texts in columns:
            strange = pc.match_substring_regex(texts, doubtful).to_pylist()
            out = np.zeros(len(texts), dtype=np.int64)
            for i, t in enumerate(texts):
                t = t.as_py()
                if not t:
                    continue
                if strange[i]:
                    out[i] = len(tokenizer.encode(t, add_special_tokens=False).ids)
                elif any(m in t for m in specials):
                    out[i] = sum(map(count, parts.split(t))) + len(parts.findall(t))
                else:
                    out[i] = count(t)
            yield pa.array(out)

    return F.arrow_udf(batches, T.LongType(), F.ArrowUDFType.SCALAR_ITER)(text)


def with_token_count(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with one more column ``name``."""
    return docs.withColumn(name, token_count(docs.sparkSession, F.col(text), path))
