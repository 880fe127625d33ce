"""URL filters: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table with one row per block of 256 bits (four longs).  A URL's hash names its block, so one
probe of a hash join fetches all bits that it needs; a second hash gives eight bits inside the block.  URLs
that miss a bit are not on the list.  The others, true hits and a few false ones, go on to an exact hash join
with the list, which removes the false ones.  All of it is built-in column work.

A null URL or one without ``://`` has empty host and path, fits no rule and is not on any list, so it is
allowed.  Repeated pages stay repeated; an empty list blocks nothing; an empty table gives an empty table.
Input columns that share a name with a result column are replaced by it, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bits of the filter per listed URL; with eight bits set, about one URL in a few hundred passes by chance.
BITS_PER_URL = 16
#: Filters of up to so many blocks (32 bytes each) are broadcast; a larger one is joined by shuffling hashes.
BROADCAST_BLOCKS = 1 << 18
_WORDS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host, its subdomains, and paths with a prefix; ``text`` is host + path."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, rest = text.partition("/")
        return cls(verdict, host, slash + rest)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without trailing slashes and ``.html``; null without host."""
    bare = F.regexp_replace(host, r"\A(?:www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(?:\.html)?/*\z", "")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the four longs of a block."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int"))
    return [bit(2 * k).bitwiseOR(bit(2 * k + 1)) for k in range(_WORDS)]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of distinct keys: ``block`` and its four longs; blocks without a key are left out."""
    made = keys.select(_block(F.col(key), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))))
    return made.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)))


def bloom_probe(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``possible``: false for keys that are surely not in the filter, and for null."""
    masks, held = _masks(F.col(key)), F.lit(True)
    joined = rows.withColumn("block", _block(F.col(key), blocks)).join(bloom, "block", "left")
    for i, m in enumerate(masks):
        held = held & (F.col(f"w{i}").bitwiseAND(m) == m)
    return joined.select(*rows.columns, F.coalesce(F.col(key).isNotNull() & held, F.lit(False)).alias("possible"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", listed_url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``listed`` and ``verdict``.

    The fitting rule with the longest text decides; of equally long ones the first in text order.  Without a
    rule, listed URLs are blocked and others allowed.  ``listed`` is false for URLs that a rule decides.
    ``rules`` are settings, a column expression each; ``listed`` may have any number of rows.
    """
    keys = cut_lineage(
        listed.select(canonical(host_of(F.col(listed_url)), path_of(F.col(listed_url))).alias("key")).where("key IS NOT NULL").distinct())
    blocks = max(1, -(-keys.count() * BITS_PER_URL // (64 * _WORDS)))
    bloom = bloom_blocks(keys, "key", blocks)
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)

    base = pages.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    chosen = F.coalesce(F.lit(None).cast("string"), *(F.when(r.fits(F.col("host"), F.col("path")), r.text) for r in ordered))
    base = base.withColumn("rule", chosen)
    base = base.withColumn("key", F.when(F.col("rule").isNull(), canonical(F.col("host"), F.col("path"))))
    probed = bloom_probe(base, "key", bloom, blocks)

    exact = probed.where("possible").join(keys.withColumn("found", F.lit(True)), "key", "left")
    judged = exact.select("row", "host", "path", "rule", F.coalesce("found", F.lit(False)).alias("listed")).unionByName(
        probed.where("NOT possible").select("row", "host", "path", "rule", F.lit(False).alias("listed")))
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    if rules:
        by_rule = F.coalesce(*(F.when(F.col("rule") == r.text, r.verdict) for r in ordered))
        verdict = F.coalesce(by_rule, verdict)
    results = {"host", "path", "rule", "listed", "verdict"}
    kept = [F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in results]
    return judged.select(*kept, "host", "path", "rule", "listed", verdict.alias("verdict"))
