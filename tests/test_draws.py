"""Draws with replacement: exact totals, shares, and independence of placement."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from signalframe.operators import split


def rows(spark, n, parts=3):
    data = [(i, "hot" if i % 10 else None if i % 20 else "rare") for i in range(n)]
    return spark.createDataFrame(data, "id long, cls string").repartition(parts)


def test_ranks_are_places_in_hash_order(spark):
    got = split.ranked_rows(rows(spark, 500), ["id"], 5, ["cls"]).withColumn("k", split.hash_key(5, "id")).collect()
    for cls in ("hot", "rare", None):
        mine = sorted((r for r in got if r["cls"] == cls), key=lambda r: r["k"])
        assert [r["rank"] for r in mine] == list(range(len(mine)))


@pytest.mark.parametrize("n", [1, 2, 37, 400])
def test_bootstrap_totals_are_exact(spark, n):
    for seed in (1, 2):
        got = {r["id"]: r["draws"] for r in split.resampled_counts(rows(spark, n), ["id"], seed).collect()}
        assert sum(got.values()) == n and len(got) == n
        assert got == {r["id"]: r["draws"] for r in split.resampled_counts(rows(spark, n, 7), ["id"], seed).collect()}
    bags = {r["id"]: r["draws"] for r in split.resampled_bags(rows(spark, n), ["id"], 3, 4).collect()}
    assert [sum(b) for b in zip(*bags.values())] == [n] * 4
    assert {i: b[2] for i, b in bags.items()} == {r["id"]: r["draws"] for r in split.resampled_counts(rows(spark, n), ["id"], "3-2").collect()}


def test_bootstrap_of_nothing(spark):
    assert split.resampled_counts(rows(spark, 3).where("false"), ["id"], 1).count() == 0
    assert split.balanced_resample(rows(spark, 3).where("false"), ["id"], "cls", 1).count() == 0


def test_bootstrap_spreads_like_a_bootstrap(spark):
    got = Counter(r["draws"] for r in split.resampled_counts(rows(spark, 4000), ["id"], 9).collect())
    assert abs(got[0] / 4000 - 0.368) < 0.03 and abs(got[1] / 4000 - 0.368) < 0.03


def test_balanced_resample(spark):
    df = rows(spark, 600)
    drawn = split.balanced_resample(df, ["id"], "cls", 4).collect()
    assert len(drawn) == 600 and sorted(r["draw"] for r in drawn) == list(range(600))
    shares = Counter(r["cls"] for r in drawn)
    assert all(abs(shares[c] - 200) < 60 for c in ("hot", "rare", None))
    even = Counter(r["cls"] for r in split.balanced_resample(df, ["id"], "cls", 4, even=True).collect())
    assert set(even.values()) <= {199, 200, 201} and sum(even.values()) == 600
    again = split.balanced_resample(rows(spark, 600, 8), ["id"], "cls", 4)
    assert {(r["draw"], r["id"]) for r in again.collect()} == {(r["draw"], r["id"]) for r in drawn}
    assert split.balanced_resample(df, ["id"], "cls", 4, n=10).count() == 10
    hot = [r["id"] for r in split.balanced_resample(df, ["id"], "cls", 6, n=3000).where(F.col("cls") == "hot").collect()]
    assert len(set(hot)) > 400
    with pytest.raises(ValueError):
        split.balanced_resample(df, ["id"], "id", 4, max_classes=5)
