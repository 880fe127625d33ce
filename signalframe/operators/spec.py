"""Feature specifications: what each raw column becomes, decided once and applied as projections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import domain_group, in_layout, index_of, parse_array, prefix_of

MAX_CATEGORIES = 10_000
ARRAY_SHARE = 0.8
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def as_number(name: str, kind: str) -> Column:
    """Column as double with NaN turned into null."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


@dataclass(frozen=True)
class Feature:
    """One source column and the features made from it."""

    source: str
    kind: str  # number, array or category
    names: tuple[str, ...]
    fill: float = 0.0
    width: int = 0
    values: tuple[str, ...] = ()

    def columns(self, raw_kind: str) -> list[Column]:
        src = F.col(f"`{self.source}`")
        if self.kind == "number":
            return [F.coalesce(as_number(self.source, raw_kind), F.lit(self.fill)).alias(self.names[0])]
        if self.kind == "array":
            a = F.col(self.staged)
            return [F.coalesce(F.get(a, F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(self.names)]
        text = F.coalesce(src.cast("string"), F.lit("missing"))
        return [(text == v).cast("double").alias(n) for v, n in zip(self.values, self.names)]

    @property
    def staged(self) -> str:
        return f"_sf_array_{self.source}"

    def stage(self, raw_kind: str) -> Column:
        """The parsed array: a column of its own, so the text is parsed once per row."""
        src = F.col(f"`{self.source}`")
        return parse_array(src) if raw_kind == "string" else src.cast("array<double>")


@dataclass(frozen=True)
class FeatureSpec:
    features: tuple[Feature, ...] = field(default_factory=tuple)

    @property
    def names(self) -> list[str]:
        return [n for f in self.features for n in f.names]

    def _columns(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        kinds = dict(df.dtypes)
        arrays = {f.staged: f.stage(kinds[f.source]) for f in self.features if f.kind == "array"}
        staged = df.withColumns(arrays) if arrays else df
        return staged, [c for f in self.features for c in f.columns(kinds[f.source])]

    def expand(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns plus one double column per feature, in one projection."""
        staged, cols = self._columns(df)
        return staged.select(*keep, *cols)

    def vector(self, df: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        """``keep`` columns plus one array column: wide feature sets stay one column."""
        staged, cols = self._columns(df)
        return staged.select(*keep, F.array(*cols).alias(out))


def impute_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean of the present values per column, 0.0 where there are none; one pass for all columns."""
    kinds = dict(df.dtypes)
    row = df.agg(*[F.avg(as_number(c, kinds[c])).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(columns)}


def _share_and_width(text: Column, parsed: Column) -> list[Column]:
    """Aggregates: share of non-null texts that parse as arrays, and the longest array."""
    ok = F.when(text.isNotNull(), parsed.isNotNull().cast("double"))
    return [F.coalesce(F.avg(ok), F.lit(0.0)), F.greatest(F.coalesce(F.max(F.size(parsed)), F.lit(0)), F.lit(0))]


def array_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share, width): share of non-null texts that parse as arrays, and the longest array."""
    parsed = df.select(*[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(columns)],
                       *[parse_array(F.col(f"`{c}`")).alias(f"a{i}") for i, c in enumerate(columns)])
    aggs = [x.alias(f"{k}{i}") for i in range(len(columns)) for k, x in zip("sw", _share_and_width(F.col(f"t{i}"), F.col(f"a{i}")))]
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("share"), F.col(f"w{i}").alias("width")) for i, c in enumerate(columns)]
    return parsed.agg(*aggs).select(F.inline(F.array(*cells)))


def _category_text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("missing"))


def categories(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct values of every column, null as "missing", from one pass over the rows.

    More than ``limit`` values would make as many columns; encode such a column as one index
    column instead (``labels.encode_labels``), which joins and has no limit.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("at"), _category_text(c).alias("v")) for i, c in enumerate(columns)])
    # One value more than allowed per column is enough to tell; a window limit keeps at most so many rows of each.
    rank = F.row_number().over(W.partitionBy("at").orderBy("v"))
    rows = df.select(F.inline(cells)).distinct().withColumn("rank", rank).where(F.col("rank") <= limit + 1).collect()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        found[columns[r["at"]]].append(r["v"])
    for c, values in found.items():
        if len(values) > limit:
            raise ValueError(f"{c} has more than {limit} categories; use encode_labels for it")
    return {c: sorted(v) for c, v in found.items()}


@dataclass(frozen=True)
class ColumnProfile:
    """What one pass tells about a column; ``distinct`` is an estimate (5 % standard error)."""

    mean: float = 0.0
    share: float = 0.0
    width: int = 0
    distinct: int = 0


def profile_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnProfile]:
    """Means of numbers, shares and widths of arrays and the number of distinct values of the others: one aggregate for all columns.

    Its state is of fixed size per column, whatever the values.
    """
    kinds = dict(df.dtypes)
    texts = [c for c in columns if kinds[c] == "string"]
    staged = df.withColumns({f"_sf_array_{c}": parse_array(F.col(f"`{c}`")) for c in texts}) if texts else df
    aggs: list[Column] = []
    for i, c in enumerate(columns):
        src = F.col(f"`{c}`")
        made: dict[str, Column] = {}
        if is_numeric(kinds[c]):
            made["mean"] = F.coalesce(F.avg(as_number(c, kinds[c])), F.lit(0.0))
        elif kinds[c].startswith("array<"):
            made.update(share=F.lit(1.0), width=F.greatest(F.coalesce(F.max(F.size(src)), F.lit(0)), F.lit(0)))
        else:
            made["distinct"] = F.approx_count_distinct(_category_text(c))
            if c in texts:
                made["share"], made["width"] = _share_and_width(src, F.col(f"`_sf_array_{c}`"))
        aggs.append(F.struct(*[x.alias(k) for k, x in made.items()]).alias(f"p{i}"))
    row = staged.agg(*aggs).first()
    return {c: ColumnProfile(**row[f"p{i}"].asDict()) for i, c in enumerate(columns)}


def infer_spec(df: DataFrame, columns: Sequence[str] | None = None, limit: int = MAX_CATEGORIES) -> FeatureSpec:
    """Numbers are mean-filled, array texts padded to the longest, everything else one-hot encoded.

    One scan profiles all columns; a second lists the values of all category columns, if there are any.  A column whose
    estimated number of values is twice the limit is refused after the first.
    """
    kinds = dict(df.dtypes)
    columns = list(columns or df.columns)
    seen = profile_columns(df, columns)
    arrays = [c for c in columns if seen[c].share >= ARRAY_SHARE]
    others = [c for c in columns if c not in arrays and not is_numeric(kinds[c])]
    for c in others:
        if seen[c].distinct > 2 * limit:
            raise ValueError(f"{c} has more than {limit} categories; use encode_labels for it")
    values = categories(df, others, limit)
    out = []
    for c in columns:
        if c in arrays:
            out.append(Feature(c, "array", tuple(f"{c}_{i}" for i in range(seen[c].width)), width=seen[c].width))
        elif c in values:
            out.append(Feature(c, "category", tuple(f"{c}__{v}" for v in values[c]), values=tuple(values[c])))
        else:
            out.append(Feature(c, "number", (c,), fill=float(seen[c].mean)))
    return FeatureSpec(tuple(out))


def name_frame(spark, names: Sequence[str]) -> DataFrame:
    """(idx, name): the feature names as a table."""
    return spark.createDataFrame(list(enumerate(names)), "idx int, name string")


def describe_names(spark, names: Sequence[str]) -> DataFrame:
    """(idx, name, domain_group, prefix, member): what the names say about the features."""
    n = F.col("name")
    return name_frame(spark, names).select(
        "idx", "name", domain_group(n).alias("domain_group"), prefix_of(n).alias("prefix"), index_of(n).alias("member")
    )


def group_indices(spark, names: Sequence[str], groups: Sequence[str], strict: bool = True) -> list[int]:
    """Feature positions of the wanted domain groups, groups in order of first appearance.

    Nothing selected is an error; ``strict=False`` keeps all features instead.
    """
    rows = describe_names(spark, names).collect()
    rows.sort(key=lambda r: r["idx"])
    seen = list(dict.fromkeys(r["domain_group"] for r in rows))
    picked = [r["idx"] for g in seen if g in set(groups) for r in rows if r["domain_group"] == g]
    if not picked:
        if strict:
            raise ValueError(f"no feature belongs to {sorted(groups)}; present: {seen}")
        return list(range(len(names)))
    return picked


def layout_indices(spark, names: Sequence[str], layout: str) -> list[int]:
    rows = name_frame(spark, names).where(in_layout(F.col("name"), layout)).select("idx").collect()
    if not rows:
        raise ValueError(f"layout {layout!r} selects no feature")
    return sorted(r["idx"] for r in rows)


def pick(features: str, indices: Sequence[int]) -> Column:
    """Array of the elements at ``indices``, in that order."""
    a = F.col(features)
    return F.transform(F.lit(list(indices)), lambda i: F.get(a, i))


def prefix_groups(names: Sequence[str], least: int = 2) -> list[tuple[str, list[int]]]:
    """(prefix, positions by member number) for prefixes with ``least`` members, by prefix."""
    groups: dict[str, list[tuple[int, int]]] = {}
    for pos, n in enumerate(names):
        head, _, tail = n.rpartition("_")
        if head and tail.isdigit():
            groups.setdefault(head, []).append((int(tail), pos))
    return [(p, [pos for _, pos in sorted(m)]) for p, m in sorted(groups.items()) if len(m) >= least]
