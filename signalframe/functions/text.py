"""Text expressions: number formats, slugs, feature names, array strings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

FLOAT_PATTERN = r"[-+]?(?:[0-9]*\.[0-9]+|[0-9]+\.?)(?:[eE][-+]?[0-9]+)?"


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, rounded on the exact binary value (half to even), as C and Python print it."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def signed_fixed(x: Column, digits: int) -> Column:
    """Fixed-point text with an explicit plus sign."""
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), fixed(x, digits))


def timestamp_tag(at: Column | None = None) -> Column:
    """A time, or the present one, as yyyymmdd-hhmmss in UTC, whatever the session's time zone."""
    utc = F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone())
    return F.date_format(utc, "yyyyMMdd-HHmmss")


def six_digits(x: Column) -> Column:
    """Shortest text with six significant digits (the %.6g rules); "nan" for missing or infinite."""
    x = x.cast("double")
    sci = F.call_function("format_number", x, F.lit("0.00000E0"))
    parts = F.split(sci, "E")
    mantissa, exponent = parts[0], parts[1].try_cast("int")
    plain = sci.try_cast("decimal(28,12)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(F.regexp_replace(mantissa, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    power = F.concat(
        F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0")
    )
    wide = F.abs(exponent) >= 100
    power = F.when(wide, F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.abs(exponent).cast("string"))).otherwise(power)
    zero = F.when(x.cast("string").startswith("-"), "-0").otherwise("0")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        F.when(bad, "nan").when(x == 0, zero)
        .when((exponent >= -4) & (exponent < 6), trimmed)
        .otherwise(F.concat(short, power))
    )


def slug(x: Column, empty: str = "run", unicode_letters: bool = False) -> Column:
    """Lower-case words joined by single dashes; ``empty`` when nothing is left."""
    other = r"[^\p{L}\p{N}]+" if unicode_letters else "[^a-z0-9]+"
    dashed = F.regexp_replace(F.lower(F.trim(x)), other, "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit(empty))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unwrapped(s: Column) -> Column:
    """Text without an enclosing array(...)."""
    inside = F.trim(F.substring(s, F.lit(7), F.length(s) - 7))
    return F.when(s.startswith("array(") & s.endswith(")"), inside).otherwise(s)


def _listed(s: Column) -> Column:
    """Text between the outer brackets, null when there are none."""
    return F.when(s.startswith("[") & s.endswith("]") & (F.length(s) >= 2), F.trim(F.substring(s, F.lit(2), F.length(s) - 2)))


def _numbers(inner: Column) -> Column:
    # Nested lists flatten by blanking their punctuation; the pattern search is only for text with other words.
    blank = F.translate(F.replace(inner, F.lit("array"), F.lit(" ")), "[](),", "     ")
    words = F.array_remove(F.split(blank, " "), "")

    def found(_: Column) -> Column:
        return F.transform(F.regexp_extract_all(inner, F.lit(FLOAT_PATTERN), F.lit(0)), lambda w: w.try_cast("double"))

    def result(v: Column) -> Column:
        clean = (F.size(v) > 0) & (F.size(F.array_compact(v)) == F.size(v))
        return F.when(clean, v).otherwise(let(found(inner), lambda f: F.when(F.size(f) > 0, f)))

    return let(words.try_cast("array<double>"), result)


def parse_array(text: Column) -> Column:
    """ARRAY<DOUBLE> from "[1.0, 2.0]", "array([1, 2])" or nested array text; null when it is none.

    An empty pair of brackets is an empty array.  Bracketed text with other words in it falls back
    to every number found.
    """
    flat = F.trim(F.translate(text, "\n\r\t", "   "))
    empty = F.array().cast("array<double>")
    return let(flat, lambda s: let(_unwrapped(s), lambda u: let(_listed(u), lambda i: F.when(i == "", empty).when(
        i.isNotNull(), _numbers(i)))))


def prefix_of(name: Column) -> Column:
    """Part before a trailing _<digits>, null when there is none."""
    return F.nullif(F.regexp_extract(name, r"^(.+)_([0-9]+)$", 1), F.lit(""))


def index_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.+)_([0-9]+)$", 2).try_cast("int")


# Domain groups in order of precedence: (group, lower-case test) (fixed values).
DOMAIN_GROUPS = (
    ("covariance_based", "contains", "_cov_flat_"),
    ("temporal_covariance", "contains", "_temporal_cov_"),
    ("entropy_related", "contains", "entropy"),
    ("spectral_energy", "startswith", "fft_"),
    ("spectral_energy", "contains", "spectrum"),
)
DEFAULT_GROUP = "basic_statistical"


def domain_group(name: Column) -> Column:
    """Feature group of a feature name."""
    low = F.lower(name)
    out = F.lit(DEFAULT_GROUP)
    for group, test, word in reversed(DOMAIN_GROUPS):
        out = F.when(getattr(low, test)(word), group).otherwise(out)
    return out


# Layout name -> what a feature name must (not) contain (fixed values).
LAYOUTS = ("all", "basic_only", "cov_flat_only", "temporal_cov_only")


def in_layout(name: Column, layout: str) -> Column:
    layout = layout.lower()
    cov, temporal = name.contains("_cov_flat_"), name.contains("_temporal_cov_")
    tests = {"all": F.lit(True), "basic_only": ~(cov | temporal), "cov_flat_only": cov, "temporal_cov_only": temporal}
    if layout not in tests:
        raise ValueError(f"unknown layout {layout!r}, expected one of {LAYOUTS}")
    return tests[layout]


# Readable names.  Exact aliases first, then substring replacements in this order (fixed values).
PHASE_NAMES = {
    "Ia": "phase_a_current", "Ib": "phase_b_current", "Ic": "phase_c_current",
    "Va": "phase_a_voltage", "Vb": "phase_b_voltage", "Vc": "phase_c_voltage",
}
READABLE = (
    ("phys_tmean_", "temporal_mean_"),
    ("phys_tstd_", "temporal_std_"),
    ("phys_tdelta_", "temporal_delta_"),
    ("phys_eig_spread", "eigenvalue_spread"),
    ("phys_eig_max", "max_eigenvalue"),
    ("phys_eig_min", "min_eigenvalue"),
    ("phys_trace_ed", "energy_detection_trace"),
    ("phys_mme", "max_min_eigenvalue_ratio"),
    ("phys_rle", "roy_largest_eigenvalue_ratio"),
    ("phys_cav", "covariance_abs_value_ratio"),
    ("phys_coherence", "signal_coherence"),
    ("phys_log_det", "log_determinant"),
    ("phys_det", "determinant"),
    ("emc_three_phase_current_rms", "three_phase_current_rms"),
    ("emc_three_phase_voltage_rms", "three_phase_voltage_rms"),
    ("emc_current_unbalance", "current_unbalance_ratio"),
    ("emc_voltage_unbalance", "voltage_unbalance_ratio"),
    ("emc_current_range", "current_range"),
    ("emc_voltage_range", "voltage_range"),
    ("emc_current_sum", "current_sum"),
    ("emc_voltage_sum", "voltage_sum"),
    ("emc_max_current_ratio", "max_current_to_mean_ratio"),
    ("emc_max_voltage_ratio", "max_voltage_to_mean_ratio"),
    ("emc_current_diff_ab", "phase_ab_current_difference"),
    ("emc_current_diff_bc", "phase_bc_current_difference"),
    ("emc_current_diff_ac", "phase_ac_current_difference"),
    ("emc_voltage_diff_ab", "phase_ab_voltage_difference"),
    ("emc_voltage_diff_bc", "phase_bc_voltage_difference"),
    ("emc_voltage_diff_ac", "phase_ac_voltage_difference"),
    ("emc_power_like_total", "three_phase_apparent_power_proxy"),
    ("emc_power_like_unbalance", "power_proxy_unbalance_ratio"),
    ("emc_current_voltage_alignment", "current_voltage_alignment"),
    ("cross_su_cov_", "cross_sensor_"),
    ("_vs_", "_versus_"),
    ("_trace_ed_x_", "_energy_detection_trace_times_"),
    ("_mme_x_", "_max_min_eigenvalue_ratio_times_"),
    ("_coherence_x_", "_signal_coherence_times_"),
    ("_x_", "_times_"),
)


def readable_name(name: str) -> str:
    """Readable form of one feature name (driver side: there are as many names as columns)."""
    if name in PHASE_NAMES:
        return PHASE_NAMES[name]
    for raw, nice in READABLE:
        name = name.replace(raw, nice)
    return re.sub("__+", "_", name)


def prompt_text(
    features: Column,
    names: Sequence[str],
    instruction: str = "Classify this EMC and cognitive radio sensing sample.",
    label_meanings: dict[str, str] | None = None,
    limit: int | None = None,
) -> Column:
    """One text per row that lists its features as name=value, the first ``limit`` of them."""
    shown = [readable_name(n) for n in names]
    if limit and limit > 0:
        shown = shown[:limit]
    # The sentences of the prompt, the default instruction among them, are fixed values.
    head = f"EMC signal classification sample.\nTask: {instruction}\n"
    if label_meanings:
        pairs = "; ".join(f"{k}={label_meanings[k]}" for k in sorted(label_meanings, key=str))
        head += f"Label meanings: {pairs}.\n"
    head += "Observed features (spectrum-sensing style statistics where applicable): "
    body = F.zip_with(F.lit(shown), F.slice(features, 1, len(shown)), lambda n, v: F.concat(n, F.lit("="), six_digits(v)))
    return F.concat(F.lit(head), F.array_join(body, "; "))
