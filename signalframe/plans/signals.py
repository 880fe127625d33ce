"""Feature queries: vector aggregates, three-phase, covariance, waveforms, tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import VECTOR_AGGREGATES, array_shape_moments, vector_aggregates, zero_cross_rate
from ..functions.numeric import rounded
from ..sources import readers
from ..operators import covariance as cov
from ..operators import tensors, waveform
from ..operators.profile import correlation_ranking
from ..operators.threephase import PHASES, add_three_phase, three_phase_features
from .cleaning import VECTOR_NAMES
from .frames import SQL_CELLS, table, vectors
from .registry import query


def _r(expr: str, name: str) -> str:
    return f'round({expr}, 6) + 0.0 AS "{name}"'


# --- per-vector aggregates -------------------------------------------------------------------

SQL_STEPS = f"""WITH {SQL_CELLS}, st AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM cells)"""
_AGG_SQL = {
    "mean": "avg(v)", "std": "stddev_pop(v)", "max": "max(v)", "min": "min(v)", "q25": "quantile_cont(v, 0.25)",
    "median": "quantile_cont(v, 0.5)", "q75": "quantile_cont(v, 0.75)", "iqr": "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)",
    "range": "max(v) - min(v)", "abs_mean": "avg(abs(v))", "l1_energy": "sum(abs(v))", "energy": "avg(v * v)",
    "l2_energy": "sqrt(sum(v * v))", "variation": "avg(abs(v - p))", "zero_cross_rate": "avg(CASE WHEN p IS NULL THEN NULL WHEN (v < 0) <> (p < 0) THEN 1.0 ELSE 0.0 END)",
}


@query("vector_aggregates", " ".join(f"PFX-{i}" for i in range(1, 16)),
       f"{SQL_STEPS} SELECT vec_id, {', '.join(_r(_AGG_SQL[k], 'wave__' + k) for k in VECTOR_AGGREGATES)} FROM st GROUP BY vec_id")
def vector_aggregate_query(spark, d):
    out = vector_aggregates(vectors(spark, d), "features", "wave")
    return out.select("vec_id", *[rounded(f"wave__{k}").alias(f"wave__{k}") for k in VECTOR_AGGREGATES])


_SHAPE_SQL = {
    "l2norm": "sqrt(sum(v * v))", "mean": "avg(v)", "std": "stddev_pop(v)", "max": "max(v)", "min": "min(v)", "range": "max(v) - min(v)",
    "median": "median(v)", "energy": "sum(v * v)", "skew": "avg(power(z, 3))", "kurtosis": "avg(power(z, 4)) - 3",
}


@query("array_moments", "COV-11",
       f"""WITH {SQL_CELLS}, m AS (SELECT vec_id, avg(v) AS mu, stddev_pop(v) AS sd FROM cells GROUP BY vec_id),
zz AS (SELECT vec_id, v, (v - mu) / CASE WHEN sd < 1e-15 THEN 1.0 ELSE sd END AS z FROM cells JOIN m USING (vec_id))
SELECT vec_id, {', '.join(_r(e, 'a_' + k) for k, e in _SHAPE_SQL.items())} FROM zz GROUP BY vec_id""")
def array_moments(spark, d):
    out = array_shape_moments(vectors(spark, d), "features", "a")
    return out.select("vec_id", *[rounded(f"a_{k}").alias(f"a_{k}") for k in _SHAPE_SQL])


# --- three-phase -----------------------------------------------------------------------------


def _three_phase_sql(x: list[str]) -> dict[str, str]:
    i, v = x[:3], x[3:]
    s = [f"abs({a}) * abs({b})" for a, b in zip(i, v)]

    def mean(t):
        return f"(({t[0]} + {t[1]} + {t[2]}) / 3)"

    def std(t):
        return "sqrt((" + " + ".join(f"power({q} - {mean(t)}, 2)" for q in t) + ") / 3)"

    def absmean(t):
        return mean([f"abs({q})" for q in t])

    def norm(t):
        return "sqrt(" + " + ".join(f"power({q}, 2)" for q in t) + ")"

    out = {}
    for name, t in (("current", i), ("voltage", v)):
        out[f"emc_three_phase_{name}_rms"] = f"{norm(t)} / sqrt(3)"
        out[f"emc_{name}_unbalance"] = f"{std(t)} / greatest({absmean(t)}, 1e-12)"
        out[f"emc_{name}_range"] = f"greatest({', '.join(t)}) - least({', '.join(t)})"
        out[f"emc_{name}_sum"] = " + ".join(t)
        out[f"emc_max_{name}_ratio"] = f"greatest({', '.join(f'abs({q})' for q in t)}) / greatest({absmean(t)}, 1e-12)"
        for pair, (a, b) in {"ab": (0, 1), "bc": (1, 2), "ac": (0, 2)}.items():
            out[f"emc_{name}_diff_{pair}"] = f"abs({t[a]} - {t[b]})"
    out["emc_power_like_total"] = " + ".join(s)
    out["emc_power_like_unbalance"] = f"{std(s)} / greatest({mean(s)}, 1e-12)"
    out["emc_current_voltage_alignment"] = f"({' + '.join(f'{a} * {b}' for a, b in zip(i, v))}) / greatest({norm(i)} * {norm(v)}, 1e-12)"
    return out


_EL_SQL = _three_phase_sql([f"x{k}" for k in range(6)])

def item_phases(spark, d):
    """Line items read as three currents and three voltages."""
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    phases = (q - 25, disc * 100, tax * 50 - 2, F.col("l_extendedprice") / 1000, F.col("l_linenumber") - 4.5, q * tax)
    return table(spark, d, "lineitem").select("l_returnflag", *[c.cast("double").alias(n) for n, c in zip(PHASES, phases)])


@query("three_phase_vectors", " ".join(f"EL-{i}" for i in range(1, 20)),
       f"""WITH x AS (SELECT vec_id, {', '.join(f'embedding[{k + 1}]::DOUBLE AS x{k}' for k in range(6))} FROM embeddings)
SELECT vec_id, {', '.join(_r(e, n) for n, e in _EL_SQL.items())} FROM x""")
def three_phase_vectors(spark, d):
    v = vectors(spark, d).select("vec_id", *[F.get("features", F.lit(k)).alias(p) for k, p in enumerate(PHASES)])
    return add_three_phase(v).select("vec_id", *[rounded(n).alias(n) for n in three_phase_features()])


@query("three_phase_items", "EL-1 EL-3 EL-10 EL-17 EL-18 EL-19",
       f"""WITH x AS (SELECT l_returnflag, l_quantity - 25 AS x0, l_discount * 100 AS x1, l_tax * 50 - 2 AS x2, l_extendedprice / 1000 AS x3,
l_linenumber - 4.5::DOUBLE AS x4, l_quantity * l_tax AS x5 FROM lineitem)
SELECT l_returnflag, {', '.join(f'round(avg({_EL_SQL[n]}), 5) + 0.0 AS "{n}"' for n in sorted(_EL_SQL))} FROM x GROUP BY l_returnflag""")
def three_phase_items(spark, d):
    """All 19 features for every line item, averaged per return flag."""
    f = add_three_phase(item_phases(spark, d))
    return f.groupBy("l_returnflag").agg(*[rounded(F.avg(n), 5).alias(n) for n in sorted(three_phase_features())])


# --- covariance ------------------------------------------------------------------------------


def _stats_sql(start: int) -> dict[str, str]:
    e = [f"embedding[{start + k + 1}]::DOUBLE" for k in range(8)]
    a, dd = e[0], e[3]
    b2 = f"(power(({e[1]} + {e[2]}) / 2, 2) + power(({e[5]} - {e[6]}) / 2, 2))"
    rad = f"sqrt(power(({a} - {dd}) / 2, 2) + {b2})"
    hi, lo, tr = f"(({a} + {dd}) / 2 + {rad})", f"(({a} + {dd}) / 2 - {rad})", f"({a} + {dd})"
    det = f"({a} * {dd} - {b2})"
    diag = f"(abs({a}) + abs({dd}))"
    return {
        "eig_max": hi, "eig_min": lo, "eig_spread": f"{hi} - {lo}", "trace_ed": tr,
        "mme": f"{hi} / greatest(abs({lo}), 1e-15)", "rle": f"{hi} / greatest(abs({tr}), 1e-15)",
        "cav": f"{diag} / greatest({diag} + 2 * sqrt({b2}), 1e-15)",
        "coherence": f"sqrt({b2}) / greatest(sqrt(abs({a}) * abs({dd})), 1e-15)",
        "det": det, "log_det": f"ln(greatest(abs({det}), 1e-30))",
    }


def sensors(spark, d):
    """Vectors read as three 8-element sensors, one 32-element temporal sensor and a scalar."""
    a = F.col("features")
    return vectors(spark, d).select(
        "vec_id", "label", *[F.slice(a, 8 * s + 1, 8).alias(f"SU{s + 1}_cov_flat") for s in range(3)],
        F.slice(a, 25, 32).alias("SU1_temporal_cov"), F.get(a, F.lit(56)).alias("power_dB"),
    )


WIDTHS = {"cov_flat": {f"SU{s}_cov_flat": 8 for s in (1, 2, 3)}, "temporal_cov": {"SU1_temporal_cov": 32}}


def sensor_features(spark, d):
    return cov.covariance_features(sensors(spark, d), WIDTHS)


_DET_NAMES = [f"SU{s}_cov_flat_phys_{k}" for s in (1, 2, 3) for k in cov.STATS]
_LOOSE = ("mme", "rle", "coherence")


def _rounding(name: str, expr: str) -> str:
    return f'round({expr}, {3 if any(k in name for k in _LOOSE) else 6}) + 0.0 AS "{name}"'


def _rounded_named(df, names):
    return df.select("vec_id", *[rounded(n, 3 if any(k in n for k in _LOOSE) else 6).alias(n) for n in names])


@query("detector_statistics", "COV-1 COV-2 COV-4",
       f"""SELECT vec_id, {', '.join(_rounding(f'SU{s + 1}_cov_flat_phys_{k}', e) for s in range(3) for k, e in _stats_sql(8 * s).items())} FROM embeddings""")
def detector_statistics(spark, d):
    return _rounded_named(sensor_features(spark, d), _DET_NAMES)


_T = [_stats_sql(24 + 8 * b) for b in range(4)]


def _temporal_sql(k: str) -> list[str]:
    x = [f"({t[k]})" for t in _T]
    mean = f"(({' + '.join(x)}) / 4)"
    return [
        _rounding(f"SU1_temporal_cov_phys_tmean_{k}", mean),
        _rounding(f"SU1_temporal_cov_phys_tstd_{k}", f"sqrt(({' + '.join(f'power({e} - {mean}, 2)' for e in x)}) / 4)"),
        _rounding(f"SU1_temporal_cov_phys_tdelta_{k}", f"abs({x[3]} - {x[0]})"),
    ]


_TEMPORAL_SHOWN = cov.STATS


@query("temporal_statistics", "COV-5",
       f"SELECT vec_id, {', '.join(c for k in _TEMPORAL_SHOWN for c in _temporal_sql(k))} FROM embeddings")
def temporal_statistics(spark, d):
    names = [f"SU1_temporal_cov_phys_{t}_{k}" for k in _TEMPORAL_SHOWN for t in ("tmean", "tstd", "tdelta")]
    return _rounded_named(sensor_features(spark, d), names)


@query("repeated_temporal_blocks", "COV-6",
       f"SELECT vec_id, {', '.join(_rounding(f'SU1_temporal_cov_phys_tmean_{k}', e) for k, e in _stats_sql(0).items())} FROM embeddings")
def repeated_temporal_blocks(spark, d):
    """Sensors that repeat one block are read as that block."""
    a = F.slice("features", 1, 8)
    s = vectors(spark, d).select("vec_id", F.concat(a, a, a, a).alias("SU1_temporal_cov"))
    f = cov.covariance_features(s, {"temporal_cov": {"SU1_temporal_cov": 32}})
    assert not [c for c in f.columns if "tstd" in c]
    return _rounded_named(f, [f"SU1_temporal_cov_phys_tmean_{k}" for k in cov.STATS])


@query("basic_sensor_statistics", "COV-3",
       f"WITH {SQL_CELLS} SELECT vec_id, {_r('sqrt(sum(v * v))', 'SU1_cov_flat_phys_norm')}, {_r('avg(v)', 'SU1_cov_flat_phys_mean')}, {_r('stddev_pop(v)', 'SU1_cov_flat_phys_std')} FROM cells WHERE i < 6 GROUP BY vec_id")
def basic_sensor_statistics(spark, d):
    s = vectors(spark, d).select("vec_id", F.slice("features", 1, 6).alias("SU1_cov_flat"))
    f = cov.covariance_features(s, {"cov_flat": {"SU1_cov_flat": 6}})
    return _rounded_named(f, [f"SU1_cov_flat_phys_{k}" for k in ("norm", "mean", "std")])


SQL_SENSORS = f"""WITH {SQL_CELLS}, sc AS (SELECT vec_id, label, i // 8 + 1 AS s, i % 8 AS k, v FROM cells WHERE i < 24),
pr AS (SELECT a.vec_id, a.s AS s1, b.s AS s2, sum(a.v * b.v) AS dot, sqrt(sum(a.v * a.v)) AS na, sqrt(sum(b.v * b.v)) AS nb, sqrt(sum(power(a.v - b.v, 2))) AS dist
  FROM sc a JOIN sc b ON a.vec_id = b.vec_id AND a.k = b.k AND a.s < b.s GROUP BY ALL)"""


@query("sensor_pairs", "COV-7 JON-6",
       f"{SQL_SENSORS} SELECT vec_id, 'SU' || s1 || '_cov_flat_vs_SU' || s2 || '_cov_flat' AS pair, round(dot / greatest(na * nb, 1e-15), 6) + 0.0 AS cosine, round(dist, 6) AS l2dist FROM pr")
def sensor_pairs(spark, d):
    f = cov.cross_sensor(sensors(spark, d), list(WIDTHS["cov_flat"]))
    pairs = [f"SU{a}_cov_flat_vs_SU{b}_cov_flat" for a, b in ((1, 2), (1, 3), (2, 3))]
    cells = [F.struct(F.lit(p).alias("pair"), rounded(f"{p}_cosine").alias("cosine"), rounded(f"{p}_l2dist").alias("l2dist")) for p in pairs]
    return f.select("vec_id", F.inline(F.array(*cells)))


def _cross_sql(k: str) -> list[str]:
    x = [f"({_stats_sql(8 * s)[k]})" for s in range(3)]
    mean = f"(({' + '.join(x)}) / 3)"
    return [_rounding(f"cross_su_cov_{k}_mean", mean),
            _rounding(f"cross_su_cov_{k}_std", f"sqrt(({' + '.join(f'power({e} - {mean}, 2)' for e in x)}) / 3)")]


_CROSS_SHOWN = cov.STATS


@query("cross_sensor_statistics", "COV-8",
       f"SELECT vec_id, {', '.join(c for k in _CROSS_SHOWN for c in _cross_sql(k))} FROM embeddings")
def cross_sensor_statistics(spark, d):
    return _rounded_named(sensor_features(spark, d), [f"cross_su_cov_{k}_{m}" for k in _CROSS_SHOWN for m in ("mean", "std")])


@query("scalar_interactions", "COV-9",
       f"""SELECT vec_id, {', '.join(_rounding(f'SU{s + 1}_cov_flat_{k}_x_power_dB', f'embedding[57]::DOUBLE * ({_stats_sql(8 * s)[k]})') for s in range(3) for k in ('trace_ed', 'mme', 'coherence'))} FROM embeddings""")
def scalar_interactions(spark, d):
    names = [f"SU{s}_cov_flat_{k}_x_power_dB" for s in (1, 2, 3) for k in cov.INTERACTING]
    return _rounded_named(sensor_features(spark, d), names)


@query("square_covariance", "COV-10",
       f"""WITH {SQL_CELLS}, m AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, v FROM cells)
SELECT vec_id, {_r('sum(v) FILTER (r = c)', 'trace_ed')}, {_r('sum(abs(v)) FILTER (r = c) / greatest(sum(abs(v)), 1e-12)', 'cav_ratio')}, true AS ordered FROM m GROUP BY vec_id""")
def square_covariance(spark, d):
    """Statistics of 8 x 8 matrices.  SQL can follow the trace and the ratio; the eigenvalues must be ordered."""
    v = vectors(spark, d).withColumn("c", cov.square_covariance_stats(F.col("features")))
    ordered = (F.col("c.max_eig") >= F.col("c.min_eig")) & (F.abs(F.col("c.eig_spread") - (F.col("c.max_eig") - F.col("c.min_eig"))) < 1e-9)
    return v.select("vec_id", rounded("c.trace_ed").alias("trace_ed"), rounded("c.cav_ratio").alias("cav_ratio"), ordered.alias("ordered"))


@query("gram_statistics", "COV-12",
       f"""WITH {SQL_CELLS}, rv AS (SELECT vec_id, avg(x) AS rv FROM (SELECT vec_id, var_pop(v) AS x FROM cells WHERE i < 32 GROUP BY vec_id, i // 8) GROUP BY vec_id)
SELECT vec_id, {_r('sum(v * v) FILTER (i < 8)', 'gram_trace')}, {_r('sum(v * v) FILTER (i < 8)', 'eigen_sum')}, {_r('sqrt(sum(v * v) FILTER (i < 32))', 'frob')}, round(any_value(rv), 6) AS row_var_mean
FROM cells JOIN rv USING (vec_id) GROUP BY vec_id""")
def gram_statistics(spark, d):
    """Gram statistics of 2 x 4 and 4 x 8 readings; the eigenvalues add up to the trace."""
    small, big = F.slice("features", 1, 8), F.slice("features", 1, 32)
    v = vectors(spark, d).select("vec_id", small.alias("s"), big.alias("b"))
    v = v.withColumn("eig", cov.gram_eigenvalues(4, 2)(F.col("s")))
    return v.select(
        "vec_id", rounded(cov.gram_trace(F.col("s"))).alias("gram_trace"),
        rounded(F.aggregate("eig", F.lit(0.0), lambda s, x: s + x)).alias("eigen_sum"),
        rounded(F.sqrt(cov.gram_trace(F.col("b")))).alias("frob"), rounded(cov.row_variance_mean(F.col("b"), 4, 8)).alias("row_var_mean"),
    )


@query("sensor_agreement", "COV-13",
       f"""{SQL_SENSORS}, f AS (SELECT vec_id, 'SU' || s1 || '_cov_flat_vs_SU' || s2 || '_cov_flat_cosine' AS feature, dot / greatest(na * nb, 1e-15) AS x FROM pr
  UNION ALL SELECT vec_id, 'SU' || s1 || '_cov_flat_vs_SU' || s2 || '_cov_flat_l2dist', dist FROM pr)
SELECT feature, round(corr(x, (label < 5)::INT), 6) + 0.0 AS r, count(*) AS n FROM f JOIN embeddings USING (vec_id) GROUP BY feature""")
def sensor_agreement(spark, d):
    """Which pairwise sensor agreements go with the class."""
    f = cov.cross_sensor(sensors(spark, d), list(WIDTHS["cov_flat"])).withColumn("y", (F.col("label") < 5).cast("int"))
    names = [c for c in f.columns if "_vs_" in c]
    return correlation_ranking(f, names, "y").select("feature", rounded("r").alias("r"), "n")


# --- waveforms -------------------------------------------------------------------------------

_TIME_SQL = {
    "mean": "avg(v)", "std": "stddev_pop(v)", "rms": "sqrt(avg(v * v))", "abs_mean": "avg(abs(v))", "max": "max(v)", "min": "min(v)",
    "peak_to_peak": "max(v) - min(v)", "crest_factor": "abs(max(v)) / greatest(sqrt(avg(v * v)), 1e-12)",
}


def event_signals(spark, d):
    """Events as one signal per user, centred near zero."""
    return table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") - 50).alias("value"))


SQL_EVENTS = "ev AS (SELECT user_id, ts, event_id, value - 50 AS v FROM events)"


@query("event_time_statistics", "WAV-1",
       f"WITH {SQL_EVENTS} SELECT user_id, count(*) AS n, {', '.join(_r(_TIME_SQL[k], 'stat_' + k) for k in waveform.TIME_STATS)} FROM ev GROUP BY user_id")
def event_time_statistics(spark, d):
    s = waveform.time_statistics(event_signals(spark, d), "user_id")
    return s.select("user_id", "n", *[rounded(f"stat_{k}").alias(f"stat_{k}") for k in waveform.TIME_STATS])


@query("event_steps", "WIN-5",
       f"""WITH {SQL_EVENTS}, l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ev)
SELECT user_id, round(coalesce(avg(abs(v - p)), 0), 9) AS variation, round(coalesce(avg(CASE WHEN p IS NULL THEN NULL WHEN (v < 0) <> (p < 0) THEN 1.0 ELSE 0.0 END), 0), 6) AS zero_cross_rate
FROM l GROUP BY user_id""")
def event_steps(spark, d):
    """Adjacent differences and sign changes per user, ordered inside day-long pieces."""
    s = waveform.step_statistics(event_signals(spark, d), "user_id", ["ts", "event_id"], "value", F.to_date("ts"))
    return s.select("user_id", rounded("variation", 9).alias("variation"), rounded("zero_cross_rate").alias("zero_cross_rate"))


SQL_DFT = f"""{SQL_CELLS}, spec AS (
  SELECT vec_id, k, sqrt(power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2)) AS m, k / 64.0::DOUBLE AS f
  FROM cells, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k)"""


@query("fft_summary", "WAV-2",
       f"""WITH {SQL_DFT}, t AS (SELECT vec_id, sum(m * m) AS tp, sum(m * m * f) / greatest(sum(m * m), 1e-12) AS cen, max(m) AS amp, arg_max(f, m) AS dom,
  exp(avg(ln(greatest(m, 1e-12)))) / greatest(avg(m), 1e-12) AS flat FROM spec GROUP BY vec_id)
SELECT vec_id, {_r('any_value(tp)', 'total_power')}, {_r('any_value(dom)', 'dominant_frequency')}, {_r('any_value(amp)', 'dominant_amplitude')},
{_r('any_value(cen)', 'spectral_centroid')}, {_r('sqrt(sum(m * m * power(f - cen, 2)) / greatest(any_value(tp), 1e-12))', 'spectral_bandwidth')}, {_r('any_value(flat)', 'spectral_flatness')}
FROM spec JOIN t USING (vec_id) GROUP BY vec_id""")
def fft_summary(spark, d):
    v = vectors(spark, d).withColumn("s", waveform.fft_summary(F.col("features")))
    return v.select("vec_id", *[rounded(f"s.{k}").alias(k) for k in waveform.FFT_STATS])


SQL_STFT = f"""{SQL_CELLS}, fr AS (SELECT vec_id, g, i - 8 * g AS j, v FROM cells, (SELECT unnest(range(7)) AS g) WHERE i >= 8 * g AND i < 8 * g + 16),
st AS (SELECT vec_id, g, k, sqrt(power(sum(v * w * cos(2 * pi() * k * j / 16)), 2) + power(sum(v * w * sin(2 * pi() * k * j / 16)), 2)) / 8 AS m
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / 16) AS w FROM fr), (SELECT unnest(range(9)) AS k) GROUP BY vec_id, g, k),
fl AS (SELECT *, m - lag(m) OVER (PARTITION BY vec_id, k ORDER BY g) AS dm FROM st)"""
_STFT_SQL = {"energy": "avg(m * m)", "mean_magnitude": "avg(m)", "std_magnitude": "stddev_pop(m)", "max_magnitude": "max(m)", "temporal_flux": "avg(abs(dm))"}


@query("stft_summary", "WAV-3", f"WITH {SQL_STFT} SELECT vec_id, {', '.join(_r(e, k) for k, e in _STFT_SQL.items())} FROM fl GROUP BY vec_id")
def stft_summary(spark, d):
    v = vectors(spark, d).withColumn("s", waveform.stft_summary(F.col("features"), 16, 8))
    return v.select("vec_id", *[rounded(f"s.{k}").alias(k) for k in waveform.STFT_STATS])


@query("waveform_bundle", "WAV-4 WAV-5",
       f"""WITH {SQL_STFT}, s AS (SELECT vec_id, {', '.join(f'{e} AS {k}' for k, e in _STFT_SQL.items())} FROM fl GROUP BY vec_id),
p AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM cells),
t AS (SELECT vec_id, {', '.join(f'{e} AS {k}' for k, e in _TIME_SQL.items())}, {_AGG_SQL['zero_cross_rate']} AS zc FROM p GROUP BY vec_id)
SELECT vec_id, {', '.join(_r(f't.{k}', 'signal_' + k) for k in waveform.TIME_STATS)}, {_r('zc', 'signal_zero_cross_rate')}, {', '.join(_r(f's.{k}', 'stft_' + k) for k in waveform.STFT_STATS)}
FROM t JOIN s USING (vec_id)""")
def waveform_bundle(spark, d):
    """Time and short-time features under their signal names, with the zero-cross rate."""
    b = waveform.waveform_bundle(vectors(spark, d), "features", nperseg=16, noverlap=8, stat_prefix="signal_")
    b = b.withColumn("signal_zero_cross_rate", zero_cross_rate(F.col("features")))
    names = [f"signal_{k}" for k in waveform.TIME_STATS] + ["signal_zero_cross_rate"] + [f"stft_{k}" for k in waveform.STFT_STATS]
    return b.select("vec_id", *[rounded(n).alias(n) for n in names])


@query("waveform_head", "WAV-6",
       f"""WITH {SQL_DFT}, h AS (SELECT vec_id, {', '.join(f'max(m) FILTER (k = {k}) AS fft_{k}' for k in range(8))} FROM spec WHERE k < 8 GROUP BY vec_id),
t AS (SELECT vec_id, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS max, min(v) AS min, sqrt(avg(v * v)) AS rms FROM cells GROUP BY vec_id)
SELECT vec_id, {', '.join(_r(k, k) for k in waveform.HEAD_STATS)}, {', '.join(_r(f'fft_{k}', f'fft_{k}') for k in range(8))} FROM t JOIN h USING (vec_id)""")
def waveform_head(spark, d):
    h = waveform.waveform_head(vectors(spark, d), "features")
    return h.select("vec_id", *[rounded(n).alias(n) for n in (*waveform.HEAD_STATS, *[f"fft_{k}" for k in range(8)])])


@query("waveform_overview", "WAV-7",
       f"WITH {SQL_EVENTS} SELECT user_id, {_r('sqrt(avg(v * v))', 'rms')}, {_r('max(v) - min(v)', 'peak_to_peak')}, {_r('max(abs(v))', 'max_abs')} FROM ev GROUP BY user_id")
def waveform_overview(spark, d):
    o = waveform.waveform_overview(event_signals(spark, d), "user_id")
    return o.select("user_id", *[rounded(c).alias(c) for c in ("rms", "peak_to_peak", "max_abs")])


SQL_FRAMES = f"""{SQL_CELLS}, fr AS (SELECT vec_id, g, i - 12 * g AS j, v FROM cells, (SELECT unnest(range(5)) AS g) WHERE i >= 12 * g AND i < 12 * g + 16),
st AS (SELECT vec_id, g, k, sqrt(power(sum(v * w * cos(2 * pi() * k * j / 16)), 2) + power(sum(v * w * sin(2 * pi() * k * j / 16)), 2)) AS m
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / 15) AS w FROM fr), (SELECT unnest(range(9)) AS k) GROUP BY vec_id, g, k)"""


@query("stft_frames", "WAV-8",
       f"WITH {SQL_FRAMES} SELECT vec_id, CAST(g AS INT) AS frame_index, round(k / 16.0::DOUBLE, 6) AS freq_bin, {_r('m', 'magnitude')} FROM st")
def stft_frames(spark, d):
    """Frames of 16 samples every 12; the last of the five ends exactly at sample 64."""
    f = waveform.stft_frames(vectors(spark, d), "vec_id", "features", 16, 4)
    return f.select("vec_id", "frame_index", rounded("freq_bin").alias("freq_bin"), rounded("magnitude").alias("magnitude"))


@query("dominant_frequency", "WAV-8",
       f"""WITH {SQL_FRAMES}, a AS (SELECT vec_id, k, avg(m) AS m FROM st GROUP BY vec_id, k)
SELECT vec_id, round(arg_max(k, m) / 16.0::DOUBLE, 6) AS dominant_freq, {_r('max(m)', 'dominant_magnitude')} FROM a GROUP BY vec_id""")
def dominant_frequency(spark, d):
    f = waveform.dominant_frequency(waveform.stft_frames(vectors(spark, d), "vec_id", "features", 16, 4), "vec_id")
    return f.select("vec_id", rounded("dominant_freq").alias("dominant_freq"), rounded("dominant_magnitude").alias("dominant_magnitude"))


# --- tensors ---------------------------------------------------------------------------------


@query("sequence_tensor", "TEN-1",
       f"""WITH {SQL_CELLS}, ch AS (SELECT vec_id, CASE WHEN i < 8 THEN 0 WHEN i < 40 THEN 1 WHEN i < 60 THEN 2 ELSE 3 + i - 60 END AS c,
  CASE WHEN i < 8 THEN i WHEN i < 40 THEN i - 8 WHEN i < 60 THEN i - 40 ELSE 0 END AS p, v FROM cells),
grid AS (SELECT vec_id, c, p FROM embeddings, (SELECT unnest(range(7)) AS c), (SELECT unnest(range(32)) AS p))
SELECT vec_id, CAST(c AS INT) AS channel, CAST(p AS INT) AS pos, round(coalesce(v, 0), 6) + 0.0 AS value FROM grid LEFT JOIN ch USING (vec_id, c, p)""")
def sequence_tensor(spark, d):
    t, _ = tensors.sequence_tensor(vectors(spark, d), "features", VECTOR_NAMES)
    cells = t.select("vec_id", F.posexplode("sequence").alias("channel", "row"))
    return cells.select("vec_id", "channel", F.posexplode("row").alias("pos", "value")).withColumn("value", rounded("value"))


@query("selected_sequence", "TEN-2",
       f"WITH {SQL_CELLS} SELECT vec_id, CAST(CASE i WHEN 63 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS INT) AS pos, round(v, 6) + 0.0 AS value FROM cells WHERE i IN (63, 5, 20)")
def selected_sequence(spark, d):
    t = tensors.selected_sequence(vectors(spark, d), "features", [63, 5, 20])
    return t.select("vec_id", F.posexplode(F.get("sequence", F.lit(0))).alias("pos", "value")).withColumn("value", rounded("value"))


@query("hybrid_tensor", "TEN-3",
       f"""WITH {SQL_CELLS} SELECT vec_id, CASE WHEN i < 8 THEN 'cov' WHEN i < 40 THEN 'temporal' ELSE 'scalar' END AS branch,
CAST(CASE WHEN i < 8 THEN i WHEN i < 40 THEN i - 8 ELSE i - 40 END AS INT) AS pos, round(v, 6) + 0.0 AS value FROM cells""")
def hybrid_tensor(spark, d):
    t = tensors.hybrid_tensor(vectors(spark, d), "features", VECTOR_NAMES)
    parts = [F.struct(F.lit(b).alias("branch"), a.alias("vals")) for b, a in
             (("scalar", F.col("hybrid.scalar")), ("cov", F.flatten("hybrid.cov")), ("temporal", F.flatten("hybrid.temporal")))]
    rows = t.select("vec_id", F.inline(F.array(*parts)))
    return rows.select("vec_id", "branch", F.posexplode("vals").alias("pos", "value")).withColumn("value", rounded("value"))


PRIME = 1009
_PRIME_FRAMES = f"(SELECT unnest(range({1 + (PRIME - 256) // 128})) AS g)"
SQL_PRIME = f"""long AS (SELECT signal_id, t, v FROM (SELECT t, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount
    FROM (SELECT *, row_number() OVER () - 1 AS t FROM lineitem) WHERE t < {PRIME}) UNPIVOT (v FOR signal_id IN (l_quantity, l_extendedprice, l_discount))),
moves AS (SELECT *, lag(v) OVER (PARTITION BY signal_id ORDER BY t) AS p FROM long),
spec AS (SELECT signal_id, k / {PRIME}.0::DOUBLE AS f, sqrt(power(sum(v * cos(2 * pi() * (k * t % {PRIME}) / {PRIME})), 2) + power(sum(v * sin(2 * pi() * (k * t % {PRIME}) / {PRIME})), 2)) AS m
  FROM long, (SELECT unnest(range({PRIME // 2 + 1})) AS k) GROUP BY signal_id, k),
tot AS (SELECT signal_id, sum(m * m) AS tp, sum(m * m * f) / greatest(sum(m * m), 1e-12) AS cen, max(m) AS amp, arg_max(f, m) AS dom,
  exp(avg(ln(greatest(m, 1e-12)))) / greatest(avg(m), 1e-12) AS flat FROM spec GROUP BY signal_id),
wide_spec AS (SELECT signal_id, sqrt(sum(m * m * power(f - cen, 2)) / greatest(any_value(tp), 1e-12)) AS bw FROM spec JOIN tot USING (signal_id) GROUP BY signal_id),
fr AS (SELECT signal_id, g, t - 128 * g AS j, v * (0.5 - 0.5 * cos(2 * pi() * (t - 128 * g) / 256)) AS w FROM long, {_PRIME_FRAMES} WHERE t BETWEEN 128 * g AND 128 * g + 255),
st AS (SELECT signal_id, g, k, sqrt(power(sum(w * cos(2 * pi() * k * j / 256)), 2) + power(sum(w * sin(2 * pi() * k * j / 256)), 2)) / 128 AS m FROM fr, (SELECT unnest(range(129)) AS k) GROUP BY signal_id, g, k),
fl AS (SELECT *, m - lag(m) OVER (PARTITION BY signal_id, k ORDER BY g) AS dm FROM st),
short AS (SELECT signal_id, {', '.join(f'{e} AS {k}' for k, e in _STFT_SQL.items())} FROM fl GROUP BY signal_id),
stats AS (SELECT signal_id, {', '.join(f'{_TIME_SQL[k]} AS signal_{k}' for k in waveform.TIME_STATS)}, avg(((v < 0) <> (p < 0))::INT) AS zc FROM moves GROUP BY signal_id)"""


@query("prime_length_spectra", "SRC-5 WAV-2 WAV-4 WAV-5",
       f"""WITH {SQL_PRIME} SELECT signal_id, {', '.join(f'round(signal_{k}, 4) + 0.0 AS signal_{k}' for k in waveform.TIME_STATS)}, round(zc, 6) + 0.0 AS signal_zero_cross_rate,
  round(tp / 1e6, 4) AS fft_total_power, round(dom, 9) AS fft_dominant_frequency, round(amp, 4) AS fft_dominant_amplitude, round(cen, 9) AS fft_spectral_centroid,
  round(bw, 9) AS fft_spectral_bandwidth, round(flat, 9) AS fft_spectral_flatness, {', '.join(f'round({k}, 4) AS stft_{k}' for k in waveform.STFT_STATS)}
FROM stats JOIN tot USING (signal_id) JOIN wide_spec USING (signal_id) JOIN short USING (signal_id)""")
def prime_length_spectra(spark, d):
    """All 20 features of signals that no transform in two steps can cut: a prime number of samples."""
    long = readers.read_signals_long(spark, f"{d}/lineitem.parquet", ["l_quantity", "l_extendedprice", "l_discount"], PRIME)
    out = waveform.long_features(long, PRIME)
    digits = {c: 4 for c in out.columns if c.startswith(("signal_", "stft_", "fft_dominant_amplitude"))} | {"signal_zero_cross_rate": 6}
    out = out.withColumn("fft_total_power", F.round(F.col("fft_total_power") / 1e6, 4))
    return out.select("signal_id", *(F.col(c) if c == "fft_total_power" else rounded(c, digits.get(c, 9)).alias(c) for c in out.columns if c != "signal_id"))
