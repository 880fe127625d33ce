"""Three-phase electrical features: plain column arithmetic, one codegen stage, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import add_all, col, floored_div, pop_std

PHASES = ("Ia", "Ib", "Ic", "Va", "Vb", "Vc")


def three_phase_features(phases: Sequence[Column | str] = PHASES, prefix: str = "emc_") -> dict[str, Column]:
    """The 19 features of three currents and three voltages, by output name."""
    c = [col(p).cast("double") for p in phases]
    current, voltage = c[:3], c[3:]
    power = [F.abs(i) * F.abs(v) for i, v in zip(current, voltage)]

    def per_quantity(x: list[Column]) -> dict[str, Column]:
        size = [F.abs(p) for p in x]
        level = add_all(size) / 3
        return {
            "rms": F.sqrt(add_all([p * p for p in x]) / 3),
            "unbalance": floored_div(pop_std(x), level),
            "range": F.greatest(*x) - F.least(*x),
            "sum": add_all(x),
            "ratio": floored_div(F.greatest(*size), level),
            "ab": F.abs(x[0] - x[1]), "bc": F.abs(x[1] - x[2]), "ac": F.abs(x[0] - x[2]),
        }

    i, v = per_quantity(current), per_quantity(voltage)
    norm = F.sqrt(add_all([p * p for p in current])) * F.sqrt(add_all([p * p for p in voltage]))
    out = {
        "three_phase_current_rms": i["rms"], "three_phase_voltage_rms": v["rms"],
        "current_unbalance": i["unbalance"], "voltage_unbalance": v["unbalance"],
        "current_range": i["range"], "voltage_range": v["range"],
        "current_sum": i["sum"], "voltage_sum": v["sum"],
        "max_current_ratio": i["ratio"], "max_voltage_ratio": v["ratio"],
        "current_diff_ab": i["ab"], "current_diff_bc": i["bc"], "current_diff_ac": i["ac"],
        "voltage_diff_ab": v["ab"], "voltage_diff_bc": v["bc"], "voltage_diff_ac": v["ac"],
        "power_like_total": add_all(power),
        "power_like_unbalance": floored_div(pop_std(power), add_all(power) / 3),
        "current_voltage_alignment": floored_div(add_all([a * b for a, b in zip(current, voltage)]), norm),
    }
    return {prefix + k: e for k, e in out.items()}


def add_three_phase(df: DataFrame, phases: Sequence[str] = PHASES, prefix: str = "emc_") -> DataFrame:
    """Append the features; a frame without all six phase columns comes back unchanged."""
    if any(p not in df.columns for p in phases):
        return df
    return df.withColumns(three_phase_features(phases, prefix))
