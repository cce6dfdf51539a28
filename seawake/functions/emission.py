"""The emission model: published factors as expressions over vessel class and mode."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The factor tables of the inventory.
# class: rated kW, reference knots, fuel, engine, auxiliary kW in transit, manoeuvring, berth, anchorage
VESSELS = {
    "tanker": (12000.0, 13.0, "HFO", "slow", 900.0, 1250.0, 650.0, 520.0),
    "cargo": (9000.0, 12.5, "MGO", "medium", 700.0, 950.0, 550.0, 460.0),
    "container": (15000.0, 17.0, "HFO", "slow", 850.0, 1150.0, 700.0, 560.0),
    "passenger": (18000.0, 19.0, "MGO", "medium", 1200.0, 1500.0, 1100.0, 900.0),
    "service": (3500.0, 10.0, "MDO", "high", 450.0, 650.0, 350.0, 320.0),
    "unknown": (8000.0, 12.0, "MGO", "medium", 600.0, 850.0, 500.0, 420.0),
}
# mode: g/kWh main, g/kWh auxiliary, sulphur, NOx slow/medium/high kg/t, PM slow/medium/high kg/t
MODES = {
    "transit": (185.0, 210.0, 0.0010, 65.0, 55.0, 45.0, 1.60, 1.30, 0.95),
    "manoeuvring": (195.0, 215.0, 0.0015, 62.0, 53.0, 43.0, 1.55, 1.25, 0.90),
    "berth": (0.0, 220.0, 0.0010, 38.0, 34.0, 28.0, 1.20, 1.00, 0.75),
    "anchorage": (0.0, 220.0, 0.0012, 41.0, 37.0, 30.0, 1.25, 1.05, 0.80),
}
# fuel: t CO2 per t, t CO2e upstream per t
FUELS = {"MGO": (3.206, 0.62), "HFO": (3.114, 0.74), "LNG": (2.750, 1.05), "MDO": (3.190, 0.66)}
SIGMA_SPEED, SIGMA_SFC, SIGMA_FACTOR = 0.08, 0.10, 0.08
PENALTY_INTERPOLATION, PENALTY_GAP, PENALTY_FALLBACK = 0.10, 0.08, 0.12
SOX_MULTIPLIER, DEFAULT_FUEL, DEFAULT_ENGINE = 2.0, "MGO", "medium"
POLLUTANTS = ("co2_t", "nox_kg", "sox_kg", "pm_kg", "ttw_co2e_t", "wtt_co2e_t", "wtw_co2e_t")
Z95 = 1.96


def vessel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v[:4]) for k, v in VESSELS.items()], "vessel_class string, mcr_kw double, ref_speed_kn double, fuel_type string, engine_family string")


def factor_table(spark: SparkSession) -> DataFrame:
    """All factors by vessel class and mode: 24 rows, so a join with it is always a broadcast."""
    rows = []
    for cls, (mcr, ref, fuel, engine, *aux) in VESSELS.items():
        e = ("slow", "medium", "high").index(engine)
        for a, (mode, (main, auxg, sulphur, *by_engine)) in zip(aux * 1, MODES.items(), strict=True):
            rows.append((cls, mode, mcr, ref, fuel, engine, a, main, auxg, sulphur, by_engine[e], by_engine[3 + e], *FUELS[fuel]))
    return spark.createDataFrame(rows, "vessel_class string, mode string, mcr_kw double, ref_speed_kn double, fuel_type string, engine_family string, aux_kw double, sfc_main double, sfc_aux double, sulphur double, nox_kg_per_t double, pm_kg_per_t double, co2_factor double, wtt_factor double")


def load_factor(mode: Column, speed: Column, ref: Column) -> Column:
    cubed = F.least(F.greatest(F.pow(F.coalesce(speed / F.nullif(ref, F.lit(0.0)), F.lit(0.0)), 3), F.lit(0.2)), F.lit(1.0))
    return F.when(mode.isin("transit", "manoeuvring"), cubed).otherwise(0.0)


def with_emissions(df: DataFrame) -> DataFrame:
    """Fuel and pollutants of rows that have mode, speed_kn, duration_h and the columns of `factor_table`."""
    fuel = (F.col("mcr_kw") * F.col("load_factor") * F.col("sfc_main") + F.col("aux_kw") * F.col("sfc_aux")) * F.col("duration_h") / 1e6
    out = df.withColumn("load_factor", load_factor(F.col("mode"), F.col("speed_kn"), F.col("ref_speed_kn"))).withColumn("fuel_t", F.greatest(fuel, F.lit(0.0)))
    f = F.col("fuel_t")
    out = out.withColumns({
        "co2_t": f * F.col("co2_factor"), "nox_kg": f * F.col("nox_kg_per_t"), "sox_kg": f * F.col("sulphur") * 1000.0 * SOX_MULTIPLIER,
        "pm_kg": f * F.col("pm_kg_per_t"), "ttw_co2e_t": f * F.col("co2_factor"), "wtt_co2e_t": f * F.col("wtt_factor"),
    })
    return out.withColumn("wtw_co2e_t", F.col("ttw_co2e_t") + F.col("wtt_co2e_t"))


def relative_sigma(interpolated: Column, gap: Column, fallback: Column) -> Column:
    base = (SIGMA_SPEED**2 + SIGMA_SFC**2 + SIGMA_FACTOR**2) ** 0.5
    total = F.lit(base) + interpolated.cast("double") * PENALTY_INTERPOLATION + gap.cast("double") * PENALTY_GAP + fallback.cast("double") * PENALTY_FALLBACK
    return F.least(F.greatest(total, F.lit(0.05)), F.lit(0.95))


def is_fallback() -> Column:
    """Whether a row's factors are defaults, by class, fuel or engine."""
    return (F.col("vessel_class") == "unknown") | (F.col("fuel_type") == DEFAULT_FUEL) | (F.col("engine_family") == DEFAULT_ENGINE)


def bounds(metric: str, sigma: Column) -> list[Column]:
    """Lower and upper ends of the 95 % interval of a metric: the limit of the clipped normal sampler."""
    s = F.least(F.greatest(F.coalesce(sigma, F.lit(0.30)), F.lit(0.05)), F.lit(0.95))
    x = F.coalesce(F.col(metric), F.lit(0.0))
    return [F.greatest(x * (1 - Z95 * s), F.lit(0.0)).alias(f"{metric}_lower"), F.greatest(x * (1 + Z95 * s), F.lit(0.0)).alias(f"{metric}_upper")]


#: Draws of an interval, and the multiplier of the mixing of 32-bit numbers (odd, below 2^31, so that no product leaves a long).
DRAWS, MIX, STEP = 500, 0x45D9F3B, 0x9E3779B1


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, well mixed; kept to shifts and products that SQL can repeat."""
    for _ in range(2):
        x = ((x >> 16) ^ x) * MIX & 0xFFFFFFFF
    return (x >> 16) ^ x


def normals(seed: np.ndarray, other: np.ndarray, draws: int) -> np.ndarray:
    """Standard normal draws of each pair of 32-bit seeds: two mixed counters and the Box-Muller transform."""
    i = np.arange(draws, dtype=np.int64)[None]
    u, v = (mixed((s[:, None] + i * STEP) & 0xFFFFFFFF) for s in (seed, other))
    return np.sqrt(-2 * np.log((u + 1) / 4294967296.0)) * np.cos(2 * np.pi * v / 4294967296.0)


def sampled_bounds(total: np.ndarray, sigma: np.ndarray, seed: np.ndarray, other: np.ndarray, draws: int = DRAWS) -> tuple[np.ndarray, np.ndarray]:
    """The 0.025 and 0.975 quantiles of draws around each total, no draw below zero; zero for totals that are not positive."""
    rel = np.clip(sigma, 0.05, 0.95)
    x = np.maximum(total[:, None] * (1 + rel[:, None] * normals(seed, other, draws)), 0)
    x.sort(1)
    ends = []
    for p in (0.025, 0.975):
        at = (draws - 1) * p
        low = int(at)
        ends.append(np.where(total > 0, x[:, low] + (x[:, min(low + 1, draws - 1)] - x[:, low]) * (at - low), 0.0))
    return ends[0], ends[1]
