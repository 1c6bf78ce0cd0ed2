"""Vessel performance and the price of an edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.geo import clamp, col, mod360
from fathomline.functions.risk import or_else
from fathomline.params import DEFAULT, Params

#: Speed factor by wave-height bin (rows) and encounter-angle bin of 45 degrees (columns).
POLAR = (
    (1.0, 0.99, 0.98, 0.97, 0.96, 0.97, 0.98, 0.99),
    (0.98, 0.96, 0.94, 0.92, 0.90, 0.92, 0.94, 0.96),
    (0.95, 0.92, 0.88, 0.84, 0.80, 0.84, 0.88, 0.92),
    (0.90, 0.85, 0.80, 0.75, 0.70, 0.75, 0.80, 0.85),
    (0.85, 0.78, 0.70, 0.65, 0.60, 0.65, 0.70, 0.78),
    (0.75, 0.68, 0.60, 0.55, 0.50, 0.55, 0.60, 0.68),
)


def polar_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h, d, f) for h, row in enumerate(POLAR) for d, f in enumerate(row)], "h_bin int, d_bin int, factor double")


def height_bin(wave) -> Column:
    return F.least(F.floor(F.greatest(or_else(wave, 0), F.lit(0.0))), F.lit(5)).cast("int")


def encounter_bin(wave_dir, heading) -> Column:
    return (F.floor(mod360(col(wave_dir) - col(heading)) / 45.0) % 8).cast("int")


def polar_factor(wave, wave_dir, heading) -> Column:
    table = F.array(*[F.lit(f) for row in POLAR for f in row])
    return F.get(table, height_bin(wave) * 8 + encounter_bin(F.coalesce(col(wave_dir), col(heading)), heading))


def performance(distance_nm, wave, wave_dir, wind, wind_dir, current, current_dir, heading, p: Params = DEFAULT) -> dict[str, Column]:
    """hours, fuel_t, ground_kn, speed_factor and surge over a distance."""
    heading = col(heading)
    angle = lambda d: F.cos(F.radians(F.coalesce(col(d), heading) - heading))
    penalty = 0.2 * (or_else(wind, 0) / 90.0) * angle(wind_dir)
    boost = or_else(current, 0) / p.km_per_nm * angle(current_dir)
    factor = F.greatest(polar_factor(wave, wave_dir, heading) - penalty, F.lit(0.05))
    ground = F.greatest(F.greatest(p.service_speed_kn * factor, F.lit(0.1)) + boost, F.lit(0.1))
    surge = clamp(1.0 / factor, 0.6, 2.5)
    fuel = col(distance_nm) * (p.fuel_t_per_day / (p.service_speed_kn * 24.0)) * surge
    return {"hours": col(distance_nm) / ground, "fuel_t": fuel, "ground_kn": ground, "speed_factor": factor, "surge": surge}


def edge_cost(distance_nm, hours, fuel, risk, no_go, alpha, beta, gamma, safety, p: Params = DEFAULT) -> Column:
    """USD for an edge; a no-go edge costs a calm passage many times over."""
    distance_nm, risk = col(distance_nm), col(risk)
    excess = F.greatest(risk - p.risk_free, F.lit(0.0))
    cost = col(alpha) * col(hours) * p.time_usd_h + col(beta) * F.pow(excess, F.lit(max(p.risk_power, 1.0))) * distance_nm * p.risk_usd + col(gamma) * col(fuel) * p.fuel_usd_t
    cost = F.when(col(safety) & (risk > p.safety_from), cost * (1.0 + p.safety_factor * (risk - p.safety_from) / (1.0 - p.safety_from))).otherwise(cost)
    calm = p.fuel_t_per_day / (p.service_speed_kn * 24.0)
    blocked = distance_nm * (round(calm, 3) * p.fuel_usd_t + p.time_usd_h / p.service_speed_kn) * p.no_go_factor
    return F.when(col(no_go), blocked).otherwise(cost)
