"""Risk, weather cost, severity and the predicates on weather."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.geo import clamp, col, opposition
from fathomline.params import DEFAULT, Params


def or_else(x, default: float) -> Column:
    return F.coalesce(col(x), F.lit(float(default)))


def finite(x) -> Column:
    """NaN and infinities become null."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def _ramp(x: Column, start: float, span: float, most: float) -> Column:
    return F.when(x <= start, F.lit(0.0)).otherwise(F.least(((x - start) / span) * ((x - start) / span), F.lit(most)))


def safety_risk(wind, wave, precip, vis) -> Column:
    wind, wave, precip, vis = or_else(wind, 0), or_else(wave, 0), or_else(precip, 0), or_else(vis, 10000)
    poor = F.greatest(F.lit(0.0), 1.0 - F.least(vis / 10000.0, F.lit(1.0)))
    return 0.45 * _ramp(wave, 2.2, 5.8, 1.2) + 0.35 * _ramp(wind, 28.0, 62.0, 1.2) + 0.15 * poor + 0.05 * F.least(precip / 10.0, F.lit(1.0))


def weather_cost(wind, wind_dir, wave, wave_dir, current, current_dir, heading) -> Column:
    heading = col(heading)
    toward = lambda d: opposition(F.coalesce(col(d), heading), heading)
    return (0.55 * _ramp(or_else(wave, 0), 2.2, 2.3, 1.0) * toward(wave_dir) + 0.35 * _ramp(or_else(wind, 0), 28.0, 34.0, 1.0) * toward(wind_dir)
            + 0.10 * F.least(or_else(current, 0) / 5.0, F.lit(1.0)) * toward(current_dir))


def display_severity(wind, wave, precip, vis) -> Column:
    return 100.0 * (0.40 * clamp(or_else(wave, 0) / 4.0, 0, 1) + 0.30 * clamp(or_else(wind, 0) / 35.0, 0, 1)
                    + 0.20 * clamp(1.0 - or_else(vis, 10000) / 10000.0, 0, 1) + 0.10 * clamp(or_else(precip, 0) / 10.0, 0, 1))


def no_go(wave, wind, current, p: Params = DEFAULT) -> Column:
    over = [F.coalesce(col(c) > k, F.lit(False)) for c, k in ((wave, p.wave_limit_m), (wind, p.wind_limit_kmh), (current, p.current_limit_kmh))]
    return reduce(lambda a, b: a | b, over)


def missing_weather(wind, wave) -> Column:
    return col(wind).isNull() | col(wave).isNull()


#: Fields in which a zero counts as missing (fixed values).
ZERO_IS_MISSING = ("wind_speed", "visibility", "wave_height")


def needs_patch(name: str) -> Column:
    x = finite(name)
    return x.isNull() | (x == 0.0) if name in ZERO_IS_MISSING else x.isNull()


def banded(x, bounds: list[tuple[float, str]], last: str, strict: bool = False) -> Column:
    """The label of the first bound that isn't exceeded (strict: that is above)."""
    x = col(x)
    out = None
    for bound, label in bounds:
        test = x < bound if strict else x <= bound
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(last))
