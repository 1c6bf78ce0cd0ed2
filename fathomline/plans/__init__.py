"""Queries over whole tables, and the SQL that another engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Queries of priced searches, which take much longer than all others.
SEARCHES = ("turn_aware_cost", "refine_rounds", "voyage_route", "pareto_routes")


def _modules():
    from fathomline.plans import routes, scalars, spatial, voyages

    return (scalars, routes, spatial, voyages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
