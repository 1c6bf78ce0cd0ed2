"""SQL for another engine: the domain views, formulas and how a query is put together from them.

Written apart from the column functions, so that comparing both says something.
"""

from __future__ import annotations

VIEWS = {
    "nav_nodes": """SELECT CAST(p_partkey AS BIGINT) AS node_id, CAST(p_partkey % 100 AS BIGINT) AS col_, CAST(FLOOR(p_partkey / 1e2) AS BIGINT) AS row_,
  -60e0 + 0.25e0 * (p_partkey % 100) AS lon, 10e0 + 0.2e0 * FLOOR(p_partkey / 1e2) AS lat FROM part WHERE p_size > 2""",
    "nav_edges": """SELECT src, dst, 2e0 * 3440.065e0 * ATAN2(SQRT(h), SQRT(1e0 - h)) AS distance_nm, 2e0 * 6371e0 * ATAN2(SQRT(h), SQRT(1e0 - h)) AS distance_km
  FROM (SELECT a.node_id AS src, b.node_id AS dst, POWER(SIN(RADIANS(b.lat - a.lat) / 2e0), 2) + COS(RADIANS(a.lat)) * COS(RADIANS(b.lat)) * POWER(SIN(RADIANS(b.lon - a.lon) / 2e0), 2) AS h
        FROM nav_nodes a JOIN nav_nodes b ON b.row_ BETWEEN a.row_ - 1 AND a.row_ + 1 AND b.col_ BETWEEN a.col_ - 1 AND a.col_ + 1 AND a.node_id <> b.node_id) e""",
    "wx_obs": """SELECT CAST(l_partkey AS BIGINT) AS node_id, CAST(3 * (l_orderkey % 25) AS BIGINT) AS step_h, FLOOR((AVG(2e0 * l_quantity)) * 1e6 + 0.50001e0) / 1e6 AS wind_speed,
  FLOOR((AVG(CASE WHEN l_returnflag <> 'R' THEN 80e0 * l_discount END)) * 1e6 + 0.50001e0) / 1e6 AS wave_height, FLOOR((AVG(125e0 * l_tax)) * 1e6 + 0.50001e0) / 1e6 AS precipitation, FLOOR((AVG(10000e0 - 90e0 * ((l_orderkey * 17) % 100))) * 1e6 + 0.50001e0) / 1e6 AS visibility,
  FLOOR((AVG(0.2e0 * l_quantity)) * 1e6 + 0.50001e0) / 1e6 AS current_vel, CAST(MIN((l_orderkey * 53) % 360) AS DOUBLE) AS wind_dir, CAST(MIN((l_suppkey * 37) % 360) AS DOUBLE) AS wave_dir,
  CAST(MIN((l_partkey * 71) % 360) AS DOUBLE) AS current_dir FROM lineitem GROUP BY l_partkey, l_orderkey % 25""",
    "voyages": """SELECT CAST(o_orderkey AS BIGINT) AS voyage_id, o_orderdate AS departure, CAST(o_custkey % n.n AS BIGINT) AS start_key, CAST((o_orderkey * 7919) % n.n AS BIGINT) AS end_key,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'fastest' WHEN '2-HIGH' THEN 'Safety' WHEN '3-MEDIUM' THEN 'balanced' WHEN '4-NOT SPECIFIED' THEN 'fuel' ELSE ' distance ' END AS mode_raw
  FROM orders CROSS JOIN (SELECT COUNT(*) AS n FROM part) n""",
    "api_calls": "SELECT event_id, ts, user_id, CASE event_type WHEN 'error' THEN 2 ELSE 1 END AS units, value AS payload FROM events",
    "atmos_grid": """SELECT step_h, li, lj, 10e0 + 2e0 * li AS lat, -60e0 + 2.5e0 * lj AS lon, u10, v10, SUM(tax) OVER (PARTITION BY li, lj ORDER BY step_h ROWS UNBOUNDED PRECEDING) AS precip_accum
  FROM (SELECT CAST(3 * (l_orderkey % 25) AS BIGINT) AS step_h, CAST(FLOOR(l_partkey / 1e3) AS BIGINT) AS li, CAST(FLOOR((l_partkey % 100) / 1e1) AS BIGINT) AS lj,
        FLOOR((8e0 * (AVG(l_quantity) - 25e0)) * 1e6 + 0.50001e0) / 1e6 AS u10, FLOOR((1600e0 * (AVG(l_discount) - 0.05e0)) * 1e6 + 0.50001e0) / 1e6 AS v10, FLOOR((SUM(l_tax)) * 1e6 + 0.50001e0) / 1e6 AS tax FROM lineitem GROUP BY 1, 2, 3) g""",
    "marine_grid": """SELECT CAST(FLOOR(l_partkey / 1e3) AS BIGINT) AS li, CAST(FLOOR((l_partkey % 100) / 1e1) AS BIGINT) AS lj, FLOOR((AVG(80e0 * l_discount)) * 1e6 + 0.50001e0) / 1e6 AS wave_height,
  CAST(MIN((61 * CAST(FLOOR(l_partkey / 1e3) AS BIGINT) + 37 * CAST(FLOOR((l_partkey % 100) / 1e1) AS BIGINT)) % 360) AS DOUBLE) AS wave_dir,
  FLOOR((0.4e0 * (AVG(l_quantity) - 25e0)) * 1e6 + 0.50001e0) / 1e6 AS current_u, FLOOR((40e0 * (AVG(l_tax) - 0.04e0)) * 1e6 + 0.50001e0) / 1e6 AS current_v FROM lineitem WHERE l_orderkey % 25 = 0 GROUP BY 1, 2""",
    "route_points": """SELECT voyage_id, route_type, seq, node_id, 10e0 + 0.2e0 * FLOOR(node_id / 1e2) AS lat, -60e0 + 0.25e0 * (node_id % 100) AS lon
  FROM (SELECT voyage_id, route_type, seq, (start_key + step * seq) % n AS node_id FROM voyages CROSS JOIN (SELECT COUNT(*) AS n FROM part) c
        CROSS JOIN (SELECT 'baseline' AS route_type, 5 AS step UNION ALL SELECT 'optimized', 7) t CROSS JOIN (SELECT CAST(range AS BIGINT) AS seq FROM range(10)) s) r""",
    "route_wx": """SELECT r.*, w.step_h, wind_speed, wave_height, precipitation, visibility, current_vel, wind_dir, wave_dir, current_dir
  FROM route_points r LEFT JOIN wx_obs w ON w.node_id = r.node_id AND w.step_h = 3 * ((r.voyage_id + r.seq) % 25)""",
}
NEEDS = {"nav_edges": ["nav_nodes"], "route_points": ["voyages"], "route_wx": ["route_points", "wx_obs"]}


def over(sql: str, *views: str, **more: str) -> str:
    """sql over domain views and further named selects, in order."""
    order: list[str] = []

    def add(v: str) -> None:
        for need in NEEDS.get(v, []):
            add(need)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    named = [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ",\n".join(named) + "\n" if named else "") + sql


def recursive(sql: str, name: str, columns: str, key: str) -> str:
    """sql of over() in which the named select reads itself, with one row a key; what it reads in every step is made once."""
    for v in ("nav_nodes", "nav_edges", "snap"):
        sql = sql.replace(f"{v} AS (", f"{v} AS MATERIALIZED (", 1)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace(f"\n{name} AS (", f"\n{name}({columns}) USING KEY ({key}) AS (", 1)


def r(x: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(FLOOR(({x}) * {scale} + 0.50001e0) / {scale})"


def hav(lat1: str, lon1: str, lat2: str, lon2: str, radius: str = "3440.065e0") -> str:
    h = f"LEAST(1e0, POWER(SIN(RADIANS(({lat2}) - ({lat1})) / 2e0), 2) + COS(RADIANS({lat1})) * COS(RADIANS({lat2})) * POWER(SIN(RADIANS(({lon2}) - ({lon1})) / 2e0), 2))"
    return f"(2e0 * {radius} * ASIN(SQRT({h})))"


def km(*a: str) -> str:
    return hav(*a, radius="6371e0")


def m360(x: str) -> str:
    return f"(({x}) - 360e0 * FLOOR(({x}) / 360e0))"


def brg(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    d = f"RADIANS(({lon2}) - ({lon1}))"
    return m360(f"DEGREES(ATAN2(SIN({d}) * COS(RADIANS({lat2})), COS(RADIANS({lat1})) * SIN(RADIANS({lat2})) - SIN(RADIANS({lat1})) * COS(RADIANS({lat2})) * COS({d}))) + 360e0")


def fold(a: str, b: str) -> str:
    d = f"ABS({m360(a)} - {m360(b)})"
    return f"LEAST({d}, 360e0 - {d})"


def opp(a: str, b: str) -> str:
    return f"((1e0 - COS(RADIANS({fold(a, b)}))) / 2e0)"


def _ramp(x: str, start: str, span: str, most: str) -> str:
    return f"(CASE WHEN {x} <= {start} THEN 0e0 ELSE LEAST(POWER(({x} - {start}) / {span}, 2), {most}) END)"


def risk(wind: str = "wind_speed", wave: str = "wave_height", precip: str = "precipitation", vis: str = "visibility") -> str:
    w, h, p, v = (f"COALESCE({x}, {d})" for x, d in ((wind, "0e0"), (wave, "0e0"), (precip, "0e0"), (vis, "10000e0")))
    return (f"(0.45e0 * {_ramp(h, '2.2e0', '5.8e0', '1.2e0')} + 0.35e0 * {_ramp(w, '28e0', '62e0', '1.2e0')} + 0.15e0 * GREATEST(0e0, 1e0 - LEAST({v} / 10000e0, 1e0))"
            f" + 0.05e0 * LEAST({p} / 10e0, 1e0))")


def wcost(h: str) -> str:
    ramp_h, ramp_w = _ramp("COALESCE(wave_height, 0e0)", "2.2e0", "2.3e0", "1e0"), _ramp("COALESCE(wind_speed, 0e0)", "28e0", "34e0", "1e0")
    d = [opp(f"COALESCE({x}, {h})", h) for x in ("wave_dir", "wind_dir", "current_dir")]
    return f"(0.55e0 * {ramp_h} * {d[0]} + 0.35e0 * {ramp_w} * {d[1]} + 0.10e0 * LEAST(COALESCE(current_vel, 0e0) / 5e0, 1e0) * {d[2]})"


def severity(wind: str = "wind_speed", wave: str = "wave_height", precip: str = "precipitation", vis: str = "visibility") -> str:
    c = lambda x: f"LEAST(GREATEST({x}, 0e0), 1e0)"
    return (f"(100e0 * (0.40e0 * {c(f'COALESCE({wave}, 0e0) / 4e0')} + 0.30e0 * {c(f'COALESCE({wind}, 0e0) / 35e0')}"
            f" + 0.20e0 * {c(f'1e0 - COALESCE({vis}, 10000e0) / 10000e0')} + 0.10e0 * {c(f'COALESCE({precip}, 0e0) / 10e0')}))")


def polar(wave: str, wdir: str, h: str) -> str:
    from fathomline.functions.vessel import POLAR

    flat = ", ".join(f"{f}e0" for row in POLAR for f in row)
    hb = f"LEAST(FLOOR(GREATEST(COALESCE({wave}, 0e0), 0e0)), 5)"
    db = f"(FLOOR({m360(f'COALESCE({wdir}, {h}) - {h}')} / 45e0) % 8)"
    return f"([{flat}])[CAST({hb} * 8 + {db} AS INTEGER) + 1]"


def perf(dist: str, h: str) -> dict[str, str]:
    a = lambda x: f"COS(RADIANS(COALESCE({x}, {h}) - {h}))"
    f = f"GREATEST({polar('wave_height', 'wave_dir', h)} - 0.2e0 * (COALESCE(wind_speed, 0e0) / 90e0) * {a('wind_dir')}, 0.05e0)"
    g = f"GREATEST(GREATEST(14e0 * {f}, 0.1e0) + COALESCE(current_vel, 0e0) / 1.852e0 * {a('current_dir')}, 0.1e0)"
    s = f"LEAST(GREATEST(1e0 / {f}, 0.6e0), 2.5e0)"
    return {"hours": f"({dist} / {g})", "fuel_t": f"({dist} * (35e0 / 336e0) * {s})", "ground_kn": g, "speed_factor": f, "surge": s}


NO_GO = "(COALESCE(wave_height > 6e0, FALSE) OR COALESCE(wind_speed > 75e0, FALSE) OR COALESCE(current_vel > 8e0, FALSE))"


def price(dist: str, hours: str, fuel: str, rk: str, a: str, b: str, c: str, safety: str) -> str:
    base = f"({a} * {hours} * 2000e0 + {b} * POWER(GREATEST({rk} - 0.2e0, 0e0), 2) * {dist} * 300e0 + {c} * {fuel} * 600e0)"
    return (f"(CASE WHEN no_go THEN {dist} * (0.104e0 * 600e0 + 2000e0 / 14e0) * 50e0 WHEN {safety} AND {rk} > 0.25e0 THEN {base} * (1e0 + 10e0 * ({rk} - 0.25e0) / 0.75e0) ELSE {base} END)")
