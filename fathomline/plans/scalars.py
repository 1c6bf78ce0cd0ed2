"""Queries for scalar functions, predicates and source reshaping, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import geo, risk, vessel
from fathomline.functions.geo import rounded as r
from fathomline.params import DEFAULT
from fathomline.plans import oracle as o
from fathomline.sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def edge_ends(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the coordinates of both ends."""
    return fx.edge_ends(spark, d)


ENDS = "SELECT e.src, e.dst, distance_nm, distance_km, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM nav_edges e JOIN nav_nodes a ON a.node_id = src JOIN nav_nodes b ON b.node_id = dst"
ENDS_AT = ("lat1", "lon1", "lat2", "lon2")
WX = ("wind_speed", "wave_height", "precipitation", "visibility")


@query(o.over("SELECT node_id, lon, lat FROM nav_nodes", "nav_nodes"))
def nav_nodes(spark, d):
    return fx.nav_nodes(spark, d).select("node_id", "lon", "lat")


@query(o.over(f"SELECT src, dst, {o.r('distance_nm')} AS distance_nm, {o.r('distance_km')} AS distance_km FROM nav_edges", "nav_edges"))
def nav_edges(spark, d):
    return fx.nav_edges(spark, d).select("src", "dst", r("distance_nm").alias("distance_nm"), r("distance_km").alias("distance_km"))


@query(o.over(f"SELECT src, dst, {o.r(o.hav(*ENDS_AT))} AS nm FROM e", "nav_edges", e=ENDS))
def haversine_nm(spark, d):
    return edge_ends(spark, d).select("src", "dst", r(geo.haversine_nm(*ENDS_AT)).alias("nm"))


@query(o.over(f"SELECT src, dst, {o.r(o.km(*ENDS_AT))} AS km FROM e", "nav_edges", e=ENDS))
def haversine_km(spark, d):
    return edge_ends(spark, d).select("src", "dst", r(geo.haversine_km(*ENDS_AT)).alias("km"))


@query(o.over(f"SELECT src, dst, {o.r(o.brg(*ENDS_AT))} AS deg FROM e", "nav_edges", e=ENDS))
def bearing(spark, d):
    return edge_ends(spark, d).select("src", "dst", r(geo.bearing(*ENDS_AT)).alias("deg"))


@query(o.over(f"SELECT node_id, step_h, {o.r(o.opp('wind_dir', 'wave_dir'))} AS opposition FROM wx_obs", "wx_obs"))
def angular_opposition(spark, d):
    return fx.wx_obs(spark, d).select("node_id", "step_h", r(geo.opposition("wind_dir", "wave_dir")).alias("opposition"))


@query(o.over(f"SELECT node_id, step_h, {o.r(o.risk())} AS risk FROM wx_obs", "wx_obs"))
def safety_risk(spark, d):
    return fx.wx_obs(spark, d).select("node_id", "step_h", r(risk.safety_risk(*WX)).alias("risk"))


@query(o.over(f"SELECT node_id, step_h, {o.r(o.wcost('45e0'))} AS cost FROM wx_obs", "wx_obs"))
def weather_cost(spark, d):
    cost = risk.weather_cost("wind_speed", "wind_dir", "wave_height", "wave_dir", "current_vel", "current_dir", F.lit(45.0))
    return fx.wx_obs(spark, d).select("node_id", "step_h", r(cost).alias("cost"))


@query(o.over(f"SELECT node_id, step_h, {o.r(o.severity())} AS severity FROM wx_obs", "wx_obs"))
def display_severity(spark, d):
    return fx.wx_obs(spark, d).select("node_id", "step_h", r(risk.display_severity(*WX)).alias("severity"))


PERF = o.perf("100e0", "45e0")


@query(o.over(f"SELECT node_id, step_h, {', '.join(f'{o.r(v)} AS {k}' for k, v in PERF.items())} FROM wx_obs", "wx_obs"))
def vessel_performance(spark, d):
    found = vessel.performance(F.lit(100.0), "wave_height", "wave_dir", "wind_speed", "wind_dir", "current_vel", "current_dir", F.lit(45.0))
    return fx.wx_obs(spark, d).select("node_id", "step_h", *[r(c).alias(k) for k, c in found.items()])


@query(o.over(f"SELECT node_id, step_h, {o.r(o.polar('wave_height', 'wave_dir', '45e0'))} AS factor, {o.r('14e0 * ' + o.polar('wave_height', 'wave_dir', '45e0'))} AS speed_kn FROM wx_obs", "wx_obs"))
def polar_speed(spark, d):
    """A broadcast join with the table of 48 rows, a fixed size."""
    w = fx.wx_obs(spark, d).withColumns({"h_bin": vessel.height_bin("wave_height"), "d_bin": vessel.encounter_bin(F.coalesce("wave_dir", F.lit(45.0)), F.lit(45.0))})
    j = w.join(F.broadcast(vessel.polar_table(spark)), ["h_bin", "d_bin"], "left").withColumn("factor", F.coalesce("factor", F.lit(0.25)))
    return j.select("node_id", "step_h", r("factor").alias("factor"), r(F.col("factor") * DEFAULT.service_speed_kn).alias("speed_kn"))


@query("SELECT CAST(h AS BIGINT) AS h_bin, FLOOR(AVG(f) * 1e6 + 0.50001e0) / 1e6 AS factor FROM (SELECT (i // 8) AS h, ([" + ", ".join(f"{f}e0" for row in vessel.POLAR for f in row) + "])[i + 1] AS f FROM range(48) t(i)) GROUP BY h")
def polar_mean(spark, d):
    return vessel.polar_table(spark).groupBy(F.col("h_bin").cast("long").alias("h_bin")).agg(r(F.avg("factor")).alias("factor"))


@query(o.over(f"""SELECT node_id, step_h, {o.r("-wind_speed * SIN(RADIANS(wind_dir))")} AS u_from, {o.r("-wind_speed * COS(RADIANS(wind_dir))")} AS v_from,
  {o.r("wind_speed * SIN(RADIANS(wind_dir))")} AS u_toward, {o.r("wind_speed * COS(RADIANS(wind_dir))")} AS v_toward FROM wx_obs""", "wx_obs"))
def wind_components(spark, d):
    (a, b), (c, e) = geo.uv_from("wind_speed", "wind_dir"), geo.uv_toward("wind_speed", "wind_dir")
    return fx.wx_obs(spark, d).select("node_id", "step_h", r(a).alias("u_from"), r(b).alias("v_from"), r(c).alias("u_toward"), r(e).alias("v_toward"))


MODE = "CASE WHEN m IN ('balanced', 'safety', 'distance') THEN m WHEN m = 'fastest' THEN 'distance' WHEN m IN ('lowest-risk', 'risk') THEN 'safety' ELSE 'balanced' END"


def mode_name(raw) -> Column:
    """The objective behind what was typed; what isn't known is balanced."""
    m = F.lower(F.trim(geo.col(raw)))
    alias = F.when(m == "fastest", "distance").when(m.isin("lowest-risk", "risk"), "safety").otherwise("balanced")
    return F.when(m.isin(*DEFAULT.profiles), m).otherwise(alias)


@query(o.over(f"""SELECT voyage_id, mode, CASE mode WHEN 'safety' THEN 0.7e0 ELSE 1e0 END AS alpha, CASE mode WHEN 'balanced' THEN 0.45e0 WHEN 'safety' THEN 1.5e0 ELSE 0e0 END AS beta,
  CASE mode WHEN 'distance' THEN 0e0 ELSE 1e0 END AS gamma, m NOT IN ('balanced', 'safety', 'distance', 'fastest', 'lowest-risk', 'risk') AS unknown_mode
  FROM (SELECT voyage_id, m, {MODE} AS mode FROM (SELECT voyage_id, lower(trim(mode_raw)) AS m FROM voyages))""", "voyages"))
def objective_profile(spark, d):
    """Profiles are three rows, a fixed size to broadcast."""
    p = spark.createDataFrame([(k, *v) for k, v in DEFAULT.profiles.items()], "mode string, alpha double, beta double, gamma double")
    v = fx.voyages(spark, d).select("voyage_id", mode_name("mode_raw").alias("mode"), (~F.lower(F.trim("mode_raw")).isin(*DEFAULT.profiles, "fastest", "lowest-risk", "risk")).alias("unknown_mode"))
    return v.join(F.broadcast(p), "mode").select("voyage_id", "mode", "alpha", "beta", "gamma", "unknown_mode")


@query(o.over(f"SELECT voyage_id, {MODE} AS mode, CASE {MODE} WHEN 'distance' THEN 'Shortest passage, weather ignored' WHEN 'safety' THEN 'Lowest exposure to wind and waves' ELSE 'Time, fuel and risk weighed together' END AS reason FROM (SELECT voyage_id, lower(trim(mode_raw)) AS m FROM voyages)", "voyages"))
def mode_explanation(spark, d):
    said = F.create_map(F.lit("distance"), F.lit("Shortest passage, weather ignored"), F.lit("safety"), F.lit("Lowest exposure to wind and waves"), F.lit("balanced"), F.lit("Time, fuel and risk weighed together"))
    return fx.voyages(spark, d).select("voyage_id", mode_name("mode_raw").alias("mode")).withColumn("reason", said[F.col("mode")])


@query(o.over(f"SELECT DISTINCT {o.r('lat', 2)} AS qlat, {o.r('lon', 2)} AS qlon FROM nav_nodes", "nav_nodes"))
def quantize_points(spark, d):
    return fx.nav_nodes(spark, d).select(r("lat", 2).alias("qlat"), r("lon", 2).alias("qlon")).distinct()


VALUE_TEXT = "CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'n/a' WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN '' ELSE CAST(event_id AS VARCHAR) || '.5' END"


@query(f"SELECT event_id, CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS number, COALESCE(CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END, 0e0) AS or_zero FROM (SELECT event_id, TRY_CAST({VALUE_TEXT} AS DOUBLE) AS x FROM events)")
def valid_number(spark, d):
    e, k = fx.table(spark, d, "events"), F.col("event_id") % 5
    said = F.when(k == 0, "NaN").when(k == 1, "n/a").when(k == 2, F.col("event_id").cast("string")).when(k == 3, "").otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    x = risk.finite(said.try_cast("double"))
    return e.select("event_id", x.alias("number"), F.coalesce(x, F.lit(0.0)).alias("or_zero"))


FIELDS = ("wind_speed", "wind_dir", "precipitation", "visibility", "wave_height", "wave_dir", "current_vel", "current_dir")
PATCH = {f: f"({f} IS NULL" + (f" OR {f} = 0e0)" if f in risk.ZERO_IS_MISSING else ")") for f in FIELDS}


@query(o.over("SELECT node_id, step_h, " + ", ".join(f"{v} AS {k}_bad" for k, v in PATCH.items()) + " FROM wx_obs", "wx_obs"))
def needs_patch(spark, d):
    return fx.wx_obs(spark, d).select("node_id", "step_h", *[risk.needs_patch(f).alias(f"{f}_bad") for f in FIELDS])


@query(o.over("SELECT node_id, step_h, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in PATCH.items()) + "], lambda x: x IS NOT NULL), ',') AS missing FROM wx_obs", "wx_obs"))
def missing_fields(spark, d):
    names = F.filter(F.array(*[F.when(risk.needs_patch(f), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())
    return fx.wx_obs(spark, d).select("node_id", "step_h", F.array_join(names, ",").alias("missing"))


@query(o.over(f"SELECT node_id, step_h FROM wx_obs WHERE {o.NO_GO}", "wx_obs"))
def no_go_filter(spark, d):
    return fx.wx_obs(spark, d).where(risk.no_go("wave_height", "wind_speed", "current_vel")).select("node_id", "step_h")


@query(o.over("SELECT node_id, step_h FROM wx_obs WHERE wind_speed IS NULL OR wave_height IS NULL", "wx_obs"))
def missing_weather(spark, d):
    return fx.wx_obs(spark, d).where(risk.missing_weather("wind_speed", "wave_height")).select("node_id", "step_h")


@query(o.over(f"SELECT node_id, step_h, CASE WHEN s < 33e0 THEN 'low' WHEN s < 60e0 THEN 'moderate' WHEN s < 80e0 THEN 'high' ELSE 'extreme' END AS band FROM (SELECT node_id, step_h, {o.r(o.severity())} AS s FROM wx_obs)", "wx_obs"))
def risk_band(spark, d):
    band = risk.banded("s", [(33.0, "low"), (60.0, "moderate"), (80.0, "high")], "extreme", strict=True)
    return fx.wx_obs(spark, d).select("node_id", "step_h", r(risk.display_severity(*WX)).alias("s")).select("node_id", "step_h", band.alias("band"))


#: The upper bounds of Beaufort forces 1 to 11, km/h; below 1 is force 0.
BEAUFORT = (5, 11, 19, 28, 38, 49, 61, 74, 88, 102, 117)


@query(o.over("SELECT node_id, step_h, CAST(CASE WHEN wind_speed < 1e0 THEN 0 " + " ".join(f"WHEN wind_speed <= {b}e0 THEN {i + 1}" for i, b in enumerate(BEAUFORT)) + " ELSE 12 END AS BIGINT) AS force FROM wx_obs", "wx_obs"))
def beaufort(spark, d):
    passed = F.size(F.filter(F.array(*map(F.lit, BEAUFORT)), lambda b: F.col("wind_speed") > b))
    return fx.wx_obs(spark, d).select("node_id", "step_h", F.when(F.col("wind_speed") < 1.0, 0).otherwise(passed + 1).cast("long").alias("force"))


@query(o.over("SELECT src, dst, CAST(CASE WHEN distance_km <= 25e0 THEN 2 WHEN distance_km <= 80e0 THEN 3 WHEN distance_km <= 180e0 THEN 4 ELSE 5 END AS BIGINT) AS samples FROM nav_edges", "nav_edges"))
def edge_sample_count(spark, d):
    return fx.nav_edges(spark, d).select("src", "dst", sample_count("distance_km").cast("long").alias("samples"))


def sample_count(distance_km) -> Column:
    x = geo.col(distance_km)
    return F.when(x <= 25.0, 2).when(x <= 80.0, 3).when(x <= 180.0, 4).otherwise(5)


DELTAS = "SELECT event_id, value AS a, COALESCE(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), NULL) AS b FROM events"


@query(f"""SELECT event_id, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN ABS(a - b) < 0.05e0 OR FLOOR(a * 1e1 + 0.5e0) = FLOOR(b * 1e1 + 0.5e0) THEN 'neutral' WHEN a < b THEN 'good' ELSE 'bad' END AS verdict FROM ({DELTAS})""")
def delta_class(spark, d):
    """Lower is better; a small difference, or one that the shown digits hide, is neutral."""
    a, b = F.col("a"), F.col("b")
    same = (F.abs(a - b) < 0.05) | (F.floor(a * 10.0 + 0.5) == F.floor(b * 10.0 + 0.5))
    verdict = F.when(a.isNull() | b.isNull(), F.lit(None)).when(same, "neutral").when(a < b, "good").otherwise("bad")
    return _deltas(spark, d).select("event_id", verdict.alias("verdict"))


def _deltas(spark, d) -> DataFrame:
    return fx.table(spark, d, "events").select("event_id", F.col("value").alias("a"), F.expr("lag(value) over (partition by user_id order by ts, event_id)").alias("b"))


@query(f"""SELECT event_id, CASE WHEN b IS NULL OR ABS(a - b) < 0.05e0 THEN '' WHEN FLOOR(a + 0.5e0) = FLOOR(b + 0.5e0) THEN 'same' WHEN ABS(a - b) < 0.5e0 THEN 'slight' WHEN a < b THEN 'saved' ELSE 'added' END AS badge FROM ({DELTAS})""")
def result_badges(spark, d):
    a, b = F.col("a"), F.col("b")
    badge = (F.when(b.isNull() | (F.abs(a - b) < 0.05), "").when(F.floor(a + 0.5) == F.floor(b + 0.5), "same").when(F.abs(a - b) < 0.5, "slight").when(a < b, "saved").otherwise("added"))
    return _deltas(spark, d).select("event_id", badge.alias("badge"))


MESSAGE = "CASE event_id % 4 WHEN 0 THEN 'HTTP 429 Too Many Requests' WHEN 1 THEN 'Minutely API request limit exceeded. Retry after ' || CAST(event_id % 90 AS VARCHAR) || ' seconds' WHEN 2 THEN 'connection reset' ELSE 'Rate Limit reached' END"


@query(f"""SELECT event_id, regexp_matches(lower(m), '429|too many requests|rate limit|request limit') AS limited, TRY_CAST(NULLIF(regexp_extract(lower(m), 'retry after ([0-9]+)', 1), '') AS BIGINT) AS retry_after
FROM (SELECT event_id, {MESSAGE} AS m FROM events)""")
def rate_limit_error(spark, d):
    k = F.col("event_id") % 4
    said = F.when(k == 0, "HTTP 429 Too Many Requests").when(k == 1, F.format_string("Minutely API request limit exceeded. Retry after %d seconds", F.col("event_id") % 90)).when(k == 2, "connection reset").otherwise("Rate Limit reached")
    m = F.lower("m")
    after = F.nullif(F.regexp_extract(m, "retry after ([0-9]+)", 1), F.lit("")).cast("long")
    return fx.table(spark, d, "events").select("event_id", said.alias("m")).select("event_id", m.rlike("429|too many requests|rate limit|request limit").alias("limited"), after.alias("retry_after"))


NODE_TEXT = "CASE p_partkey % 4 WHEN 0 THEN '(' || CAST(p_size AS VARCHAR) || '.25, -' || CAST(p_size AS VARCHAR) || '.5)' WHEN 1 THEN CAST(p_size AS VARCHAR) || ' ' || CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'node ' || CAST(p_size AS VARCHAR) ELSE '1,2,3' END"


@query(f"""SELECT k, CASE WHEN len(n) = 2 THEN TRY_CAST(n[1] AS DOUBLE) END AS lon, CASE WHEN len(n) = 2 THEN TRY_CAST(n[2] AS DOUBLE) END AS lat
FROM (SELECT CAST(p_partkey AS BIGINT) AS k, regexp_extract_all({NODE_TEXT}, '-?[0-9]+\\.?[0-9]*') AS n FROM part)""")
def parse_node_id(spark, d):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    said = (F.when(k == 0, F.concat(F.lit("("), size, F.lit(".25, -"), size, F.lit(".5)"))).when(k == 1, F.concat_ws(" ", size, F.col("p_partkey").cast("string")))
            .when(k == 2, F.concat(F.lit("node "), size)).otherwise("1,2,3"))
    n = F.regexp_extract_all(said, F.lit(r"-?\d+\.?\d*"), F.lit(0))
    part = lambda i: F.when(F.size("n") == 2, F.get("n", F.lit(i)).try_cast("double"))
    return fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), n.alias("n")).select("k", part(0).alias("lon"), part(1).alias("lat"))


LATLON = "CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.5,-' || CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) || ', 3' ELSE '-7.,8.25' END"


@query(f"""SELECT k, CASE WHEN ok THEN TRY_CAST(split_part(t, ',', 1) AS DOUBLE) END AS lat, CASE WHEN ok THEN TRY_CAST(split_part(t, ',', 2) AS DOUBLE) END AS lon
FROM (SELECT k, t, regexp_full_match(t, '-?[0-9]+\\.?[0-9]*,-?[0-9]+\\.?[0-9]*') AS ok FROM (SELECT CAST(p_partkey AS BIGINT) AS k, {LATLON} AS t FROM part))""")
def parse_latlon(spark, d):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(size, F.lit(".5,-"), size)).when(k == 1, F.concat(size, F.lit(", 3"))).otherwise("-7.,8.25")
    part = lambda i: F.when(F.col("t").rlike(r"^-?\d+\.?\d*,-?\d+\.?\d*$"), F.get(F.split("t", ","), F.lit(i)).try_cast("double"))
    return fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), said.alias("t")).select("k", part(0).alias("lat"), part(1).alias("lon"))


@query("""SELECT k, CASE WHEN level = 'heightAboveGround' AND name IN ('10u', 'u10') THEN 'wind_u10' WHEN level = 'heightAboveGround' AND name IN ('10v', 'v10') THEN 'wind_v10'
  WHEN level = 'surface' AND name IN ('tp', 'prate') THEN 'precipitation' END AS variable
FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CASE p_partkey % 3 WHEN 0 THEN 'surface' ELSE 'heightAboveGround' END AS level, (['10u', 'u10', '10v', 'v10', 'tp', 'prate', 't2m'])[CAST(p_size % 7 AS INTEGER) + 1] AS name FROM part)""")
def grib_var_classify(spark, d):
    name = F.get(F.array(*map(F.lit, ("10u", "u10", "10v", "v10", "tp", "prate", "t2m"))), F.col("p_size") % 7)
    rows = fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.when(F.col("p_partkey") % 3 == 0, "surface").otherwise("heightAboveGround").alias("level"), name.alias("name"))
    high = F.col("level") == "heightAboveGround"
    kind = F.when(high & F.col("name").isin("10u", "u10"), "wind_u10").when(high & F.col("name").isin("10v", "v10"), "wind_v10").when((F.col("level") == "surface") & F.col("name").isin("tp", "prate"), "precipitation")
    return rows.select("k", kind.alias("variable"))


@query("""SELECT event_id, '/gfs.' || strftime(ts, '%Y%m%d') || '/' || lpad(CAST(6 * (hour(ts) // 6) AS VARCHAR), 2, '0') || '/f' || lpad(CAST(3 * (event_id % 25) AS VARCHAR), 3, '0') AS path FROM events""")
def source_url(spark, d):
    run = F.floor(F.hour("ts") / 6) * 6
    path = F.format_string("/gfs.%s/%02d/f%03d", F.date_format("ts", "yyyyMMdd"), run, (F.col("event_id") % 25) * 3)
    return fx.table(spark, d, "events").select("event_id", path.alias("path"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d') || lpad(CAST(6 * (hour(ts) // 6) AS VARCHAR), 2, '0') AS run_key,
  strftime(ts - INTERVAL 4 HOUR, '%Y%m%d') || lpad(CAST(6 * (hour(ts - INTERVAL 4 HOUR) // 6) AS VARCHAR), 2, '0') AS published FROM events""")
def model_run_key(spark, d):
    """The six-hour run of a time, and the latest run that was published by then, four hours after its start."""
    key = lambda t: F.concat(F.date_format(t, "yyyyMMdd"), F.lpad((F.floor(F.hour(t) / 6) * 6).cast("string"), 2, "0"))
    return fx.table(spark, d, "events").select("event_id", key(F.col("ts")).alias("run_key"), key(F.col("ts") - F.expr("interval 4 hours")).alias("published"))


@query("""SELECT event_id, LEAST(120e0, GREATEST(POWER(2e0, n) + 0.5e0, COALESCE(w, 0e0))) AS wait_s, LEAST(30e0, POWER(2e0, n)) AS grouped_s, 60e0 * (n + 1) AS text_s
FROM (SELECT event_id, event_id % 9 AS n, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 200 AS DOUBLE) END AS w FROM events)""")
def backoff(spark, d):
    n, w = F.col("event_id") % 9, F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 200).cast("double"))
    two = F.pow(F.lit(2.0), n)
    return fx.table(spark, d, "events").select("event_id", F.least(F.lit(120.0), F.greatest(two + 0.5, F.coalesce(w, F.lit(0.0)))).alias("wait_s"), F.least(F.lit(30.0), two).alias("grouped_s"), (60.0 * (n + 1)).alias("text_s"))


#: The stops of the risk ramp, percent and red, green, blue.
RAMP = ((0, 0, 80, 255), (12, 0, 160, 255), (25, 0, 220, 180), (38, 60, 220, 60), (50, 180, 230, 0), (62, 255, 220, 0), (75, 255, 140, 0), (88, 255, 50, 0), (100, 160, 0, 30))


@query(o.over("SELECT node_id, step_h, " + ", ".join(
    f"CAST(FLOOR(CASE {' '.join(f'WHEN s <= {b[0]} THEN {a[i]} + ({b[i]} - {a[i]}) * (s - {a[0]}) / {b[0] - a[0]}e0' for a, b in zip(RAMP, RAMP[1:], strict=False))} ELSE {RAMP[-1][i]} END + 0.5e0) AS BIGINT) AS {n}"
    for i, n in ((1, "red"), (2, "green"), (3, "blue"))) + f" FROM (SELECT node_id, step_h, LEAST(GREATEST({o.r(o.severity())}, 0e0), 100e0) AS s FROM wx_obs)", "wx_obs"))
def risk_color(spark, d):
    def channel(i: int) -> Column:
        x = F.lit(RAMP[-1][i]).cast("double")
        for a, b in reversed(list(zip(RAMP, RAMP[1:], strict=False))):
            x = F.when(F.col("s") <= b[0], a[i] + (b[i] - a[i]) * (F.col("s") - a[0]) / float(b[0] - a[0])).otherwise(x)
        return F.floor(x + 0.5)

    rows = fx.wx_obs(spark, d).select("node_id", "step_h", geo.clamp(r(risk.display_severity(*WX)), 0, 100).alias("s"))
    return rows.select("node_id", "step_h", channel(1).alias("red"), channel(2).alias("green"), channel(3).alias("blue"))


@query(o.over(f"""SELECT node_id, step_h, printf('%02X%02X00', CAST(FLOOR(LEAST(255e0, 510e0 * s)) AS INTEGER), CAST(FLOOR(LEAST(255e0, 510e0 * (1e0 - s))) AS INTEGER)) AS fill
FROM (SELECT node_id, step_h, LEAST(GREATEST({o.r(o.severity())} / 1e2, 0e0), 1e0) AS s FROM wx_obs)""", "wx_obs"))
def score_fill(spark, d):
    part = lambda x: F.floor(F.least(F.lit(255.0), 510.0 * x))
    s = geo.clamp(r(risk.display_severity(*WX)) / 100.0, 0, 1)
    return fx.wx_obs(spark, d).select("node_id", "step_h", s.alias("s")).select("node_id", "step_h", F.format_string("%02X%02X00", part(F.col("s")), part(1.0 - F.col("s"))).alias("fill"))


@query("SELECT event_id, CAST(h // 24 AS VARCHAR) || 'd ' || CAST(h % 24 AS VARCHAR) || 'h' AS eta FROM (SELECT event_id, CAST(FLOOR(value) AS BIGINT) AS h FROM events)")
def fmt_eta(spark, d):
    h = F.floor("value")
    return fx.table(spark, d, "events").select("event_id", F.format_string("%dd %dh", F.floor(h / 24), h % 24).alias("eta"))


@query(o.over("SELECT DISTINCT CAST(CAST(FLOOR(lat * 1e2 + 0.5e0) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(FLOOR(lon * 1e2 + 0.5e0) AS BIGINT) AS VARCHAR) || ':' || CAST(n.node_id % 25 AS VARCHAR) AS cube_key FROM nav_nodes n", "nav_nodes"))
def weather_cube_key(spark, d):
    q = lambda c: F.floor(F.col(c) * 100.0 + 0.5).cast("string")
    return fx.nav_nodes(spark, d).select(F.concat_ws(":", q("lat"), q("lon"), (F.col("node_id") % 25).cast("string")).alias("cube_key")).distinct()


#: Place kinds that count as water.
WATER = ("sea", "ocean", "bay", "strait", "water", "river", "lake", "harbour", "channel", "gulf", "lagoon", "fjord", "coastline", "reservoir", "canal")


@query("SELECT CAST(p_partkey AS BIGINT) AS k, COALESCE(t IN (" + ", ".join(f"'{w}'" for w in WATER) + "), TRUE) AS water FROM (SELECT p_partkey, (['sea', 'city', 'bay', 'road', NULL])[CAST(p_size % 5 AS INTEGER) + 1] AS t FROM part)")
def is_water_type(spark, d):
    kind = F.get(F.array(F.lit("sea"), F.lit("city"), F.lit("bay"), F.lit("road"), F.lit(None)), F.col("p_size") % 5)
    return fx.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.coalesce(kind.isin(*WATER), F.lit(True)).alias("water"))
