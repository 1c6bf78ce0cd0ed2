"""Streams with state, sinks by batch, and the source of forecast steps."""

import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fathomline.plans import routes
from fathomline.sources import fixtures
from fathomline.sources.steps import Steps
from fathomline.streaming import windows

SF = "/root/testdata/sf0.001"


def _waits(calls, limits):
    """Per call, until the stamp that many places before its last one leaves the window."""
    out, users = {}, {}
    for c in sorted(calls, key=lambda c: (c.t, c.event_id)):
        stamps = users.setdefault(c.user_id, [])
        stamps += [c.t] * c.units
        back = {k: stamps[-1 - n] if len(stamps) > n else None for k, n in limits.items()}
        out[c.event_id] = tuple(max(0, routes.RATE[k] * 1_000_000 - (c.t - back[k])) if back[k] is not None else 0 for k in limits)
    return out


@pytest.mark.parametrize("limits", [{"minute": 1, "hour": 1, "day": 2}, routes.USER_LIMITS])
def test_waits_of_a_stream_equal_those_of_the_table_over_a_restart(spark, limits):
    calls = fixtures.api_calls(spark, SF)
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = calls.agg(F.percentile_approx(t, [0.3, 0.6]).alias("q")).first()["q"]
    for part in (t <= bounds[0], (t > bounds[0]) & (t <= bounds[1]), t > bounds[1]):  # a run of the query each, from the checkpoint of the one before
        calls.where(part).coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = windows.waits(windows.read_stream(spark, f"{top}/in", calls.schema), limits, routes.RATE, "400 days")
        stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{top}/out").select("event_id", *[f"wait_{k}" for k in limits]).collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert len(rows) == len(got) and got == _waits(calls.withColumn("t", t).collect(), limits)
    if limits is routes.USER_LIMITS:
        assert got == {r[0]: tuple(r[1:]) for r in routes.rate_limit_wait(spark, SF).collect()}
    else:
        assert any(w[2] for w in got.values())


def test_state_of_a_user_goes_with_age_and_nothing_waits_after_it(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "event_id long, user_id long, ts timestamp, units int"
    for k, day in enumerate((1, 1, 9, 9)):
        rows = [(10 * k + i, 7, f"2024-01-0{day} 00:00:{10 * (k % 2) + i:02d}") for i in range(3)] + [(100 + k, 8, f"2024-01-0{day} 01:00:00")]
        spark.createDataFrame(rows, "event_id long, user_id long, t string").select("event_id", "user_id", F.to_timestamp("t").alias("ts"), F.lit(1).alias("units")).coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = windows.waits(windows.read_stream(spark, f"{top}/in", schema), {"minute": 4}, {"minute": 60}, "1 hour")
        q = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.event_id: r.wait_minute for r in spark.read.parquet(f"{top}/out").collect()}
    assert len(got) == 16 and all(got[i] == 0 for i in (0, 1, 2, 10, 20, 21, 22, 30, 100, 102))
    assert [got[i] // 1_000_000 for i in (11, 12, 31, 32)] == [49, 49, 49, 49]


def test_a_batch_that_comes_again_changes_nothing(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "lat double, lon double, wind_speed double, wave_height double, precipitation double, visibility double"
    spark.createDataFrame([(1.0, 2.0, 40.0, 3.0, 0.0, 9000.0), (3.0, 4.0, None, None, None, None)], schema).coalesce(1).write.parquet(f"{top}/in")

    def run(state):
        windows.severity_sink(windows.read_stream(spark, f"{top}/in", schema), f"{top}/out", f"{top}/{state}").awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{top}/out").collect()))

    first = run("a")
    assert [(r[0], r[3], r[4]) for r in first] == [(1.0, False, 0), (3.0, True, 0)] and first[0][2] > first[1][2] == 0  # the default weather is calm
    assert run("b") == first and run("a") == first


def test_steps_are_partitions_with_older_runs_and_fallback_rows(spark, tmp_path):
    for run, step, n in (("new", 0, 4), ("old", 0, 9), ("old", 3, 3)):
        (tmp_path / run).mkdir(exist_ok=True)
        pq.write_table(pa.table({"lat": [float(i) for i in range(n)], "lon": [0.5] * n, "u10": [1.5] * n}), tmp_path / run / f"{step}.parquet")
    (tmp_path / "new" / "3.parquet").write_bytes(b"<html>")
    (tmp_path / "new" / "6.parquet").write_bytes(b"PAR1")
    spark.dataSource.register(Steps)
    df = spark.read.format("forecast_steps").options(path=str(tmp_path), runs="new, old", last="6").load()
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert sorted((r.step_h, r.run or "") for r in rows) == [(0, "new")] * 4 + [(3, "old")] * 3 + [(6, "")]
    assert all(r.u10 == 1.5 and r.v10 is None for r in rows if r.run) and [r.lat for r in rows if not r.run] == [None]
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    for pushed in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        few = spark.read.format("forecast_steps").options(path=str(tmp_path), runs="new,old", last="6", pushdown=pushed).load().where("lat >= 1 and lat < 3 and u10 > 1")
        assert sorted((r.step_h, r.lat) for r in few.collect()) == [(0, 1.0), (0, 2.0), (3, 1.0), (3, 2.0)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
