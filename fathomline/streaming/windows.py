"""Event-time windows that run alike on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from fathomline.functions import risk
from fathomline.functions.geo import rounded
from fathomline.params import DEFAULT, Params


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def slots(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls and units in each six-hour model run; on a stream, rows later than `late` are left out."""
    c = calls.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = c.groupBy(F.window("at", "6 hours").alias("w")).agg(F.count("*").alias("calls"), F.sum("units").alias("units"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("run_start"), "calls", "units")


def sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Calls of a user without a pause of `gap` between them."""
    c = calls.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    s = c.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("calls"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "calls")


def limited(calls: DataFrame, per_minute: int, late: str = "1 minute") -> DataFrame:
    """Minutes, ten seconds apart, in which a user's calls go over a limit: the stream's form of trailing windows."""
    c = calls.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = c.groupBy(F.window("at", "1 minute", "10 seconds").alias("w"), "user_id").agg(F.sum("units").alias("units"))
    return w.where(F.col("units") > per_minute).select("user_id", F.col("w.end").cast("timestamp_ntz").alias("until"), "units")


def waits(calls: DataFrame, limits: dict[str, int], lengths: dict[str, int], late: str = "1 hour") -> DataFrame:
    """event_id and, per limit, the microseconds that a call of a stream has to wait until it fits, by stamps that are kept as state.

    calls: event_id, user_id, ts, units. Each unit is a stamp. A user's state is the newest stamps, as many as the largest limit, whatever the
    number of calls; it goes once the watermark has passed the newest by the longest window. Calls of one micro-batch are taken in order of time; one
    that comes after later ones, within `late`, takes its place among the stamps, but what was told before stays. A user's calls of a
    micro-batch are sorted in one task, so the source's limit to a trigger is the bound of its memory.
    """
    most, longest = max(limits.values()), max(lengths.values())
    names = list(limits)

    def run(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        stamps = list(state.get[0]) if state.exists else []
        rows = []
        for c in pd.concat(list(frames)).sort_values(["t", "event_id"]).itertuples(index=False):
            at = len(stamps)
            while at and stamps[at - 1] > c.t:
                at -= 1
            units = min(int(c.units), most + 1)
            stamps[at:at] = [c.t] * units
            last, row = at + units - 1, [c.event_id]
            for k in names:
                before = last - limits[k]
                gone = c.t - stamps[before] if before >= 0 else None
                row.append(max(lengths[k] * 1_000_000 - gone, 0) if gone is not None else 0)
            rows.append(row)
            stamps = stamps[-(most + 1) :]
        state.update((stamps,))
        ends = stamps[-1] // 1000 + longest * 1000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["event_id", *(f"wait_{k}" for k in names)])

    c = calls.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).where("units > 0")
    c = c.select("event_id", "user_id", "at", F.unix_micros("at").alias("t"), "units")
    kind = dict(calls.dtypes)["event_id"]
    out = f"event_id {kind}, " + ", ".join(f"wait_{k} long" for k in names)
    return c.groupBy("user_id").applyInPandasWithState(run, out, "stamps array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def severity_sink(stream: DataFrame, path: str, state: str, p: Params = DEFAULT):
    """A started query that writes where and how severe the weather of each batch is, as folders by batch below path; `state` is its checkpoint folder.

    stream: lat, lon, wind_speed, wave_height, precipitation, visibility. A batch that comes again, after a restart or a lost write, takes
    the place of its own rows. Points without wind and waves get the default weather and fallback = true.
    """

    def put(batch: DataFrame, number: int) -> None:
        none = F.col("wind_speed").isNull() & F.col("wave_height").isNull()
        held = batch.select("lat", "lon", none.alias("fallback"), *[F.coalesce(c, F.when(none, F.lit(p.defaults[c]))).alias(c) for c in ("wind_speed", "wave_height", "precipitation", "visibility")])
        severe = rounded(100.0 * risk.safety_risk("wind_speed", "wave_height", "precipitation", "visibility"), 2)
        held.select("lat", "lon", severe.alias("risk"), "fallback").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
