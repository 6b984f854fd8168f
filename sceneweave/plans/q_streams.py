"""Queries and SQL of event logs: the batch forms, and streams run to their end over the same files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sceneweave.plans.fixtures import view, view_sql
from sceneweave.plans.shared import shared_folder
from sceneweave.streaming import runs

GAP = 3600


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def k1_run_summary(spark, sf):
    return runs.run_summary(view(spark, sf, "run_events")).select("run_id", "status", "steps", "n_events", _stamp("first_ts"), _stamp("last_ts"))


def _stream(spark, sf):
    """The event log as a stream of files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    kind = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "start").otherwise("step")
    return s.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), "value")


def _finish(spark, frame, mode, name, writer=None, reader=None):
    """Run a stream to the end of its input and read what it wrote, by functions of the folder or as it is."""
    folder = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    each = writer(f"{folder}/out") if writer else write
    q = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return reader(spark, f"{folder}/out") if reader else spark.read.parquet(f"{folder}/out")


def k1_run_summary_stream(spark, sf):
    found = _finish(spark, _stream(spark, sf), "append", "k1", runs.append_summaries, runs.summaries)
    return found.select("run_id", "status", "steps", "n_events", _stamp("first_ts"), _stamp("last_ts"))


def k2_silent_sessions_stream(spark, sf):
    """Stretches of events without a silence, of those that the watermark has closed at the log's end."""
    s = _finish(spark, runs.silent_sessions(_stream(spark, sf), GAP), "append", "k2")
    return s.select("run_id", _stamp("start"), _stamp("end"), "n")


def _alerts(found):
    return found.select("run_id", _stamp("silent_since"), _stamp("alerted_at"))


def k2_silence_alerts(spark, sf):
    return _alerts(runs.silence_alerts(view(spark, sf, "run_events"), GAP))


def k2_silence_alerts_stream(spark, sf):
    return _alerts(_finish(spark, runs.silence_alerts(_stream(spark, sf), GAP), "append", "k2-alerts"))


def k2_silent_runs(spark, sf):
    return runs.silent_runs(view(spark, sf, "run_events"), GAP)


def k3_running_accuracy(spark, sf):
    """Each row twice, as a log that was delivered again; a hit is an even value."""
    s = view(spark, sf, "run_events").select((F.col("run_id") % 3).cast("string").alias("model"), F.col("seq").alias("sample_id"), (F.col("seq") % 4 == 0).cast("int").alias("hit"))
    return runs.running_accuracy(runs.deduplicated(s.union(s))).select("model", "n", F.round("oa", 6).alias("oa"))


def k3_running_accuracy_stream(spark, sf):
    s = _stream(spark, sf).select((F.col("run_id") % 3).cast("string").alias("model"), F.col("seq").alias("sample_id"), (F.col("seq") % 4 == 0).cast("int").alias("hit"), "ts")
    out = _finish(spark, runs.deduplicated(s.union(s)), "append", "k3")
    return runs.running_accuracy(out).select("model", "n", F.round("oa", 6).alias("oa"))


def k3_headlines(spark, sf):
    """Result rows in two batches, the second of them sent again after a snapshot took it in; the last value by seq counts."""
    folder = f"{shared_folder(spark)}/headlines-{uuid.uuid4().hex}"
    r = view(spark, sf, "results").where("metric = 'oa'")
    write = runs.upsert_headlines(folder, every=2)
    write(r.where("seq % 2 = 0"), 0)
    for _ in range(2):
        write(r.where("seq % 2 = 1"), 1)
    return runs.headlines(spark, folder).select("model", "benchmark", F.round("value", 6).alias("value"))


def _areas(spark, sf):
    ids = view(spark, sf, "scenes").select("area_id").distinct()
    return ids.select("area_id", (70.0 + F.col("area_id")).alias("west"), F.lit(10.0).alias("south"), (71.0 + F.col("area_id")).alias("east"), F.lit(11.5).alias("north"))


def k4_acquisition_feed(spark, sf):
    return runs.acquisition_feed(view(spark, sf, "scenes").drop("area_id"), _areas(spark, sf)).select("area_id", "id", "collection")


def k4_acquisition_feed_stream(spark, sf):
    """The same over a stream of scenes, joined with the table of areas."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    west, south = 70 + (F.col("user_id") % 50) / 10.0, 10 + (F.col("user_id") % 30) / 10.0
    optical = F.col("event_id") % 3 != 0
    s = events.select(
        F.col("event_id").alias("id"),
        F.when(optical, "sentinel-2-l2a").otherwise("sentinel-1-rtc").alias("collection"),
        F.col("ts").alias("datetime"),
        F.when(optical & (F.col("event_id") % 17 != 0), F.col("value") % 100).alias("cloud_cover"),
        west.alias("x1"), south.alias("y1"), (west + 0.2).alias("x2"), (south + 0.2).alias("y2"),
    )
    return _finish(spark, runs.acquisition_feed(s, _areas(spark, sf)), "append", "k4").select("area_id", "id", "collection")


QUERIES = {f.__name__: f for f in [k1_run_summary, k1_run_summary_stream, k2_silence_alerts, k2_silence_alerts_stream, k2_silent_runs, k2_silent_sessions_stream, k3_running_accuracy, k3_running_accuracy_stream, k3_headlines, k4_acquisition_feed, k4_acquisition_feed_stream]}

EV = f"ev AS ({view_sql('run_events')})"
K1 = "SELECT run_id, CASE WHEN bool_or(type = 'error') THEN 'error' WHEN bool_or(type = 'complete') THEN 'complete' ELSE 'running' END AS status, count(*) FILTER (WHERE type = 'step') AS steps, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts"
K3 = "SELECT CAST(user_id % 3 AS VARCHAR) AS model, count(*) AS n, round(avg(CAST(event_id % 4 = 0 AS INT)), 6) AS oa FROM events GROUP BY 1"
K4 = f"WITH sc AS ({view_sql('scenes')}), ar AS (SELECT DISTINCT area_id FROM sc) SELECT ar.area_id, sc.id, sc.collection FROM sc JOIN ar ON (x1 + x2) / 2 BETWEEN 70.0 + ar.area_id AND 71.0 + ar.area_id AND (y1 + y2) / 2 BETWEEN 10.0 AND 11.5 WHERE collection = 'sentinel-1-rtc' OR cloud_cover < 20"
ALERTS = f"""WITH {EV}, g AS (SELECT run_id, ts, type, coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= {GAP}, TRUE) AS fresh FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
k AS (SELECT run_id, ts, type, sum(CAST(fresh AS INT)) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
z AS (SELECT run_id, session, max(ts) AS a FROM k GROUP BY run_id, session),
e AS (SELECT z.run_id, z.a, bool_or(k.type IN ('complete', 'error')) AS ended FROM z JOIN k ON k.run_id = z.run_id AND k.session = z.session AND k.ts = z.a GROUP BY ALL)
SELECT run_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS silent_since, strftime(a + INTERVAL {GAP} SECONDS, '%Y-%m-%d %H:%M:%S') AS alerted_at FROM e WHERE NOT ended AND a + INTERVAL {GAP} SECONDS <= (SELECT max(ts) FROM ev)"""
SQL = {
    "k2_silence_alerts": ALERTS,
    "k2_silence_alerts_stream": ALERTS,
    "k1_run_summary": f"WITH {EV} {K1} FROM ev GROUP BY run_id",
    "k1_run_summary_stream": f"WITH {EV} {K1} FROM ev GROUP BY run_id",
    "k2_silent_sessions_stream": f"""WITH {EV}, g AS (SELECT run_id, ts, coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= {GAP}, TRUE) AS fresh FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
k AS (SELECT run_id, ts, sum(CAST(fresh AS INT)) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
z AS (SELECT run_id, min(ts) AS a, max(ts) + INTERVAL {GAP} SECONDS AS b, count(*) AS n FROM k GROUP BY run_id, session)
SELECT run_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS "start", strftime(b, '%Y-%m-%d %H:%M:%S') AS "end", n FROM z WHERE b <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR""",
    "k2_silent_runs": f"WITH {EV}, g AS (SELECT run_id, epoch(ts) AS t, epoch(lag(ts) OVER (PARTITION BY run_id ORDER BY ts)) AS b FROM ev) SELECT run_id, count(*) AS n_gaps, CAST(max(floor(t) - floor(b)) AS BIGINT) AS longest_gap_s FROM g WHERE t - b >= {GAP} GROUP BY run_id",
    "k3_running_accuracy": K3,
    "k3_running_accuracy_stream": K3,
    "k3_headlines": f"WITH r AS ({view_sql('results')}) SELECT model, benchmark, round(arg_max(value, seq), 6) AS value FROM r WHERE metric = 'oa' GROUP BY ALL",
    "k4_acquisition_feed_stream": K4,
    "k4_acquisition_feed": K4,
}
