"""Event and result logs as streams; each function takes a batch table as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneweave.operators import scenes as scene_ops
from sceneweave.streaming.folds import EVERY, FoldedFolder


def partial_summary(events: DataFrame) -> DataFrame:
    """(run_id, failed, done, steps, n_events, first_ts, last_ts): sums that add up over parts of a log."""
    failed, done = F.max((F.col("type") == "error").cast("int")), F.max((F.col("type") == "complete").cast("int"))
    return events.groupBy("run_id").agg(failed.alias("failed"), done.alias("done"), F.count_if(F.col("type") == "step").alias("steps"), F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def added_summaries(parts: DataFrame) -> DataFrame:
    """Partial summaries of the same runs as one; as often as wanted."""
    return parts.groupBy("run_id").agg(F.max("failed").alias("failed"), F.max("done").alias("done"), F.sum("steps").alias("steps"), F.sum("n_events").alias("n_events"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def merged_summary(parts: DataFrame) -> DataFrame:
    """(run_id, status, steps, n_events, first_ts, last_ts) of partial summaries: error, else complete, else running."""
    status = F.when(F.col("failed") == 1, "error").when(F.col("done") == 1, "complete").otherwise("running")
    return added_summaries(parts).select("run_id", status.alias("status"), "steps", "n_events", "first_ts", "last_ts")


def run_summary(events: DataFrame) -> DataFrame:
    """The summary of each run of a table of events (run_id, type, ts)."""
    return merged_summary(partial_summary(events))


def append_summaries(path: str, every: int = EVERY):
    """A foreachBatch function that keeps partial summaries, folded every ``every`` batches.

    A run may go on for any time, so a state per run could never be dropped;
    partial summaries need none. ``summaries`` reads the folder: a snapshot with
    a row a run, and fewer than ``every`` batches after it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        FoldedFolder(batch.sparkSession, path, added_summaries, every).append(partial_summary(batch), batch_id)

    return write


def summaries(spark: SparkSession, path: str) -> DataFrame:
    return merged_summary(FoldedFolder(spark, path, added_summaries).read())


def silent_runs(events: DataFrame, gap_seconds: int = 15) -> DataFrame:
    """(run_id, n_gaps, longest_gap_s): silences of over ``gap_seconds`` between a run's events.

    Sessions end at a silence, so a run has one gap less than sessions; merging
    sessions is an aggregate, which a run of any length can take part in.
    """
    sessions = events.groupBy("run_id", F.session_window("ts", f"{gap_seconds} seconds").alias("s")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    w = Window.partitionBy("run_id").orderBy("a")
    gaps = sessions.withColumn("gap", F.unix_seconds(F.col("a").cast("timestamp")) - F.unix_seconds(F.lag("b").over(w).cast("timestamp")))
    return gaps.where("gap IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("n_gaps"), F.max("gap").alias("longest_gap_s"))


def silent_sessions(events: DataFrame, gap_seconds: int = 15, watermark: str = "1 hour") -> DataFrame:
    """The streaming form: (run_id, start, end, n) of each stretch without such a silence, in append mode."""
    s = events.withWatermark("ts", watermark).groupBy("run_id", F.session_window("ts", f"{gap_seconds} seconds").alias("s")).agg(F.count("*").alias("n"))
    return s.select("run_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def silence_alerts(events: DataFrame, gap_seconds: int = 15, delay: str = "0 seconds") -> DataFrame:
    """(run_id, silent_since, alerted_at) for each silence of ``gap_seconds`` or more of a run that has not ended; in append mode as a stream.

    An alert comes once, as soon as event time (that of any run, less
    ``delay``) is ``gap_seconds`` past the run's last event, while the silence
    lasts; ``delay`` is how late an event may come. A run whose last event
    before the silence is complete or error has ended (of several events at one
    time, those two come last). State is a session a run, which goes with its
    alert. Over a table, all silences that its last event has outlasted.
    """
    ended = F.col("type").isin("complete", "error")
    told = events.withWatermark("ts", delay) if events.isStreaming else events
    s = told.groupBy("run_id", F.session_window("ts", f"{gap_seconds} seconds").alias("s")).agg(F.max("ts").alias("last"), F.max(F.struct("ts", ended.alias("ended"))).alias("e"))
    alerts = s.where(~F.coalesce(F.col("e.ended"), F.lit(False))).select("run_id", F.col("last").alias("silent_since"), F.col("s.end").alias("alerted_at"))
    if events.isStreaming:
        return alerts
    now = events.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("now"))
    return alerts.join(F.broadcast(now), F.col("alerted_at") <= F.col("now")).drop("now")


def deduplicated(predictions: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Predictions without those delivered again, by sample and model."""
    keys = ["sample_id", "model"]
    return predictions.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys) if predictions.isStreaming else predictions.dropDuplicates(keys)


def running_accuracy(marked: DataFrame) -> DataFrame:
    """(model, n, oa) so far, from rows with hit; in complete or update mode as a stream."""
    return marked.groupBy("model").agg(F.count("*").alias("n"), F.avg("hit").alias("oa"))


def last_headlines(rows: DataFrame) -> DataFrame:
    """(model, benchmark, seq, value): the last value by seq."""
    return rows.groupBy("model", "benchmark").agg(F.max(F.struct("seq", "value")).alias("l")).select("model", "benchmark", "l.seq", "l.value")


def upsert_headlines(path: str, every: int = EVERY):
    """A foreachBatch function that keeps the last value by seq per (model, benchmark), folded every ``every`` batches.

    A repeated batch changes nothing; ``headlines`` reads the last values.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        FoldedFolder(batch.sparkSession, path, last_headlines, every).append(last_headlines(batch), batch_id)

    return write


def headlines(spark: SparkSession, path: str) -> DataFrame:
    return FoldedFolder(spark, path, last_headlines).read().select("model", "benchmark", "value")


def acquisition_feed(stream: DataFrame, areas: DataFrame, max_cloud: float = 20.0) -> DataFrame:
    """Scenes of a stream that cover an area (area_id, west, south, east, north), cloud-filtered where optical.

    Areas are filed under whole degrees, so that the stream meets them by an equality.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo), F.floor(hi)))
    filed = areas.withColumn("cx", cells("west", "east")).withColumn("cy", cells("south", "north"))
    centre: dict[str, Column] = {"cx": F.floor((F.col("x1") + F.col("x2")) / 2), "cy": F.floor((F.col("y1") + F.col("y2")) / 2)}
    inside = ((F.col("x1") + F.col("x2")) / 2).between(F.col("west"), F.col("east")) & ((F.col("y1") + F.col("y2")) / 2).between(F.col("south"), F.col("north"))
    clear = ~scene_ops._optical(F.col("collection")) | (F.col("cloud_cover") < max_cloud)
    return stream.where(clear).withColumns(centre).join(filed, ["cx", "cy"]).where(inside).select("area_id", "id", "collection", "datetime", "cloud_cover")
