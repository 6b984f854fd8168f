"""Result logs: append, read, pivot, progress, normalised comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneweave.functions import lookup, text

RESULTS = "timestamp string, benchmark string, task string, backend string, model string, num_samples long, metric string, value double, duration_s double, prompt_version string, config_hash string, git_sha string"


def headline_metric(task: Column) -> Column:
    """The metric that ranks a task; oa for an unknown one."""
    out = F.lit("oa")
    for name, metric in lookup.HEADLINE_METRIC.items():
        out = F.when(task == name, metric).otherwise(out)
    return out


def results_rows(metrics: DataFrame) -> DataFrame:
    """Long rows with values to 6 places and durations to 2, ready to append."""
    return metrics.withColumn("value", F.bround("value", 6)).withColumn("duration_s", F.bround("duration_s", 2))


def append_results(metrics: DataFrame, path: str) -> None:
    results_rows(metrics).write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The log, or an empty table where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], RESULTS)
    return spark.read.schema(RESULTS).option("header", True).csv(path)


def latest_headlines(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): the last headline value by seq."""
    headline = results.where(F.col("metric") == headline_metric(F.col("task")))
    return headline.groupBy(*keys).agg(F.max_by("value", "seq").alias("value"))


def dashboard(results: DataFrame, benchmarks: list[str]) -> DataFrame:
    """(backend, model, one column per benchmark): latest headline values; null where there is none."""
    cells = latest_headlines(results, ["backend", "model", "benchmark"])
    seen = results.select("backend", "model").distinct()
    return seen.join(cells.groupBy("backend", "model").pivot("benchmark", benchmarks).agg(F.first("value")), ["backend", "model"], "left")


def recent_runs(results: DataFrame) -> DataFrame:
    """(ts, backend, model, n_benchmarks, scores), newest first; scores lists benchmark=value in order."""
    headline = results.where(F.col("metric") == headline_metric(F.col("task"))).groupBy("ts", "backend", "model", "benchmark").agg(F.max_by("value", "seq").alias("value"))
    scores = F.array_join(F.array_sort(F.collect_list(F.concat("benchmark", F.lit("="), text.fixed(text.rounded(F.col("value"), 6), 6)))), ";")
    return headline.groupBy("ts", "backend", "model").agg(F.count("*").alias("n_benchmarks"), scores.alias("scores")).orderBy(F.desc("ts"), "backend", "model")


def comparison(results: DataFrame, benchmarks: list[str]) -> DataFrame:
    """(model, one text column per benchmark): four places, or "-" where a cell is absent."""
    cells = latest_headlines(results, ["model", "benchmark"]).groupBy("model").pivot("benchmark", benchmarks).agg(F.first("value"))
    seen = results.select("model").distinct().join(cells, "model", "left")
    return seen.select("model", *[F.when(F.col(f"`{b}`").isNotNull(), text.fixed(F.col(f"`{b}`"), 4)).otherwise("-").alias(b) for b in benchmarks])


def matrix_grid(models: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Every model with every benchmark: both are short lists of names."""
    return models.select("model").distinct().crossJoin(benchmarks.select("benchmark").distinct())


def pending_cells(grid: DataFrame, done: DataFrame) -> DataFrame:
    return grid.join(done.select("model", "benchmark"), ["model", "benchmark"], "left_anti")


def cached_cells(grid: DataFrame, done: DataFrame) -> DataFrame:
    return grid.join(done.select("model", "benchmark"), ["model", "benchmark"], "left_semi")


def sweep_status(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, total, done, failed, percent, per_second) from cells with status, num_samples and duration_s."""
    done = F.count_if(F.col("status") == "ok")
    return cells.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        done.alias("done"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.bround(100.0 * (done + F.count_if(F.col("status") == "error")) / F.count("*"), 1).alias("percent"),
        (F.sum("num_samples") / F.greatest(F.sum("duration_s"), F.lit(1e-6))).alias("per_second"),
    )


def normalise_scores(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(model, overall): headline values scaled to 0..1 between the benchmark's worst and best model, then their weighted mean.

    A benchmark on which all models are equal gives 1. Weights are 1 unless named.
    """
    cells = latest_headlines(results, ["model", "benchmark"])
    ranges = cells.groupBy("benchmark").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("benchmark") == name, w).otherwise(weight)
    scaled = cells.join(ranges, "benchmark").withColumn("scaled", F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(1.0)))
    return scaled.groupBy("model").agg((F.sum(F.col("scaled") * weight) / F.sum(weight)).alias("overall"), F.count("*").alias("n_benchmarks"))
