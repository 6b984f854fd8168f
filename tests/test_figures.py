"""Figures as text: decimals that no double is, as SQL and C round them."""

from pyspark.sql import functions as F

from sceneweave.functions import scenes, text
from sceneweave.operators import results

VALUES = [0.0020475, 0.2559355, 0.1234565, 1234567.0, None]


def test_ties_are_rounded_by_their_binary_value(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES], "v double").select(text.fixed(text.rounded(F.col("v"), 6), 6).alias("t")).collect()
    assert [r["t"] for r in rows] == ["0.002047", "0.255935", "0.123457", "1234567.000000", None]


def test_change_floor_reason(spark):
    reason = spark.range(1).select(scenes.change_floor_reason(F.lit(1.0), F.lit(10_000 / 0.0020475)).alias("r")).head()["r"]
    assert reason == "speckle floor 0.002047 of the scene, which is 1 ha at 1.00 m/px"


def test_scores_of_runs(spark):
    log = spark.createDataFrame([(1, "t", "b", "m", "x", "vqa", "oa", 0.2559355)], "seq long, ts string, backend string, model string, benchmark string, task string, metric string, value double")
    assert results.recent_runs(log).head()["scores"] == "x=0.255935"
    # In binary just below and exactly a tie.
    for value, want in ((0.00045, "0.0004"), (0.03125, "0.0312")):
        assert results.comparison(log.withColumn("value", F.lit(value)), ["x"]).head()["x"] == want
