"""Exact percentiles by selection against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneweave.operators import raster
from sceneweave.operators.selection import exact_percentiles


def frame_of(spark, groups):
    rows = [(k, float(x) if x is not None else None) for k, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("limit", [10_000, 50])
def test_matches_numpy(spark, limit):
    rng = np.random.default_rng(1)
    groups = {"even": rng.random(900), "ties": rng.integers(0, 3, 800), "two": [1.0] * 500 + [2.0] * 500, "one": [7.5] * 300, "wide": 10.0 ** rng.uniform(-300, 300, 700), "single": [3.0], "none": [None, None], "nulls": [None, *range(120)], None: rng.normal(size=400)}
    shares = (0.0, 0.02, 0.5, 0.98, 0.995, 1.0)
    got = {r.k: r.p for r in exact_percentiles(frame_of(spark, groups), ["k"], shares, limit=limit).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        xs = [x for x in xs if x is not None]
        assert got[k] == (pytest.approx(np.percentile(xs, [100 * s for s in shares]), rel=1e-12) if len(xs) else [None] * len(shares))


def test_shares_of_each_group(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.random(300), "b": rng.random(301), "c": rng.random(5)}
    shares = spark.createDataFrame([("a", [0.92]), ("b", [0.95, 0.5, 2.0]), ("z", [0.1])], "k string, shares array<double>")
    got = {r.k: r.p for r in exact_percentiles(frame_of(spark, groups), ["k"], shares, limit=40).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"] == pytest.approx([np.percentile(groups["a"], 92)])
    assert got["b"][:2] == pytest.approx(list(np.percentile(groups["b"], [95, 50]))) and got["b"][2] is None


def test_a_scene_of_a_million_distinct_values(spark):
    """As large a scene as its values are many: ranges of 10,000 at most are sorted, and results equal Spark's own map of values."""
    pixels = spark.range(1_000_000, numPartitions=16).select(F.lit(1).cast("long").alias("scene_id"), F.lit(1).alias("band"), F.col("id").alias("y"), F.lit(0).alias("x"), F.exp(F.rand(3) * 20).alias("v")).cache()
    got = exact_percentiles(pixels, ["scene_id"], (0.02, 0.5, 0.98, 0.99)).first().p
    assert got == pixels.agg(F.percentile("v", F.array(*[F.lit(s) for s in (0.02, 0.5, 0.98, 0.99)]))).first()[0]
    limits = raster.stretch_limits(pixels, ["scene_id", "band"]).first()
    assert [limits.lo, limits.hi] == [got[0], got[2]]


def test_empty(spark):
    assert exact_percentiles(frame_of(spark, {"a": []}), ["k"], (0.5,)).count() == 0
