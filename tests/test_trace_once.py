"""What a trace derives from its inputs is derived once, and kept."""

from sceneweave.operators import raster
from sceneweave.plans import measure, trace


def test_questions_are_routed_once(spark, tmp_path):
    """Neither traces nor steps go back to the questions or to what was measured."""
    folder = str(tmp_path)
    spark.createDataFrame([(k, f"Has question {k} changed?", k) for k in range(20)], "run_id long, query string, set_id long").write.parquet(f"{folder}/queries")
    spark.createDataFrame([(k, "bitemporal_pair") for k in range(20)], "set_id long, config string").write.parquet(f"{folder}/sets")
    spark.createDataFrame([(k, k / 100) for k in range(19)], "set_id long, changed_area_frac double").write.parquet(f"{folder}/measures")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    traces, steps = trace.trace(spark, read("queries"), read("sets"), read("measures"))
    for frame in (traces, steps):
        assert folder not in frame._jdf.queryExecution().executedPlan().toString()
    # The last question's set was not measured; it keeps its trace. Quiet masks against the answer "yes" are asked again.
    rows = {r["run_id"]: r for r in traces.collect()}
    assert set(rows) == set(range(20)) and {k for k, r in rows.items() if r["warning"]} == {0, 1}
    assert {k: r["n_steps"] for k, r in rows.items()} == {k: 3 if k < 2 else 2 for k in range(20)}
    assert steps.count() == 42


def test_radar_pixels_are_found_once(spark, tmp_path, monkeypatch):
    """Percentiles read their values several times; what they are given is kept, not found again each time."""
    folder = str(tmp_path / "pixels")
    spark.createDataFrame([(s, 1, y, x, float(8 * y + x)) for s in (1, 2) for y in range(8) for x in range(8)], "scene_id long, band int, y int, x int, v double").write.parquet(folder)
    seen = []
    for name in ("is_linear", "stretch"):
        plain = getattr(raster, name)
        monkeypatch.setattr(raster, name, lambda pixels, plain=plain: seen.append(pixels) or plain(pixels))
    found = measure.measure_radar(spark.createDataFrame([(1, 95.0)], "scene_id long, percentile double"), spark.read.parquet(folder))
    assert found.count() == 1
    assert len(seen) == 2 and not any(folder in f._jdf.queryExecution().executedPlan().toString() for f in seen)
