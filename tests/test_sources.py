"""Several files, keys with several partners, parameter rules, logs and readiness."""

import json

import pytest
from pyspark.sql import functions as F

from sceneweave.operators import bench
from sceneweave.plans import trace
from sceneweave.sources import adapters, tables  # noqa: F401


def test_sample_ids_go_on_from_file_to_file(spark, tmp_path):
    for name, ids in (("b", range(3)), ("a", range(10, 14)), ("c", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"image_id": i, "question": "q", "answer": "a"} for i in ids]))
    s = bench.load_samples(spark, {"adapter": "vrsbench_vqa", "name": "v", "annotations": str(tmp_path)}).collect()
    assert sorted((r.sample_id, r.images[0].path) for r in s) == sorted((f"v-{k}", str(i)) for k, i in enumerate([10, 11, 12, 13, 0, 1, 2]))
    assert [r.key for r in tables.sniff_keys(tables.read_records(spark, str(tmp_path)), 1).collect()] == ["answer", "image_id", "question"]
    alone = tables.read_records(spark, str(tmp_path / "a.json"))
    assert sorted(r.pos for r in alone.collect()) == [0, 1, 2, 3]


def test_keys_of_one_patch_are_missed_one_by_one(spark):
    keys = spark.createDataFrame([("p1", "s1"), ("p1", "s2"), ("p2", "s1"), ("p1", None)], "patch_id string, s1_name string")
    store = spark.createDataFrame([("p1", [1.0]), ("s1", [2.0])], "key string, bands array<double>")
    found, missed = bench.load_patch_bands(keys, store)
    assert [(r.patch_id, r.s1_name) for r in found.collect()] == [("p1", "s1")]
    assert sorted((r.patch_id, str(r.s1_name)) for r in missed.collect()) == [("p1", "None"), ("p1", "s2"), ("p2", "s1")]


def test_stores_in_buckets_are_not_shuffled(spark):
    keys = spark.range(200).selectExpr("concat('p', id % 120) AS patch_id", "concat('s', id) AS s1_name")
    store = spark.range(100).selectExpr("explode(array(concat('p', id), concat('s', id))) AS key", "array(1.0D * id) AS bands")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, missed = bench.load_patch_bands(keys, bench.write_store(store, "bands_in_buckets", 12))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") == 2
        assert found.count() == 100 and missed.count() == 100
        assert all(r.optical == [float(r.patch_id[1:])] and r.radar == [float(r.s1_name[1:])] for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_set_rules(spark):
    calls = spark.createDataFrame([(1, "change_mask", "tile", 999.0), (1, "change_mask", "threshold", 0.5), (2, "change_mask", "tile", 512.0), (3, "change_mask", "threshold", None), (3, "change_mask", "tile", None), (4, "vlm_vqa", "top_k", 1.0)], "run_id long, tool string, param string, value double")
    said = {r.run_id: r.violations for r in trace.validate_params(calls, trace.rules_table(spark, [("change_mask", "tile", [512, 256])])).collect()}
    assert said == {1: "change_mask: 'tile'=999 not in [256, 512]", 2: "", 3: "change_mask: 'threshold'=None outside [0.02, 0.9]; change_mask: 'tile'=None not in [256, 512]", 4: "vlm_vqa: parameter 'top_k' is not permitted"}


def test_listing_has_tasks_configuration_and_constraints(spark):
    registry = trace.ToolRegistry([("change_mask", "tile", [512, 256])])
    for name in ("change_mask", "vlm_vqa", "other"):
        registry.add(name, "1.0", lambda t: t)
    rows = {(r.tool, r.param): r for r in registry.listing(spark).collect()}
    assert rows["change_mask", "tile"].constraint == "256 | 512" and rows["change_mask", "threshold"].constraint == "0.02 to 0.9"
    assert rows["change_mask", "tile"].tasks == "change_caption,change_vqa" and rows["vlm_vqa", "temperature"].accepts == "single"
    assert rows["other", None].constraint is None


def test_prediction_log_keeps_raw_text_beside_what_was_parsed(spark):
    samples = spark.createDataFrame([(1, "vqa", "yes"), (2, "grounding", None), (3, "grounding", None), (4, "vqa", "no")], "sample_id long, task string, answer string")
    said = spark.createDataFrame([(1, "Yes."), (2, "[100, 100, 500, 500]"), (3, "nothing"), (4, " ")], "sample_id long, raw_text string")
    log = {r.sample_id: r for r in tables.prediction_log(samples, said, "milli").collect()}
    assert log[1].answer == "yes" and log[1].reference == "yes" and log[1].raw_text == "Yes." and log[1].parse_ok and log[1].bbox is None
    assert log[2].bbox.x1 == 0.1 and log[2].answer is None and log[2].parse_ok
    assert not log[3].parse_ok and log[3].bbox is None and not log[4].parse_ok


def test_readiness_needs_every_file(spark, tmp_path):
    (tmp_path / "q.json").write_text("[]")
    specs = [{"name": "a", "adapter": "rsvqa", "questions": str(tmp_path / "q.json"), "answers": str(tmp_path / "none.json")}, {"name": "b", "adapter": "cdvqa", "annotations": str(tmp_path / "q.json")}, {"name": "c", "adapter": "cdvqa"}]
    assert {r.benchmark: (r.ready, bool(r.missing)) for r in tables.readiness(spark, specs).collect()} == {"a": (False, True), "b": (True, False), "c": (False, False)}


def test_unmatched_predictions_are_an_error(spark):
    samples, said = spark.range(3).withColumnRenamed("id", "sample_id"), spark.range(1, 4).withColumnRenamed("id", "sample_id").withColumn("answer", F.lit("x"))
    with pytest.raises(ValueError, match="2 sample ids"):
        bench.join_predictions(samples, said)


def test_images_move_once_and_only_those_of_chosen_keys(spark):
    record = lambda image: json.dumps({"conversations": [{"from": "human", "value": "q?"}, {"from": "gpt", "value": "a"}], "meta": {"image_id": image, "question_type": "t"}})
    rows = [(s, k, "json", record(image)) for s, k, image in (("0", "b", "x"), ("0", "a", "x"), ("1", "c", "y"), ("1", "d", "z"))]
    rows += [(s, k, kind, f"{k}-{kind}") for s, k in (("0", "b"), ("0", "a"), ("1", "c")) for kind in ("before", "after")] + [("1", "d", "before", "lonely")]
    members = spark.createDataFrame(rows, "shard string, key string, suffix string, payload string").withColumn("payload", F.col("payload").cast("binary"))
    images, questions = bench.assemble_pairs(members)
    assert sorted((r.image_id, bytes(r.before).decode(), bytes(r.after).decode()) for r in images.collect()) == [("x", "a-before", "a-after"), ("y", "c-before", "c-after")]
    assert sorted((r.key, r.img_name) for r in questions.collect()) == [("a", "x"), ("b", "x"), ("c", "y")]
    plan = images._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Pivot" not in plan
