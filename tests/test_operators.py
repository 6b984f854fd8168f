"""Operators on small hand-made tables: traps, and the same results for any partitioning."""

import json

import pytest
from pyspark.sql import functions as F

from sceneweave.functions import boxes
from sceneweave.operators import bench, corpus, metrics, raster, results, scenes
from sceneweave.plans import fixtures, trace
from sceneweave.sources import adapters, tables  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_accuracy_of_a_majority_model(spark):
    rows = [("yes", "yes", "a")] * 9 + [("yes", "no", "b")]
    m = metrics.vqa_metrics(metrics.mark_answers(spark.createDataFrame(rows, "raw_text string, gold string, qtype string"))).first()
    assert (m.oa, m.aa, m.n) == (0.9, 0.5, 10)


def test_rows_without_type_count_in_overall_accuracy_only(spark):
    rows = [("yes", "yes", "a"), ("yes", "no", None), ("yes", "no", "")]
    m = metrics.vqa_metrics(metrics.mark_answers(spark.createDataFrame(rows, "raw_text string, gold string, qtype string"))).first()
    assert m.oa == pytest.approx(1 / 3) and m.aa == 1.0
    untyped = metrics.vqa_metrics(metrics.mark_answers(spark.createDataFrame(rows[1:], "raw_text string, gold string, qtype string"))).first()
    assert untyped.oa == untyped.aa == 0.0


def test_an_unparseable_box_is_a_miss(spark):
    b = spark.createDataFrame([("[0, 0, 500, 1000]",), ("nothing",)], "t string").select(boxes.parse_bbox(F.col("t"), "milli").alias("predicted"), boxes.box(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(1.0)).alias("box"))
    m = metrics.grounding_metrics(b).first()
    assert m["miou"] == 0.5 and m["acc@0.5"] == 0.5 and m["parse_rate"] == 0.5 and m["n"] == 2


def captions(spark, rows):
    return spark.createDataFrame([(i, "candidate", 0, c) for i, (c, _) in enumerate(rows)] + [(i, "reference", k + 1, r) for i, (_, rs) in enumerate(rows) for k, r in enumerate(rs)], "sample_id int, part string, ref int, text string")


def test_caption_scores_of_identical_texts(spark):
    c = captions(spark, [("a red house by the lake", ["a red house by the lake"]), ("two green fields and a road", ["two green fields and a road", "fields"])])
    assert metrics.bleu(c).first()["bleu4"] == pytest.approx(1.0)
    assert metrics.rouge_l(c).first()[0] == pytest.approx(1.0)
    assert metrics.cider_d(c).first()[0] > 5
    single = captions(spark, [("a red house", ["a red house"])])
    assert metrics.cider_d(single).first()[0] == 0.0
    assert metrics.bleu(captions(spark, [("b", ["a"])])).first()["bleu1"] == 0.0
    assert metrics.rouge_l(captions(spark, [("a b", [])])).first()[0] == 0.0


def test_null_category_is_kept(spark):
    rows = [(1, None), (2, " Country "), (3, "area"), (4, "climate zone")]
    assert [r.id for r in corpus.drop_unanswerable(spark.createDataFrame(rows, "id int, category string")).orderBy("id").collect()] == [1, 3]


def test_active_flag_has_three_states(spark):
    assert corpus.active_only(spark.createDataFrame([(True,), (False,), (None,)], "active boolean")).count() == 2


def test_sample_spreads_over_strata(spark):
    rows = [(i, "vqa", "ABCD"[min(i // 40, 3)], "s") for i in range(300)] + [(900 + i, "vqa", None, "s") for i in range(50)]
    a = spark.createDataFrame(rows, "id int, type string, country string, season string")
    got = corpus.stratified_sample(a, 20, 7)
    counts = {r.country: r["count"] for r in got.groupBy("country").count().collect()}
    assert counts == {"A": 5, "B": 5, "C": 5, "D": 5}
    assert got.columns == a.columns
    assert {r.id for r in corpus.stratified_sample(a.repartition(17), 20, 7).collect()} == {r.id for r in got.collect()}
    assert corpus.stratified_sample(a, 2, 7).count() == 2


def test_filter_comes_before_sampling(spark):
    rows = [(i, "vqa", "A", "s", "country" if i % 2 else "area") for i in range(40)]
    a = spark.createDataFrame(rows, "id int, type string, country string, season string, category string")
    assert corpus.stratified_sample(corpus.drop_unanswerable(a), 20, 1).count() == 20


def test_first_active_answer_wins(spark):
    q = spark.createDataFrame([(1, True), (2, None), (3, False), (4, True)], "question_id int, active boolean")
    a = spark.createDataFrame([(1, "no", False, 0), (1, "yes", None, 1), (1, "no", True, 2), (2, "5", True, 0), (3, "x", True, 0)], "question_id int, answer string, active boolean, pos int")
    assert {(r.question_id, r.answer) for r in bench.join_qa(q, a).collect()} == {(1, "yes"), (2, "5")}


def test_predictions_must_match_one_to_one(spark):
    s, p = spark.createDataFrame([(1,), (2,)], "sample_id int"), spark.createDataFrame([(1, "a"), (1, "b")], "sample_id int, answer string")
    with pytest.raises(ValueError, match="2 sample ids"):
        bench.join_predictions(s, p)


@pytest.mark.parametrize("payload", [[{"id": 1, "q": "a"}, {"id": 2, "q": "b"}], {"info": {}, "questions": [{"id": 1, "q": "a"}, {"id": 2, "q": "b"}]}, {"meta": 3, "things": [{"id": 1, "q": "a"}, {"id": 2, "q": "b"}]}, {"1": {"id": 1, "q": "a"}, "2": {"id": 2, "q": "b"}}])
def test_benchmark_json_shapes(spark, tmp_path, payload):
    (tmp_path / "f.json").write_text(json.dumps(payload))
    r = tables.resolve_fields(tables.read_records(spark, str(tmp_path / "f.json"), ("questions",)), {"question": ["text", "q"]}, required=["question"])
    assert [(x.pos, x.question) for x in r.orderBy("pos").collect()] == [(0, "a"), (1, "b")]
    missing = tables.resolve_fields(tables.read_records(spark, str(tmp_path / "f.json"), ("questions",)), {"answer": ["gt", "label"]}, required=["answer"])
    with pytest.raises(Exception, match="could not resolve field 'answer'"):
        missing.collect()


def test_unsupported_json_is_an_error(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="unsupported annotation payload"):
        tables.read_records(spark, str(tmp_path / "f.json")).collect()


def test_results_log(spark, tmp_path):
    assert results.read_results(spark, str(tmp_path / "none")).count() == 0
    row = spark.createDataFrame([("t", "b", "vqa", "echo", "m", 3, "oa", 0.12345678, 1.239, "1", "h", "g")], results.RESULTS)
    for _ in range(2):
        results.append_results(row, str(tmp_path / "log"))
    got = results.read_results(spark, str(tmp_path / "log")).collect()
    assert len(got) == 2 and got[0].value == 0.123457 and got[0].duration_s == 1.24


def test_last_value_wins_and_absent_cells_show(spark):
    r = spark.createDataFrame([(1, "m", "x", "vqa", "oa", 0.1), (3, "m", "x", "vqa", "oa", 0.3), (2, "m", "x", "vqa", "oa", 0.2), (4, "n", "y", "odd", "oa", 0.5), (5, "n", "x", "vqa", "aa", 0.9)], "seq int, model string, benchmark string, task string, metric string, value double")
    got = {r.model: (r.x, r.y) for r in results.comparison(r, ["x", "y"]).collect()}
    assert got == {"m": ("0.3000", "-"), "n": ("-", "0.5000")}


def test_unknown_cloud_ranks_last(spark):
    s = spark.createDataFrame([(1, "a", None), (2, "a", 40.0), (3, "a", 40.0), (4, "b", None)], "id int, area_id string, cloud_cover double")
    assert {(r.area_id, r.id) for r in scenes.clearest(s, ["area_id"]).collect()} == {("a", 2), ("b", 4)}


def grid(spark, values, scene=0, band=1):
    return spark.createDataFrame([(scene, band, y, x, float(v)) for y, row in enumerate(values) for x, v in enumerate(row)], "scene_id int, band int, y int, x int, v double")


def test_flat_band_stretches_to_zero(spark):
    assert {r.level for r in raster.stretch(grid(spark, [[3, 3], [3, float("nan")]])).collect()} == {0}


def test_single_bin_has_the_middle_threshold(spark):
    g = grid(spark, [[0.25, 0.25]]).withColumnRenamed("v", "gray")
    assert raster.otsu(g).first()["cut"] == 0.5


def test_quadrants_break_ties_in_order(spark):
    m = grid(spark, [[1, 1], [1, 1]]).select("scene_id", "y", "x", (F.col("v") > 0).alias("hit"))
    assert raster.quadrant_summary(m).first()["location"] == "spread across the scene"
    two = grid(spark, [[1, 1], [0, 0]]).select("scene_id", "y", "x", (F.col("v") > 0).alias("hit"))
    assert raster.quadrant_summary(two).first()["location"] == "mainly north-west and north-east"
    assert raster.quadrant_summary(two.withColumn("hit", F.lit(False))).first()["location"] == "nowhere"


def test_three_bands_give_no_index(spark):
    p = grid(spark, [[1, 2]], band=1).union(grid(spark, [[1, 2]], band=2)).union(grid(spark, [[1, 2]], band=3))
    r = raster.optical_indices(p).first()
    assert not r.applicable and r.water_fraction is None and r.reason.startswith("3-band input")


def test_resize_reads_nearest_pixels(spark):
    p = grid(spark, [[1, 2, 3], [4, 5, 6]])
    got = {(r.y, r.x): r.v for r in raster.resize(p, 4, 6).collect()}
    assert got == {(y, x): [[1, 2, 3], [4, 5, 6]][y // 2][x // 2] for y in range(4) for x in range(6)}
    small = {(r.y, r.x): r.v for r in raster.resize(p, 1, 2).collect()}
    assert small == {(0, 0): 1, (0, 1): 2}


def test_small_masks_go_whole(spark):
    pairs = spark.createDataFrame([(1, y, x, 0.9 if (y, x) == (0, 0) else 0.0, 0.9 if (y, x) == (0, 0) else 0.0) for y in range(4) for x in range(4)], "pair_id int, y int, x int, delta double, diff double")
    rules = spark.createDataFrame([(1, 0.5, 0.2)], "pair_id int, threshold double, min_area_frac double")
    r = raster.change_mask(pairs, rules).first()
    assert r.changed_area_frac == 0.0 and r.direction == "no significant change" and r.change_location == "nowhere"
    kept = raster.change_mask(pairs).first()
    assert kept.method == "otsu" and kept.changed_area_frac == 0.0625 and kept.direction == "brightened"


def test_a_retry_happens_once(spark):
    first = spark.createDataFrame([(1, "otsu", 0.5, 0.01), (2, "otsu", 0.02, 0.0), (3, "explicit", 0.5, 0.0), (4, "otsu", 0.5, 0.3)], "pair_id int, method string, threshold double, changed_area_frac double")
    assert [(r.pair_id, r.threshold) for r in raster.replan_rules(first).collect()] == [(1, 0.275)]


def test_registries_take_a_name_once():
    registry = trace.ToolRegistry()
    registry.add("t", "1", lambda x: x)
    with pytest.raises(ValueError):
        registry.add("t", "2", lambda x: x)
    with pytest.raises(KeyError):
        registry.get("u")

    @bench.register("test-only")
    def load(spark, spec):
        return spark.range(spec["n"])

    with pytest.raises(ValueError):
        bench.register("test-only")(load)


def test_model_must_answer_every_request(spark):
    r = spark.createDataFrame([(1, "p", 5), (2, "q", 5)], "run_id long, prompt string, max_new_tokens int")
    assert {x.answer for x in trace.run_model(r, lambda: lambda p, b: [(t.upper(), "stop") for t in p]).collect()} == {"P", "Q"}
    with pytest.raises(Exception, match="replies"):
        trace.run_model(r.coalesce(1), lambda: lambda p, b: []).collect()


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_any_partitioning_gives_the_same(spark, parts):
    v = fixtures.view(spark, SF, "vqa").repartition(parts)
    m = metrics.vqa_metrics(metrics.mark_answers(v)).first()
    w = metrics.vqa_metrics(metrics.mark_answers(fixtures.view(spark, SF, "vqa"))).first()
    assert (m.n, round(m.oa, 9), round(m.aa, 9)) == (w.n, round(w.oa, 9), round(w.aa, 9))


def test_pair_search_has_no_nested_loop(spark):
    rows = [(1, 10, 10, "e", (0.0, 0.0, 2.0, 2.0), 10.0), (2, 10, 10, "e", (0.0, 0.0, 2.0, 2.0), 10.2), (3, 10, 10, "e", (9.0, 9.0, 11.0, 11.0), 10.0), (4, 10, 10, "f", (0.0, 0.0, 2.0, 2.0), 10.0)]
    r = spark.createDataFrame(rows, "id int, width int, height int, crs string, bounds struct<x1:double,y1:double,x2:double,y2:double>, gsd_m double")
    found = scenes.check_pairs(r)
    assert [(p.a_id, p.b_id, p.coregistered, p.gsd_match) for p in found.collect()] == [(1, 2, True, True)]
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def samples(spark, tmp_path, payload, **spec):
    (tmp_path / "a.json").write_text(json.dumps(payload))
    return bench.load_samples(spark, {"name": "b", "annotations": str(tmp_path / "a.json"), "root": "img", "suffix": ".png", **spec}).collect()


def test_question_adapters(spark, tmp_path):
    rows = samples(spark, tmp_path, [{"image_id": "1", "question": "q?", "ground_truth": "yes", "type": ""}, {"image_id": "2.png", "question": "r?", "ground_truth": 3, "type": "count"}], adapter="vrsbench_vqa")
    assert [(r.sample_id, r["images"][0].path, r.answer, r.qtype) for r in rows] == [("b-0", "img/1.png", "yes", None), ("b-1", "img/2.png", "3", "count")]
    renamed = samples(spark, tmp_path, [{"picture": "x", "query": "q", "gold": "a"}], adapter="vrsbench_vqa", fields={"image_id": "picture", "answer": "gold"})
    assert renamed[0].question == "q" and renamed[0].answer == "a"
    with pytest.raises(KeyError):
        bench.load_samples(spark, {"adapter": "none"})


def test_caption_and_box_adapters(spark, tmp_path):
    rows = samples(spark, tmp_path, {"data": [{"image": "1", "caption": ["a", "b"]}, {"image": "2", "caption": "c"}]}, adapter="vrsbench_caption")
    assert [(r.answer, r.references) for r in rows] == [("a", ["a", "b"]), ("c", ["c"])]
    rows = samples(spark, tmp_path, [{"image": "1", "question": "q", "bbox": [10, 20, 50, 60]}, {"image": "1", "question": "q", "bbox": "(50, 20, 10, 60)"}], adapter="vrsbench_referring", scale="percent")
    assert tuple(rows[0].bbox) == pytest.approx((0.1, 0.2, 0.5, 0.6)) and rows[1].bbox is None


def test_pair_and_file_adapters(spark, tmp_path):
    rows = samples(spark, tmp_path, [{"img_name": "x", "question": "q", "answer": "a", "type": "t"}, {"img1": "p.png", "img2": "r.png", "question": "q", "answer": "a"}], adapter="cdvqa")
    assert [[i.path for i in r["images"]] for r in rows] == [["img/im1/x.png", "img/im2/x.png"], ["img/p.png", "img/r.png"]]
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": 1, "img_id": 5, "question": "q", "type": "p", "active": True}, {"id": 2, "img_id": 5, "question": "r", "type": "p", "active": False}]}))
    (tmp_path / "n.json").write_text(json.dumps({"answers": [{"id": 7, "question_id": 1, "answer": "no", "active": False}, {"id": 8, "question_id": 1, "answer": "yes", "active": True}]}))
    rows = bench.load_samples(spark, {"adapter": "rsvqa", "name": "lr", "questions": str(tmp_path / "q.json"), "answers": str(tmp_path / "n.json"), "root": "img", "suffix": ".tif"}).collect()
    assert [(r.sample_id, r.answer, r["images"][0].path) for r in rows] == [("lr-1", "yes", "img/5.tif")]


def test_a_model_is_asked_once_for_each_request(spark, tmp_path):
    """Both rounds of replies are used several times; the model writes down every prompt it gets."""
    import os
    import uuid

    folder = str(tmp_path)
    queries = spark.createDataFrame([(i, "Is there water?", i) for i in range(40)], "run_id long, query string, set_id long")
    sets = spark.createDataFrame([(i, "bitemporal_pair") for i in range(40)], "set_id long, config string")
    measures = spark.createDataFrame([(i, 0.01 if i % 4 == 0 else 0.3) for i in range(40)], "set_id long, changed_area_frac double")

    def make():
        def reply(prompts, budgets):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as log:
                log.write("x" * len(prompts))
            return [("yes", "stop")] * len(prompts)

        return reply

    traces, steps = trace.trace(spark, queries, sets, measures, lambda requests: trace.run_model(requests, make))
    assert {r.run_id for r in traces.where("warning IS NOT NULL").collect()} == set(range(0, 40, 4))
    assert steps.where("revises IS NOT NULL").count() == 10
    assert sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder)) == 50


def test_named_pairs_of_any_crs(spark):
    raster = "id long, width int, height int, crs string, bounds struct<x1:double,y1:double,x2:double,y2:double>, gsd_m double"
    box = (0.0, 0.0, 10.0, 10.0)
    r = spark.createDataFrame([(1, 10, 10, "EPSG:4326", box, 10.0), (2, 10, 10, "EPSG:32643", box, 10.0), (3, 10, 10, None, None, None), (4, 10, 10, "EPSG:4326", (20.0, 0.0, 30.0, 10.0), 10.0)], raster)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 1), (1, 4), (1, 99)], "a_id long, b_id long")
    got = {(x.a_id, x.b_id): x for x in scenes.check_named_pairs(pairs, r).collect()}
    assert set(got) == {(1, 2), (1, 3), (3, 1), (1, 4)}
    assert got[1, 2].warnings == ["CRS differs: EPSG:4326 vs EPSG:32643"] and not got[1, 2].crs_match
    assert got[3, 1].coregistered and not got[1, 3].coregistered and "not georeferenced" in got[1, 3].warnings[0]
    assert got[1, 4].warnings == ["extents do not overlap: images cover different ground"]


@pytest.mark.parametrize("ranges", [1, 3, 4096])
def test_average_precision_whatever_the_ranges(spark, ranges):
    rows = [(i, "ab"[i % 2], (i * 7 % 10) / 10, int(i % 3 == 0)) for i in range(60)] + [(100 + i, "c", 0.5, i % 2) for i in range(6)]
    got = metrics.multilabel_metrics(spark.createDataFrame(rows, "sample_id long, label string, score double, truth int"), ranges=ranges).first()
    want = []
    for label in "abc":
        hits, points = 0, []
        for n, r in enumerate(sorted((r for r in rows if r[1] == label), key=lambda r: (-r[2], r[0])), 1):
            hits += r[3]
            points += [hits / n] * r[3]
        want.append(sum(points) / len(points))
    assert abs(got.mean_ap - sum(want) / 3) < 1e-12
