"""Queries and SQL of benchmark tables and result logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sceneweave.functions import boxes, lookup, text
from sceneweave.operators import bench, corpus, results
from sceneweave.plans.fixtures import view, view_sql
from sceneweave.plans.shared import shared_folder
from sceneweave.sources import adapters, documents, tables  # noqa: F401  adapters register themselves

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEED = 1234
#: Records in one made document, about.
MOST_RECORDS = 10_000


def _in_parts(frame, column):
    """``frame`` with a part for each row, as many as its rows need for documents of bounded size."""
    return frame.withColumn("part", F.pmod(F.xxhash64(column), F.lit(max(1, -(-frame.count() // MOST_RECORDS)))))


def _json_folder(spark, frame, kind):
    """Benchmark files made from a table: one document with a list under a known key, or with objects by id."""
    folder = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    record = F.struct(F.col("question_id").alias("id"), F.col("img_id").alias("image"), F.col("qtype").alias("type"), "active")
    part = _in_parts(frame, "question_id")
    if kind == "list":
        docs = part.groupBy("part").agg(F.to_json(F.struct(F.collect_list(record).alias("questions"))).alias("value"))
    else:
        docs = part.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("question_id").cast("string"), record)))).alias("value"))
    docs.select("value", "part").write.partitionBy("part").text(folder)
    return folder


def a2_read_records(spark, sf):
    folder = _json_folder(spark, view(spark, sf, "questions"), "list")
    keyed = _json_folder(spark, view(spark, sf, "questions"), "keyed")
    fields = {"id": ["question_id", "id"], "qtype": ["category", "type"]}
    a = tables.resolve_fields(tables.read_records(spark, folder, ("questions",)), fields)
    b = tables.resolve_fields(tables.read_records(spark, keyed), {"id": ["_key"], "qtype": ["type"]})
    return a.groupBy("qtype").agg(F.count("*").alias("listed"), F.sum(F.col("id").cast("long")).alias("ids")).join(b.groupBy("qtype").agg(F.count("*").alias("keyed"), F.sum(F.col("id").cast("long")).alias("keys")), "qtype")


def a2_read_split_records(spark, sf):
    """The same documents, cut at byte ranges."""
    q = view(spark, sf, "questions")
    fields = {"id": ["question_id", "id"], "qtype": ["category", "type"]}
    a = tables.resolve_fields(documents.read_split_records(spark, _json_folder(spark, q, "list"), ("questions",)), fields)
    b = tables.resolve_fields(documents.read_split_records(spark, _json_folder(spark, q, "keyed")), {"id": ["_key"], "qtype": ["type"]})
    return a.groupBy("qtype").agg(F.count("*").alias("listed"), F.sum(F.col("id").cast("long")).alias("ids")).join(b.groupBy("qtype").agg(F.count("*").alias("keyed"), F.sum(F.col("id").cast("long")).alias("keys")), "qtype")


def a3_resolve_fields(spark, sf):
    folder = _json_folder(spark, view(spark, sf, "questions"), "list")
    r = tables.resolve_fields(tables.read_records(spark, folder, ("questions",)), {"question": ["question", "id"], "image_id": ["image_id", "img_id"]}, required=["question", "image_id"], overrides={"image_id": "image"})
    return r.select(F.col("question").cast("long").alias("question_id"), F.col("image_id").cast("long").alias("img_id"))


def a12_sniff_keys(spark, sf):
    return tables.sniff_keys(tables.read_records(spark, _json_folder(spark, view(spark, sf, "questions"), "list"), ("questions",)))


def a5_assemble_pairs(spark, sf):
    """Archive members made from conversations: each key has its json, and those of over two turns have both images."""
    turns = view(spark, sf, "turns")
    record = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "speaker", "value"))), lambda t: F.struct(t["speaker"].alias("from"), t["value"].alias("value"))).alias("conversations"), F.struct(F.concat(F.lit("img"), F.col("conv_id") % 40).alias("image_id"), F.lit("kind").alias("question_type")).alias("meta")))
    json = turns.groupBy("conv_id").agg(record.alias("payload")).withColumn("suffix", F.lit("json"))
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    images = ids.where("turns > 2").select("conv_id", F.lit("b").alias("payload"), F.lit("before").alias("suffix")).union(ids.select("conv_id", F.lit("a"), F.lit("after")))
    members = json.unionByName(images).select((F.col("conv_id") % 3).cast("string").alias("shard"), F.lpad(F.col("conv_id").cast("string"), 6, "0").alias("key"), "suffix", "payload")
    pairs, questions = bench.assemble_pairs(members)
    shared = pairs.select(F.col("image_id").alias("img_name"), F.lit(1).alias("has"))
    return questions.join(shared, "img_name").groupBy("img_name").agg(F.count("*").alias("questions"), F.sum(F.length("question")).alias("q_chars"), F.sum(F.length("answer")).alias("a_chars"))


def _band_store(spark, sf):
    optical = view(spark, sf, "patches").where("NOT contains_seasonal_snow").select(F.col("patch_id").alias("key"))
    radar = view(spark, sf, "annotations").where("split = 'train'").select(F.col("s1_name").alias("key")).distinct()
    return optical.union(radar).withColumn("bands", F.array(F.lit(1.0)))


def _looked_up(spark, sf, store):
    keys = view(spark, sf, "annotations").select("patch_id", "s1_name").distinct()
    found, missed = bench.load_patch_bands(keys, store)
    return found.select("patch_id", "s1_name", F.lit(True).alias("found")).union(missed.select("patch_id", "s1_name", F.lit(False)))


def a6_load_patch_bands(spark, sf):
    return _looked_up(spark, sf, _band_store(spark, sf))


def a6_bucketed_store(spark, sf):
    """The same from a table in buckets."""
    return _looked_up(spark, sf, bench.write_store(_band_store(spark, sf), f"bands_{uuid.uuid4().hex}", 16))


def c2_join_modalities(spark, sf):
    a = view(spark, sf, "annotations")
    return a.where("split = 'train'").select("id", "patch_id").join(bench.last_s1_names(a), "patch_id").select("id", "patch_id", "s1_name")


def b2_active_only(spark, sf):
    return corpus.active_only(view(spark, sf, "questions")).groupBy("qtype").agg(F.count("*").alias("n"))


def c1_join_qa(spark, sf):
    return bench.join_qa(view(spark, sf, "questions"), view(spark, sf, "answers")).select("question_id", "img_id", "qtype", "answer")


def c3_pair_temporal(spark, sf):
    q = view(spark, sf, "questions")
    explicit = F.when(F.col("question_id") % 5 == 0, F.concat(F.lit("b"), "question_id"))
    p = bench.pair_temporal(q, explicit, F.when(F.col("question_id") % 10 == 0, F.lit("after.png")), F.col("img_id").cast("string"), "root", ".png")
    return p.select("question_id", "image_before", "image_after")


def c4_join_predictions(spark, sf):
    s, p = view(spark, sf, "vqa").select("sample_id", "gold"), view(spark, sf, "predictions").select("sample_id", "answer", "finish")
    return bench.join_predictions(s, p.join(s.select("sample_id"), "sample_id", "left_semi"))


def d2_seeded_subset(spark, sf):
    return corpus.seeded_subset(view(spark, sf, "questions"), 200, SEED, "question_id", "question_id").select("question_id", "img_id")


def e14_requests(spark, sf):
    d = view(spark, sf, "queries")
    names = F.array(*[F.lit(t) for t in lookup.TASKS])
    s = d.select(F.col("run_id").alias("sample_id"), F.get(names, (F.col("run_id") % len(lookup.TASKS)).cast("int")).alias("task"), F.col("query").alias("question"))
    return bench.requests(s)


def e26_config_hash(spark, sf):
    d = view(spark, sf, "predictions")
    return d.select("sample_id", text.config_hash([F.col("model"), F.col("sample_id").alias("seed")]).alias("hash"), text.model_slug(F.concat("model", F.lit("/v1"))).alias("slug"))


def f7_describe(spark, sf):
    a = view(spark, sf, "annotations").select(F.col("id").alias("pos"), F.concat(F.lit("s-"), "id").alias("sample_id"), F.concat("patch_id", F.lit(".png")).alias("image"), F.col("category").alias("qtype"), "split")
    listing = a.where("split = 'train'").select(F.col("image").alias("path")).distinct()
    return bench.describe(a, listing).withColumn("images_probed", F.col("images_probed").cast("long"))


def f7_readiness(spark, sf):
    """Releases with all their files, with one of two, with none, and with none named."""
    there, absent = _annotation_files(spark, view(spark, sf, "vqa"), F.struct("sample_id")), f"{shared_folder(spark)}/no-such-release-{uuid.uuid4().hex}"
    specs = [{"adapter": "rsvqa", "name": "whole", "questions": there, "answers": there}, {"adapter": "rsvqa", "name": "half", "questions": there, "answers": absent}, {"adapter": "cdvqa", "name": "lost", "annotations": absent}, {"adapter": "cdvqa", "name": "unnamed"}]
    ready = tables.readiness(spark, specs).select("benchmark", "ready", (F.col("missing") != "").alias("lacks"))
    return ready.crossJoin(F.broadcast(view(spark, sf, "vqa").agg(F.count("*").alias("samples"))))  # one row


def _annotation_files(spark, rows, record):
    """A benchmark release made from a table: documents that are lists of records, in the order of the first column from file to file."""
    folder = f"{shared_folder(spark)}/release-{uuid.uuid4().hex}"
    key = rows.columns[0]
    parts = rows.withColumn("part", F.lpad(F.floor(F.col(key) / MOST_RECORDS).cast("string"), 12, "0"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_id"), record.alias("r")))), lambda x: x["r"])
    parts.groupBy("part").agg(F.to_json(ordered).alias("value")).select("value", "part").write.partitionBy("part").text(folder)
    return folder


def _rsvqa_files(spark, sf):
    root = f"{shared_folder(spark)}/rsvqa-{uuid.uuid4().hex}"
    q = _in_parts(view(spark, sf, "questions"), "question_id")
    q.groupBy("part").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("question_id").alias("id"), "img_id", F.concat(F.lit("q"), "question_id").alias("question"), F.col("qtype").alias("type"), "active")).alias("questions"))).alias("value")).select("value", "part").write.partitionBy("part").text(f"{root}/q")
    a = view(spark, sf, "answers").groupBy("question_id").agg(F.min_by("answer", F.when(F.coalesce("active", F.lit(True)), F.col("pos"))).alias("answer")).where("answer IS NOT NULL")
    a = _in_parts(a, "question_id")
    a.groupBy("part").agg(F.to_json(F.struct(F.collect_list(F.struct("question_id", "answer")).alias("answers"))).alias("value")).select("value", "part").write.partitionBy("part").text(f"{root}/a")
    return {"adapter": "rsvqa", "name": "lr", "questions": f"{root}/q", "answers": f"{root}/a", "root": "img", "suffix": ".tif"}


def h1_union_samples(spark, sf):
    """Releases in the shape of each of the five adapters, made from the tables, loaded and put into one table."""
    vqa, boxes_, caps, turns = view(spark, sf, "vqa"), view(spark, sf, "boxes"), view(spark, sf, "captions"), view(spark, sf, "questions")
    text_of = lambda c: F.col(c).cast("string")
    specs = [
        {"adapter": "vrsbench_vqa", "name": "v", "annotations": _annotation_files(spark, vqa, F.struct(F.concat(F.lit("i"), "sample_id").alias("image"), F.col("raw_text").alias("question"), F.col("gold").alias("gt"), F.col("qtype").alias("type")))},
        {"adapter": "vrsbench_caption", "name": "c", "annotations": _annotation_files(spark, caps.where("part = 'reference'").groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref", "text"))), lambda r: r["text"]).alias("captions")), F.struct(text_of("sample_id").alias("image_id"), "captions")), "suffix": ".png"},
        {"adapter": "vrsbench_referring", "name": "r", "annotations": _annotation_files(spark, boxes_, F.struct(text_of("sample_id").alias("image_id"), F.concat(F.lit("box "), "sample_id").alias("expression"), F.array("gx1", "gy1", "gx2", "gy2").alias("bbox"))), "scale": "milli"},
        {"adapter": "cdvqa", "name": "d", "annotations": _annotation_files(spark, turns, F.struct(text_of("question_id").alias("img_name"), F.col("qtype").alias("question"), F.lit("yes").alias("answer"))), "root": "cd", "suffix": ".png"},
        _rsvqa_files(spark, sf),
    ]
    both = bench.union_samples([bench.load_samples(spark, spec) for spec in specs])
    golds = F.size(bench.gold_texts(F.coalesce("references", F.array().cast("array<string>")), F.col("answer")))
    box = F.array_join(F.transform(F.array("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2"), lambda x: F.round(x * 1000, 0).cast("int").cast("string")), ",")
    return both.select("sample_id", "task", F.array_join(F.transform("images", lambda i: F.concat_ws(":", i["role"], i["path"])), ",").alias("images"), "question", "answer", "qtype", golds.alias("golds"), F.when(F.col("bbox").isNotNull(), box).alias("box"))


def l3_load_samples(spark, sf):
    """Question and answer files made from tables, read by a registered adapter."""
    s = bench.load_samples(spark, _rsvqa_files(spark, sf))
    return s.select("sample_id", "task", F.col("images")[0]["path"].alias("path"), "answer", "qtype")


def a9_prediction_log(spark, sf):
    """Answers to questions and boxes, written and read again: raw text beside what was parsed of it."""
    folder = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    vqa, boxes_ = view(spark, sf, "vqa"), view(spark, sf, "boxes")
    samples = vqa.select("sample_id", F.lit("vqa").alias("task"), F.col("gold").alias("answer"), "qtype", F.lit("?").alias("question"))
    boxed = boxes_.select((-1 - F.col("sample_id")).alias("sample_id"), F.lit("grounding").alias("task"), boxes.normalize_box([F.col(c) for c in ("gx1", "gy1", "gx2", "gy2")], "milli").alias("bbox"))
    said = vqa.select("sample_id", F.when(F.col("sample_id") % 7 != 0, F.col("raw_text")).otherwise(" ").alias("raw_text")).union(boxes_.select(-1 - F.col("sample_id"), "raw_text"))
    tables.write_predictions(samples.unionByName(boxed, allowMissingColumns=True), said, folder, "milli")
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    log = spark.read.schema(f"sample_id long, reference string, reference_bbox {box}, qtype string, raw_text string, answer string, bbox {box}, parse_ok boolean").json(folder)
    return log.select("sample_id", "reference", F.col("reference_bbox").isNotNull().alias("has_box"), "raw_text", "answer", F.col("bbox").isNotNull().alias("boxed"), "parse_ok")


def a10_append_results(spark, sf):
    """The log written in two runs and read again."""
    folder = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    r = view(spark, sf, "results")
    rows = r.select(F.col("ts").cast("string").alias("timestamp"), "benchmark", "task", "backend", "model", F.lit(10).cast("long").alias("num_samples"), "metric", "value", (F.col("seq") / 4).alias("duration_s"), F.lit("1.1.0").alias("prompt_version"), F.lit("h").alias("config_hash"), F.lit("g").alias("git_sha"))
    results.append_results(rows.where("metric <> 'n'"), folder)
    results.append_results(rows.where("metric = 'n'"), folder)
    return results.read_results(spark, folder).groupBy("model", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("duration_s"), 2).alias("seconds"))


def a11_read_absent(spark, sf):
    """The number of rows of a log that is not there, beside the tables that are."""
    none = results.read_results(spark, f"{shared_folder(spark)}/no-such-log").agg(F.count("*").alias("absent"))
    return view(spark, sf, "results").agg(F.count("*").alias("present")).crossJoin(none)


def f10_dashboard(spark, sf):
    d = results.dashboard(view(spark, sf, "results"), PRIORITIES)
    return d.select("backend", "model", *[F.round(F.col(f"`{p}`"), 6).alias("p" + p[0]) for p in PRIORITIES])


def f10_recent_runs(spark, sf):
    return results.recent_runs(view(spark, sf, "results")).select(F.col("ts").cast("string").alias("ts"), "backend", "model", "n_benchmarks", "scores")


def f11_comparison(spark, sf):
    c = results.comparison(view(spark, sf, "results"), PRIORITIES)
    return c.select("model", *[F.col(f"`{p}`").alias("p" + p[0]) for p in PRIORITIES])


def f13_sweep_status(spark, sf):
    cells = view(spark, sf, "results").select("model", F.when(F.col("seq") % 7 == 0, "error").when(F.col("seq") % 11 == 0, "pending").otherwise("ok").alias("status"), F.lit(10).alias("num_samples"), F.lit(2.0).alias("duration_s"))
    return results.sweep_status(cells, ["model"])


def f15_normalise_scores(spark, sf):
    return results.normalise_scores(view(spark, sf, "results"), {"1-URGENT": 2.0}).select("model", F.round("overall", 6).alias("overall"), "n_benchmarks")


def c10_matrix_grid(spark, sf):
    r = view(spark, sf, "results")
    return results.matrix_grid(r, r)


def c11_pending_cells(spark, sf):
    r = view(spark, sf, "results")
    grid = results.matrix_grid(r, r)
    done = r.where("metric = 'oa' AND value > 0.3")
    return results.pending_cells(grid, done).withColumn("state", F.lit("pending")).union(results.cached_cells(grid, done).withColumn("state", F.lit("cached")))


QUERIES = {f.__name__: f for f in [a2_read_records, a2_read_split_records, a3_resolve_fields, a5_assemble_pairs, a6_load_patch_bands, a6_bucketed_store, a9_prediction_log, a10_append_results, a11_read_absent, a12_sniff_keys, b2_active_only, c1_join_qa, c2_join_modalities, c3_pair_temporal, c4_join_predictions, c10_matrix_grid, c11_pending_cells, d2_seeded_subset, e14_requests, e26_config_hash, f7_describe, f7_readiness, f10_dashboard, f10_recent_runs, f11_comparison, f13_sweep_status, f15_normalise_scores, h1_union_samples, l3_load_samples]}

RES = f"res AS ({view_sql('results')}), head AS (SELECT * FROM res WHERE metric = CASE task WHEN 'vqa' THEN 'oa' WHEN 'caption' THEN 'cider_d' WHEN 'grounding' THEN 'acc@0.5' ELSE 'oa' END)"
QA = f"q AS ({view_sql('questions')}), a AS ({view_sql('answers')}), f AS (SELECT question_id, arg_min(answer, pos) AS answer FROM a WHERE coalesce(active, TRUE) GROUP BY question_id), qa AS (SELECT q.*, f.answer FROM q JOIN f USING (question_id) WHERE coalesce(q.active, TRUE))"
_cell = lambda p, form: form.format(f"max(value) FILTER (WHERE benchmark = '{p}')")
_prompt = "CASE task " + " ".join(f"WHEN '{t}' THEN " + (f"CASE WHEN trim(question) <> '' THEN replace('{p}', '{{question}}', trim(question)) END" if "{question}" in p else f"'{p}'").replace("\n", "' || chr(10) || '") for t, p in lookup.PROMPTS.items()) + " END"
_tasks = "[" + ", ".join(f"'{t}'" for t in lookup.TASKS) + "]"
A6 = f"""WITH ann AS ({view_sql("annotations")}), pa AS ({view_sql("patches")}), k AS (SELECT DISTINCT patch_id, s1_name, patch_id IN (SELECT patch_id FROM pa WHERE NOT contains_seasonal_snow) AND s1_name IN (SELECT s1_name FROM ann WHERE split = 'train') AS found FROM ann)
SELECT * FROM k"""
A2 = f"WITH q AS ({view_sql('questions')}) SELECT qtype, count(*) AS listed, CAST(sum(question_id) AS BIGINT) AS ids, count(*) AS keyed, CAST(sum(question_id) AS BIGINT) AS keys FROM q GROUP BY qtype"
SQL = {
    "a2_read_records": A2,
    "a2_read_split_records": A2,
    "a3_resolve_fields": f"WITH q AS ({view_sql('questions')}) SELECT question_id, img_id FROM q",
    "a5_assemble_pairs": f"""WITH turns AS ({view_sql("turns")}), u AS (SELECT conv_id, arg_max(value, turn) FILTER (WHERE speaker <> 'gpt') AS q, arg_max(value, turn) FILTER (WHERE speaker = 'gpt') AS a FROM turns GROUP BY conv_id HAVING count(*) > 2),
k AS (SELECT conv_id, trim(regexp_replace(q, '^Image 1: <image>\\nImage 2: <image>\\n', '')) AS question, trim(a) AS answer FROM u)
SELECT 'img' || (conv_id % 40) AS img_name, count(*) AS questions, CAST(sum(length(question)) AS BIGINT) AS q_chars, CAST(sum(length(answer)) AS BIGINT) AS a_chars FROM k WHERE question <> '' AND answer <> '' GROUP BY 1""",
    "a6_load_patch_bands": A6,
    "a6_bucketed_store": A6,
    "a9_prediction_log": f"""WITH v AS ({view_sql("vqa")}), b AS ({view_sql("boxes")}), s AS (SELECT sample_id, gold, CASE WHEN sample_id % 7 <> 0 THEN raw_text ELSE ' ' END AS t FROM v)
SELECT sample_id, gold AS reference, FALSE AS has_box, t AS raw_text, CASE WHEN t = ' ' THEN '' ELSE CASE sample_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'residential area' WHEN 3 THEN 'yes' WHEN 4 THEN '3' ELSE 'it is yes' END END AS answer, FALSE AS boxed, t <> ' ' AS parse_ok FROM s
UNION ALL SELECT -1 - sample_id, NULL, TRUE, raw_text, NULL, raw_text <> 'no box here', raw_text <> 'no box here' FROM b""",
    "a10_append_results": f"WITH {RES} SELECT model, metric, count(*) AS n, round(sum(round_even(value, 6)), 4) AS total, round(sum(round_even(seq / 4, 2)), 2) AS seconds FROM res GROUP BY ALL",
    "a11_read_absent": f"WITH {RES} SELECT count(*) AS present, CAST(0 AS BIGINT) AS absent FROM res",
    "a12_sniff_keys": "SELECT unnest(['active', 'id', 'image', 'type']) AS key",
    "b2_active_only": f"WITH q AS ({view_sql('questions')}) SELECT qtype, count(*) AS n FROM q WHERE active IS DISTINCT FROM FALSE GROUP BY qtype",
    "c1_join_qa": f"WITH {QA} SELECT question_id, img_id, qtype, answer FROM qa",
    "c2_join_modalities": f"WITH ann AS ({view_sql('annotations')}), l AS (SELECT patch_id, arg_max(s1_name, pos) AS s1_name FROM ann GROUP BY patch_id) SELECT id, patch_id, l.s1_name FROM ann JOIN l USING (patch_id) WHERE split = 'train'",
    "c3_pair_temporal": f"WITH q AS ({view_sql('questions')}) SELECT question_id, CASE WHEN question_id % 10 = 0 THEN 'root/b' || question_id ELSE 'root/im1/' || img_id || '.png' END AS image_before, CASE WHEN question_id % 10 = 0 THEN 'root/after.png' ELSE 'root/im2/' || img_id || '.png' END AS image_after FROM q",
    "c4_join_predictions": f"WITH v AS ({view_sql('vqa')}), p AS ({view_sql('predictions')}) SELECT sample_id, gold, answer, finish FROM v JOIN p USING (sample_id)",
    "c10_matrix_grid": f"WITH {RES} SELECT model, benchmark FROM (SELECT DISTINCT model FROM res) m CROSS JOIN (SELECT DISTINCT benchmark FROM res) b",
    "c11_pending_cells": f"WITH {RES}, g AS (SELECT model, benchmark FROM (SELECT DISTINCT model FROM res) m CROSS JOIN (SELECT DISTINCT benchmark FROM res) b) SELECT g.*, CASE WHEN EXISTS (SELECT 1 FROM res r WHERE r.model = g.model AND r.benchmark = g.benchmark AND r.metric = 'oa' AND r.value > 0.3) THEN 'cached' ELSE 'pending' END AS state FROM g",
    "d2_seeded_subset": f"WITH q AS ({view_sql('questions')}) SELECT question_id, img_id FROM q ORDER BY md5('{SEED}-' || CAST(question_id AS VARCHAR)), question_id LIMIT 200",
    "e14_requests": f"WITH d AS ({view_sql('queries')}), s AS (SELECT run_id AS sample_id, ({_tasks})[run_id % 6 + 1] AS task, query AS question FROM d) SELECT sample_id, task, {_prompt} AS prompt, CAST(CASE task WHEN 'caption' THEN 128 WHEN 'change_caption' THEN 128 WHEN 'grounding' THEN 64 ELSE 32 END AS INTEGER) AS max_new_tokens FROM s",
    "e26_config_hash": f"""WITH p AS ({view_sql('predictions')}) SELECT sample_id, substr(sha256('{{"model":"' || model || '","seed":' || sample_id || '}}'), 1, 12) AS hash, model || '__v1' AS slug FROM p""",
    "f7_describe": f"""WITH ann AS ({view_sql('annotations')}), a AS (SELECT id AS pos, 's-' || id AS sample_id, patch_id || '.png' AS image, category AS qtype, split FROM ann), l AS (SELECT DISTINCT image FROM a WHERE split = 'train'), p AS (SELECT * FROM a ORDER BY pos LIMIT 200), m AS (SELECT * FROM p WHERE image NOT IN (SELECT image FROM l))
SELECT (SELECT count(*) FROM a) AS num_samples, (SELECT count(*) FROM p) AS images_probed, (SELECT count(*) FROM m) AS images_missing, coalesce((SELECT string_agg(image, ',' ORDER BY pos) FROM (SELECT * FROM m ORDER BY pos LIMIT 5) z), '') AS missing_examples,
 (SELECT string_agg(qtype, ',' ORDER BY qtype) FROM (SELECT DISTINCT qtype FROM a WHERE coalesce(qtype, '') <> '' ORDER BY qtype LIMIT 20) z) AS question_types, (SELECT arg_min(sample_id, pos) FROM a) AS example_id, (SELECT '{{"pos":' || pos || ',"sample_id":"' || sample_id || '","image":"' || image || '"' || coalesce(',"qtype":"' || qtype || '"', '') || ',"split":"' || split || '"}}' FROM a ORDER BY pos LIMIT 1) AS example""",
    "f7_readiness": f"WITH v AS ({view_sql('vqa')}) SELECT benchmark, ready, lacks, samples FROM (VALUES ('whole', TRUE, FALSE), ('half', FALSE, TRUE), ('lost', FALSE, TRUE), ('unnamed', FALSE, FALSE)) r(benchmark, ready, lacks) CROSS JOIN (SELECT count(*) AS samples FROM v) n",
    "f10_dashboard": f"WITH {RES}, c AS (SELECT backend, model, benchmark, arg_max(value, seq) AS value FROM head GROUP BY ALL) SELECT s.backend, s.model, " + ", ".join(_cell(p, "round({}, 6)") + f" AS p{p[0]}" for p in PRIORITIES) + " FROM (SELECT DISTINCT backend, model FROM res) s LEFT JOIN c ON c.backend = s.backend AND c.model = s.model GROUP BY ALL",
    "f10_recent_runs": f"WITH {RES}, l AS (SELECT ts, backend, model, benchmark, arg_max(value, seq) AS value FROM head GROUP BY ALL), c AS (SELECT *, benchmark || '=' || printf('%.6f', round(value, 6)) AS v FROM l) SELECT CAST(ts AS VARCHAR) AS ts, backend, model, count(*) AS n_benchmarks, string_agg(v, ';' ORDER BY v) AS scores FROM c GROUP BY ALL",
    "f11_comparison": f"WITH {RES}, c AS (SELECT model, benchmark, arg_max(value, seq) AS value FROM head GROUP BY ALL) SELECT s.model, " + ", ".join(_cell(p, "coalesce(printf('%.4f', {}), '-')") + f" AS p{p[0]}" for p in PRIORITIES) + " FROM (SELECT DISTINCT model FROM res) s LEFT JOIN c ON c.model = s.model GROUP BY s.model",
    "f13_sweep_status": f"WITH {RES}, c AS (SELECT model, CASE WHEN seq % 7 = 0 THEN 'error' WHEN seq % 11 = 0 THEN 'pending' ELSE 'ok' END AS status FROM res) SELECT model, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS done, count(*) FILTER (WHERE status = 'error') AS failed, round_even(100.0 * count(*) FILTER (WHERE status <> 'pending') / count(*), 1) AS percent, CAST(5.0 AS DOUBLE) AS per_second FROM c GROUP BY model",
    "f15_normalise_scores": f"WITH {RES}, c AS (SELECT model, benchmark, arg_max(value, seq) AS value FROM head GROUP BY ALL), r AS (SELECT benchmark, min(value) AS lo, max(value) AS hi FROM c GROUP BY benchmark) SELECT model, round(CAST(sum(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 1 END * CASE WHEN benchmark = '1-URGENT' THEN 2 ELSE 1 END) / sum(CASE WHEN benchmark = '1-URGENT' THEN 2 ELSE 1 END) AS DOUBLE), 6) AS overall, count(*) AS n_benchmarks FROM c JOIN r USING (benchmark) GROUP BY model",
    "l3_load_samples": f"WITH {QA} SELECT 'lr-' || question_id AS sample_id, 'vqa' AS task, 'img/' || img_id || '.tif' AS path, CAST(answer AS VARCHAR) AS answer, qtype FROM qa",
    "h1_union_samples": f"""WITH {QA}, v AS ({view_sql("vqa")}), caps AS ({view_sql("captions")}), bx AS ({view_sql("boxes")}), r AS (SELECT sample_id, arg_min(text, ref) AS answer, count(*) AS n FROM caps WHERE part = 'reference' GROUP BY sample_id)
SELECT 'v-' || (row_number() OVER (ORDER BY sample_id) - 1) AS sample_id, 'vqa' AS task, 'single:i' || sample_id AS images, raw_text AS question, gold AS answer, qtype, 1 AS golds, CAST(NULL AS VARCHAR) AS box FROM v
UNION ALL SELECT 'c-' || (row_number() OVER (ORDER BY sample_id) - 1), 'caption', 'single:' || sample_id || '.png', NULL, answer, NULL, CAST(n AS INTEGER), NULL FROM r
UNION ALL SELECT 'r-' || (row_number() OVER (ORDER BY sample_id) - 1), 'grounding', 'single:' || sample_id, 'box ' || sample_id, NULL, NULL, 0, gx1 || ',' || gy1 || ',' || gx2 || ',' || gy2 FROM bx
UNION ALL SELECT 'd-' || (row_number() OVER (ORDER BY question_id) - 1), 'change_vqa', 'before:cd/im1/' || question_id || '.png,after:cd/im2/' || question_id || '.png', qtype, 'yes', NULL, 1, NULL FROM q
UNION ALL SELECT 'lr-' || question_id, 'vqa', 'single:img/' || img_id || '.tif', 'q' || question_id, CAST(answer AS VARCHAR), qtype, 1, NULL FROM qa""",
}
