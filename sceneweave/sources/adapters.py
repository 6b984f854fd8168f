"""Benchmark releases as one samples table: (sample_id, task, images, question, answer, references, bbox, qtype).

A spec is a dict: adapter, name, annotations (or questions and answers), root,
suffix, fields (overrides), large (documents are cut at byte ranges), and for
boxes scale, xywh and image_size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneweave.functions import boxes, text
from sceneweave.operators import bench
from sceneweave.sources.documents import read_split_records
from sceneweave.sources.tables import read_records, resolve_fields

CONTAINERS = ("annotations", "data", "questions", "items")
IMAGE = ["image_id", "image", "img_id", "filename", "image_name"]
QUESTION, ANSWER, QTYPE = ["question", "text", "query"], ["ground_truth", "answer", "gt", "label"], ["type", "question_type", "category"]


def _image(path: Column, modality: str, role: str) -> Column:
    return F.struct(path.alias("path"), F.lit(modality).alias("modality"), F.lit(role).alias("role"))


def _read(spark: SparkSession, spec: dict, path: str, containers: tuple[str, ...]) -> DataFrame:
    return (read_split_records if spec.get("large") else read_records)(spark, path, containers)


def _records(spark: SparkSession, spec: dict, fields: dict[str, list[str]], required: list[str]) -> DataFrame:
    found = _read(spark, spec, spec["annotations"], CONTAINERS)
    resolved = resolve_fields(found, fields, required, spec.get("fields"))
    return resolved.withColumn("sample_id", F.concat(F.lit(spec["name"] + "-"), "pos"))


def _single(spec: dict) -> Column:
    return F.array(_image(text.resolve_image(F.col("image_id"), spec.get("root", ""), spec.get("suffix", "")), "rgb", "single")).alias("images")


@bench.register("vrsbench_vqa")
def vrsbench_vqa(spark: SparkSession, spec: dict) -> DataFrame:
    r = _records(spark, spec, {"image_id": IMAGE, "question": QUESTION, "answer": ANSWER, "qtype": QTYPE}, ["image_id", "question", "answer"])
    return r.select("sample_id", F.lit("vqa").alias("task"), _single(spec), "question", "answer", text.clean_qtype(F.col("qtype")).alias("qtype"))


@bench.register("vrsbench_caption")
def vrsbench_caption(spark: SparkSession, spec: dict) -> DataFrame:
    """A caption, or a list of them: the first is the answer, all are references."""
    r = _records(spark, spec, {"image_id": IMAGE, "caption": ["caption", "ground_truth", "captions", "text", "description"]}, ["image_id", "caption"])
    listed = F.from_json("caption", "array<string>")
    references = F.when(F.col("caption").startswith("["), F.coalesce(listed, F.array("caption"))).otherwise(F.array("caption"))
    return r.select("sample_id", F.lit("caption").alias("task"), _single(spec), F.get(references, F.lit(0)).alias("answer"), references.alias("references"))


@bench.register("vrsbench_referring")
def vrsbench_referring(spark: SparkSession, spec: dict) -> DataFrame:
    r = _records(spark, spec, {"image_id": IMAGE, "question": ["question", "expression", "referring", "text", "query"], "raw": ["ground_truth", "bbox", "box", "gt_box", "answer"]}, ["image_id", "question", "raw"])
    raw = boxes.coerce_box(F.col("raw"))
    size = spec.get("image_size")
    width, height = (F.lit(size[0]), F.lit(size[1])) if size else (None, None)
    box = boxes.normalize_box([F.get(raw, F.lit(i)) for i in range(4)], spec.get("scale", "auto"), width, height, spec.get("xywh", False))
    return r.select("sample_id", F.lit("grounding").alias("task"), _single(spec), "question", box.alias("bbox"))


@bench.register("cdvqa")
def cdvqa(spark: SparkSession, spec: dict) -> DataFrame:
    fields = {"image_id": ["img_name", "image", "image_id", "filename", "name"], "before": ["img1", "image1", "im1", "before"], "after": ["img2", "image2", "im2", "after"], "question": QUESTION, "answer": ["answer", "ground_truth", "gt", "label"], "qtype": QTYPE}
    r = _records(spark, spec, fields, ["question", "answer"])
    paired = bench.pair_temporal(r, F.col("before"), F.col("after"), F.col("image_id"), spec.get("root", ""), spec.get("suffix", ""))
    images = F.array(_image(F.col("image_before"), "optical", "before"), _image(F.col("image_after"), "optical", "after"))
    return paired.select("sample_id", F.lit("change_vqa").alias("task"), images.alias("images"), "question", "answer", text.clean_qtype(F.col("qtype")).alias("qtype"))


@bench.register("rsvqa")
def rsvqa(spark: SparkSession, spec: dict) -> DataFrame:
    """Questions and answers in files of their own; inactive ones go, the first answer of a question counts."""
    fields = {"question": ["question"], "qtype": ["type", "question_type"], "image_id": ["img_id", "image_id", "image"], "question_id": ["id"], "active": ["active"]}
    q = resolve_fields(_read(spark, spec, spec["questions"], ("questions",)), fields, ["question", "image_id"], spec.get("fields"))
    a = resolve_fields(_read(spark, spec, spec["answers"], ("answers",)), {"question_id": ["question_id"], "answer": ["answer"], "active": ["active"]}, [], spec.get("fields"))
    joined = bench.join_qa(q.withColumn("active", F.col("active").cast("boolean")), a.withColumn("active", F.col("active").cast("boolean")).select("question_id", "answer", "active", "pos"))
    image = _image(text.resolve_image(F.col("image_id"), spec.get("root", ""), spec.get("suffix", "")), "optical", "single")
    return joined.select(F.concat(F.lit(spec["name"] + "-"), "question_id").alias("sample_id"), F.lit("vqa").alias("task"), F.array(image).alias("images"), "question", "answer", text.clean_qtype(F.col("qtype")).alias("qtype"))
