"""Reading and writing: annotations, benchmark JSON, catalogue features, predictions, instruction lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneweave.functions import boxes, text

ANNOTATIONS = ["ID", "s1_name", "patch_id", "input", "output", "type", "category", "split", "country", "season"]
FEATURE = "id string, collection string, bbox array<double>, properties struct<datetime:string,`eo:cloud_cover`:double,platform:string,`sat:orbit_state`:string>"


def read_annotations(spark: SparkSession, path: str, split: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The annotation table with the columns needed; the split is compared as it is, so that it prunes partitions or reaches the scan."""
    table = spark.read.parquet(path)
    if split is not None:
        table = table.where(F.col("split") == split)
    return table.select(*[c for c in columns or ANNOTATIONS if c in table.columns])


def read_records(spark: SparkSession, path: str, containers: tuple[str, ...] = ()) -> DataFrame:
    """(pos, _key, record variant) from JSON files of one document each.

    A document is a list of objects; or an object with a list under one of the
    ``containers``, else with its first list of objects; or an object of
    objects, whose keys become _key. Anything else is an error. ``pos`` goes on
    from file to file, in the order of their paths. A document is one row of one
    task; ``documents.read_split_records`` cuts large ones.
    """
    files = spark.read.text(path, wholetext=True)
    whole = files.select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("doc"))
    members = F.expr("try_variant_get(doc, '$', 'map<string,variant>')")
    is_list = F.schema_of_variant("doc").startswith("ARRAY")
    as_list = lambda v: F.expr(f"try_variant_get({v}, '$', 'array<variant>')")
    whole = whole.withColumn("members", F.when(~is_list, members))
    listed = F.filter(F.map_entries("members"), lambda e: F.schema_of_variant(e["value"]).startswith("ARRAY<OBJECT"))
    named = [F.when(F.schema_of_variant(F.col("members")[c]).startswith("ARRAY"), F.col("members")[c]) for c in containers]
    whole = whole.withColumn("list", F.when(is_list, F.col("doc")).otherwise(F.coalesce(*named, F.get(listed, F.lit(0))["value"])))
    keyed = F.when(F.col("list").isNull() & F.forall(F.map_values("members"), lambda v: F.schema_of_variant(v).startswith("OBJECT")), F.map_entries("members"))
    rows = F.when(F.col("list").isNotNull(), F.transform(as_list("list"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))).otherwise(keyed)
    rows = F.coalesce(rows, F.raise_error(F.lit("unsupported annotation payload")).cast("array<struct<key:string,value:variant>>"))
    flat = whole.select("file", F.posexplode(rows).alias("pos", "r")).select("file", F.col("pos").cast("long").alias("pos"), F.col("r.key").alias("_key"), F.col("r.value").alias("record"))
    if len(files.inputFiles()) > 1:
        # One row a file, whose names the driver has listed; the records of the files before it. Records stay in the
        # tasks that read them: shuffled by file they are few bytes, so that two tasks or so would resolve the fields of all.
        sizes = whole.select("file", F.size(rows).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        flat = flat.join(F.broadcast(sizes.select("file", before.alias("before"))), "file").withColumn("pos", F.col("pos") + F.col("before"))
    return flat.where(F.schema_of_variant("record").startswith("OBJECT")).select("pos", "_key", "record")


def field(record: str, names: list[str], kind: str = "string") -> Column:
    """The first of the candidate keys that is not null."""
    return F.coalesce(*[F.expr(f"try_variant_get({record}, '$[\"{n}\"]', '{kind}')") for n in names])


def resolve_fields(frame: DataFrame, fields: dict[str, list[str]], required: list[str] = (), overrides: dict[str, str] | None = None) -> DataFrame:
    """``frame`` (pos, _key, record) with one column per logical field.

    An override replaces the candidates of a field. A row that lacks a required
    field raises an error that names the field and what was tried.
    """
    overrides = overrides or {}
    out = frame
    for name, candidates in fields.items():
        tried = [overrides[name]] if name in overrides else candidates
        value = F.coalesce(F.when(F.lit("_key" in tried), F.col("_key")), field("record", [t for t in tried if t != "_key"] or ["_key"]))
        if name in required:
            value = F.coalesce(value, F.raise_error(F.lit(f"could not resolve field '{name}' (tried: {', '.join(tried)}); set fields.{name}")).cast("string"))
        out = out.withColumn(name, value)
    return out


def missing_fields(frame: DataFrame, fields: dict[str, list[str]], required: list[str]) -> DataFrame:
    """(field, n): how many rows lack each required field; for reports instead of errors."""
    counts = frame.agg(*[F.count_if(field("record", fields[r]).isNull()).alias(r) for r in required])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("field"), F.col(r).alias("n")) for r in required])).alias("m")).select("m.field", "m.n")


def sniff_keys(frame: DataFrame, limit: int = 50) -> DataFrame:
    """(key): the keys of the first ``limit`` records."""
    head = frame.orderBy("pos").limit(limit)
    return head.select(F.explode(F.map_keys(F.expr("try_variant_get(record, '$', 'map<string,variant>')"))).alias("key")).distinct().sort("key")


def flatten_scenes(raw: DataFrame, column: str = "value") -> DataFrame:
    """Scene rows (id, collection, datetime, cloud_cover, platform, orbit_state, x1, y1, x2, y2) from feature JSON."""
    f = raw.select(F.from_json(column, FEATURE).alias("f"))
    box = [F.get("f.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return f.select("f.id", "f.collection", F.try_to_timestamp(F.col("f.properties.datetime")).alias("datetime"), F.col("f.properties.`eo:cloud_cover`").alias("cloud_cover"), "f.properties.platform", F.col("f.properties.`sat:orbit_state`").alias("orbit_state"), *box)


def write_instructions(lines: DataFrame, path: str) -> None:
    """Instruction lines (task, value), one folder per task."""
    lines.write.mode("overwrite").partitionBy("task").text(path)


#: A line of the prediction log, besides columns that tell logs apart.
LOG = ["sample_id", "question", "reference", "references", "reference_bbox", "qtype", "raw_text", "answer", "bbox", "parse_ok"]


def prediction_log(samples: DataFrame, predictions: DataFrame, scale: str = "auto") -> DataFrame:
    """Columns of LOG, then other columns of ``predictions``: samples joined to (sample_id, raw_text).

    Beside the raw text are what was parsed of it: for grounding tasks the box,
    normalised from ``scale``, and whether there was one; for all others the
    normalised answer, and whether any text was left. Columns that samples lack
    are null.
    """
    kinds = {"question": "string", "answer": "string", "references": "array<string>", "bbox": "struct<x1:double,y1:double,x2:double,y2:double>", "qtype": "string", "task": "string"}
    own = [(F.col(c) if c in samples.columns else F.lit(None).cast(kind)).alias("reference" if c == "answer" else "reference_bbox" if c == "bbox" else c) for c, kind in kinds.items()]
    joined = samples.select("sample_id", *own).join(predictions, "sample_id")
    grounding = F.coalesce(F.col("task") == "grounding", F.lit(False))
    box = F.when(grounding, boxes.parse_bbox(F.col("raw_text"), scale))
    answer = F.when(~grounding, text.normalize_answer(F.col("raw_text")))
    parsed = F.when(grounding, box.isNotNull()).otherwise(F.coalesce(answer != "", F.lit(False)))
    others = [c for c in predictions.columns if c not in LOG]
    return joined.withColumns({"answer": answer, "bbox": box, "parse_ok": parsed}).select(*LOG, *others)


def write_predictions(samples: DataFrame, predictions: DataFrame, path: str, scale: str = "auto") -> None:
    """The prediction log as JSON lines, with null fields kept."""
    prediction_log(samples, predictions, scale).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def readiness(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """(benchmark, adapter, ready, missing): whether every annotation file that a release needs is there.

    Files are those under annotations, questions and answers of a spec; a spec
    that names none is not ready. One listing a path, on the driver.
    """

    def exists(name: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))

    rows = []
    for spec in specs:
        named = [spec[k] for k in ("annotations", "questions", "answers") if spec.get(k)]
        missing = [n for n in named if not exists(n)]
        rows.append((spec["name"], spec["adapter"], bool(named) and not missing, ",".join(missing)))
    return spark.createDataFrame(rows, "benchmark string, adapter string, ready boolean, missing string")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
