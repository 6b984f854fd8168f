"""Benchmark tables: joins of questions, answers and images, subsets, requests, audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneweave.functions import text
from sceneweave.operators.corpus import active_only

Adapter = Callable[[SparkSession, dict], DataFrame]
ADAPTERS: dict[str, Adapter] = {}


def register(name: str) -> Callable[[Adapter], Adapter]:
    """Register an adapter (spark, spec) -> samples; a name is taken once."""

    def put(adapter: Adapter) -> Adapter:
        if name in ADAPTERS:
            raise ValueError(f"adapter {name!r} is registered already")
        ADAPTERS[name] = adapter
        return adapter

    return put


def load_samples(spark: SparkSession, spec: dict) -> DataFrame:
    if spec["adapter"] not in ADAPTERS:
        raise KeyError(f"no adapter {spec['adapter']!r}; known: {sorted(ADAPTERS)}")
    return ADAPTERS[spec["adapter"]](spark, spec)


def join_qa(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Active questions with their first active answer by pos; questions without one go.

    The first answer is an aggregate, not a window, so that it is taken before the shuffle.
    """
    first = active_only(answers).where("answer IS NOT NULL").groupBy("question_id").agg(F.min_by("answer", "pos").alias("answer"))
    return active_only(questions).join(first, "question_id")


def pair_temporal(frame: DataFrame, before: Column, after: Column, name: Column, root: str = "", suffix: str = "", dirs: tuple[str, str] = ("im1", "im2")) -> DataFrame:
    """``frame`` with image_before and image_after: both explicit names, else one name under two folders."""
    lead = f"{root.rstrip('/')}/" if root else ""
    under = lambda d: text.resolve_image(name, f"{lead}{d}", suffix)
    explicit = (F.coalesce(before, F.lit("")) != "") & (F.coalesce(after, F.lit("")) != "")
    pick = lambda given, d: F.when(explicit, F.concat(F.lit(lead), given)).otherwise(under(d))
    return frame.withColumns({"image_before": pick(before, dirs[0]), "image_after": pick(after, dirs[1])})


def join_predictions(samples: DataFrame, predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    """One prediction per sample and the other way round; anything else fails with a count of what does not match."""
    left = samples.groupBy(key).agg(F.count("*").alias("s"))
    right = predictions.groupBy(key).agg(F.count("*").alias("p"))
    odd = left.join(right, key, "full_outer").where("coalesce(s, 0) <> 1 OR coalesce(p, 0) <> 1").count()
    if odd:
        raise ValueError(f"{odd} sample ids have not exactly one sample and one prediction")
    return samples.join(predictions, key)


def write_store(store: DataFrame, table: str, buckets: int) -> DataFrame:
    """The store (key, bands) as a table in buckets by key, one file each, and the table read again.

    ``load_patch_bands`` then moves keys to the buckets of both stores, and the
    optical bands once, to their radar bands; the table itself is not shuffled.
    A bucket should hold about as much as a task is to read.
    """
    store.repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").saveAsTable(table)
    return store.sparkSession.table(table)


def load_patch_bands(keys: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys (patch_id, s1_name) with optical and radar bands of the store (key, bands); and the keys that miss either, whatever other keys of their patch have."""
    optical = store.select(F.col("key").alias("patch_id"), F.col("bands").alias("optical"))
    radar = store.select(F.col("key").alias("s1_name"), F.col("bands").alias("radar"))
    found = keys.join(optical, "patch_id").join(radar, "s1_name")
    return found, keys.join(found.select("patch_id", "s1_name").distinct(), ["patch_id", "s1_name"], "left_anti")


def last_s1_names(annotations: DataFrame) -> DataFrame:
    """(patch_id, s1_name): the last name by pos of each patch, over all splits."""
    return annotations.groupBy("patch_id").agg(F.max_by("s1_name", "pos").alias("s1_name"))


def requests(samples: DataFrame) -> DataFrame:
    """(sample_id, task, prompt, max_new_tokens); a sample without a question that its task needs has a null prompt."""
    return samples.select("sample_id", "task", text.render_prompt(F.col("task"), F.col("question")).alias("prompt"), text.token_budget(F.col("task")).alias("max_new_tokens"))


def question_answers(turns: DataFrame, order: str = "turn") -> DataFrame:
    """(conv_id, question, answer): the last user turn without image lines, the last assistant turn; both must have text."""
    user, assistant = F.col("speaker") != "gpt", F.col("speaker") == "gpt"
    pairs = turns.groupBy("conv_id").agg(F.max_by("value", F.when(user, F.col(order))).alias("question"), F.max_by("value", F.when(assistant, F.col(order))).alias("answer"))
    pairs = pairs.select("conv_id", text.turn_text(F.col("question")).alias("question"), F.trim("answer").alias("answer"))
    return pairs.where("question <> '' AND answer <> ''")


def assemble_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From archive members (shard, key, suffix, payload): image pairs, one per image name, and questions, one per key.

    A key needs its json and both images. The first key of a name, by shard and
    key, gives its images.
    """
    has = lambda kind: F.bool_or(F.col("suffix") == kind).alias(f"has_{kind}")
    # Which keys are whole, and which give images, is decided without payloads; those of the chosen keys are moved once.
    whole = members.groupBy("shard", "key").agg(has("json"), has("before"), has("after")).where("has_json AND has_before AND has_after").select("shard", "key")
    shape = "conversations array<struct<`from`:string,value:string>>, meta struct<image_id:string,question_type:string>"
    json = members.where("suffix = 'json'").groupBy("shard", "key").agg(F.first(F.col("payload").cast("string")).alias("json")).join(whole, ["shard", "key"])
    parsed = json.withColumn("record", F.from_json("json", shape)).withColumn("image_id", F.coalesce("record.meta.image_id", F.concat("key", F.lit(".png"))))
    turns = parsed.select("shard", "key", F.posexplode("record.conversations").alias("turn", "t")).select(F.concat_ws("/", "shard", "key").alias("conv_id"), "turn", F.col("t.from").alias("speaker"), F.col("t.value").alias("value"))
    asked = parsed.withColumn("conv_id", F.concat_ws("/", "shard", "key")).join(question_answers(turns), "conv_id")
    chosen = asked.groupBy("image_id").agg(F.min(F.struct("shard", "key")).alias("k")).select("image_id", F.col("k.shard").alias("shard"), F.col("k.key").alias("key"))
    payload = lambda kind: F.first(F.when(F.col("suffix") == kind, F.col("payload")), ignorenulls=True).alias(kind)
    images = members.where("suffix IN ('before', 'after')").join(chosen, ["shard", "key"]).groupBy("shard", "key", "image_id").agg(payload("before"), payload("after")).select("image_id", "before", "after")
    return images, asked.select("shard", "key", F.col("image_id").alias("img_name"), "question", "answer", F.coalesce("record.meta.question_type", F.lit("")).alias("type"))


def describe(samples: DataFrame, listing: DataFrame, probe: int = 200) -> DataFrame:
    """One row: num_samples, images_probed, images_missing, missing_examples, question_types, example_id, example (the first row as JSON).

    samples has (pos, sample_id, image, qtype); listing has the paths that exist.
    """
    probed = samples.orderBy("pos").limit(probe)
    missing = probed.join(listing.select(F.col("path").alias("image")), "image", "left_anti")
    lost = missing.agg(F.count("*").alias("images_missing"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "image"))), lambda x: x["image"]), 1, 5), ",").alias("missing_examples"))
    types = samples.where("coalesce(qtype, '') <> ''").select("qtype").distinct().orderBy("qtype").limit(20).agg(F.array_join(F.array_sort(F.collect_list("qtype")), ",").alias("question_types"))
    head = samples.agg(F.count("*").alias("num_samples"), F.min_by("sample_id", "pos").alias("example_id"), F.min_by(F.to_json(F.struct(*samples.columns)), "pos").alias("example"))
    counted = head.crossJoin(F.broadcast(probed.agg(F.count("*").alias("images_probed"))))  # one row each
    return counted.crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(types)).select("num_samples", "images_probed", "images_missing", "missing_examples", "question_types", "example_id", "example")


SAMPLES = ["sample_id", "task", "images", "question", "answer", "references", "bbox", "qtype", "meta"]


def union_samples(tables: list[DataFrame]) -> DataFrame:
    """One samples table from several adapters; columns that one lacks are null."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def gold_texts(references: Column, answer: Column) -> Column:
    return F.when(F.size(references) > 0, references).when(answer.isNotNull(), F.array(answer)).otherwise(F.array().cast("array<string>"))
