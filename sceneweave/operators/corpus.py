"""Preparation of the instruction corpus: filters, stratified sample, records, profile, evidence mix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneweave.functions import boxes, lookup, text


def drop_unanswerable(annotations: DataFrame) -> DataFrame:
    """Rows whose category pixels can answer. A null category is kept. Belongs before sampling, so that no quota is spent on dropped rows."""
    return annotations.where(~F.lower(F.trim(F.coalesce("category", F.lit("none")))).isin(lookup.UNANSWERABLE))


def active_only(frame: DataFrame, column: str = "active") -> DataFrame:
    """Rows whose flag is not false; a missing flag keeps the row."""
    return frame.where(F.coalesce(column, F.lit(True)))


def with_imagery(annotations: DataFrame, images: DataFrame, key: str = "patch_id") -> DataFrame:
    return annotations.join(images.select(key), key, "left_semi")


def drop_poor_patches(annotations: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows whose patch has neither seasonal snow nor cloud; unknown flags count as clear, unknown patches go."""
    clear = patches.where(~F.coalesce("contains_seasonal_snow", F.lit(False)) & ~F.coalesce("contains_cloud_or_shadow", F.lit(False)))
    return annotations.join(clear.select("patch_id"), "patch_id", "left_semi")


def seeded(seed: int, key: str | Column) -> Column:
    """An order that is the same for a seed and an id, on any engine."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")).cast("binary"))


def stratified_sample(annotations: DataFrame, per_type: int, seed: int = 1234, strata: tuple[str, ...] = ("country", "season"), key: str = "id") -> DataFrame:
    """Up to ``per_type`` rows of each type, spread evenly over the strata.

    Each stratum gives ``per_type // strata of the type`` rows, at least one;
    rows with a null stratum column are left out. Only what is picked within
    strata reaches the second ranking.
    """
    rows = annotations.where(reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in strata]))
    rows = rows.withColumn("_order", seeded(seed, key))
    counts = rows.select("type", *strata).distinct().groupBy("type").agg(F.count("*").alias("_strata"))
    picked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("type", *strata).orderBy("_order", key))).where(F.col("_rank") <= per_type)
    picked = picked.join(counts, "type").where(F.col("_rank") <= F.greatest(F.floor(F.lit(per_type) / F.col("_strata")), F.lit(1)))
    capped = picked.withColumn("_rank", F.row_number().over(Window.partitionBy("type").orderBy("_order", key))).where(F.col("_rank") <= per_type)
    return capped.select(*annotations.columns)


def seeded_subset(frame: DataFrame, limit: int, seed: int, key: str, position: str) -> DataFrame:
    """``limit`` rows by hash, in their original order: the same for every model."""
    return frame.orderBy(seeded(seed, key), key).limit(limit).orderBy(position)


def patch_ids(annotations: DataFrame) -> DataFrame:
    return annotations.select("patch_id").distinct().sort("patch_id")


def build_records(annotations: DataFrame) -> DataFrame:
    """(id, patch_id, task, prompt, answer, reject): reject says why a row is unusable, null if it is not."""
    task, output = F.trim("type"), F.trim("output")
    box = boxes.parse_published_box(output)
    answer = F.when(task == "captioning", text.redact_caption(output, F.col("country"))).when(task == "bounding box", F.when(box.isNotNull(), boxes.milli_box(box))).otherwise(output)
    prompt = text.rewrite_prompt(F.col("input"))
    reject = (
        F.when(F.lower(F.trim(F.coalesce("category", F.lit("none")))).isin(lookup.UNANSWERABLE), "unanswerable")
        .when((task == "captioning") & answer.isNull(), "caption")
        .when((task == "bounding box") & answer.isNull(), "box")
        .when((F.coalesce(prompt, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == ""), "empty")
    )
    return annotations.select("id", "patch_id", task.alias("task"), prompt.alias("prompt"), answer.alias("answer"), reject.alias("reject"))


def instruction_json(records: DataFrame, images: Column) -> DataFrame:
    """(task, value): one JSON line per usable record, a conversation of two turns."""
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), F.col(what).alias("value"))
    line = F.to_json(F.struct(F.col("id"), F.col("patch_id"), F.col("task"), images.alias("images"), F.array(turn("human", "prompt"), turn("gpt", "answer")).alias("conversations")))
    return records.where("reject IS NULL").select("task", line.alias("value"))


def profile(annotations: DataFrame) -> DataFrame:
    """(type, n_rows, n_countries, n_seasons, n_patches)."""
    return annotations.groupBy("type").agg(F.count("*").alias("n_rows"), F.count_distinct("country").alias("n_countries"), F.count_distinct("season").alias("n_seasons"), F.count_distinct("patch_id").alias("n_patches"))


def preparation_manifest(annotations: DataFrame, seed: int, split: str = "train", per_type: int = 100) -> DataFrame:
    """One row: rows_in, rows_clean, rows_sampled, records, patches, seed, dropped."""
    part = annotations.where(F.col("split") == split)
    sampled = stratified_sample(drop_unanswerable(part), per_type, seed)
    usable = build_records(sampled).where("reject IS NULL")
    counts = part.agg(F.count("*").alias("rows_in"), F.count_if(~F.lower(F.trim(F.coalesce("category", F.lit("none")))).isin(lookup.UNANSWERABLE)).alias("rows_clean"))
    kept = usable.agg(F.count("*").alias("records"), F.count_distinct("patch_id").alias("patches"))
    row = counts.crossJoin(F.broadcast(sampled.agg(F.count("*").alias("rows_sampled")))).crossJoin(F.broadcast(kept))  # one row each
    return row.select("rows_in", "rows_clean", "rows_sampled", "records", "patches", F.lit(seed).cast("long").alias("seed"), F.lit(",".join(lookup.UNANSWERABLE)).alias("dropped"))


def contradicts(answer: Column, changed: Column) -> Column:
    return F.coalesce(text.agreement(answer, changed, F.lit(None).cast("double"), F.lit(None).cast("double"))["adjustment"] < 0, F.lit(False))


def mix_evidence(records: DataFrame, measures: DataFrame, share: float, seed: int) -> DataFrame:
    """``records`` (patch_id, prompt, answer, id) of which a seeded share has measured values before the prompt.

    A measure that would contradict the gold answer is left out.
    """
    joined = records.join(measures, "patch_id", "left")
    chosen = F.conv(F.substring(seeded(seed, "id"), 1, 8), 16, 10).cast("long") < int(share * 2**32)
    usable = chosen & F.col("changed_area_frac").isNotNull() & ~contradicts(F.col("answer"), F.col("changed_area_frac"))
    preamble = text.evidence_preamble({"changed_area_frac": F.col("changed_area_frac"), "direction": F.col("direction")})
    return joined.select("id", "patch_id", F.when(usable, F.concat(preamble, F.lit("\n\n"), F.col("prompt"))).otherwise(F.col("prompt")).alias("prompt"), "answer", usable.alias("has_evidence"))


def generate_supervision(measures: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """(pair_id, question, answer) from measured water, only where both sensors agree within the tolerance."""
    agreed = measures.where(F.abs(F.col("optical_water") - F.col("sar_water")) <= tolerance)
    mean = (F.col("optical_water") + F.col("sar_water")) / 2
    pair = lambda q, a: F.struct(F.lit(q).alias("question"), a.alias("answer"))
    asked = F.explode(F.array(pair("Is there water in this scene?", F.when(mean > 0.05, "yes").otherwise("no")), pair("What share of the scene is water?", F.format_string("%d%%", F.bround(mean * 100).cast("int"))))).alias("qa")
    return agreed.select("pair_id", asked).select("pair_id", "qa.question", "qa.answer")
