"""Questions over image sets, many at once: check, route, select, parameters, measure, answer, revise, fuse, trace.

Each stage is a join or a projection. At most two revisions happen per run: one
of a quiet change mask, and one of the answer (cut off, or against the
measurement). Both attempts stay in the trace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneweave.functions import lookup, scenes, text
from sceneweave.operators.cluster import cut_lineage
from sceneweave.operators.scenes import infer_sets
from sceneweave.plans.measure import measure_sets

MOST_TOKENS = 384


def tools_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lookup.TOOLS, "tool string, task string, config string, ord int")


RULE = "tool string, param string, lo double, hi double, allowed array<double>"


def rules_table(spark: SparkSession, sets: list[tuple[str, str, list[float]]] = ()) -> DataFrame:
    """Rules of parameters: ranges, and ``sets`` (tool, param, permitted values)."""
    rows = [(*r, None) for r in lookup.PARAM_RULES] + [(tool, param, None, None, [float(v) for v in values]) for tool, param, values in sets]
    return spark.createDataFrame(rows, RULE)


def _number(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def _members(join: str) -> Column:
    return F.array_join(F.transform(F.array_sort("allowed"), _number), join)


class ToolRegistry:
    """Measuring functions by name; a name is taken once."""

    def __init__(self, sets: list[tuple[str, str, list[float]]] = ()) -> None:
        self.tools: dict[str, tuple[str, Callable]] = {}
        self.sets = sets

    def add(self, name: str, version: str, function: Callable) -> None:
        if name in self.tools:
            raise ValueError(f"tool {name!r} is registered already")
        self.tools[name] = (version, function)

    def get(self, name: str) -> Callable:
        if name not in self.tools:
            raise KeyError(f"no tool {name!r}; known: {sorted(self.tools)}")
        return self.tools[name][1]

    def listing(self, spark: SparkSession) -> DataFrame:
        """(tool, version, accepts, tasks, param, constraint): one row per permitted parameter, or one without.

        ``tasks`` are those that the tool serves for input of configuration
        ``accepts``; a constraint is a range or the permitted values.
        """
        rows = [(n, v) for n, (v, _) in sorted(self.tools.items())]
        named = spark.createDataFrame(rows, "tool string, version string").withColumn("family", tool_family("tool"))
        served = tools_table(spark).groupBy("tool", F.col("config").alias("accepts")).agg(F.array_join(F.array_sort(F.collect_set("task")), ",").alias("tasks"))
        rules = rules_table(spark, self.sets).withColumnRenamed("tool", "family")
        constraint = F.when(F.col("allowed").isNotNull(), _members(" | ")).when(F.col("lo").isNotNull(), F.format_string("%s to %s", "lo", "hi"))
        return named.join(served, "tool", "left").join(rules, "family", "left").select("tool", "version", "accepts", "tasks", "param", constraint.alias("constraint"))


def tool_family(tool: str) -> Column:
    return F.when(F.col(tool).startswith("vlm_"), "vlm").otherwise(F.col(tool))


def validate_params(params: DataFrame, rules: DataFrame) -> DataFrame:
    """(run_id, tool, violations) from (run_id, tool, param, value), one row per call: empty where all is permitted.

    Rules of the tool family, the name before the first "_" for models, hold for
    its members. A rule is a range (lo, hi) or a list of permitted values; a null
    value keeps neither.
    """
    checked = params.withColumn("family", tool_family("tool")).join(rules.withColumnRenamed("tool", "family"), ["family", "param"], "left")
    named = F.concat("tool", F.lit(": '"), "param", F.lit("'="))
    said = (
        F.when(F.col("allowed").isNotNull(), F.when(~F.coalesce(F.array_contains("allowed", F.col("value")), F.lit(False)), F.concat(named, F.coalesce(_number(F.col("value")), F.lit("None")), F.lit(" not in ["), _members(", "), F.lit("]"))))
        .when(F.col("lo").isNull(), F.concat("tool", F.lit(": parameter '"), "param", F.lit("' is not permitted")))
        .when(F.col("value").isNull(), F.concat(named, F.lit("None outside ["), F.col("lo").cast("string"), F.lit(", "), F.col("hi").cast("string"), F.lit("]")))
        .when(~F.col("value").between(F.col("lo"), F.col("hi")), F.concat("tool", F.lit(": '"), "param", F.lit("'="), F.col("value").cast("string"), F.lit(" outside ["), F.col("lo").cast("string"), F.lit(", "), F.col("hi").cast("string"), F.lit("]")))
    )
    return checked.groupBy("run_id", "tool").agg(F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("violations"))


def select_tools(routed: DataFrame, tools: DataFrame) -> DataFrame:
    """``routed`` (run_id, task, config) with the tools of its task in order, specialists first."""
    return routed.join(F.broadcast(tools), ["task", "config"])  # a fixed list of tools


def agree(measures: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """``measures`` (pair_id, optical_water, sar_water) with gap, agrees, confidence: both sensors within the tolerance."""
    gap = F.abs(F.col("optical_water") - F.col("sar_water"))
    return measures.withColumn("gap", gap).withColumn("agrees", gap <= tolerance).withColumn("confidence", F.when(gap <= tolerance, 0.85).otherwise(0.4))


def blend(steps: DataFrame, by: str = "run_id", *also: Column) -> DataFrame:
    """(by, confidence): the mean of the confidences reported, within bounds, to 3 places; null if none was. ``also`` are further aggregates."""
    return steps.groupBy(by).agg(F.bround(text.bounded(F.avg("confidence")), 3).alias("confidence"), *also)


def run_model(requests: DataFrame, make: Callable[[], Callable[[list[str], list[int]], list[tuple[str, str]]]], batch_rows: int = 64) -> DataFrame:
    """``requests`` (run_id, prompt, max_new_tokens) with answer and finish, by a model that ``make`` loads once per task.

    The model takes batches of prompts and budgets and returns (text, finish
    reason) in the same order; fewer or more replies are an error.
    """
    schema = "run_id long, prompt string, max_new_tokens int, answer string, finish string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                replies = model(batch.column("prompt").to_pylist(), batch.column("max_new_tokens").to_pylist())
                if len(replies) != batch.num_rows:
                    raise ValueError(f"{batch.num_rows} requests, {len(replies)} replies")
                answers, finish = zip(*replies, strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers), pa.array(finish)], ["run_id", "prompt", "max_new_tokens", "answer", "finish"])

    return requests.select(F.col("run_id").cast("long"), "prompt", F.col("max_new_tokens").cast("int")).mapInArrow(run, schema)


def echo(requests: DataFrame) -> DataFrame:
    """The deterministic stand-in, as an expression."""
    return requests.withColumn("answer", text.echo_answer(F.col("prompt"))).withColumn("finish", F.lit("stop"))


def retry_truncated(answered: DataFrame) -> DataFrame:
    """A second batch of requests for replies that hit their budget: doubled, up to a ceiling, once."""
    longer = F.least(F.col("max_new_tokens") * 2, F.lit(MOST_TOKENS))
    cut = answered.where((F.col("finish") == "length") & (longer > F.col("max_new_tokens")))
    reason = F.format_string("reply was cut off at the %d-token budget; retrying with %d", F.col("max_new_tokens"), longer)
    return cut.select("run_id", "prompt", longer.cast("int").alias("max_new_tokens"), reason.alias("reason"))


def contradiction(answer: Column) -> Column:
    return text.agreement(answer, F.col("changed_area_frac"), F.col("sar_water_fraction"), F.col("optical_water_fraction"))["warning"]


def retry_contradicted(answered: DataFrame, prompts: Column) -> DataFrame:
    """A second batch for answers against the measurement, with the firmer preamble; cut-off replies are not judged."""
    warning = contradiction(F.col("answer"))
    odd = answered.where((F.col("finish") != "length") & warning.isNotNull())
    return odd.select("run_id", prompts.alias("prompt"), "max_new_tokens", F.concat(F.lit("answer conflicts with the measurement ("), warning, F.lit("); asking again")).alias("reason"))


EVIDENCE = {"changed_area_frac": "double", "change_location": "string", "direction": "string", "sar_water_fraction": "double", "sar_builtup_fraction": "double", "sar_water_location": "string", "optical_water_fraction": "double", "optical_builtup_fraction": "double"}


def routed(queries: DataFrame, sets: DataFrame) -> DataFrame:
    """(run_id, query, set_id, config, task, rule, route_confidence); rejected sets go."""
    joined = queries.join(sets.where("config IS NOT NULL").select("set_id", "config"), "set_id")
    r = joined.withColumn("r", text.route(F.col("query"), F.col("config")))
    return r.select("run_id", "query", "set_id", "config", F.col("r.task").alias("task"), F.col("r.rule").alias("rule"), F.col("r.confidence").alias("route_confidence"))


#: What ``measure.measure_sets`` gives besides evidence.
MEASURED = {"gsd_m": "double", "pixels": "int", "coregistered": "boolean", "check_warnings": "array<string>", "change_confidence": "double", "change_confidence_2": "double", "change_threshold_2": "double", "change_reason_2": "string"}


def trace_images(spark: SparkSession, queries: DataFrame, images: DataFrame, rasters: DataFrame, pixels: DataFrame, model: Callable[[DataFrame], DataFrame] = echo, unknown_floor: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(traces, steps) from images alone: sets are inferred, checked and measured, then questions are traced; see ``measure.measure_sets`` and ``trace``."""
    sets = infer_sets(images)
    return trace(spark, queries, sets, cut_lineage(measure_sets(sets, images, rasters, pixels, unknown_floor)), model, unknown_floor)


def trace(spark: SparkSession, queries: DataFrame, sets: DataFrame, measures: DataFrame, model: Callable[[DataFrame], DataFrame] = echo, unknown_floor: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(traces, steps) for queries (run_id, query, set_id), sets (F14) and measures by set_id with columns of EVIDENCE and MEASURED.

    Measures may lack columns: what is missing was not measured, and a change
    mask without a confidence counts as 0.5. A second attempt at a mask is a step
    of its own that revises the first.

    traces: run_id, task, rule, answer, confidence, warning, n_steps, coregistered, check_warnings.
    steps: run_id, step, tool, params, confidence, reason, revises.
    """
    for name, kind in (EVIDENCE | MEASURED).items():
        if name not in measures.columns:
            measures = measures.withColumn(name, F.lit(None).cast(kind))
    # Questions are routed and meet their measures once; answers, retries and all steps read what is kept.
    measured = cut_lineage(routed(queries, sets).join(measures.select("set_id", *EVIDENCE, *MEASURED), "set_id", "left"))
    planned = select_tools(measured, tools_table(spark))
    tokens = text.generation_budget(F.col("task"), F.col("query"))
    distance, size = F.col("gsd_m"), F.col("pixels")
    floor = F.coalesce(scenes.change_floor(distance, size), F.lit(unknown_floor).cast("double"))
    params = (
        F.when(F.col("tool") == "change_mask", F.to_json(F.struct(floor.alias("min_area_frac"))))
        .when(F.col("tool") == "sar_indices", F.to_json(F.struct(scenes.builtup_percentile(distance).alias("builtup_percentile"))))
        .when(F.col("tool").startswith("vlm_"), F.to_json(F.struct(tokens["tokens"].alias("max_new_tokens"))))
        .otherwise("{}")
    )
    reason = (
        F.when(F.col("tool") == "change_mask", scenes.change_floor_reason(distance, size))
        .when(F.col("tool") == "sar_indices", F.when(scenes.builtup_percentile(distance).isNotNull(), F.format_string("built-up tail at p%.0f for %.1f m/px imagery", scenes.builtup_percentile(distance), distance)).otherwise("no ground sample distance available; using tool defaults"))
        .when(F.col("tool").startswith("vlm_"), tokens["reason"])
        .otherwise("")
    )
    values = {k: F.col(k) for k in EVIDENCE}
    body = text.render_prompt(F.col("task"), F.when(F.trim("query") != "", F.col("query")).otherwise("Describe the image."))
    with_preamble = lambda again: F.concat_ws("\n\n", F.nullif(text.evidence_preamble(values, again), F.lit("")), body)
    first = measured.withColumn("prompt", with_preamble(None)).withColumn("max_new_tokens", tokens["tokens"])
    # A model is asked once: both rounds of replies are kept before anything reads them.
    replies = cut_lineage(model(first.select("run_id", "prompt", "max_new_tokens")))
    answered = first.join(replies.select("run_id", "answer", "finish"), "run_id")
    retries = cut_lineage(retry_truncated(answered).unionByName(retry_contradicted(answered, with_preamble(F.lit(True)))))
    second = cut_lineage(model(retries.select("run_id", "prompt", "max_new_tokens"))).select("run_id", F.col("answer").alias("answer_2"))
    second = retries.select("run_id", F.col("reason").alias("reason_2"), F.col("max_new_tokens").alias("tokens_2")).join(second, "run_id")
    final = answered.join(second, "run_id", "left").withColumn("final_answer", F.coalesce("answer_2", "answer"))
    vlm = text.text_confidence
    model_step = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("k"), F.col("answer").alias("a"), F.lit(None).cast("string").alias("why"), F.col("max_new_tokens").cast("int").alias("t")),
            F.when(F.col("answer_2").isNotNull(), F.struct(F.lit(1).alias("k"), F.col("answer_2").alias("a"), F.col("reason_2").alias("why"), F.col("tokens_2").cast("int").alias("t"))),
        )
    )
    model_rows = final.select("run_id", F.explode(model_step).alias("m")).select("run_id", "m.*")
    specialist = F.when(F.col("tool") == "optical_indices", F.when(F.col("optical_water_fraction").isNotNull(), 0.85)).when(F.col("tool") == "sar_indices", F.when(F.col("sar_water_fraction").isNotNull(), 0.8)).when(F.col("tool") == "change_mask", F.when(F.col("changed_area_frac").isNotNull(), F.coalesce("change_confidence", F.lit(0.5))))
    steps = planned.withColumn("params", params).withColumn("reason", reason)
    special = steps.where(~F.col("tool").startswith("vlm_")).select("run_id", "ord", F.lit(0).alias("k"), "tool", "params", specialist.alias("confidence"), "reason")
    second = steps.where("tool = 'change_mask' AND change_threshold_2 IS NOT NULL")
    second = second.select("run_id", "ord", F.lit(1).alias("k"), "tool", F.to_json(F.struct(floor.alias("min_area_frac"), F.col("change_threshold_2").alias("threshold"))).alias("params"), F.col("change_confidence_2").alias("confidence"), F.col("change_reason_2").alias("reason"))
    special = special.unionByName(second)
    models = steps.where(F.col("tool").startswith("vlm_")).select("run_id", "ord", "tool", "reason").join(model_rows, "run_id")
    models = models.select("run_id", "ord", "k", "tool", F.to_json(F.struct(F.col("t").alias("max_new_tokens"))).alias("params"), vlm(F.col("a")).alias("confidence"), F.coalesce("why", "reason").alias("reason"))
    every = special.unionByName(models)
    # A run has a handful of steps; ranks come from an array of its own.
    ranked = every.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", "k", "tool", "params", "confidence", "reason"))).alias("s"))
    numbered = ranked.select("run_id", F.posexplode("s").alias("i", "t")).select("run_id", (F.col("i") + 1).alias("step"), "t.tool", "t.params", "t.confidence", "t.reason", F.when(F.col("t.k") == 1, F.col("i")).alias("revises"))
    verdict = text.agreement(F.col("final_answer"), F.col("changed_area_frac"), F.col("sar_water_fraction"), F.col("optical_water_fraction"))
    blended = blend(every, "run_id", F.count("*").alias("n_steps")).withColumnRenamed("confidence", "mean")
    traces = final.withColumn("v", verdict).join(blended, "run_id")
    traces = traces.select("run_id", "task", "rule", F.col("final_answer").alias("answer"), F.bround(text.bounded(F.col("mean") + F.col("v.adjustment")), 3).alias("confidence"), F.col("v.warning").alias("warning"), "n_steps", "coregistered", "check_warnings")
    return traces, numbered
