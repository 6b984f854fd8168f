"""Scores over whole tables of predictions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneweave.functions import boxes, text
from sceneweave.operators.cluster import cut_lineage, join_skewed


def mark_answers(frame: DataFrame, prediction: str = "raw_text", gold: str = "gold") -> DataFrame:
    """``frame`` with normalised texts (norm_pred, norm_gold) and hit (0 or 1)."""
    frame = frame.withColumn("norm_pred", text.normalize_answer(F.col(prediction))).withColumn("norm_gold", text.normalize_answer(F.col(gold)))
    return frame.withColumn("hit", F.coalesce(text.answers_match(F.col("norm_pred"), F.col("norm_gold")), F.lit(False)).cast("int"))


def type_accuracy(marked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, qtype, n, accuracy): one row per question type, and one of null qtype for all rows."""
    by = by or []
    rows = marked.select(*by, F.nullif(F.col("qtype"), F.lit("")).alias("qtype"), "hit")
    # Types alone are small: totals come from the same partial sums.
    typed = rows.groupBy(*by, "qtype").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    total = typed.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).withColumn("qtype", F.lit(None).cast("string"))
    both = typed.where("qtype IS NOT NULL").unionByName(total)
    return both.select(*by, "qtype", "n", (F.col("hits") / F.col("n")).alias("accuracy"))


def vqa_metrics(marked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, oa, aa, n): overall accuracy, and the plain mean over question types.

    Rows without a type count in oa alone; without any types aa is oa.
    """
    by = by or []
    typed = type_accuracy(marked, by)
    overall = F.max(F.when(F.col("qtype").isNull(), F.col("accuracy")))
    return typed.groupBy(*by).agg(
        overall.alias("oa"),
        F.coalesce(F.avg(F.when(F.col("qtype").isNotNull(), F.col("accuracy"))), overall).alias("aa"),
        F.max(F.when(F.col("qtype").isNull(), F.col("n"))).alias("n"),
    )


def grounding_metrics(frame: DataFrame, predicted: str = "predicted", gold: str = "box", thresholds: tuple[float, ...] = (0.25, 0.5), by: list[str] | None = None) -> DataFrame:
    """(by, miou, acc@t.., parse_rate, n). A missing box is an overlap of 0 and stays in the count."""
    scored = frame.withColumn("iou", boxes.iou(F.col(predicted), F.col(gold)))
    at = [F.avg((F.col("iou") >= t).cast("int")).alias(f"acc@{t:g}") for t in thresholds]
    return scored.groupBy(*(by or [])).agg(F.avg("iou").alias("miou"), *at, (F.count(predicted) / F.count("*")).alias("parse_rate"), F.count("*").alias("n"))


#: Tokens of a task that takes captions apart: some four times as many grams, a few dozen MB.
TOKENS = 200_000


def dealt(captions: DataFrame, tokens: Column, keys: tuple[str, ...] = ("sample_id", "part", "ref")) -> DataFrame:
    """``captions`` in as many partitions as their ``tokens`` (their number) need.

    What comes out of a caption is many times its size. Adaptive execution sees
    captions alone, and would put those of a whole join into one task or two.
    """
    total = captions.agg(F.sum(tokens)).head()[0] or 0
    return captions.repartition(max(1, -(-total // TOKENS)), *keys)


def caption_grams(captions: DataFrame) -> DataFrame:
    """(sample_id, part, ref, n, gram, count) from (sample_id, part, ref, tokens) for n = 1..4.

    Captions are dealt by their own keys, so grams are counted where they are made.
    """
    return count_grams(dealt(captions, F.size("tokens")))


def count_grams(captions: DataFrame) -> DataFrame:
    def numbered(n: int) -> Column:
        return F.transform(text.ngrams(F.col("tokens"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    rows = captions.select("sample_id", "part", "ref", F.explode(F.concat(*map(numbered, (1, 2, 3, 4)))).alias("g"))
    return rows.select("sample_id", "part", "ref", "g.n", "g.gram").groupBy("sample_id", "part", "ref", "n", "gram").count()


def by_sample(captions: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``combine``, an aggregate by sample, of the ``caption_grams`` of ``captions``.

    All captions of a sample are dealt to one task, so grams are combined where
    they are made and none is shuffled: no task grows with the input. Samples
    that alone have more than ``TOKENS`` tokens are dealt by caption, and their
    counts shuffled.
    """
    length = F.size("tokens")
    tokens = captions.groupBy("sample_id").agg(F.sum(length).alias("n"))
    large = F.col("n") > TOKENS
    # At most one sample in so many tokens is large.
    total, named = tokens.agg(F.sum(F.when(~large, F.col("n"))), F.collect_list(F.when(large, F.col("sample_id")))).head()
    crowded = F.col("sample_id").isin(named)
    rest = captions.where(F.col("sample_id").isNull() | ~crowded) if named else captions
    out = combine(count_grams(rest.repartition(max(1, -(-(total or 0) // TOKENS)), "sample_id")))
    return out.unionByName(combine(caption_grams(captions.where(crowded)))) if named else out


def gram_table(grams: DataFrame) -> DataFrame:
    """(sample_id, n, gram, c, most, refs) of ``caption_grams``: a candidate's count, the largest of its references', and each reference's.

    Candidate and references meet in one aggregate, so that no score joins the grams with themselves.
    """
    reference = F.col("part") == "reference"
    return grams.groupBy("sample_id", "n", "gram").agg(
        F.coalesce(F.sum(F.when(~reference, F.col("count"))), F.lit(0)).alias("c"),
        F.coalesce(F.max(F.when(reference, F.col("count"))), F.lit(0)).alias("most"),
        F.collect_list(F.when(reference, F.struct("ref", "count"))).alias("refs"),
    )


def tokenized(captions: DataFrame) -> DataFrame:
    """(sample_id, part, ref, tokens) from (sample_id, part, ref, text); part is candidate or reference."""
    return captions.select("sample_id", "part", "ref", text.caption_tokens(F.col("text")).alias("tokens"))


def bleu(captions: DataFrame) -> DataFrame:
    """One row bleu1..bleu4 over the corpus: clipped counts against the best reference, brevity from the closest length."""
    tokens = tokenized(captions)
    sums = by_sample(tokens, gram_table).groupBy("n").agg(F.sum(F.least("c", "most")).alias("clipped"), F.sum("c").alias("total"))
    lengths = tokens.withColumn("length", F.size("tokens"))
    candidate = lengths.where("part = 'candidate'").select("sample_id", F.col("length").alias("c"))
    pairs = candidate.join(lengths.where("part = 'reference'").select("sample_id", F.col("length").alias("r")), "sample_id", "left")
    closest = pairs.groupBy("sample_id").agg(F.max("c").alias("c"), F.coalesce(F.min_by("r", F.struct(F.abs(F.col("r") - F.col("c")), "r")), F.lit(0)).alias("r"))
    total = closest.agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    brevity = F.when(F.coalesce("c", F.lit(0)) == 0, 0.0).when(F.col("c") < F.col("r"), F.exp(1 - F.col("r") / F.col("c"))).otherwise(1.0)
    by_n = {n: F.coalesce(F.max(F.when(F.col("n") == n, F.try_divide(F.col("clipped"), F.col("total")))), F.lit(0.0)) for n in (1, 2, 3, 4)}
    precision = sums.agg(*[by_n[n].alias(f"p{n}") for n in by_n])
    out = []
    for n in (1, 2, 3, 4):
        product = reduce(lambda a, b: a * b, [F.col(f"p{k}") for k in range(1, n + 1)])
        logs = reduce(lambda a, b: a + b, [F.ln(f"p{k}") for k in range(1, n + 1)])
        out.append(F.when(product > 0, brevity * F.exp(logs / n)).otherwise(0.0).alias(f"bleu{n}"))
    return precision.crossJoin(F.broadcast(total)).select(*out)  # one row each


def rouge_l(captions: DataFrame, beta: float = 1.2) -> DataFrame:
    """One row rouge_l: mean over candidates of the best reference's F-measure; 0 without references."""
    tokens = tokenized(captions)
    candidate = tokens.where("part = 'candidate'").select("sample_id", F.col("tokens").alias("a"))
    reference = tokens.where("part = 'reference'").select("sample_id", "ref", F.col("tokens").alias("b"))
    pairs = dealt(candidate.join(reference, "sample_id", "left"), F.size("a") + F.coalesce(F.size("b"), F.lit(0)), ("sample_id", "ref")).withColumn("lcs", F.coalesce(text.lcs_length(F.col("a"), F.col("b")), F.lit(0)))
    p, r = F.try_divide(F.col("lcs"), F.size("a")), F.try_divide(F.col("lcs"), F.size("b"))
    score = F.when(F.col("lcs") > 0, (1 + beta**2) * p * r / (r + beta**2 * p)).otherwise(0.0)
    return pairs.groupBy("sample_id").agg(F.max(score).alias("best")).agg(F.avg("best").alias("rouge_l"))


def cider_d(captions: DataFrame, sigma: float = 6.0) -> DataFrame:
    """One row cider_d over the corpus.

    Document frequencies come from all reference sets. Candidates without
    references add nothing but count in the number of samples. Grams are
    counted once and kept; a gram of very many samples gets its frequency by
    broadcast, the others by shuffle.
    """
    tokens = tokenized(captions)
    samples = tokens.where("part = 'candidate'").select("sample_id")
    grams = cut_lineage(gram_table(caption_grams(tokens.join(samples, "sample_id", "left_semi"))))
    df = cut_lineage(grams.groupBy("n", "gram").agg(F.count_if(F.col("most") > 0).alias("df"), F.count("*").alias("rows")))
    total = samples.agg(F.count("*").alias("samples"))
    idf = F.ln("samples") - F.ln(F.greatest("df", F.lit(1)))
    weighted = join_skewed(grams, df, ["n", "gram"], "rows", grams.count()).crossJoin(F.broadcast(total)).withColumn("idf", idf)  # one row
    # A row of its own, without reference, carries the candidate's own norm.
    own = F.array(F.struct(F.lit(None).cast(tokens.schema["ref"].dataType).alias("ref"), F.lit(0).cast("long").alias("count")))
    spread = weighted.select("sample_id", "n", (F.col("c") * F.col("idf")).alias("cw"), "idf", F.explode(F.concat(own, "refs")).alias("r"))
    rw = F.col("r.count") * F.col("idf")
    sums = spread.groupBy("sample_id", "n", F.col("r.ref").alias("ref")).agg(F.sum(F.when(F.col("cw") > 0, F.least(F.col("cw"), rw) * rw).otherwise(0.0)).alias("dot"), F.sqrt(F.sum(rw * rw)).alias("rn"), F.sqrt(F.sum(F.col("cw") * F.col("cw"))).alias("norm"))
    sums = sums.withColumn("cn", F.max(F.when(F.col("ref").isNull(), F.col("norm"))).over(Window.partitionBy("sample_id", "n"))).where("ref IS NOT NULL")
    lengths = tokens.withColumn("length", F.size("tokens"))
    pair = lengths.where("part = 'reference'").select("sample_id", "ref", F.col("length").alias("rl")).join(lengths.where("part = 'candidate'").select("sample_id", F.col("length").alias("cl")), "sample_id")
    value = sums.join(pair, ["sample_id", "ref"])
    scaled = F.when((F.col("cn") > 0) & (F.col("rn") > 0), F.col("dot") / (F.col("cn") * F.col("rn"))).otherwise(F.col("dot"))
    penalty = F.exp(-((F.col("cl") - F.col("rl")) * (F.col("cl") - F.col("rl"))) / (2 * sigma**2))
    refs = pair.groupBy("sample_id").agg(F.count("*").alias("refs"))
    per_sample = value.groupBy("sample_id").agg(F.sum(scaled * penalty).alias("s")).join(refs, "sample_id").withColumn("score", 10.0 * F.col("s") / (4 * F.col("refs")))
    return per_sample.agg(F.sum("score").alias("s")).crossJoin(F.broadcast(total)).select(F.coalesce(F.try_divide(F.col("s"), F.col("samples")), F.lit(0.0)).alias("cider_d"))


def long_metrics(wide: DataFrame, metrics: list[str], task: str, by: list[str] | None = None) -> DataFrame:
    """(by, task, metric, value) from a table with one column per metric."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics])).alias("m")
    return wide.select(*(by or []), F.lit(task).alias("task"), pairs).select(*(by or []), "task", "m.metric", "m.value")


def score(vqa: DataFrame | None = None, boxed: DataFrame | None = None, captions: DataFrame | None = None) -> DataFrame:
    """All metrics of the tables given, as one long table (task, metric, value)."""
    out = []
    if vqa is not None:
        out.append(long_metrics(vqa_metrics(mark_answers(vqa)), ["oa", "aa", "n"], "vqa"))
    if boxed is not None:
        out.append(long_metrics(grounding_metrics(boxed), ["miou", "acc@0.25", "acc@0.5", "parse_rate", "n"], "grounding"))
    if captions is not None:
        out += [long_metrics(bleu(captions), ["bleu1", "bleu2", "bleu3", "bleu4"], "caption"), long_metrics(rouge_l(captions), ["rouge_l"], "caption"), long_metrics(cider_d(captions), ["cider_d"], "caption")]
    return reduce(DataFrame.unionByName, out)


def defect_rates(predictions: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(by, one rate per flag, n): the share of rows for which a flag holds; null flags count as false."""
    rates = [F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in flags.items()]
    return predictions.groupBy(*(by or [])).agg(*rates, F.count("*").alias("n"))


def multilabel_metrics(scores: DataFrame, threshold: float = 0.5, ranges: int = 4096) -> DataFrame:
    """One row (micro_f1, macro_f1, mean_ap) from (sample_id, label, score, truth).

    Average precision of a label is the mean of the precision at each true row,
    in order of score, then sample_id. Labels are few, rows are many: each
    label's scores are cut into equal ``ranges`` between the least and the
    greatest score. Counts per range add up to what lies above it, and only
    the rows of a range are ranked together.
    """
    hit = (F.col("score") >= threshold).cast("int")
    counts = scores.groupBy("label").agg(F.sum(hit * F.col("truth")).alias("tp"), F.sum(hit * (1 - F.col("truth"))).alias("fp"), F.sum((1 - hit) * F.col("truth")).alias("fn"))
    f1 = lambda tp, fp, fn: F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    sums = counts.agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))
    limits = scores.agg(F.min("score").alias("least"), F.max("score").alias("greatest"))  # one row
    width = F.nullif(F.col("greatest") - F.col("least"), F.lit(0.0))
    cut = scores.crossJoin(F.broadcast(limits)).withColumn("range", F.coalesce(F.floor((F.col("greatest") - F.col("score")) / width * ranges), F.lit(0)).cast("int")).drop("least", "greatest")
    above = Window.partitionBy("label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    steps = cut.groupBy("label", "range").agg(F.count("*").alias("n"), F.sum("truth").alias("t"))
    steps = steps.select("label", "range", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"))
    order = Window.partitionBy("label", "range").orderBy(F.col("score").desc(), "sample_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.withColumn("t", F.sum("truth").over(order)).withColumn("n", F.count("*").over(order)).where("truth = 1").join(steps, ["label", "range"])
    ap = ranked.groupBy("label").agg(F.avg((F.col("t") + F.col("t_above")) / (F.col("n") + F.col("n_above"))).alias("ap"))
    return sums.crossJoin(F.broadcast(ap.agg(F.avg("ap").alias("mean_ap"))))  # one row each
