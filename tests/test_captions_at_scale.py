"""Captions that a join has put into one partition are taken apart in as many tasks as their tokens need."""

import pytest
from pyspark.sql import functions as F

from sceneweave.operators import metrics
from sceneweave.plans import q_metrics


@pytest.fixture(scope="module")
def captions(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: (i * (F.col("id") + 1) % 97).cast("string")), " ")
    part = F.when(F.col("id") % 2 == 0, "candidate").otherwise("reference")
    return spark.range(6000).select(F.floor(F.col("id") / 2).cast("long").alias("sample_id"), part.alias("part"), F.col("id").cast("int").alias("ref"), text.alias("text")).repartition(1, "sample_id")


def test_grams(captions):
    grams = metrics.caption_grams(metrics.tokenized(captions))
    assert grams.rdd.getNumPartitions() == 6000 * 100 // metrics.TOKENS
    assert {r["n"]: r["c"] for r in grams.groupBy("n").agg(F.sum("count").alias("c")).collect()} == {n: 6000 * (101 - n) for n in (1, 2, 3, 4)}


def test_subsequences(captions):
    """Each pair is compared by a task with its share of the tokens, not by the one that joined them."""
    plan = metrics.rouge_l(captions)._jdf.queryExecution().optimizedPlan().toString()
    # 3,000 pairs of 200 tokens.
    assert "RepartitionByExpression [sample_id" in plan and f", {6000 * 100 // metrics.TOKENS}" in plan


def test_scores_count_grams_of_dealt_captions(captions):
    plan = metrics.bleu(captions)._jdf.queryExecution().optimizedPlan().toString()
    assert f", {6000 * 100 // metrics.TOKENS}" in plan and "RepartitionByExpression [sample_id" in plan


def test_reference_grams(spark, captions, monkeypatch):
    """h3_reference_ngrams takes captions apart in as many tasks as their tokens need."""
    monkeypatch.setattr(q_metrics, "view", lambda *_: captions)
    plan = q_metrics.h3_reference_ngrams(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    # References alone, half of the captions, may be what is dealt.
    assert "RepartitionByExpression [sample_id" in plan and any(f", {n * 100 // metrics.TOKENS}" in plan for n in (6000, 3000))


def test_consensus_counts_grams_of_dealt_captions(captions, monkeypatch):
    """cider_d keeps its grams, so its plan no longer tells how captions were dealt; what it counts does."""
    counted = []
    grams = metrics.caption_grams
    monkeypatch.setattr(metrics, "caption_grams", lambda tokens: counted.append(grams(tokens)) or counted[-1])
    assert metrics.cider_d(captions).head()["cider_d"] >= 0
    assert [g.rdd.getNumPartitions() for g in counted] == [6000 * 100 // metrics.TOKENS]


def _shuffles_grams(frame):
    return any("gram#" in line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)


def test_scores_meet_grams_of_a_sample_without_a_shuffle(captions):
    """Otherwise the tasks that meet a sample's grams grow with the input, whose shuffle partitions do not."""
    assert not _shuffles_grams(metrics.bleu(captions))


def test_reference_grams_are_counted_without_a_shuffle(spark, captions, monkeypatch):
    monkeypatch.setattr(q_metrics, "view", lambda *_: captions)
    assert not _shuffles_grams(q_metrics.h3_reference_ngrams(spark, ""))


def test_a_large_sample_is_dealt_by_caption(spark, captions, monkeypatch):
    """Scores are the same whether samples fit a task or all, some or none do."""
    monkeypatch.setattr(q_metrics, "view", lambda *_: captions.where("sample_id < 40").unionByName(captions.where("sample_id < 9 AND part = 'reference'").withColumn("ref", F.col("ref") + 1_000_000)))

    def results():
        return sorted(map(tuple, q_metrics.h3_reference_ngrams(spark, "").collect())), tuple(q_metrics.f3_bleu(spark, "").head())

    want = results()
    for tokens in (150, 250):
        monkeypatch.setattr(metrics, "TOKENS", tokens)
        assert results() == want
