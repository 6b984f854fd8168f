"""Made benchmark documents stay small however many records there are."""

import json

from sceneweave.plans import q_bench


def test_documents_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(q_bench, "MOST_RECORDS", 100, raising=False)
    frame = spark.range(5000).selectExpr("id AS question_id", "id AS img_id", "'x' AS qtype", "true AS active")
    for kind in ("list", "keyed"):
        docs = [json.loads(r.value) for r in spark.read.text(q_bench._json_folder(spark, frame, kind), wholetext=True).collect()]
        sizes = [len(d.get("questions", d)) for d in docs]
        assert sum(sizes) == 5000 and max(sizes) < 200
