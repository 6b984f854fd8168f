"""Records of many documents are resolved where they are read."""

import json

from sceneweave.sources.tables import read_records, resolve_fields


def test_records_are_not_shuffled_to_be_numbered(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"part-{k:02}.json").write_text(json.dumps([{"id": 5 * k + i} for i in range(5)]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the documents were large
    try:
        rows = resolve_fields(read_records(spark, str(tmp_path)), {"id": ["id"]}, ["id"])
        assert "hashpartitioning(file" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["pos"], r["id"]) for r in rows.collect()) == [(k, str(k)) for k in range(60)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
