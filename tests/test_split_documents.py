"""Documents cut at byte ranges give the records that whole documents give."""

import json
import random

import pytest

from sceneweave.operators import bench
from sceneweave.sources import adapters, documents, tables  # noqa: F401  adapters register themselves


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def some_record(rng, k):
    odd = rng.choice(["plain", "a } brace", 'quote " and \\ and }', "[{]},", "é}ü😀", "\\\\", '\\"}', ""])
    return {"id": k, "text": odd * rng.randint(0, 4), "deep": {"a": [{"b": [1, 2, {"c": "}"}]}, []], "n": None}, "}{": rng.random(), "long": "x}" * rng.choice([0, 0, 0, 900])}


def shapes(rng, n):
    records = [some_record(rng, k) for k in range(n)]
    yield "list", records, ()
    yield "named", {"info": {"a}": [1, {"b": 2}]}, "other": [{"z": 1}], "questions": records, "after": [{"id": -1}] * 40, "end": {"x": {}}}, ("nothing", "questions")
    yield "first", {"info": {"a": {}}, "numbers": list(range(300)), "questions": records, "zz": 1}, ()
    yield "keyed", {f"k}}{k}\"": r for k, r in enumerate(records)}, ()


@pytest.mark.parametrize("indent", [None, 1])
def test_cut_documents_equal_whole_ones(small_splits, tmp_path, indent):
    spark, rng = small_splits, random.Random(7)
    for name, payload, containers in shapes(rng, 60):
        (tmp_path / f"{name}.json").write_text(json.dumps(payload, indent=indent, ensure_ascii=False), encoding="utf-8")
        path = str(tmp_path / f"{name}.json")
        assert documents._pieces(spark, path).rdd.getNumPartitions() > 10
        want = [(r.pos, r._key, json.loads(r.record.toJson())) for r in tables.read_records(spark, path, containers).sort("pos").collect()]
        got = [(r.pos, r._key, json.loads(r.record.toJson())) for r in documents.read_split_records(spark, path, containers).sort("pos").collect()]
        assert len(got) == 60
        if name == "keyed":
            want, got = sorted((k, v["id"]) for _, k, v in want), sorted((k, v["id"]) for _, k, v in got)
        assert got == want


def test_more_splits_than_are_sent_meet_in_a_shuffle(small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "MOST_SENT", 0)
    records = [some_record(random.Random(k), k) for k in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(records))
    got = documents.read_split_records(small_splits, str(tmp_path)).sort("pos").collect()
    assert [json.loads(r.record.toJson()) for r in got] == records


def test_several_files_and_members_that_are_no_objects(small_splits, tmp_path):
    (tmp_path / "b.json").write_text('{"questions": [{"id": 1}, 5, "x}", {"id": 2}]}\n')
    (tmp_path / "a.json").write_text('[{"id": 3}]')
    (tmp_path / "c.json").write_text("[ ]")
    (tmp_path / "d.json").write_text('{"info": 1, "questions": []}')
    (tmp_path / "e.json").write_text("{}")
    (tmp_path / "f.json").write_text('{"x": {"id": 4}}')
    rows = documents.read_split_records(small_splits, str(tmp_path), ("questions",)).sort("pos").collect()
    assert [(r.pos, r._key, json.loads(r.record.toJson())["id"]) for r in rows] == [(0, None, 3), (1, None, 1), (4, None, 2), (5, "x", 4)]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": {"b": 2}', '{"a": 3, "b": 4}', "7"])
def test_other_documents_are_an_error(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(Exception, match="unsupported annotation payload"):
        documents.read_split_records(spark, str(tmp_path / "f.json")).collect()


def test_adapters_read_large_documents(small_splits, tmp_path):
    rows = [{"image_id": f"i{k}", "question": "what}?" * 20, "answer": "a"} for k in range(40)]
    (tmp_path / "a.json").write_text(json.dumps({"data": rows}))
    spec = {"adapter": "vrsbench_vqa", "name": "v", "annotations": str(tmp_path)}
    whole, cut = (bench.load_samples(small_splits, spec | {"large": large}).collect() for large in (False, True))
    assert len(whole) == 40 and sorted(map(str, cut)) == sorted(map(str, whole))


def test_names_and_records_that_cross_batches(spark, tmp_path):
    """A list is found by its name wherever a task's batches end, also within the name."""
    (tmp_path / "a.json").write_text(json.dumps({"other": [{"z": 1}], "a}b": [{"id": k, "s": "}{" * k} for k in range(9)]}))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = documents.read_split_records(spark, str(tmp_path), ("a}b",)).sort("pos").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [json.loads(r.record.toJson()) for r in got] == [{"id": k, "s": "}{" * k} for k in range(9)]
