"""Token counts over nulls, copies, repeated rows and an empty table, against the query's SQL."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from sceneweave.llm import queries, rollup

ROWS = [(1, None, "a", "en"), (2, "", "a", "en"), (3, "one two", "b", None), (3, "one two", "b", None), (4, "one two", None, "de"), (None, "one two", "b", "en"), (None, None, "c", "en"), (5, "alone, here!", "a", "en")]


def both(spark, rows, folder):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    frame.write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cursor = db.execute(queries.oracle_sql()["op10_token_counts"])
    names = [d[0] for d in cursor.description]
    return sorted(repr([r[c] for c in names]) for r in queries.op10_token_counts(spark, folder).collect()), sorted(repr(list(r)) for r in cursor.fetchall())


def test_nulls_copies_and_repeated_rows(spark, tmp_path):
    got, want = both(spark, ROWS, str(tmp_path))
    assert got == want
    assert "['a', 'en', 'words-1', 2, 2]" in got and "['b', None, 'words-1', 2, 4]" in got and "['c', 'en', 'words-1', 1, 0]" in got


def test_empty_table(spark, tmp_path):
    got, want = both(spark, ROWS[:0], str(tmp_path))
    assert got == want == []


def one(spark, tokens):
    return rollup.inserts(spark.createDataFrame([("a", "en", "v", tokens), ("a", "en", "v", None)], "source string, lang string, tokenizer_version string, tokens long"))


def sums(totals):
    return [(r.n_docs, r.n_tokens) for r in totals.totals().collect()]


def test_snapshots_keep_what_is_read_small(spark, tmp_path):
    totals = rollup.TokenRollup(spark, str(tmp_path), every=3)
    for k in range(11):
        assert totals.apply(f"b{k}", one(spark, 1 << k))
        assert sums(totals) == [(2 * (k + 1), (2 << k) - 1)]
        assert len(totals.committed()) <= 6 and len(os.listdir(tmp_path / "deltas")) <= 6
    assert len(os.listdir(tmp_path / "snapshots")) <= 2
    for k in range(11):
        assert not totals.apply(f"b{k}", one(spark, 1)) and totals.counted(f"b{k}")
    assert sums(totals) == [(22, (1 << 11) - 1)]


@pytest.mark.parametrize("broken_at", ["start", "commit", "cleaning"])
def test_a_fold_that_broke_off_counts_nothing_twice(spark, tmp_path, monkeypatch, broken_at):
    totals = rollup.TokenRollup(spark, str(tmp_path), every=100)
    for k in range(3):
        totals.apply(f"b{k}", one(spark, 1 << k))
    assert totals.fold()
    for k in range(3, 5):
        totals.apply(f"b{k}", one(spark, 1 << k))
    if broken_at == "cleaning":
        # All but moving marks and deleting deltas, as if the driver had died right after the commit.
        shutil.copytree(tmp_path / "commits", tmp_path / "kept-commits")
        shutil.copytree(tmp_path / "deltas", tmp_path / "kept-deltas")
        assert totals.fold()
        for kind in ("commits", "deltas"):
            shutil.rmtree(tmp_path / kind)
            os.rename(tmp_path / f"kept-{kind}", tmp_path / kind)
        shutil.rmtree(tmp_path / "folded")
    else:
        def fail(*_):
            raise RuntimeError("lost")

        with monkeypatch.context() as patched:
            patched.setattr(totals, "_commit" if broken_at == "commit" else "_folder", fail)
            with pytest.raises(RuntimeError):
                totals.fold()
    assert sums(totals) == [(10, 31)]
    totals.apply("b5", one(spark, 32))
    assert totals.fold() and not totals.fold()
    totals.apply("b6", one(spark, 64))
    assert totals.fold()
    assert sums(totals) == [(14, 127)] and not any(totals.apply(f"b{k}", one(spark, 9)) for k in range(7))
    assert totals.totals().where(F.col("n_tokens") < 0).isEmpty()
