"""The operators' queries against their SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from sceneweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr([dict(zip(names, r, strict=True))[c] for c in sorted(names)]) for r in cursor.fetchall())
    frame = queries.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(repr([r[c] for c in sorted(names)]) for r in frame.collect()) == want


def test_licence_sql_finds_texts_and_words_in_a_row(spark):
    """The SQL of the licence scan over documents that hold whole licences and equivalent words side by side."""
    from sceneweave.llm import licences

    texts = [licences.MIT.upper(), "owner owner licence licence", "holder holder license license", None, "", "LICENCE,licence;Owner", "x\nReleased under the MIT Licence!\n", *(t for _, t in licences.long_texts())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    want = db.execute(queries.oracle_sql()["op4_license_scan"]).fetchall()
    got = licences.scan(docs, licences.known_licences(spark)).select("doc_id", "text_digest", "license_id", "n_notices", "notice_ids").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].license_id == "MIT" and by_id[1].text_digest == by_id[2].text_digest and by_id[6].notice_ids == "MIT"
    assert all(by_id[7 + i].license_id == name for i, (name, _) in enumerate(licences.long_texts()))
