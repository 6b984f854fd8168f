"""Views of the given tables in the shape of each operator family's input, for Spark and as SQL for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PIXELS = """SELECT CAST(floor(vec_id / 4.0) AS BIGINT) AS scene_id, CAST(vec_id % 4 + 1 AS INT) AS band,
       CAST(floor(pos / 8.0) AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(e AS DOUBLE) + 1.0 AS v FROM (<pixels>)"""
PAIRS = """SELECT CAST(floor(vec_id / 2.0) AS BIGINT) AS pair_id, CASE WHEN vec_id % 2 = 0 THEN 'before' ELSE 'after' END AS role,
       CAST(floor(pos / 8.0) AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(e AS DOUBLE) + 1.0 AS v FROM (<pixels>)"""
#: How each engine takes vectors apart.
TAKE_APART = {
    "spark": "SELECT vec_id, pos, e FROM @embeddings LATERAL VIEW posexplode(embedding) t AS pos, e",
    "duckdb": "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS e FROM @embeddings",
}
VIEWS = {
    "pixels": PIXELS,
    "pairs": PAIRS,
    "sar": f"SELECT scene_id, 1 AS band, y, x, v*v*v*v*v*v*v*v*v*v*v*v AS v FROM ({PIXELS}) p WHERE band = 1",
    "vqa": """SELECT l.doc_id AS sample_id, CASE WHEN d.lang = 'en' AND l.doc_id % 5 = 0 THEN NULL ELSE d.lang END AS qtype,
       CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS gold,
       CASE l.doc_id % 6 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'No, there is not.' WHEN 2 THEN 'The residential area'
                         WHEN 3 THEN '  YEP  ' WHEN 4 THEN 'three' ELSE 'It is yes' END AS raw_text
FROM @labels l JOIN @documents d ON d.doc_id = l.doc_id""",
    "boxes": """SELECT vec_id AS sample_id, gx1, gy1, gx1 + w AS gx2, gy1 + h AS gy2,
       CASE vec_id % 7
         WHEN 0 THEN concat('<|box_start|>(', px1, ',', py1, '),(', px2, ',', py2, ')<|box_end|>')
         WHEN 1 THEN concat('{<', px1, '><', py1, '><', px2, '><', py2, '>}')
         WHEN 2 THEN concat('{"bbox_2d": [', px1, ', ', py1, ', ', px2, ', ', py2, ']}')
         WHEN 3 THEN concat('The region is at [', px1, ', ', py1, ', ', px2, ', ', py2, '].')
         WHEN 4 THEN concat('(', px1, ',', py1, '),(', px2, ',', py2, ')')
         WHEN 5 THEN 'no box here'
         ELSE concat('[', px2, ', ', py2, ', ', px1, ', ', py1, ']') END AS raw_text
FROM (SELECT vec_id, gx1, gy1, w, h, gx1 + vec_id % 50 AS px1, gy1 + vec_id % 30 AS py1, gx1 + w + vec_id % 20 AS px2, gy1 + h AS py2
      FROM (SELECT vec_id, vec_id * 37 % 600 AS gx1, vec_id * 53 % 600 AS gy1, 100 + vec_id * 17 % 300 AS w, 100 + vec_id * 29 % 300 AS h FROM @embeddings) a) b""",
    "captions": """SELECT c.conv_id AS sample_id, c.turn AS ref, c.text, CASE WHEN c.turn = m.last_turn THEN 'candidate' ELSE 'reference' END AS part
FROM @conversations c JOIN (SELECT conv_id, max(turn) AS last_turn FROM @conversations WHERE role = 'assistant' GROUP BY conv_id) m ON m.conv_id = c.conv_id
WHERE c.role = 'assistant'""",
    "questions": """SELECT o_orderkey AS question_id, o_custkey AS img_id, o_orderpriority AS qtype,
       CASE WHEN o_orderstatus = 'P' THEN FALSE WHEN o_orderstatus = 'F' THEN NULL ELSE TRUE END AS active FROM @orders""",
    "answers": """SELECT l_orderkey AS question_id, CAST(l_quantity AS INT) AS answer,
       CASE WHEN l_returnflag = 'R' THEN FALSE WHEN l_returnflag = 'A' THEN NULL ELSE TRUE END AS active,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos FROM @lineitem""",
    "scenes": """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'sentinel-1-rtc' ELSE 'sentinel-2-l2a' END AS collection,
       ts AS datetime, CASE WHEN event_id % 3 = 0 OR event_id % 17 = 0 THEN NULL ELSE value % 100 END AS cloud_cover,
       user_id % 5 AS area_id, CAST(70 + (user_id % 50) / 10.0 AS DOUBLE) AS x1, CAST(10 + (user_id % 30) / 10.0 AS DOUBLE) AS y1,
       CAST(70.2 + (user_id % 50) / 10.0 AS DOUBLE) AS x2, CAST(10.2 + (user_id % 30) / 10.0 AS DOUBLE) AS y2 FROM @events""",
    "results": """SELECT o_orderkey AS seq, o_orderdate AS ts, 'echo' AS backend, o_orderstatus AS model, o_orderpriority AS benchmark,
       CASE WHEN o_orderkey % 3 = 0 THEN 'grounding' WHEN o_orderkey % 3 = 1 THEN 'vqa' ELSE 'caption' END AS task,
       CASE o_orderkey % 5 WHEN 0 THEN 'oa' WHEN 1 THEN 'acc@0.5' WHEN 2 THEN 'cider_d' WHEN 3 THEN 'aa' ELSE 'n' END AS metric,
       CAST(o_totalprice AS DOUBLE) / 1000000 AS value FROM @orders""",
    "annotations": """SELECT doc_id AS id, concat('P', doc_id % 400) AS patch_id, doc_id AS pos, concat('S1-', doc_id % 700) AS s1_name,
       CASE doc_id % 4 WHEN 0 THEN 'binary' WHEN 1 THEN 'mcq' WHEN 2 THEN 'bounding box' ELSE 'captioning' END AS type,
       CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 9 = 0 THEN 'Country' WHEN doc_id % 9 = 1 THEN 'season'
            WHEN doc_id % 9 = 2 THEN 'climate zone' WHEN doc_id % 9 < 6 THEN 'presence' ELSE 'area' END AS category,
       CASE WHEN doc_id % 23 = 0 THEN NULL ELSE source END AS country, lang AS season,
       CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split,
       'Box at <point>(0.82, 0.28)</point> of the <ref>largest field</ref>.' AS input,
       CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'c'
            WHEN 2 THEN CASE WHEN doc_id % 11 = 0 THEN 'north-east' ELSE concat('[0.', doc_id % 9, ' 0.9, 0.95 0.', doc_id % 7, ']') END
            ELSE concat('This satellite image, captured in ', source, ' during ', lang, ', depicts fields within the "cold, dry" climate zone. ',
                        CASE WHEN doc_id % 13 = 0 THEN source ELSE 'Arable land' END, ' is prominent.') END AS output FROM @documents""",
    "turns": """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'gpt' ELSE 'human' END AS speaker,
       CASE WHEN role = 'user' THEN concat('Image 1: <image>', chr(10), 'Image 2: <image>', chr(10), text) ELSE text END AS value FROM @conversations""",
    "run_events": """SELECT user_id AS run_id, event_id AS seq, ts,
       CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'start' ELSE 'step' END AS type FROM @events""",
    "patches": """SELECT DISTINCT concat('P', doc_id % 400) AS patch_id, doc_id % 400 % 7 = 0 AS contains_seasonal_snow,
       CASE WHEN doc_id % 400 % 11 = 0 THEN TRUE WHEN doc_id % 400 % 11 = 1 THEN NULL ELSE FALSE END AS contains_cloud_or_shadow FROM @documents""",
    "rasters": """SELECT p_partkey AS id, concat('tile_', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '_VV' WHEN 1 THEN '_msi' ELSE '' END, '.tif') AS name,
       CAST(p_size * 10 AS INT) AS width, CAST(120 AS INT) AS height, CAST(CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 12 ELSE 2 END AS INT) AS band_count,
       CASE WHEN p_partkey % 2 = 0 THEN 'float32' ELSE 'uint16' END AS dtype,
       CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 6 < 2 THEN 'EPSG:4326' ELSE 'EPSG:32643' END AS crs,
       floor(p_partkey % 1000 / 2.0) * 0.9 + p_partkey % 2 * 0.05 AS bx1, CAST(floor(p_partkey / 1000.0) % 100 AS DOUBLE) * 0.8 AS by1,
       floor(p_partkey % 1000 / 2.0) * 0.9 + p_partkey % 2 * 0.05 + 2.0 AS bx2, CAST(floor(p_partkey / 1000.0) % 100 AS DOUBLE) * 0.8 + 1.5 AS by2,
       CAST(CASE WHEN p_partkey % 6 < 2 THEN 0.0001 ELSE 10.0 + p_partkey % 3 * 0.4 END AS DOUBLE) AS pixel_x FROM @part""",
    "queries": """SELECT doc_id AS run_id, doc_id AS set_id, CASE doc_id % 8 WHEN 0 THEN 'Highlight the river' WHEN 1 THEN 'Describe this scene'
         WHEN 2 THEN 'How many ships are there?' WHEN 3 THEN 'What changed between the dates?' WHEN 4 THEN 'Has built-up increased?'
         WHEN 5 THEN '' WHEN 6 THEN 'Nice picture' ELSE 'Is there water?' END AS query FROM @documents""",
    "images": """SELECT doc_id AS set_id, 0 AS position, CASE WHEN doc_id % 3 = 0 THEN 'rgb' ELSE 'optical' END AS modality FROM @documents
UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 5 = 0 THEN 'sar' ELSE 'optical' END FROM @documents WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, 2, 'optical' FROM @documents WHERE doc_id % 35 = 1""",
    "measures": """SELECT doc_id AS set_id, CAST(n_chars % 100 AS DOUBLE) / 400 AS changed_area_frac, 'brightened' AS direction,
       CASE WHEN doc_id % 5 = 0 THEN CAST(n_chars % 37 AS DOUBLE) / 100 END AS sar_water_fraction,
       CASE WHEN doc_id % 5 = 0 THEN CAST(n_chars % 29 AS DOUBLE) / 100 END AS optical_water_fraction FROM @documents""",
    "label_scores": """SELECT doc_id AS sample_id, lang AS label, CAST(n_chars * 7919 % 1000 AS DOUBLE) / 1000 AS score, CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END AS truth FROM @documents""",
    "predictions": """SELECT doc_id AS sample_id, source AS model, CASE WHEN n_chars % 10 = 0 THEN 'length' ELSE 'stop' END AS finish,
       CASE WHEN n_chars % 4 = 0 THEN NULL ELSE lang END AS answer FROM @documents""",
}
#: Scenes as pairs of sets see them: four bands from four vectors, and radar with one band under ids of its own.
RADAR = 1_000_000
VIEWS |= {
    "set_images": f"""SELECT i.set_id, i.position, i.modality, (i.set_id * 3 + i.position * (1 + i.set_id % 4)) % n.k + CASE WHEN i.modality = 'sar' THEN {RADAR} ELSE 0 END AS scene_id
FROM ({VIEWS["images"]}) i CROSS JOIN (SELECT CAST(floor(max(vec_id) / 4.0) AS BIGINT) AS k FROM @embeddings) n""",
    "scene_rasters": f"""SELECT id + o AS id, CAST(8 AS INT) AS width, CAST(8 AS INT) AS height, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 7 = 0 THEN 'EPSG:32644' ELSE 'EPSG:32643' END AS crs,
       id % 3 * 0.05 AS bx1, 0.0 AS by1, id % 3 * 0.05 + 1.0 AS bx2, 1.0 AS by2, CAST(CASE id % 4 WHEN 0 THEN 30 WHEN 1 THEN 100 WHEN 2 THEN 5 END AS DOUBLE) AS gsd_m
FROM (SELECT CAST(floor(vec_id / 4.0) AS BIGINT) AS id FROM @embeddings WHERE vec_id % 4 = 0) r CROSS JOIN (SELECT 0 AS o UNION ALL SELECT {RADAR}) b""",
    "scene_pixels": f"""SELECT scene_id, band, y, x, v FROM ({VIEWS["pixels"]}) p UNION ALL SELECT scene_id + {RADAR}, band, y, x, v FROM ({VIEWS["sar"]}) q""",
}
TABLE = re.compile(r"@([a-z]\w*)")


def view_sql(name: str, engine: str = "duckdb") -> str:
    """A view as SQL; DuckDB has the tables under their names."""
    sql = VIEWS[name].replace("<pixels>", TAKE_APART[engine])
    return TABLE.sub(r"\1", sql) if engine == "duckdb" else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in ``sf_dir``."""
    sql = view_sql(name, "spark")
    for table in set(TABLE.findall(sql)):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"sceneweave_{table}")
    return spark.sql(TABLE.sub(r"sceneweave_\1", sql))
