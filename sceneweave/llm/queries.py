"""The operators' queries over the given tables, and their SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneweave.llm import bpe, language, licences, lines, negatives, packing, personal, rollup, secrets, simhash, spelling, vectors
from sceneweave.llm.common import checkpoint_folder, cut_lineage, join_skewed, read_table


def tokenizer_file(name: str) -> str:
    """Where the public tokenizers' package keeps a file, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, budget=4)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode_documents(encoded, path, public_tokenizers.PATTERN))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.drop_repeated_lines(read_table(spark, sf_dir, "documents")))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = read_table(spark, sf_dir, "embeddings")
    return vectors.top_k(embeddings, embeddings.where("vec_id % 50 = 0"), k=5)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read_table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), with_ids=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents, folded by two, and two of them sent again, one after its fold.

    Words are inserted by an estimate of six characters each, then revised to
    their count; pieces are inserted; then exact copies but the smallest doc_id
    are deleted under both tokenizer versions. A null text is an empty one, and
    a copy of others. Repeated rows of one doc_id count as often as they occur,
    as no id is larger than itself; rows with a null doc_id are never deleted.
    Null sources and languages are keys like any other; an empty table has no
    totals.
    """
    docs, text = read_table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", "source", "lang", F.xxhash64(text).alias("hash"), F.md5(text.cast("binary")).alias("digest"), F.floor(F.length(text) / 6).cast("long").alias("estimate"), rollup.word_count(F.col("text")).alias("words"), rollup.piece_count(F.col("text")).alias("pieces"))
    counted = cut_lineage(counted)
    first = cut_lineage(counted.groupBy("hash", "digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    copies = join_skewed(counted, first, ["hash", "digest"], "n", counted.count()).where("doc_id > first_id")
    version = lambda name, column: [F.lit(name).alias("tokenizer_version"), F.col(column).alias("tokens")]
    words, pieces = version("words-1", "words"), version("pieces-1", "pieces")
    totals = rollup.TokenRollup(spark, f"{checkpoint_folder(spark)}/token-rollup-{uuid.uuid4().hex}", every=2)
    batches = {
        "1-estimates": rollup.inserts(counted.select("source", "lang", *version("words-1", "estimate"))),
        "2-counts": rollup.revisions(counted.select("source", "lang", *words, F.col("estimate").alias("old_tokens"))),
        "3-pieces": rollup.inserts(counted.select("source", "lang", *pieces)),
        "4-copies": rollup.deletes(copies.select("source", "lang", *words).union(copies.select("source", "lang", *pieces))),
    }
    for batch_id in ("1-estimates", "2-counts", "2-counts", "3-pieces", "4-copies", "1-estimates"):
        totals.apply(batch_id, batches[batch_id])
    return totals.totals()


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.scan(read_table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are every hundredth vector; every seventh vector has the next label."""
    embeddings = read_table(spark, sf_dir, "embeddings")
    relabelled = embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(relabelled, relabelled.where("vec_id % 100 = 0"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash_near_dedup, op2_embedding_near_dedup, op3_byte_bpe, op4_license_scan, op5_language_id, op6_line_dedup, op7_exact_top_k, op8_secret_scan, op9_packing, op10_token_counts, op11_personal_data, op12_hard_negatives, op13_spelling_variants, pipeline]
    return {f.__name__: f for f in found}


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lines_sql(text: str) -> str:
    """Each line's words, one by one: a list of lists, unlike the operator, which replaces in the whole text."""
    out = f"string_split(regexp_replace(lower(coalesce({text}, '')), {_sql_text(licences.COPYRIGHT_LINE)}, chr(10), 'g'), chr(10))"
    word = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in licences.EQUIVALENT.items()) + " ELSE w END"
    words = f"list_transform(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+'), lambda w: {word})"
    return f"list_transform({out}, lambda x: coalesce(array_to_string({words}, ' '), ''))"


def _digest_sql(lines: str) -> str:
    return f"sha256(coalesce(array_to_string(list_filter({lines}, lambda x: x <> ''), ' '), ''))"


def _crc32_sql(text: str) -> str:
    """crc32 of a text whose code points are below 256, byte by byte with the usual table."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
        table.append(byte)
    each = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END))"
    return f"xor(list_reduce(list_concat([4294967295], {each}), lambda c, b: xor(CAST({table} AS BIGINT[])[1 + (xor(c, b) & 255)], c >> 8)), 4294967295)"


def oracle_sql() -> dict[str, str]:
    known = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in [*licences.TEXTS.items(), *((b, a) for a, b in licences.NOTICES.items()), *licences.long_texts()])
    return {
        "op4_license_scan": f"""
WITH known AS (SELECT {_digest_sql("l")} AS digest, min(i) AS known_id FROM (SELECT i, {_lines_sql("t")} AS l FROM (VALUES {known}) v(i, t)) z GROUP BY 1),
forms AS (SELECT doc_id, {_lines_sql("text")} AS l FROM documents), lines AS (SELECT doc_id, unnest(l) AS line FROM forms),
notices AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT known_id, ',' ORDER BY known_id) AS ids FROM (SELECT doc_id, sha256(line) AS digest FROM lines WHERE line <> '') k JOIN known USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, {_digest_sql("l")} AS text_digest FROM forms)
SELECT w.doc_id, w.text_digest, k.known_id AS license_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices, coalesce(n.ids, '') AS notice_ids
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN notices n ON n.doc_id = w.doc_id""",
        "op6_line_dedup": r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, (c.k IS NOT NULL AND doc_id <> keeper) AS gone FROM keyed LEFT JOIN common c USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
        "op7_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) x WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
        "op13_spelling_variants": f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
                        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) x GROUP BY ALL),
hashed AS (SELECT w, n, {_crc32_sql("concat(doc_id, ':', w)")} AS h FROM runs WHERE doc_id IS NOT NULL UNION ALL SELECT w, n, 1 FROM runs WHERE doc_id IS NULL),
thinned AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(w, h % length(w)), substring(w, h % length(w) + 2)) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM thinned WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, pos, concat(left(word, pos), substring(word, pos + 2)) AS rest FROM (SELECT word, unnest(range(length(word))) AS pos FROM words) p),
links AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
          UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest),
best AS (SELECT a AS word, b AS near, n AS near_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM links JOIN words ON words.word = b),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND r = 1),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT f.word, f.form, e.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)""",
        "op10_token_counts": r"""
WITH d AS (SELECT *, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
one AS (SELECT source, lang, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
               length(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+')) AS pieces FROM d WHERE doc_id IS NULL OR doc_id = first_id)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS n_docs, CAST(sum(words) AS BIGINT) AS n_tokens FROM one GROUP BY ALL
UNION ALL
SELECT source, lang, 'pieces-1', count(*), CAST(sum(pieces) AS BIGINT) FROM one GROUP BY ALL""",
    }
