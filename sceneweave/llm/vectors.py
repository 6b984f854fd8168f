"""Vector operators: near-duplicate embeddings and exact top-k search.

Both work on tiles: blocks of at most a fixed number of vectors that are
multiplied with each other in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneweave.llm.common import connected_components, cut_lineage, join_skewed, local_components, map_batches, map_whole_groups

SEED = 7


def _vectors(table: pa.Table | pa.RecordBatch, column: str) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None for null, empty, or null or non-finite components."""
    out = []
    for x in table.column(column):
        v = x.values
        v = None if v is None or not len(v) or v.null_count else v.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(None if v is None or not np.isfinite(v).all() else v)
    return out


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    """The vectors of a table whose rows all have the same length."""
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    """The rows at length one, in double precision; scaled first, so that squares stay finite."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def hyperplanes(dim: int, tables: int, bits: int) -> np.ndarray:
    """Random normals, the same for a given shape on each executor."""
    return np.random.default_rng([SEED, dim, tables, bits]).standard_normal((dim, tables * bits))


#: Share of pairs at exactly the threshold that no table may file together.
MISSED = 0.0056
#: Vectors that share a bucket by chance, on average, at most.
BUCKET = 64


def table_sizes(n: int, threshold: float) -> tuple[int, int]:
    """Tables and bits for n vectors: bits follow the number of vectors, and tables make up for the pairs that more bits part."""
    bits = min(30, max(12, math.ceil(math.log2(max(1, n) / BUCKET))))
    together = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-together))) if together < 1 else 1, bits


def cosine_links(vectors: DataFrame, threshold: float, tables: int, bits: int, unit_rows: int) -> DataFrame:
    """What linked, of distinct vectors (node long, copies long, v array).

    Rows of kind 0: (node, copies of the vectors that it links with); of kind 1:
    links (a, b) that span the same components as all links do.

    Each table files a vector under the signs of ``bits`` random projections.
    Vectors that meet in a bucket are compared exactly. A pair that meets in
    several tables counts in the first of them only. A bucket with more than
    ``unit_rows`` vectors is cut into pieces, and each pair of pieces is a unit
    of work of its own.
    """
    powers = 1 << np.arange(bits, dtype=np.int64)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("v")
        lengths = np.diff(lists.offsets.to_numpy())
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
        out = np.zeros((len(lists), tables), np.int64)
        for dim in np.unique(lengths):
            rows = np.flatnonzero(lengths == dim)
            m = _unit_rows(flat[offsets[rows][:, None] + np.arange(dim)])
            out[rows] = ((m @ hyperplanes(int(dim), tables, bits)) >= 0).reshape(len(rows), tables, bits) @ powers
        signs = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * tables, pa.int32()), pa.array(out.ravel().astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("node"), signs, pa.array(lengths.astype(np.int32))], ["node", "signs", "dim"])

    signed = cut_lineage(map_batches(vectors.select("node", "v"), sign, "node long, signs array<int>, dim int"))
    bucket = F.shiftleft(F.col("dim").cast("long"), 40) + F.shiftleft(F.col("table").cast("long"), bits) + F.col("value")
    filed = signed.select("node", "dim", F.posexplode("signs").alias("table", "value")).select("node", "table", bucket.alias("bucket"))
    # Placement moves ids; the vectors are moved once, to the units that need them.
    sizes = filed.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / unit_rows).cast("int").alias("pieces"))
    placed = filed.join(sizes, "bucket").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    placed = placed.select("bucket", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), "piece", "table", "node")
    placed = placed.join(vectors.select("node", "copies", "v"), "node").join(signed.select("node", "signs"), "node")

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, p, q, piece, at, node, copies = (table.column(k).to_numpy() for k in ("bucket", "p", "q", "piece", "table", "node", "copies"))
        edges = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), [True])))
        kinds, left, right = [], [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            part = table.slice(lo, hi - lo)
            m, signs = _unit_rows(_matrix(part, "v")), _matrix(part, "signs")
            own, first = piece[lo:hi], int(at[lo])
            if p[lo] == q[lo]:
                one = two = np.arange(hi - lo)
            else:
                one, two = np.flatnonzero(own == p[lo]), np.flatnonzero(own == q[lo])
            i, j = np.nonzero(m[one] @ m[two].T >= threshold)
            i, j = one[i], two[j]
            if p[lo] == q[lo]:
                i, j = i[i < j], j[i < j]
            fresh = (signs[i, :first] != signs[j, :first]).all(axis=1)
            i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            links = np.bincount(i, copies[lo:hi][j], hi - lo) + np.bincount(j, copies[lo:hi][i], hi - lo)
            some = np.flatnonzero(links)
            labels = local_components(hi - lo, i, j)
            spans = np.flatnonzero(labels != np.arange(hi - lo))
            ids = node[lo:hi]
            kinds += [np.zeros(len(some), np.int32), np.ones(len(spans), np.int32)]
            left += [ids[some], ids[spans]]
            right += [links[some].astype(np.int64), ids[labels[spans]]]
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, left, right)], ["kind", "a", "b"])

    return map_whole_groups(placed, ["bucket", "p", "q"], compare, "kind int, a long, b long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tables: int | None = None, bits: int | None = None, unit_rows: int = 512) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Equal vectors are one node with a number of copies. Tables and bits follow
    the number of vectors (``table_sizes``), so that a bucket holds a bounded
    number of vectors by chance; a pair at exactly the threshold is found with
    a probability of 0.994, a closer one with more; no pair below the threshold
    links. Vectors that are null,
    zero, empty or hold null or non-finite components link with nothing and are
    their own component. Vectors of different lengths do not link. A row with a
    null id links with nothing either and has null component_id and kept. A
    repeated id is a vector like any other. Other columns are not read.
    """
    kind, arrow = ("float", pa.float32()) if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else ("double", pa.float64())
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))

    def prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, kept = [], []
        for vec_id, v in zip(batch.column("vec_id"), _vectors(batch, "v"), strict=True):
            links = v is not None and vec_id.as_py() is not None and v.any()
            keys.append(md5((v + 0.0).tobytes()).digest() if links else None)
            kept.append(v if links else None)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(kept, pa.list_(pa.float64())).cast(pa.list_(arrow))], ["vec_id", "digest", "v"])

    prepared = map_batches(chosen, prepare, f"vec_id long, digest binary, v array<{kind}>")
    keyed = cut_lineage(prepared.select("vec_id", "digest", "v"))
    nodes = keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    # One vector stands for its copies: the row of the smallest id.
    shown = keyed.where("digest IS NOT NULL").join(nodes.withColumnRenamed("node", "vec_id").withColumnRenamed("digest", "d"), "vec_id")
    shown = shown.where("digest = d").dropDuplicates(["digest"]).select(F.col("digest"), F.col("vec_id").alias("id"), "copies", "v")
    shown = shown.select(F.xxhash64("digest", "id").alias("node"), "digest", "id", "copies", "v")
    shown = cut_lineage(shown)
    n = shown.count()
    least_tables, usual_bits = table_sizes(n, threshold)
    found = cut_lineage(cosine_links(shown, threshold, tables or least_tables, bits or usual_bits, unit_rows))
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("linked")).withColumnRenamed("a", "node")
    roots = connected_components(found.where("kind = 1").select("a", "b"))
    rooted = cut_lineage(shown.select("node", "digest", "id", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = cut_lineage(rooted.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("n_nodes")))
    classes = join_skewed(rooted, named, ["root"], "n_nodes", n).select("digest", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    joined = join_skewed(keyed.select("vec_id", "digest"), cut_lineage(classes), ["digest"], "copies", keyed.count(), "left")
    joined = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block_bytes: int = 32 << 20, fan_in: int = 32) -> DataFrame:
    """Each query's k best rows by exact integer inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries and vectors are cut into blocks
    of about ``block_bytes``, as longs; each pair of blocks is one matrix
    product, of which a task keeps k rows per query. Lists are merged ``fan_in``
    at a time until one is left. Ties go to the smaller vec_id. Vectors that
    are null, empty or hold null or non-finite components, and rows with null
    ids, take no part; vectors of different lengths do not meet. Candidates
    with the query's own id are left out; a repeated id is a candidate as often
    as it occurs, and a query once. Scores are exact. A vector with a scaled
    component that no long holds takes no part, and a pair whose score no long
    holds is not in the result.
    """

    def digitise(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = [], []
        for vec_id, v in zip(batch.column("id"), _vectors(batch, "v"), strict=True):
            if v is not None and vec_id.as_py() is not None:
                with np.errstate(over="ignore"):
                    v = np.floor(scale * v)
                if np.abs(v).max() < 2.0**63:
                    ids.append(vec_id.as_py())
                    rows.append(v.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array([len(r) for r in rows], pa.int32())], ["id", "v", "dim"])

    def chosen(frame: DataFrame) -> DataFrame:
        frame = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return map_batches(frame, digitise, "id long, v array<bigint>, dim int")

    def blocks_of(frame: DataFrame) -> int:
        """By bytes; of few vectors as many as the cluster has cores, but none under 4,096 of them."""
        n, components = frame.agg(F.count("*"), F.sum(F.size(vector_col))).first()
        return max(1, -(-8 * (components or 0) // block_bytes), min(vectors.sparkSession.sparkContext.defaultParallelism, n // 4096))

    candidates, asked = chosen(vectors), chosen(queries).dropDuplicates(["id"])
    shards, blocks = blocks_of(vectors), blocks_of(queries)
    by = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.select("*", by(shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("*", by(blocks).alias("block"), every(shards).alias("shard"))

    def tile(key: tuple, c: pa.Table, q: pa.Table) -> pa.Table:
        names = ["query_id", "shard", "vec_id", "score"]
        if not c.num_rows or not q.num_rows:
            return pa.table({n: pa.array([], pa.int32() if n == "shard" else pa.int64()) for n in names})
        ids = c.column("id").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, m = ids[by_id], _matrix(c, "v")[by_id]
        asked_ids, w = q.column("id").to_numpy(), _matrix(q, "v")
        n, tie = min(k, len(ids)), np.arange(len(ids), dtype=np.int64)
        # The largest sums that a vector can take part in; products in floats bound them from above.
        reach_m, reach_w = np.abs(m.astype(float)).max(axis=1), np.abs(w.astype(float)).max(axis=1) * w.shape[1]
        most = int(reach_w.max() * 1.001) * int(reach_m.max() * 1.001 + 1)
        wide = most >= 2**62
        factors = (w.astype(np.float64), m.astype(np.float64)) if most < 2**53 else (w, m)
        #: Score and place in one number, where both fit: no two alike, and the smaller id is larger.
        place = 1 << int(len(ids)).bit_length()
        one_number = most * place < 2**62
        step = max(1, 4_000_000 // len(ids))
        out = []
        for at in range(0, len(w), step):
            some = asked_ids[at : at + step]
            worth = (factors[0][at : at + step] @ factors[1].T).astype(np.int64)
            own = some[:, None] == ids
            if one_number:
                order = worth * place - tie
                order[own] = np.iinfo(np.int64).min
                best = np.argpartition(order, len(ids) - n, axis=1)[:, len(ids) - n :].ravel()
                rows = np.repeat(np.arange(len(some)), n)
                real = ~own[rows, best]
                rows, best = rows[real], best[real]
            else:
                if wide:  # pairs whose sum may have wrapped are added up in whole numbers
                    for i, j in np.argwhere(reach_w[at : at + step, None] * reach_m[None, :] >= 2.0**62):
                        score = sum(x * y for x, y in zip(w[at + i].tolist(), m[j].tolist(), strict=True))
                        fits = -(2**63) <= score < 2**63
                        worth[i, j], own[i, j] = score if fits else 0, own[i, j] or not fits
                lists = [[x for x in np.lexsort((ids, ~line)) if not no[x]][:k] for line, no in zip(worth, own, strict=True)]
                rows = np.repeat(np.arange(len(some)), [len(x) for x in lists])
                best = np.array([x for one in lists for x in one], np.int64)
            out.append((some[rows], ids[best], worth[rows, best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table([pa.array(columns[0]), pa.array(np.full(len(columns[0]), key[1].as_py(), np.int32)), pa.array(columns[1]), pa.array(columns[2])], names=names)

    keys = ["block", "shard", "dim"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "query_id long, shard int, vec_id long, score long")
    best = [F.col("score").desc(), F.col("vec_id")]
    while shards > fan_in:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
        shards = -(-shards // fan_in)
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
