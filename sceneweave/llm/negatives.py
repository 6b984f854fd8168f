"""Hard negatives by exact scores, which are looked up instead of multiplied.

Components are whole numbers. A candidate is stored as bit planes: plane p holds
bit p of all its components, packed into one byte for each group of eight
dimensions. An anchor has a table for each group with the sums of all 256 subsets
of its eight components. A plane's share of the inner product is then one lookup a
group, and planes are put together by shifting and adding, from the sign plane
down. The scores are exact.

Candidates and anchors are cut into blocks by a hash of their ids; each pair of
blocks is a task, whatever the labels, so that a label with most of the rows is
spread like any other. Positives come first, from candidates of the anchor's
label; their scores set the bands in which negatives are searched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneweave.llm.common import cut_lineage, map_batches
from sceneweave.llm.vectors import _matrix, _vectors

#: Anchors that are scored together, and candidates of a step: tables and sums stay in a core's cache.
ANCHORS, STEP = 64, 1024


def bit_planes(m: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of a whole-number matrix: two's complement, lowest plane first, eight dimensions a byte."""
    padded = np.zeros((len(m), -(-m.shape[1] // 8) * 8), np.int64)
    padded[:, : m.shape[1]] = m
    out = np.empty((len(m), planes, padded.shape[1] // 8), np.uint8)
    for p in range(planes):
        out[:, p] = np.packbits(((padded >> p) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def planes_needed(m: np.ndarray) -> np.ndarray:
    """Planes that each row's components and their sign take."""
    top = np.maximum(m, ~m).max(axis=1)
    return np.array([int(x).bit_length() + 1 for x in top], np.int32)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of each anchor's eight components of a group."""
    groups = -(-anchors.shape[1] // 8)
    a = np.zeros((len(anchors), groups * 8), np.int64)
    a[:, : anchors.shape[1]] = anchors
    a = a.reshape(len(a), groups, 8).transpose(1, 2, 0)
    out = np.zeros((groups, 256, len(anchors)), kind)
    with np.errstate(over="ignore"):
        for i in range(8):
            out[:, 1 << i : 2 << i] = out[:, : 1 << i] + a[:, i : i + 1].astype(kind)
    return out


def looked_up(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors): inner products, where they fit the tables' type; else their lowest 64 bits."""
    out = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    for at in range(0, len(planes), STEP):
        some, total = planes[at : at + STEP], out[at : at + STEP]
        share, row = np.empty_like(total), np.empty_like(total)
        for p in range(some.shape[1] - 1, -1, -1):
            share[:] = 0
            for g in range(len(tables)):
                np.take(tables[g], some[:, p, g], axis=0, out=row, mode="clip")
                share += row
            total += total
            if p == some.shape[1] - 1:
                total -= share
            else:
                total += share
    return out


class Candidates:
    """A block of candidates in order of their ids, unpacked by number of planes."""

    def __init__(self, table: pa.Table) -> None:
        table = table.take(np.argsort(table.column("id").to_numpy(), kind="stable"))
        self.ids, self.labels, depth = (table.column(k).to_numpy() for k in ("id", "label", "depth"))
        self.dim = int(table.column("dim")[0].as_py())
        packed = table.column("planes").to_pylist()
        self.parts = []
        for planes in np.unique(depth):
            rows = np.flatnonzero(depth == planes)
            raw = np.frombuffer(b"".join(packed[i] for i in rows), np.uint8)
            self.parts.append((rows, raw.reshape(len(rows), int(planes), -(-self.dim // 8))))

    def scores(self, anchors: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(anchors, candidates) scores, of the marked candidates if any are named, and where there is none, as no long holds it; None if all have one."""
        reach = np.abs(anchors.astype(float)).sum(axis=1) * 1.001
        out, unheld, tables = np.zeros((len(self.ids), len(anchors)), np.int64), None, {}
        for rows, planes in self.parts:
            if only is not None:
                rows, planes = rows[only[rows]], planes[only[rows]]
            most = reach * 2.0 ** (planes.shape[1] - 1)
            kind = np.int32 if most.max() < 2**31 else np.int64
            if kind not in tables:
                tables[kind] = subset_sums(anchors, kind)
            out[rows] = looked_up(tables[kind], planes)
            for j in np.flatnonzero(most >= 2**62):  # sums that may have wrapped are added up in whole numbers of any size
                unheld = np.zeros(out.shape, bool) if unheld is None else unheld
                for row, one in zip(rows, planes, strict=True):
                    score = sum(x * y for x, y in zip(components(one, self.dim), anchors[j].tolist(), strict=True))
                    unheld[row, j] = not -(2**63) <= score < 2**63
                    out[row, j] = 0 if unheld[row, j] else score
        return np.ascontiguousarray(out.T), None if unheld is None else unheld.T


def components(planes: np.ndarray, dim: int) -> list[int]:
    """The components that one candidate's planes hold."""
    bits = np.unpackbits(planes, axis=1, bitorder="little")[:, :dim].astype(np.int64)
    signed = -bits[-1]
    for plane in bits[-2::-1]:
        signed = signed * 2 + plane
    return signed.tolist()


def first_rows(scores: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest usable scores, highest first, ties by place."""
    places = np.flatnonzero(usable)
    if len(places) > k:
        own = scores[places]
        places = places[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return places[np.lexsort((places, ~scores[places]))][:k]


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    lowest: int = 30,
    highest: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: float = 256.0,
    block_bytes: int = 8 << 20,
    fan_in: int = 32,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x). A row's score is its inner product with
    the anchor; higher scores come first, ties by the smaller id. An anchor's
    positives are its first rows of the same label, and each positive's
    negatives the first rows of other labels whose scores are between
    ``lowest`` and ``highest`` per cent of the positive's; a positive without
    any is not in the result, nor are anchors without positives.

    Rows with a null id, a null label, a vector that is null, empty or holds null
    or non-finite components, or a scaled component that no long holds, take no
    part; vectors of different lengths do not meet, and a pair whose score no
    long holds is not in the result. Rows with the anchor's own id are no
    candidates of it; a repeated id is a candidate as often as it occurs, and of
    several anchors of one id the one with the smallest label and vector counts.
    Other columns are not read. Empty tables give no rows.
    """

    def digitise(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, rows = [], [], []
        for one, label, v in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), _vectors(batch, "v"), strict=True):
            if v is not None and one is not None and label is not None:
                with np.errstate(over="ignore"):
                    v = np.floor(scale * v)
                if np.abs(v).max() < 2.0**63:
                    ids.append(one)
                    labels.append(label)
                    rows.append(v.astype(np.int64))
        columns = [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array([len(r) for r in rows], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "dim"])

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, dims = batch.column("v"), batch.column("dim").to_numpy()
        packed, depths = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int32)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            m = lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)
            depths[rows] = needed = planes_needed(m)
            for depth in np.unique(needed):
                own = np.flatnonzero(needed == depth)
                for i, planes in zip(rows[own], bit_planes(m[own], int(depth)), strict=True):
                    packed[i] = planes.tobytes()
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(packed, pa.binary()), pa.array(depths), batch.column("dim")], ["id", "label", "planes", "depth", "dim"])

    def chosen(frame: DataFrame) -> DataFrame:
        frame = frame.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
        return map_batches(frame, digitise, "id long, label long, v array<bigint>, dim int")

    candidates = cut_lineage(map_batches(chosen(vectors), pack, "id long, label long, planes binary, depth int, dim int"))
    asked = chosen(anchors).groupBy("id").agg(F.min(F.struct("label", "v", "dim")).alias("a")).select("id", F.col("a.label").alias("label"), F.col("a.v").alias("v"), F.col("a.dim").alias("dim"))
    asked = cut_lineage(asked)
    n, size = candidates.agg(F.count("*"), F.sum(F.octet_length("planes") + 24)).first()
    n_asked, asked_size = asked.agg(F.count("*"), F.sum(8 * F.size("v") + 40 * positives)).first()
    # By bytes; of few rows as many blocks as there are cores, but none under 4,096 rows.
    shards = max(1, -(-(size or 0) // block_bytes), min(vectors.sparkSession.sparkContext.defaultParallelism, n // 4096))
    blocks = max(1, -(-(asked_size or 0) // block_bytes), n_asked // 65_536)
    by = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = candidates.select("*", by(shards).alias("shard"), every(blocks).alias("block"))
    keys = ["block", "shard", "dim"]

    def tiles(right: DataFrame, work, schema: str) -> DataFrame:  # noqa: ANN001
        """``work`` on each pair of a block of candidates and a block of anchors."""
        placed = right.select("*", by(blocks).alias("block"), every(shards).alias("shard"))
        return left.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(work, schema)

    def merged(lists: DataFrame, by_keys: list[str], other: str, score: str, k: int, name: str) -> DataFrame:
        """The first k of each key's lists, ``fan_in`` lists at a time, and their ranks as ``name``."""
        best = [F.col(score).desc(), F.col(other)]
        left_over = shards
        while left_over > fan_in:
            lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int"))
            lists = lists.withColumn("r", F.row_number().over(Window.partitionBy(*by_keys, "shard").orderBy(*best))).where(F.col("r") <= k).drop("r")
            left_over = -(-left_over // fan_in)
        return lists.withColumn(name, F.row_number().over(Window.partitionBy(*by_keys).orderBy(*best))).where(F.col(name) <= k).drop("shard")

    def table(columns: list[list], names: str) -> pa.Table:
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0), pa.int32() if n in ("shard", "p") else pa.int64()) for c, n in zip(columns, names.split(), strict=True)], names=names.split())

    def best_positives(key: tuple, c: pa.Table, a: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if c.num_rows and a.num_rows:
            block, ids, labels, m = Candidates(c), a.column("id").to_numpy(), a.column("label").to_numpy(), _matrix(a, "v")
            for label in np.intersect1d(labels, block.labels):
                own, same = np.flatnonzero(labels == label), block.labels == label
                for at in range(0, len(own), ANCHORS):
                    part = own[at : at + ANCHORS]
                    scores, unheld = block.scores(m[part], same)
                    for j, i in enumerate(part):
                        usable = same & (block.ids != ids[i])
                        places = first_rows(scores[j], usable if unheld is None else usable & ~unheld[j], positives)
                        for column, value in zip(out, (np.full(len(places), ids[i]), np.full(len(places), key[1].as_py()), block.ids[places], scores[j, places]), strict=True):
                            column.append(value)
        return table(out, "anchor_id shard positive_id positive_score")

    def best_negatives(key: tuple, c: pa.Table, a: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if c.num_rows and a.num_rows:
            block, ids, labels, m = Candidates(c), a.column("id").to_numpy(), a.column("label").to_numpy(), _matrix(a, "v")
            bands = a.column("positive_scores").to_pylist()
            for at in range(0, len(ids), ANCHORS):
                scores, unheld = block.scores(m[at : at + ANCHORS])
                for j, i in enumerate(range(at, min(at + ANCHORS, len(ids)))):
                    other = (block.labels != labels[i]) & (block.ids != ids[i])
                    other = other if unheld is None else other & ~unheld[j]
                    for p, score in enumerate(bands[i]):
                        low, high = -(-lowest * score // 100), highest * score // 100
                        if low > high:
                            continue
                        places = first_rows(scores[j], other & (scores[j] >= low) & (scores[j] <= high), negatives)
                        for column, value in zip(out, (np.full(len(places), ids[i]), np.full(len(places), key[1].as_py()), np.full(len(places), p), block.ids[places], scores[j, places]), strict=True):
                            column.append(value)
        return table(out, "anchor_id shard p negative_id negative_score")

    found = tiles(asked, best_positives, "anchor_id long, shard int, positive_id long, positive_score long")
    chosen_positives = merged(found, ["anchor_id"], "positive_id", "positive_score", positives, "p")
    per_anchor = chosen_positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("p", "positive_id", "positive_score"))).alias("ps"))
    with_bands = cut_lineage(asked.join(per_anchor, asked["id"] == per_anchor["anchor_id"]).select("id", "label", "v", "dim", F.col("ps.positive_id").alias("positive_ids"), F.col("ps.positive_score").alias("positive_scores")))
    found = tiles(with_bands, best_negatives, "anchor_id long, shard int, p int, negative_id long, negative_score long")
    ranked = merged(found, ["anchor_id", "p"], "negative_id", "negative_score", negatives, "rank")
    named = ranked.join(with_bands.select(F.col("id").alias("anchor_id"), "positive_ids", "positive_scores"), "anchor_id")
    return named.select("anchor_id", F.get("positive_ids", F.col("p")).alias("positive_id"), "rank", "negative_id", F.get("positive_scores", F.col("p")).alias("positive_score"), "negative_score")
