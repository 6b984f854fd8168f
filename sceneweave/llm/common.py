"""Helpers that the training-data operators share.

Nothing here holds corpus-sized state on the driver: lineage is cut in the
cluster's shared folder, and graph components are found by joins.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager, suppress
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sceneweave.operators.cluster import cut_lineage, join_skewed, shared_folder

__all__ = ["arrow_rows", "bound_batches", "broadcast_if_few", "checkpoint_folder", "connected_components", "cut_lineage", "join_skewed", "local_components", "map_batches", "map_whole_groups", "read_table"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder, set as the one for checkpoints."""
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs run inside: for rows of some kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes of an Arrow batch, unless the session names a bound: a task and its worker hold several batches of texts at once, on the way in and out.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_BYTES`` in a session without a bound of its own. A longer row is a batch by itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def broadcast_if_few(frame: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``frame``, whose rows are a few numbers each, marked for broadcast if it has no more rows than that; it should be cheap to read."""
    return F.broadcast(frame) if frame.count() <= most_rows else frame


_kept: dict[str, dict[Hashable, Any]] = {}


def kept(owner: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from batch to batch for ``owner``, made once; what it kept for other owners goes.

    Workers are used again by later stages, which have no need of an earlier
    operator's tables.
    """
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    if key not in _kept[owner]:
        _kept[owner][key] = make()
    return _kept[owner][key]


def release_memory() -> None:
    """Give back to the system what a worker's allocators hold at the end of a task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int = 1024) -> DataFrame:
    """Apply ``work`` to each Arrow batch, ``rows`` rows at a time; None gives no rows.

    Spark bounds a batch by bytes as well as by rows, so a slice of it is small
    whatever the length of its texts.
    """
    bound_batches(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := work(batch.slice(at, rows))) is not None:
                    yield out
        release_memory()

    return frame.mapInArrow(run, schema)


def map_whole_groups(frame: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring the rows of each key together and call ``work`` on runs of whole groups, sorted by key.

    A run is about one Arrow batch, so many small groups are handled by one
    call and a task holds no more than a batch and one group. Callers bound
    the size of a group before.
    """
    bound_batches(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(k)[batch.num_rows - 1] for k in keys]
            if [batch.column(k)[0] for k in keys] == last:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            open_group = np.ones(table.num_rows, bool)
            for k, value in zip(keys, last, strict=True):
                open_group &= table.column(k).to_numpy() == value.as_py()
            cut = table.num_rows - int(open_group.sum())
            if cut:
                yield from work(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())
        held.clear()
        release_memory()

    return frame.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def local_components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index for each of n nodes, over the index pairs (a, b)."""
    labels = np.arange(n) if labels is None else labels
    while True:
        low = np.minimum(labels[a], labels[b])
        apart = labels[a] != labels[b]
        if not apart.any():
            return labels
        a, b, low = a[apart], b[apart], low[apart]
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further


def forget_shuffles(spark: SparkSession) -> None:
    """Have shuffle files and checkpoints that nothing can read any more removed now.

    Spark removes them when the driver collects its garbage, which it may not do
    for half an hour; a loop of small jobs piles them up meanwhile.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Edges of a task.
EDGES = 50_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long) but the roots; root is the smallest node of its component.

    Alternates the large-star and small-star steps: in each, nodes are
    re-attached to the smallest neighbour, until the edges stay as they are.
    Each round is written to the checkpoint folder. The driver sees one count
    and one hash sum a round. The centre of a large star is a hot key of the
    large-star step; its neighbours are joined where they are. In the small-star
    step a node only has the different minima of the stars that it was in.
    Steps run in as many tasks as their edges need: most rounds are of few.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        few = lambda frame: frame.coalesce(max(1, -(-mark[0] // EDGES)))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = few(few(join_skewed(both, lowest, ["a"], "n", 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(few(few(small.union(lowest.select("a", F.col("m").alias("b")))).distinct()))
        del both, lowest, large, small
        forget_shuffles(edges.sparkSession)
    raise RuntimeError("components did not settle")
