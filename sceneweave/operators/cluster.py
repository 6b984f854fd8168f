"""What jobs on a cluster share: a folder, cut lineages, and joins on keys that many rows hold."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only in local mode, where none is named, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^]]*])?", context.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def join_skewed(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", parts: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in column ``size`` how many of ``rows`` hold it.

    A key with more than one in ``parts`` of all ``total`` rows is joined by
    broadcast, where its rows are: there are fewer than ``parts`` such keys,
    whatever the data. The other keys are shuffled. Both inputs are read twice,
    so they should be cheap to read. ``how`` is inner or left.
    """
    is_hot = F.col(size) > total / parts
    hot, cold = table.where(is_hot), table.where(~is_hot)
    placed = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return placed.unionByName(others).drop(size)
