"""Results of micro-batches in a folder that does not grow with their number.

Each micro-batch writes a folder of its own, over what a broken attempt left.
Every so many batches the last snapshot and the batches after it are merged into
the next snapshot, which counts once Spark has marked it as complete. A batch
that is sent again after a snapshot took it in is left out. What the snapshot
before the last one took in is deleted, so that readers of the last two find
their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[DataFrame], DataFrame]
#: Batches between snapshots.
EVERY = 100


class FoldedFolder:
    """Parts of batches that ``merge`` adds up: merging merged parts gives the same as merging all at once."""

    def __init__(self, spark: SparkSession, path: str, merge: Step, every: int = EVERY) -> None:
        self.spark, self.path, self.merge, self.every = spark, path.rstrip("/"), merge, every

    def _found(self) -> dict[str, list[int]]:
        """Numbers of complete folders by kind, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"batch": [], "snapshot": []}
        for status in files.listStatus(root) if files.exists(root) else []:
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and files.exists(path(status.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
        return {kind: sorted(numbers) for kind, numbers in found.items()}

    def _folders(self) -> list[str]:
        """The last snapshot and the batches after it."""
        found = self._found()
        last = found["snapshot"][-1:]
        return [f"{self.path}/snapshot={n}" for n in last] + [f"{self.path}/batch={n}" for n in found["batch"] if n > (last or [-1])[0]]

    def append(self, part: DataFrame, batch_id: int) -> None:
        """Keep a batch's part; nothing happens if a snapshot holds that batch."""
        last = (self._found()["snapshot"][-1:] or [-1])[0]
        if batch_id <= last:
            return
        part.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if batch_id - last >= self.every:
            self.fold(batch_id)

    def fold(self, batch_id: int) -> None:
        """Merge all up to ``batch_id``, the last batch, into a snapshot, then delete what the snapshot before holds."""
        before = self._found()
        self.merge(self.spark.read.parquet(*self._folders())).write.mode("overwrite").parquet(f"{self.path}/snapshot={batch_id}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for held in before["snapshot"][-1:]:
            old = [f"batch={n}" for n in before["batch"] if n <= held] + [f"snapshot={n}" for n in before["snapshot"] if n < held]
            for name in old:
                files.delete(path(f"{self.path}/{name}"), True)

    def read(self) -> DataFrame:
        """All parts merged. A folder without any batch is an error, for its columns are unknown."""
        return self.merge(self.spark.read.parquet(*self._folders()))
