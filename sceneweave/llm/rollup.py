"""Token counts as rollups that signed deltas maintain.

A change row carries what it adds: an insert adds its tokens and one document,
a delete takes both away, and a revised count adds the difference. Totals by
source, language and tokenizer version are sums of deltas, so that a batch needs
no look at earlier rows.

Each attempt at a batch writes its sums per key to a folder of its own. A file
under the batch's name then says which attempt counts; it is renamed into place
and never replaced. So a batch counts once: one that is sent again is skipped,
one that broke off leaves a folder that nothing reads, and of two attempts side
by side the first to finish counts (where the file system renames atomically
and without replacing, as HDFS does).

After every so many batches they are folded: a snapshot has the totals and the
names of the marks that it took in, and counts once it has a mark itself, by the
same rename. Marks and deltas stay until the next snapshot, so that readers find
them; then deltas are deleted, and marks move to a folder that is never listed
but tells whether a batch has counted. A fold that broke off at any point is
done by the next one. So what is read does not grow with the number of batches.

Values: null sources, languages and versions are keys like others. A null or
missing count of tokens is 0. Repeated rows count as often as they occur. A
batch without rows counts, and changes nothing.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
#: Batches between snapshots.
EVERY = 100
CHANGE = "source string, lang string, tokenizer_version string, docs long, tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add rows of (source, lang, tokenizer_version, tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take such rows away again."""
    return inserts(counts).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Changes from rows of (source, lang, tokenizer_version, old_tokens, tokens)."""
    zero = F.lit(0)
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.coalesce("tokens", zero) - F.coalesce("old_tokens", zero)).cast("long").alias("tokens"))


class TokenRollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, every: int = EVERY) -> None:
        self.spark, self.root, self.every = spark, root.rstrip("/"), every

    def _folder(self, kind: str, batch_id: str = "") -> str:
        if "/" in batch_id or batch_id.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"{self.root}/{kind}/{batch_id}".rstrip("/")

    def _files(self, folder: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, kind: str, name: str) -> bool:
        path, files = self._files(self._folder(kind, name))
        return files.exists(path)

    def _marks(self, kind: str) -> dict[str, str]:
        path, files = self._files(self._folder(kind))
        if not files.exists(path) or not len(files.listStatus(path)):
            return {}
        marks = self.spark.read.text(self._folder(kind), wholetext=True).select("_metadata.file_name", "value")
        return {r["file_name"]: r["value"] for r in marks.collect()}

    def committed(self) -> dict[str, str]:
        """The attempt that counts, by batch id, of batches since the snapshot before the last; at most a few times ``every``."""
        return self._marks("commits")

    def counted(self, batch_id: str) -> bool:
        """Whether a batch has counted, folded or not; marks move from the first folder to the second."""
        return self._exists("commits", batch_id) or self._exists("folded", batch_id)

    def _commit(self, name: str, attempt: str, kind: str = "commits") -> bool:
        """Whether this attempt is the first."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        made, files = self._files(self._folder("attempts", attempt))
        out = files.create(made, False)
        out.write(bytearray(attempt, "ascii"))
        out.close()
        mark, _ = self._files(self._folder(kind, name))
        files.mkdirs(mark.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(mark.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(made), files.makeQualified(mark), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes (columns of CHANGE; others are ignored). False if it counted before."""
        self._folder("deltas", batch_id)  # refuses ids that are no names
        if self.counted(batch_id):
            return False
        attempt = uuid.uuid4().hex
        _added(changes).write.parquet(self._folder("deltas", batch_id) + f"/{attempt}")
        first = not self._exists("folded", batch_id) and self._commit(batch_id, attempt)
        if first and len(set(self.committed()) - set(self._snapshot()[2])) >= self.every:
            self.fold()
        return first

    def _snapshot(self) -> tuple[int, list[str], list[str]]:
        """Number of the last snapshot (0: none), its folders of totals, and the marks that it took in."""
        marks = self._marks("folds")
        if not marks:
            return 0, [], []
        number = max(map(int, marks))
        folder = self._folder("snapshots", str(number)) + f"/{marks[str(number)]}"
        return number, [f"{folder}/sums"], [r["value"] for r in self.spark.read.text(f"{folder}/batches").collect()]

    def _rows(self) -> DataFrame:
        """Totals of the last snapshot and deltas of the batches after it."""
        _, folders, held = self._snapshot()
        folders = folders + [self._folder("deltas", batch) + f"/{attempt}" for batch, attempt in self.committed().items() if batch not in set(held)]
        return self.spark.read.schema(CHANGE).parquet(*folders) if folders else self.spark.createDataFrame([], CHANGE)

    def fold(self) -> bool:
        """Take all batches so far into a snapshot. False if there is none to take, or another fold came first."""
        number, folders, held = self._snapshot()
        marks = self.committed()
        fresh = [self._folder("deltas", batch) + f"/{attempt}" for batch, attempt in marks.items() if batch not in set(held)]
        if not fresh:
            return False
        attempt = uuid.uuid4().hex
        folder = self._folder("snapshots", str(number + 1)) + f"/{attempt}"
        _added(self.spark.read.schema(CHANGE).parquet(*folders, *fresh)).write.parquet(f"{folder}/sums")
        # With the marks of the last snapshot that are still there, for a broken fold may leave some of them.
        self.spark.createDataFrame([(batch,) for batch in marks], "value string").write.text(f"{folder}/batches")
        if not self._commit(str(number + 1), attempt, "folds"):
            return False
        for batch in held:
            mark, files = self._files(self._folder("commits", batch))
            aside, _ = self._files(self._folder("folded", batch))
            files.mkdirs(aside.getParent())
            files.delete(self._files(self._folder("deltas", batch))[0], True)
            files.rename(mark, aside)
        if number > 1:
            for kind in ("folds", "snapshots"):
                old, files = self._files(self._folder(kind, str(number - 1)))
                files.delete(old, True)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens over all committed batches; keys without documents and tokens are left out."""
        return _added(self._rows()).withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})


def _added(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.where("docs <> 0 OR tokens <> 0")


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def piece_count(text: Column) -> Column:
    """Runs of letters, single digits, and runs of other characters but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+")), F.lit(0)).cast("long")
