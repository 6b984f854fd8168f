"""Line deduplication with two Bloom filters.

Which line keys occur more than once is found without moving lines. Each task
adds the hashes of its lines to two Bloom filters: hashes seen once, and hashes
seen again. The tasks' filters are merged piece by piece: a bit that two tasks
have seen is seen again, too. The merged second filter goes to all executors,
and a further scan takes from the texts the lines it holds, the suspects. Only
these are shuffled, with their document, counted exactly and given a document
that keeps them. The lines to drop then go to all executors, if they are few
enough, so that texts are never shuffled; if not, they meet the texts in a join.

The filters' size follows the number of lines, up to a bound. Beyond it more
lines are suspected by chance and shuffled; the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneweave.llm.common import bound_batches, cut_lineage, join_skewed, map_batches

STRIP = b" \t\n\v\f\r"
#: Bits of a filter for each line, at least, and hash functions: 1.2 % of false positives or less.
BITS, PROBES = 10, 4
#: Bits of a filter at most. A task that builds filters holds two, 128 MiB each.
MOST_BITS = 1 << 30
#: Bytes of a filter that are merged at once.
PIECE = 1 << 14
#: Bytes of line keys that are broadcast at most.
MOST_KEY_BYTES = 32 << 20


def filter_bits(n_lines: int, most_bits: int = MOST_BITS) -> int:
    """A power of two."""
    return min(most_bits, max(8 * PIECE, 1 << (BITS * n_lines - 1).bit_length()))


class Bloom:
    """A Bloom filter of ``size`` bits, a power of two, over arrays of unsigned 64-bit hashes."""

    def __init__(self, size: int, bits: bytes | None = None) -> None:
        self.size = np.uint64(size)
        self.bits = np.zeros(size // 8, np.uint8) if bits is None else np.frombuffer(bits, np.uint8)

    def _places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(PROBES):
            place = (hashes + np.uint64(k) * step) & (self.size - np.uint64(1))
            yield (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for at, bit in self._places(hashes):
            np.bitwise_or.at(self.bits, at, bit)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at, bit in self._places(hashes):
            found &= self.bits[at] & bit != 0
        return found


def line_key(line: bytes) -> bytes:
    """A UTF-8 line without white space at both ends, A-Z in lower case."""
    return line.strip(STRIP).lower()


def is_long(key: bytes, least_length: int) -> bool:
    """Whether a key has so many code points; each is one to four bytes."""
    return len(key) >= least_length and (len(key) >= 4 * least_length or len(key.decode()) >= least_length)


def hashed_keys(text: bytes, least_length: int) -> dict[bytes, int]:
    """The distinct long line keys of a text, and their hashes."""
    if len(text) < least_length:
        return {}
    keys = {line_key(x) for x in text.split(b"\n") if len(x) >= least_length}
    return {k: xxhash.xxh64_intdigest(k) for k in keys if is_long(k, least_length)}


def count_lines(docs: DataFrame, least_length: int) -> int:
    """How many lines of so many characters (text) can have at most."""
    text = F.col("text")
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1
    return docs.agg(F.sum(F.least(lines, F.floor(F.octet_length(text) / (least_length + 1)) + 1))).first()[0] or 0


def seen_again(docs: DataFrame, least_length: int, size: int) -> bytes:
    """The bits of the merged filter of hashes seen again, over all of (text binary)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = Bloom(size), Bloom(size)
        for batch in batches:
            found = [h for text in batch.column("text") for h in hashed_keys(text.as_py(), least_length).values()]
            hashes, times = np.unique(np.array(found, np.uint64), return_counts=True)
            again.add(hashes[(times > 1) | once.holds(hashes)])
            once.add(hashes)
        for piece in np.flatnonzero(once.bits.reshape(-1, PIECE).any(axis=1)):
            both = [zlib.compress(x.bits[piece * PIECE : (piece + 1) * PIECE].tobytes(), 1) for x in (once, again)]
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), *(pa.array([x], pa.binary()) for x in both)], ["piece", "once", "again"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by piece, so that one pair of pieces is held."""
        at, once, again = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(again.tobytes(), 1)], pa.binary())], ["piece", "again"])
        for batch in batches:
            for piece, x, y in zip(batch.column("piece").to_pylist(), batch.column("once"), batch.column("again"), strict=True):
                if piece != at:
                    if at is not None and again.any():
                        yield done()
                    at, once, again = piece, np.zeros(PIECE, np.uint8), np.zeros(PIECE, np.uint8)
                x, y = (np.frombuffer(zlib.decompress(z.as_py()), np.uint8) for z in (x, y))
                again |= y | (once & x)
                once |= x
        if at is not None and again.any():
            yield done()

    bound_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(build, "piece int, once binary, again binary")
    merged = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece int, again binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in merged.toLocalIterator():
        bits[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(zlib.decompress(row["again"]), np.uint8)
    return bits.tobytes()


def cleaner(lost: Callable[[bytes], bool], text: bytes, least_length: int) -> tuple[int, int, bytes]:
    """Lines, lines dropped, and the text of the rest."""
    lines = text.split(b"\n")
    kept = [x for x in lines if len(x) < least_length or not lost(line_key(x))]
    return len(lines), len(lines) - len(kept), text if len(kept) == len(lines) else b"\n".join(kept)


def drop_repeated_lines(docs: DataFrame, least_docs: int = 5, least_length: int = 40, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), most_bits: int | None = None, most_key_bytes: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text, and the columns of ``carry``.

    A line's key is the line without white space at both ends and with A-Z in
    lower case. Keys of ``least_length`` characters or more that
    ``least_docs`` documents or more hold lose their lines in all documents but
    the one with the largest id. Null and empty texts are one empty line. Rows
    that share an id count as one document, and each of them is cleaned; rows
    with a null id are returned as they are and do not count. A text of any
    length is split in one task's memory; texts stay where they are.

    A task holds two filters of ``most_bits`` bits at most, and the driver one.
    Repeated lines of ``most_key_bytes`` bytes in all are broadcast; beyond
    that, texts and lines are shuffled by document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    known = rows.where("_id IS NOT NULL")
    n_lines = count_lines(docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")), least_length)
    size = filter_bits(n_lines, MOST_BITS if most_bits is None else most_bits)
    shared = spark.sparkContext.broadcast(seen_again(known, least_length, size))

    def suspects(batch: pa.RecordBatch) -> pa.RecordBatch:
        again, ids, keys, hashes = Bloom(size, shared.value), [], [], []
        for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("text"), strict=True):
            found = hashed_keys(text.as_py(), least_length)
            ids += [doc_id] * len(found)
            keys += found
            hashes += found.values()
        some = np.flatnonzero(again.holds(np.array(hashes, np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.int64()), pa.array([keys[i] for i in some], pa.binary())], ["_id", "key"])

    exact = map_batches(known.select("_id", "text"), suspects, "_id long, key binary").dropDuplicates(["_id", "key"])
    common = cut_lineage(exact.groupBy("key").agg(F.count("*").alias("n"), F.max("_id").alias("keeper")).where(F.col("n") >= least_docs))
    carried = [f"carried_{i}" for i in range(len(carry))]
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)

    def clean(batch: pa.RecordBatch, lost_of: Callable[[int, int | None], Callable[[bytes], bool] | None]) -> pa.RecordBatch:
        counts, drops, texts = [], [], []
        for i, (doc_id, text) in enumerate(zip(batch.column("_id").to_pylist(), batch.column("text"), strict=True)):
            lost = lost_of(i, doc_id)
            n, dropped, kept = cleaner(lost, text.as_py(), least_length) if lost else (text.as_py().count(b"\n") + 1, 0, text.as_py())
            counts.append(n)
            drops.append(dropped)
            texts.append(kept)
        made = [pa.array(counts, pa.int64()), pa.array(drops, pa.int64()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("_id"), *made, *(batch.column(c) for c in carried)], ["doc_id", "n_lines", "n_dropped", "kept_text", *carried])

    key_bytes = common.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0
    if key_bytes <= (MOST_KEY_BYTES if most_key_bytes is None else most_key_bytes):
        table = common.select("key", "keeper").toArrow()
        keepers = spark.sparkContext.broadcast(dict(zip(table.column("key").to_pylist(), table.column("keeper").to_pylist(), strict=True)))

        def clean_in_place(batch: pa.RecordBatch) -> pa.RecordBatch:
            keeper = keepers.value.get
            return clean(batch, lambda i, doc_id: None if doc_id is None else lambda key: keeper(key, doc_id) != doc_id)

        cleaned = map_batches(rows, clean_in_place, "doc_id long, n_lines long, n_dropped long, kept_text binary" + kinds)
    else:
        exact = cut_lineage(exact)
        losing = join_skewed(exact, common, ["key"], "n", exact.count()).where("_id <> keeper").groupBy("_id").agg(F.collect_set("key").alias("lost"))

        def clean_joined(batch: pa.RecordBatch) -> pa.RecordBatch:
            lost = batch.column("lost")
            return clean(batch, lambda i, doc_id: None if lost[i].values is None else set(lost[i].as_py()).__contains__)

        nameless = rows.where("_id IS NULL").withColumn("lost", F.lit(None).cast("array<binary>"))
        cleaned = map_batches(known.join(losing, "_id", "left").unionByName(nameless), clean_joined, "doc_id long, n_lines long, n_dropped long, kept_text binary" + kinds)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.col("kept_text").cast("string").alias("kept_text"), *[F.col(a).alias(b) for a, b in zip(carried, carry, strict=True)])


def digests(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
