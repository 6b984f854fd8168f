"""Near-duplicates by the exact Jaccard similarity of word shingles.

Texts with equal sets of shingles are one node. Candidates come from two
searches: the trie join over SimHash fingerprints, and buckets of MinHash bands,
which also hold the pairs whose fingerprints are far apart. Two sets of
similarity 0.8 share one of 24 bands of four rows but for a chance of 3e-6, and
closer ones but for less. No candidate is a link before its similarity is
computed from both sets, so neither search can join what is not similar.

Each member of a bucket is compared with the bucket's leader first, and the
links form components. In buckets that still hold several components, the nodes
outside the largest one are compared with all others; both sides are cut into
pieces, and each pair of pieces is a unit of work that returns a spanning forest
of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneweave.llm.common import arrow_rows, broadcast_if_few, connected_components, cut_lineage, forget_shuffles, join_skewed, local_components, map_batches, map_whole_groups
from sceneweave.llm.simhash import SEED, fingerprint_links, fingerprint_of, keep_first, shingle_hashes

BANDS, ROWS = 24, 4
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles that are one column block of a unit's product.
COLUMNS = 2048


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted; empty if there are no words."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(values: np.ndarray) -> np.ndarray:
    """One bucket for each band; a set without shingles has none."""
    if not len(values):
        return np.zeros(0, np.int64)
    lowest = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 2048):
        lowest = np.minimum(lowest, (values[at : at + 2048, None] * FACTORS).min(axis=0))
    mixed = (lowest ^ (lowest >> np.uint64(32))) * FACTORS[::-1]
    return (mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + FACTORS[:BANDS]).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def similar_pairs(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs between the sets ``first`` and ``second`` of at least this similarity."""
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    shared = np.bincount(column, minlength=len(values))[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((len(first), len(second)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[lo:hi], column[lo:hi] - start] = 1
        both += block[first] @ block[second].T
    near = both >= similarity * (sizes[first][:, None] + sizes[second][None, :] - both.astype(float)) - 1e-9
    i, j = np.nonzero(near)
    return first[i], second[j]


def with_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_key, fp, node, buckets, size): node stands for the set of shingles, buckets are its bands' keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, nodes, keys, sizes = [], [], [], []
        for x in batch.column(2):
            hashes = shingle_hashes(x.as_py(), shingle)
            values = np.unique(hashes)
            prints.append(fingerprint_of(hashes))
            nodes.append(xxhash.xxh64_intdigest(values.tobytes(), SEED))
            keys.append(band_keys(values))
            sizes.append(len(values))
        signed = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(prints), signed(nodes), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "text_key", "fp", "node", "buckets", "size"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return map_batches(chosen, work, "doc_id long, text_key long, fp long, node long, buckets array<long>, size long")


def read_sets(docs: DataFrame, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted (node, text_key)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).join(broadcast_if_few(wanted), "text_key").dropDuplicates(["node"]).select("node", "text")
    return map_batches(chosen, work, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float, part_rows: int = 10_000) -> DataFrame:
    """The pairs (a, b) whose sets are similar. A node of very many pairs has its set sent to several places, by parts of its pairs."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = batch.column("x"), batch.column("y")
        near = [similar(p.values.to_numpy().view(np.uint64), q.values.to_numpy().view(np.uint64), similarity) for p, q in zip(x, y, strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    joined, total = pairs, pairs.count()
    for end, other, name in (("a", "b", "x"), ("b", "a", "y")):
        counts = cut_lineage(pairs.groupBy(end).agg(F.count("*").alias("n")))
        parts = counts.withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
        ends = cut_lineage(join_skewed(joined, parts, [end], "n", total).withColumn("part", F.pmod(F.xxhash64(other), F.col("parts"))).drop("parts"))
        spread = sets.withColumnRenamed("node", end).join(parts.drop("n"), end).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        joined = ends.join(spread.select(end, "part", F.col("shingles").alias(name)), [end, "part"]).drop("part")
    return map_batches(joined.select("a", "b", "x", "y"), work, "a long, b long")


def links_within(members: DataFrame, sets: DataFrame, similarity: float, unit_rows: int) -> DataFrame:
    """(a, b): a spanning forest of the links between components, among the nodes of each bucket (bucket, node, root)."""
    roots = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    buckets = roots.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("few"))
    buckets = cut_lineage(buckets.select("bucket", "largest", "n", F.ceil(F.col("few") / unit_rows).cast("int").alias("p_pieces"), F.ceil(F.col("n") / unit_rows).cast("int").alias("q_pieces")))
    placed = cut_lineage(join_skewed(members, buckets, ["bucket"], "n", members.count()))
    piece = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = placed.where("root <> largest").select("bucket", piece("p_pieces").alias("p"), every("q_pieces").alias("q"), F.lit(0).alias("side"), "node")
    all_ = placed.select("bucket", every("p_pieces").alias("p"), piece("q_pieces").alias("q"), F.lit(1).alias("side"), "node")
    units = few.union(all_).join(sets, "node")

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, p, q, side, node = (table.column(k).to_numpy() for k in ("bucket", "p", "q", "side", "node"))
        start = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
        for s, e in zip(start, np.append(start[1:], len(node)), strict=True):
            first, second = np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
            if not len(first) or not len(second):
                continue
            sets_here = [x.values.to_numpy().view(np.uint64) for x in table.column("shingles").slice(s, e - s)]
            i, j = similar_pairs(sets_here, first, second, similarity)
            labels = local_components(e - s, i, j)
            linked = np.flatnonzero(node[s:e] != node[s:e][labels])
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(node[s:e][linked]), pa.array(node[s:e][labels[linked]])], ["a", "b"])

    return map_whole_groups(units.select("bucket", "p", "q", "side", "node", "shingles"), ["bucket", "p", "q"], join, "a long, b long")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, budget: int, similarity: float, unit_rows: int) -> DataFrame:
    """(doc_id, text_key, root, component_id), one row per input row."""
    spark = docs.sparkSession
    marked = cut_lineage(with_sets(docs, id_col, text_col, shingle))
    classes = cut_lineage(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("buckets").alias("buckets"), F.first("size").alias("size"), F.count("*").alias("n_rows")))

    prints = marked.select("fp", "node").distinct()
    named = prints.groupBy("fp").agg(F.min("node").alias("chief"))
    far = fingerprint_links(named.select("fp"), budget).distinct()
    far = far.join(named.select(F.col("fp").alias("a"), F.col("chief").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("chief").alias("y")), "b")
    ordered = lambda pairs: pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    far = far.select(F.col("x").alias("a"), F.col("y").alias("b")).union(prints.join(named, "fp").select("node", "chief"))

    members = classes.select("node", "size", F.explode("buckets").alias("bucket"))
    shared = cut_lineage(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by(F.struct("node", "size"), F.xxhash64("bucket", "node")).alias("leader")).where("n > 1"))
    crowd = cut_lineage(join_skewed(members, shared.withColumn("rows", F.col("n")), ["bucket"], "rows", members.count()))
    # Sets whose sizes are further apart than that cannot be so similar.
    fit = F.least("size", "leader.size") >= similarity * F.greatest("size", "leader.size") - 1e-9
    tried = cut_lineage(ordered(far.union(crowd.where(fit).select("node", "leader.node"))))

    forget_shuffles(spark)
    # Nodes of buckets with several components are read as well, whether or not their leader could be like them.
    wanted = tried.select("a").union(tried.select("b")).union(crowd.where("n > 2").select("node")).distinct().withColumnRenamed("a", "node")
    wanted = cut_lineage(classes.select("node", "text_key").join(wanted, "node"))
    sets = cut_lineage(read_sets(docs, text_col, shingle, wanted))
    with arrow_rows(spark, 1000):
        links = cut_lineage(confirmed(tried, sets, similarity))
    forget_shuffles(spark)

    # A bucket of two has had its one pair compared; of equal buckets one is enough.
    roots = connected_components(links)
    crowd = crowd.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = crowd.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")).where("low <> high")
    several = cut_lineage(several.groupBy("rows", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "rows"))
    remaining = cut_lineage(join_skewed(cut_lineage(crowd), several, ["bucket"], "rows", crowd.count()).select("bucket", "node", "root"))
    with arrow_rows(spark, 1000):
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(cut_lineage(links_within(remaining, sets, similarity, unit_rows)))

    forget_shuffles(spark)
    roots = connected_components(links)
    rooted = cut_lineage(classes.select("node", "first_id", "n_rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = cut_lineage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_nodes")))
    ids = cut_lineage(join_skewed(rooted, ids, ["root"], "n_nodes", rooted.count()).select("node", "root", "component_id", "n_rows"))
    return join_skewed(marked.select("doc_id", "text_key", "node"), ids, ["node"], "n_rows", marked.count()).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 6, similarity: float = 0.8, unit_rows: int = 512) -> DataFrame:
    """(doc_id, component_id), one row per input row: texts of at least this similarity link, and links form components.

    A text without words links with its like only. Ids are treated as in ``simhash.near_duplicates``.
    """
    return grouped(docs, id_col, text_col, shingle, budget, similarity, unit_rows).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 6, similarity: float = 0.8, unit_rows: int = 512) -> DataFrame:
    """One row of each component, as ``simhash.keep_first`` chooses it."""
    return keep_first(docs, grouped(docs, id_col, text_col, shingle, budget, similarity, unit_rows), id_col, text_col)
