"""SimHash near-duplicates: a binary trie joined with itself.

A document's fingerprint has bit i set if over half of its word shingles' XXH64
values have it set. Fingerprints link when at most ``budget`` of 64 bits differ,
and linked fingerprints form components.

The trie join. Two trie nodes are visited together, their differing bits are
added up, and a pair is dropped as soon as the sum passes the budget. Chains of
nodes with one child are one step. To deal the trie out over tasks, its bits are taken in several
orders ("views"): the 64 bits form ``budget + 2`` blocks, and each view puts two
of the blocks on top. Two fingerprints with at most ``budget`` differing bits
agree in two whole blocks, so in some view they share the node below those
blocks; only pairs of one node with itself start there. Groups of a view are
therefore independent and small. A node with more than ``unit_rows``
fingerprints is cut into pieces, and each pair of pieces is a unit of work of
its own.

Only distinct fingerprints enter the trie: thousands of equal documents are one
leaf. A unit returns a spanning forest of its links instead of all its pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneweave.llm.common import broadcast_if_few, connected_components, cut_lineage, join_skewed, local_components, map_batches, map_whole_groups

SEED = 42
#: Node pairs that are visited at once.
FRONTIER = 100_000
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
SPACE = re.compile(rb"[ \t-\r]")
FULL = np.uint64(2**64 - 1)


def word_blocks(text: str | None, shingle: int) -> Iterator[list[bytes]]:
    """The text's words in blocks, in each of which shingles begin that no other block has: ``shingle - 1`` words lie in two.

    Words are split off a slice of the text at a time, so that a very long text
    is never a list of all its words.
    """
    data, held, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        cut = len(data)
        if at + SLICE < cut and (space := SPACE.search(data, at + SLICE)):
            cut = space.start()
        words = held + data[at:cut].lower().split()
        at = cut
        if at < len(data) and len(words) < shingle:
            held = words
            continue
        yield words
        held = words[len(words) - shingle + 1 :] if shingle > 1 else []


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each word shingle in order; a shorter text is one shingle, and one without words has none."""
    digest, join, found = xxhash.xxh64_intdigest, b" ".join, []
    for words in word_blocks(text, shingle):
        if len(words) >= shingle:
            some = [digest(join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
            found.append(np.array(some, dtype=np.uint64))
        elif words and not found:
            return np.array([digest(join(words), SEED)], dtype=np.uint64)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a text's shingles; 0 if there are none."""
    bits = np.zeros(64, np.int64)
    values = hashes.astype(">u8")
    for at in range(0, len(values), 8192):
        bits += np.unpackbits(values[at : at + 8192].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(values)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of one text; 0 if it has no words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_key, fp): text_key is the text's hash, fp the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "text_key", "fp"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return map_batches(chosen, work, "doc_id long, text_key long, fp long")


def views(budget: int) -> list[tuple[list[int], int]]:
    """For each view the order of the bits, highest first, and how many of them lie in the two top blocks."""
    blocks = np.array_split(np.arange(63, -1, -1), budget + 2)
    out = []
    for top in combinations(range(len(blocks)), 2):
        first = [int(b) for i in top for b in blocks[i]]
        out.append((first + [b for b in range(63, -1, -1) if b not in set(first)], len(first)))
    return out


def reorder(words: np.ndarray, order: list[int]) -> np.ndarray:
    """The words with bit order[0] moved to the highest place, order[1] to the next, and so on."""
    out = np.zeros_like(words)
    runs = np.split(np.array(order), np.flatnonzero(np.diff(order) != -1) + 1)
    place = 64
    for run in runs:
        place -= len(run)
        mask = np.uint64((1 << len(run)) - 1)
        out |= ((words >> np.uint64(run[-1])) & mask) << np.uint64(place)
    return out


def branch_levels(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The level at which each node [lo, hi) of sorted words has two children; 64 for one word."""
    differ = words[lo] ^ words[hi - 1]
    for shift in (1, 2, 4, 8, 16, 32):
        differ = differ | differ >> np.uint64(shift)
    return 64 - np.bitwise_count(differ).astype(np.int64)


def upper_children(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Where the words with bit ``level`` set begin in each node [lo, hi), by bisection."""
    lo, hi, bit = lo.copy(), hi.copy(), np.uint64(1) << (63 - level).astype(np.uint64)
    while (open_ := lo < hi).any():
        middle = (lo + hi) // 2
        ones = words[np.minimum(middle, len(words) - 1)] & bit != 0
        hi = np.where(open_ & ones, middle, hi)
        lo = np.where(open_ & ~ones, middle + 1, lo)
    return lo


def trie_pairs(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int, lo2: np.ndarray | None = None, hi2: np.ndarray | None = None, visits: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words that differ in at most ``budget`` bits, within each range [lo, hi) or between [lo, hi) and [lo2, hi2).

    Words are sorted within each range, and no word is in both ranges of a
    pair. A node is a range of words that share their bits above its branching
    level. A visit of a node pair adds the bits in which the two differ above
    the first branching level of either, and drops the pair if the sum passes
    the budget; the rest go on to the children, or are two leaves. ``visits``
    counts pairs visited, pruned and found.
    """
    lo, hi = np.asarray(lo, np.int64), np.asarray(hi, np.int64)
    lo2, hi2 = (lo, hi) if lo2 is None else (np.asarray(lo2, np.int64), np.asarray(hi2, np.int64))
    full = (hi > lo) & (hi2 > lo2) & ~((lo == lo2) & (hi - lo == 1))
    stack = [tuple(x[full] for x in (lo, hi, lo2, hi2)) + (np.zeros(full.sum(), np.int64), np.zeros(full.sum(), np.int64))]
    while stack:
        a0, a1, b0, b1, level, differ = stack.pop()
        if not len(a0):
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [tuple(x[half:] for x in (a0, a1, b0, b1, level, differ)), tuple(x[:half] for x in (a0, a1, b0, b1, level, differ))]
            continue
        branch_a, branch_b = branch_levels(words, a0, a1), branch_levels(words, b0, b1)
        to = np.minimum(branch_a, branch_b)
        # The bits from level up to but not including ``to``, which each of the two nodes has in common.
        above = np.where(level == 0, FULL, (np.uint64(1) << (64 - np.maximum(level, 1)).astype(np.uint64)) - np.uint64(1))
        below = np.where(to == 64, np.uint64(0), FULL >> np.minimum(to, 63).astype(np.uint64))
        differ = differ + np.bitwise_count((words[a0] ^ words[b0]) & above & ~below)
        keep, leaves = differ <= budget, to == 64
        if visits is not None:
            visits.update(visited=len(a0), pruned=int((~keep).sum()), found=int((keep & leaves).sum()))
        if (keep & leaves).any():
            yield a0[keep & leaves], b0[keep & leaves]
        a0, a1, b0, b1, differ, to, branch_a, branch_b = (x[keep & ~leaves] for x in (a0, a1, b0, b1, differ, to, branch_a, branch_b))
        middle_a = np.where(branch_a == to, upper_children(words, a0, np.where(branch_a == to, a1, a0), to), a1)
        middle_b = np.where(branch_b == to, upper_children(words, b0, np.where(branch_b == to, b1, b0), to), b1)
        alone = a0 == b0  # a node with itself has one mixed pair of children, not two
        children = [(a0, middle_a, b0, middle_b, to, differ), (middle_a, a1, middle_b, b1, to, differ), (a0, middle_a, middle_b, b1, to, differ), tuple(x[~alone] for x in (middle_a, a1, b0, middle_b, to, differ))]
        a0, a1, b0, b1, to, differ = (np.concatenate(x) for x in zip(*children, strict=True))
        some = (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1))
        stack.append(tuple(x[some] for x in (a0, a1, b0, b1, to, differ)))


def fingerprint_links(fingerprints: DataFrame, budget: int = 4, unit_rows: int = 512) -> DataFrame:
    """(a, b): a spanning forest of the links between the distinct longs in column fp."""
    all_views = views(budget)
    widest = max(width for _, width in all_views)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column(0).to_numpy().view(np.uint64)
        keys = [(reorder(words, order) >> np.uint64(64 - width)).astype(np.int64) + (v << widest) for v, (order, width) in enumerate(all_views)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(words.view(np.int64), len(all_views)))], ["node", "fp"])

    dealt = map_batches(fingerprints.select("fp"), deal, "node long, fp long", rows=1 << 14)
    # Large nodes are cut into pieces; a unit is a pair of pieces of one node.
    large = dealt.groupBy("node").count().where(F.col("count") > unit_rows)
    large = large.select("node", F.ceil(F.col("count") / unit_rows).cast("int").alias("pieces"))
    placed = dealt.join(large, "node", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    placed = placed.select("node", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), "piece", "fp")

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, p, q, piece = (table.column(k).to_numpy() for k in ("node", "p", "q", "piece"))
        fp = table.column("fp").to_numpy()
        words, view = np.zeros(len(fp), np.uint64), node >> widest
        for v in np.unique(view):
            order, width = all_views[v]
            words[view == v] = reorder(fp[view == v].view(np.uint64), order) << np.uint64(width)
        by = np.lexsort((words, piece, q, p, node))
        node, p, q, piece, fp, words = (x[by] for x in (node, p, q, piece, fp, words))
        start = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
        end = np.append(start[1:], len(fp))
        alone = p[start] == q[start]
        distinct, index = np.unique(fp, return_inverse=True)
        labels = np.arange(len(distinct))
        for i, j in trie_pairs(words, start[alone], end[alone], budget):
            labels = local_components(len(distinct), index[i], index[j], labels)
        middle = np.array([s + np.searchsorted(piece[s:e], q[s]) for s, e in zip(start[~alone], end[~alone], strict=True)], np.int64)
        for i, j in trie_pairs(words, start[~alone], middle, budget, middle, end[~alone]):
            labels = local_components(len(distinct), index[i], index[j], labels)
        linked = np.flatnonzero(labels != np.arange(len(distinct)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(distinct[linked]), pa.array(distinct[labels[linked]])], ["a", "b"])

    return map_whole_groups(placed, ["node", "p", "q"], join, "a long, b long")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, budget: int) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id), one row per input row; root is the component's smallest fingerprint."""
    marked = cut_lineage(with_fingerprints(docs, id_col, text_col, shingle))
    classes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")))
    roots = connected_components(fingerprint_links(classes, budget))
    rooted = cut_lineage(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = cut_lineage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_classes")))
    named = join_skewed(rooted, named, ["root"], "n_classes", rooted.count()).select("fp", "root", "component_id", "n_rows")
    return join_skewed(marked, cut_lineage(named), ["fp"], "n_rows", marked.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    A null or blank text has fingerprint zero and links like any other; a
    repeated row is in the result as often as in the input; a row with a null
    id links too, but gives no component its name (a component of null ids
    only has a null component_id). A very long text is hashed a slice at a
    time; a task keeps eight bytes for each of its shingles. Other columns are
    not read.

    A fingerprint of very many documents, and a component of very many
    fingerprints, are joined by broadcast, all others by shuffle.
    """
    found = grouped(docs, id_col, text_col, shingle, budget)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """One row of each component of ``near_duplicates``; see ``keep_first``."""
    return keep_first(docs, grouped(docs, id_col, text_col, shingle, budget), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each root in ``groups`` (doc_id, text_key, root), with all its columns: that of the smallest id.

    Of rows that share this id, the one with the smallest hash of the text
    stays, then the one with the smallest hash of all columns; so equal rows
    are one, and rows of one id in different groups all stay. Rows with a null
    id cannot be named and stay.
    """
    pairs = groups.where("doc_id IS NOT NULL").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("doc_id", "text_key").agg(F.sum("n").alias("n"), F.min("root").alias("root"))
    first = pairs.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.doc_id", "first.text_key", F.lit(True).alias("is_first"))
    pairs = pairs.join(first, ["doc_id", "text_key"], "left").where("is_first IS NULL OR n > 1")
    # What cannot stay as it is: rows that go, and rows that are there more than once. If these are few, texts stay where they are.
    touched = cut_lineage(pairs.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.coalesce("is_first", F.lit(False)).alias("_first")))
    keyed = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_key", F.xxhash64(F.col(text_col).cast("string")))
    once = keyed.join(broadcast_if_few(touched.select("_id", "_key")), ["_id", "_key"], "left_anti").select(*docs.columns)
    repeated = keyed.join(broadcast_if_few(touched.where("_first").select("_id", "_key")), ["_id", "_key"], "left_semi")
    repeated = repeated.groupBy("_id", "_key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return once.union(repeated)
