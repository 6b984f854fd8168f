"""Spelling variants: words one edit apart, found by pivotal bigrams.

Bigrams are ordered by how many words hold them, rarest first. A word's prefix is
its three first bigrams in that order, with all places of the third. One edit
touches at most one of two disjoint bigrams, so of two disjoint bigrams that a
word chooses from its prefix, its pivots, one is still there in a near word; and
of two near words the one whose prefix ends first has such a pivot within the
prefix of the other. Which two bigrams are cheapest to look up is found by dynamic
programming over the places of the prefix.

The edit lies on one side of the surviving pivot. On the other side the words are
equal, and the pivot's place from there is the same in both. So the index has each
prefix bigram under the word's length and the text up to and with the bigram, and
under the length and the text from the bigram on; pivots are looked up under the
lengths that one edit can lead to. What meets is verified.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneweave.llm.common import cut_lineage, map_batches

# What a word is made of, how texts are thinned out, and which words count.
RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
DROPPED = 199
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5

#: Distinct words that a task counts before it passes them on.
HELD = 200_000
PREFIX = 3


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, A to Z in lower case, with how often they occur.

    A run whose crc32 with the id before it is a multiple of 199 loses a letter.
    Null texts have no words; with a null id no run loses a letter. Repeated
    rows count as often as they occur. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = Counter(RUN.findall((text.as_py() or "").translate(LOWER)))
                if doc_id is not None:
                    start = crc32(b"%d:" % doc_id)
                    for word in [w for w in words if not crc32(w.encode(), start) % DROPPED]:
                        at = crc32(word.encode(), start) % len(word)
                        n = words.pop(word)
                        # What it becomes may be a word of the text, too, and is not thinned out again.
                        held[word[:at] + word[at + 1 :]] += n
                held.update(words)
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return rows.mapInArrow(count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def pivots(places: list[int], cost: list[int]) -> list[int]:
    """The two disjoint bigrams of least total cost, by places in ascending order.

    One pass: the cheapest bigram that ends before the present one is carried
    along, as in a table of (bigrams chosen) x (place).
    """
    best, chosen = None, []
    cheapest, behind = None, 0
    for i, at in enumerate(places):
        while places[behind] + 2 <= at:
            if cheapest is None or cost[behind] < cost[cheapest]:
                cheapest = behind
            behind += 1
        if cheapest is not None and (best is None or cost[cheapest] + cost[i] < best):
            best, chosen = cost[cheapest] + cost[i], [places[cheapest], at]
    return chosen


def signatures(word: str, rank: dict[str, int], held_by: dict[str, int]) -> tuple[list[str], list[str], int]:
    """(keys under which a word is indexed, keys under which it looks others up, rank of its last prefix bigram)."""
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    order = sorted(range(len(grams)), key=lambda i: (rank[grams[i]], i))
    last = rank[grams[order[min(PREFIX, len(order)) - 1]]]
    prefix = [i for i, g in enumerate(grams) if rank[g] <= last]
    n = len(word)
    index = [key for i in prefix for key in (f"<{n}{word[: i + 2]}", f">{n}{word[i:]}")]
    asked = []
    for i in pivots(prefix, [held_by[grams[j]] for j in prefix]):
        asked += [key for length in (n - 1, n, n + 1) for key in (f"<{length}{word[: i + 2]}", f">{length}{word[i:]}")]
    return index, asked, last


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): pairs of ``words`` (word, n), three letters at least, that differ by one inserted, deleted or replaced letter; each pair once, a < b.

    The bigrams and their counts go to the driver and to all tasks: there are no
    more than pairs of letters in the words' alphabet, some thousands.
    """
    grams = F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")
    counted = words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").count().collect()
    held_by = {r["gram"]: r["count"] for r in counted}
    rank = {g: k for k, (_, g) in enumerate(sorted((c, g) for g, c in held_by.items()))}

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, index, asked, last = batch.column("word").to_pylist(), [], [], []
        for word in texts:
            one, two, rarest = signatures(word, rank, held_by)
            index.append(one)
            asked.append(two)
            last.append(rarest)
        keys = pa.list_(pa.string())
        # Letters as bits: one edit changes two of them at most.
        masks = [sum({1 << (ord(c) % 64) for c in word}) for word in texts]
        masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        return pa.RecordBatch.from_arrays([batch.column("word"), pa.array(index, keys), pa.array(asked, keys), pa.array(last, pa.int32()), pa.array(masks, pa.int64())], ["word", "index", "asked", "last", "letters"])

    signed = cut_lineage(map_batches(words.select("word"), sign, "word string, index array<string>, asked array<string>, last int, letters long"))
    filed = lambda column: signed.select(F.explode(column).alias("text"), "word", "last", "letters").select(F.xxhash64("text").alias("key"), "word", "last", "letters")
    met = filed("asked").alias("r").join(filed("index").alias("s"), "key")
    met = met.where("r.last <= s.last AND r.word <> s.word AND bit_count(r.letters ^ s.letters) <= 2").where(F.levenshtein("r.word", "s.word", 1) == 1)
    return met.select(F.least("r.word", "s.word").alias("a"), F.greatest("r.word", "s.word").alias("b")).distinct()


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root) for ``forms`` (word, form), both never null: where forms lead in the end.

    Each round doubles the steps that a word has gone, so that a chain of length
    n takes log2 n rounds; forms have to be without circles, as they are where
    each is more frequent than its word. The driver sees one count a round.
    """
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at
    raise RuntimeError("forms lead in a circle")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of that length and count.

    A word's form is its most frequent near word (ties: the first in code-point
    order), if that is ``factor`` times as frequent; its root is where forms lead
    in the end, or itself. Null and empty texts have no words, an empty table no
    rows; see ``count_words`` for ids and repeated rows. ``least_length`` is 4 or
    more, so that a word has two disjoint bigrams.
    """
    if least_length < 4:
        raise ValueError("words need two disjoint bigrams beside an edit: four letters at least")
    counted = count_words(docs, id_col, text_col)
    words = cut_lineage(counted.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count)))
    pairs = cut_lineage(near_pairs(words))
    both = pairs.union(pairs.select("b", "a"))
    near = both.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word"))
    near = near.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("order"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(near, "word", "left").withColumn("form_n", -F.col("best.order"))
    has = F.col("form_n") >= factor * F.col("n")
    formed = cut_lineage(joined.select("word", F.when(has, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")))
    found = formed.join(roots(formed.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
