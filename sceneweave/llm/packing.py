"""Packing by powers of two.

A document's n ids are cut into pieces whose lengths are powers of two, of at
most ``longest``: as many whole sequences as fit, then the binary digits of the
rest from high to low. Each piece is a sequence by itself, so that no sequence
crosses documents and none is padded. Pieces of equal length are brought
together in buckets, and a batch takes the pieces that stand next to each other
in one.
"""

from __future__ import annotations

import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sceneweave.llm.common import kept, map_batches

#: Encoded words that a worker keeps.
KEPT = 300_000
#: Below it all characters are in normal form C, and lower() works on each by itself.
PLAIN = "\u0300"
#: A run of these is one piece; an apostrophe may begin a contraction.
MARKS = string.punctuation.replace("'", "")
#: No byte of UTF-8; it stands for the end of a word.
END = b"\xff"


class WordTokenizer:
    """A tokenizer whose splits never cross white space, applied word by word with a memory of words.

    Words of letters, with or without a mark behind, are merged by tiktoken over
    the same vocabulary; the tokenizer itself encodes the rest, among them words
    with a special token's string inside, which it reads as that token.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.merges, self.ids = self._ranks()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        return kept("packing", path, lambda: cls(path))

    def _ranks(self) -> tuple[tiktoken.Encoding, list[int]]:
        """The vocabulary as ranks of byte strings, and the id of each rank.

        A last byte with its end mark has a lower rank than any merge, so that it is one symbol before merges begin.
        """
        unit = {c: b for b, c in byte_characters().items()}
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        raw = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if token not in special:
                bare = token.removesuffix(suffix) if suffix else token
                raw[bytes(unit[c] for c in bare) + (END if bare != token else b"")] = i
        first = sorted((x for x in raw if len(x.removesuffix(END)) == 1), key=lambda x: (len(x), raw[x]))
        order = first + sorted(raw.keys() - set(first), key=raw.__getitem__)
        missing = [bytes([b]) for b in range(256) if bytes([b]) not in raw]
        order = missing + order
        ids = [raw.get(x, 0) for x in order]
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks={x: r for r, x in enumerate(order)}, special_tokens={}), ids

    def _piece(self, piece: str) -> bytes:
        found = self.merges._encode_single_piece(piece.encode() + END)
        return struct.pack(f"<{len(found)}I", *map(self.ids.__getitem__, found))

    def learn(self, words: list[bytes]) -> None:
        if len(self.known) + len(words) > KEPT:
            self.known.clear()
        rest = []
        for word in words:
            low = word.decode().lower()
            if max(low) >= PLAIN:
                rest.append(word)
            elif low.isalpha():
                self.known[word] = self._piece(low)
            elif (head := low.rstrip(MARKS)) != low and head.isalpha():
                self.known[word] = self._piece(head) + self._piece(low[len(head) :])
            else:
                rest.append(word)
        for word in rest:
            self.known[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        words, out = text.encode().split(), []
        for at in range(0, len(words), KEPT // 4):
            some = words[at : at + KEPT // 4]
            found = list(map(self.known.get, some))
            if None in found:
                self.learn([w for w in dict.fromkeys(some) if w not in self.known])
                if None in (found := list(map(self.known.get, some))):  # the memory was emptied
                    self.learn([w for w in dict.fromkeys(some) if w not in self.known])
                    found = list(map(self.known.get, some))
            out += found
        return b"".join(out)


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two, from large to small, that add up to n."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


#: Bytes of text for each share of a bucket: its pieces fit a task, and a bucket of most of the corpus is many tasks.
SHARE_BYTES = 64 << 20


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, batch_ids: int = 65_536) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, batch_id, and ids if ``with_ids``.

    Every document ends with ``end_id``; a null or blank text is that id alone.
    ``bucket`` is the length. Buckets are dealt out in shares, the more the
    longer the corpus is; within a share of a bucket pieces are numbered by
    doc_id and start. sequence_id is bucket, share and number in one long:
    unique, with gaps between shares. A batch is up to ``batch_ids`` ids' worth
    of consecutive pieces, all of one length.

    A document's ids are in one task's memory, four bytes each, however long
    the text is. Rows with equal or null doc_id are packed like any other.
    ``longest`` must be a power of two. Other columns are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = n_bytes // SHARE_BYTES + 1

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer, pieces = WordTokenizer.of(tokenizer_path), []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = tokenizer.encode(text.as_py() or "") + np.array([end_id], "<u4").tobytes()
            start, n = 0, len(ids) // 4
            for length in piece_lengths(n, longest):
                raw = ids[4 * start : 4 * (start + length)]
                pieces.append((doc_id, start, length, zlib.crc32(raw), n, raw if with_ids else None))
                start += length
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*pieces, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    pieces = map_batches(rows, work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    pieces = pieces if with_ids else pieces.drop("ids")
    # No column of a piece decides alone: the pieces of one long document are spread, too.
    pieces = pieces.withColumn("bucket", F.col("length")).withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shares)))
    number = F.row_number().over(Window.partitionBy("bucket", "share").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")).cast("long") - 1
    placed = pieces.withColumn("number", number)
    power = F.round(F.log2("bucket")).cast("long")
    base = F.shiftleft(power * F.lit(shares) + F.col("share"), 36)
    # At least one piece is a batch, whatever its length.
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(batch_ids) / F.col("bucket")))
    placed = placed.withColumn("sequence_id", base + F.col("number")).withColumn("offset", F.lit(0).cast("long")).withColumn("batch_id", (base + F.floor(F.col("number") / per_batch)).cast("long"))
    return placed.drop("share", "number")


def bucket_summary(packed: DataFrame) -> DataFrame:
    """bucket, n_sequences, n_batches, n_tokens: what each length has."""
    return packed.groupBy("bucket").agg(F.count("*").alias("n_sequences"), F.count_distinct("batch_id").alias("n_batches"), F.sum("length").alias("n_tokens"))
