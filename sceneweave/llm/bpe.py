"""Byte-level BPE: encoding in overlapping chunks, decoding by concatenation.

A text is cut into chunks that overlap. Each chunk is split by the tokenizer's
pattern on its own, anywhere in the cluster. The split from a chunk's start may
be out of step with the split of the whole text at first, but both fall into
step soon: from a boundary that both have, they go on alike, as the pattern
looks only ahead. A chunk looks for the first boundary that the next chunk has
too, and hands over there. Where no such boundary lies in the overlap, the whole
text is split in one piece instead. The pattern has to match every character,
as tokenizers' patterns do.
"""

from __future__ import annotations

import base64
import struct
from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneweave.llm.common import cut_lineage, kept, map_batches

CHUNK, OVERLAP = 4_096, 256
#: Characters from which the chunks of one text are dealt over the cluster; those of shorter texts are encoded and stitched where the text is.
DEAL = 1 << 20
#: Encoded pre-tokens that a worker keeps.
KEPT = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one rank file, made once per Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split, self.known, self.bytes = regex.compile(pattern), {}, {rank: piece for piece, rank in ranks.items()}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        return kept("bpe", (path, pattern), lambda: cls(path, pattern))

    def encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token as little-endian unsigned 32-bit integers."""
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) + len(pieces) > KEPT:
                self.known.clear()
            for piece in dict.fromkeys(pieces):
                if piece not in self.known:
                    ids = self.merges._encode_single_piece(piece)
                    self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)
            found = list(map(self.known.__getitem__, pieces))
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def sure_boundaries(split: regex.Pattern, text: str, start: int) -> list[int]:
    """Starts of the matches from ``start`` on that text after the end could not move.

    Those in the last run of white space are left out, and those within a few
    characters of the end.
    """
    sure = min(len(text.rstrip()), len(text) - 4)
    return [x for x in [m.start() for m in split.finditer(text, start)][:-1] if x < sure]


def encode_part(codec: Codec, k: int, part: str, last: bool, chunk: int, overlap: int) -> tuple[bytes, int, list[int], list[int]] | None:
    """Ids from a chunk's start to where it hands over, that place in the next chunk, and places for taking over with the ids before each.

    None if the next chunk shares no boundary.
    """
    pieces = codec.split.findall(part)
    if last and not k:
        return b"".join(codec.encode(pieces)), 0, [0], [0]
    starts = [0, *accumulate(map(len, pieces))]
    to = len(part)
    if not last:
        mine = set(starts[:-2])
        to = next((x for x in sure_boundaries(codec.split, part, chunk) if x in mine), None)
        if to is None:
            return None
    n = bisect_left(starts, to)
    coded = codec.encode(pieces[:n])
    before = [0, *accumulate(len(x) // 4 for x in coded)]
    head = bisect_left(starts, overlap + 1)
    return b"".join(coded), to - chunk, starts[: min(head, n + 1)], before[:head]


def cut_text(text: str, chunk: int, overlap: int) -> list[tuple[int, str, bool]]:
    """(number, chunk with its overlap, whether it is the last) of a text; an empty text is one empty chunk."""
    return [(k, text[at : at + chunk + overlap], at + chunk >= len(text)) for k, at in enumerate(range(0, max(1, len(text)), chunk))]


def stitched(parts: Iterable[tuple[bytes | None, int | None, list[int] | None, list[int] | None]]) -> bytes | None:
    """The ids of a text from what ``encode_part`` gave for its chunks, in order; None where two chunks share no boundary."""
    ids, start = [], 0
    for coded, handed, at, before in parts:
        if coded is None or start not in at:
            return None
        ids.append(coded[4 * before[at.index(start)] :])
        start = handed
    return b"".join(ids)


def encode_text(codec: Codec, text: str, chunk: int, overlap: int) -> bytes:
    """The ids of a text, chunk by chunk; in one piece where chunks never fall into step."""
    parts = [encode_part(codec, k, part, last, chunk, overlap) or (None,) * 4 for k, part, last in cut_text(text, chunk, overlap)]
    ids = stitched(parts)
    return encode_part(codec, 0, text, True, chunk, overlap)[0] if ids is None else ids


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, deal: int = DEAL) -> DataFrame:
    """(doc_id, ids binary): the ids as little-endian unsigned 32-bit integers, one row per input row.

    A null or empty text has no ids. Rows of equal or null doc_id stay apart.
    Other columns are not read. Every text is encoded in chunks of ``chunk``
    characters that overlap, and stitched. This happens where the text is; only
    the chunks of texts of over ``deal`` characters are dealt over the cluster
    and meet again once encoded, so that a very long text is not one task's
    work. Its ids are one value, as they are one row of the result. Dealt
    chunks are kept in the checkpoint folder, as their rows are numbered there.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    part_schema = "doc_id long, row long, k int, part string, last boolean"
    part_kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
    code_kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def table(found: list[tuple], kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], names.split())

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for doc_id, row, text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "row", "text")), strict=True):
            parts += [(doc_id, row, *part) for part in cut_text(text, chunk, overlap)]
        return table(parts, part_kinds, "doc_id row k part last")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, out = Codec.of(path, pattern), []
        for doc_id, row, k, part, last in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "k", "part", "last")), strict=True):
            found = encode_part(codec, k, part, last, chunk, overlap)
            out.append((doc_id, row, k, *(found or (None, None, None, None))))
        return table(out, code_kinds, "doc_id row k ids handed at before")

    def stitch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, row, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "parts")), strict=True):
            out.append((doc_id, row, stitched((p["ids"], p["handed"], p["at"], p["before"]) for p in sorted(parts, key=lambda p: p["k"]))))
        return table(out, [pa.int64(), pa.int64(), pa.binary()], "doc_id row ids")

    def encode_whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(path, pattern)
        ids = [encode_text(codec, text.as_py(), chunk, overlap) for text in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    coded = lambda parts: map_batches(parts, encode, "doc_id long, row long, k int, ids binary, handed int, at array<int>, before array<long>", rows=256)
    here = map_batches(rows.where(F.length("text") <= deal), encode_whole, "doc_id long, ids binary", rows=256)
    of_more = rows.where(F.length("text") > deal).withColumn("row", F.monotonically_increasing_id())
    cuts = cut_lineage(map_batches(of_more, cut, part_schema, rows=64))
    gathered = coded(cuts.repartition("row", "k")).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("k", "ids", "handed", "at", "before")).alias("parts"))
    stitches = cut_lineage(map_batches(gathered.select("doc_id", "row", "parts"), stitch, "doc_id long, row long, ids binary", rows=64))
    # A text whose chunks never fall into step is put together again and encoded as one chunk.
    stuck = cuts.join(stitches.where("ids IS NULL").select("row"), "row", "left_semi").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
    stuck = stuck.select("doc_id", "row", F.lit(0).alias("k"), F.array_join(F.transform("parts", lambda p: F.substring(p["part"], 1, chunk)), "").alias("part"), F.lit(True).alias("last"))
    return here.union(coded(stuck).select("doc_id", "ids")).union(stitches.where("ids IS NOT NULL").select("doc_id", "ids"))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes of the ids in column decoded."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(path, pattern)
        texts = [codec.decode(np.frombuffer(x.as_py(), "<u4")) for x in batch.column("ids")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), work, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decoded documents."""
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

