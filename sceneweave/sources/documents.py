"""Records of JSON documents of any size: a document is read in as many tasks as it has splits."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneweave.operators.cluster import cut_lineage

#: Splits (about 100 bytes each) that are sent to every task; with more of them, text and splits meet in a shuffle.
MOST_SENT = 200_000
SPLIT = ["file", "at", "size"]
_QUOTE, _COMMA = b'",'
_MARKS, _CHANGE = np.zeros(256, bool), np.zeros(256, np.int64)
_MARKS[list(b'"[]{},')] = True
_CHANGE[list(b"[{")], _CHANGE[list(b"]}")] = 1, -1
_ESCAPE = re.compile(rb"\\.", re.S)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, size, value): text up to each closing brace, which is left out, with the place of its split."""
    meta = {"file": "_metadata.file_path", "at": "_metadata.file_block_start", "size": "_metadata.file_block_length"}
    return spark.read.text(path, lineSep="}").select(*[F.col(c).alias(n) for n, c in meta.items()], "value")


def _by_split(frames: Iterator[pd.DataFrame]):
    """(first row, texts) of each split, in a task's order; texts end in a closing brace."""

    def parts():
        for frame in frames:
            change = (frame[SPLIT] != frame[SPLIT].shift()).any(axis=1).cumsum()
            for _, rows in frame.groupby(change, sort=False):
                yield rows.iloc[0], ("}".join(rows["value"]) + "}").encode()

    for _, group in groupby(parts(), key=lambda p: tuple(p[0][SPLIT])):
        first, text = next(group)
        yield first, chain([text], (t for _, t in group))


def _marks(text: bytes, in_string: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, marks, inside): quotes, brackets and commas, and whether the text after each is within a string."""
    found = np.frombuffer(_ESCAPE.sub(b"  ", text) if b"\\" in text else text, np.uint8)
    places = np.flatnonzero(_MARKS[found])
    marks = found[places]
    return places, marks, (np.cumsum(marks == _QUOTE) + in_string) % 2 == 1


def _effects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a split does to the reader's state: quotes modulo two, and the change of depth if it starts outside or inside of a string."""
    for first, texts in _by_split(frames):
        odd, depth = 0, [0, 0]
        for text in texts:
            _, marks, inside = _marks(text, False)
            change = [int(_CHANGE[marks[inside == k]].sum()) for k in (False, True)]
            depth = [depth[s] + change[s ^ odd] for s in (0, 1)]
            odd ^= int((marks == _QUOTE).sum()) % 2
        yield pd.DataFrame([(*first[SPLIT], odd, *depth)], columns=[*SPLIT, "odd", "outside", "inside"])


class _Reader:
    """Brackets and commas of a split's texts with their places, from a known state on."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth, self.read, self.cut = bool(in_string), int(depth), 0, None

    def marks(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places within the text, marks, depths before them) outside of strings."""
        places, marks, inside = _marks(text, self.in_string)
        quotes = marks == _QUOTE
        change = np.where(inside, 0, _CHANGE[marks])
        depths = self.depth + np.cumsum(change) - change
        self.quotes, self.quote_depths, self.before = places[quotes], depths[quotes], self.cut
        self.depth += int(change.sum())
        self.in_string = bool(quotes.sum() % 2) ^ self.in_string
        # The start of a string that goes on in the next text; None if it lies in another split.
        self.cut = None if not self.in_string else text[self.quotes[-1] :] if len(self.quotes) else self.cut and self.cut + text
        self.read += len(text)
        kept = ~quotes & ~inside
        return places[kept], marks[kept], depths[kept]

    def name(self, text: bytes, place: int) -> str | None:
        """The last string among an object's members before a place of the text that ``marks`` took last."""
        own = self.quotes[(self.quote_depths == 1) & (self.quotes < place)]
        if len(own) > 1:
            return json.loads(text[own[-2] : own[-1] + 1])
        return json.loads(self.before + text[: own[0] + 1]) if len(own) and self.before else None


SEGMENT = "file string, at long, size long, level int, start long, stop long, kind string, key string, first string, commas long"


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of a split within the document's outermost brackets (level 0) and within its members (level 1).

    ``start`` and ``stop`` are places of the brackets, -1 where they are in
    other splits. Of level 1, lists are told, and what crosses a split's end.
    """
    for first, texts in _by_split(frames):
        reader, rows = _Reader(first["in_string"], first["depth"]), []
        open_ = {level: [level, -1, -1, None, None, None, 0] for level in (0, 1) if reader.depth > level}
        for text in texts:
            before, since = reader.read, [-1, -1]
            places, marks, depths = reader.marks(text)
            commas = [places[(marks == _COMMA) & (depths == level + 1)] for level in (0, 1)]
            opens = (_CHANGE[marks] > 0) & (depths >= 0) & (depths < 2)
            edges = np.flatnonzero(opens | ((_CHANGE[marks] < 0) & (depths > 0) & (depths < 3)))
            # Objects that begin and end here tell nothing of level 1.
            brief = np.flatnonzero((marks[edges[:-1]] == ord("{")) & (depths[edges[:-1]] == 1) & opens[edges[:-1]] & ~opens[edges[1:]])
            for k in np.delete(edges, np.concatenate([brief, brief + 1])):
                place, depth, kind = int(places[k]), int(depths[k]), chr(marks[k])
                if opens[k]:
                    following = text[place + 1 : place + 200].lstrip()[:1] or text[place + 1 :].lstrip()[:1]
                    open_[depth] = [depth, before + place, -1, kind, reader.name(text, place) if depth and kind == "[" else None, following.decode(errors="replace"), 0]
                    since[depth] = place
                elif depth - 1 in open_:
                    segment = open_.pop(depth - 1)
                    segment[2] = before + place
                    segment[-1] += int(((commas[depth - 1] > since[depth - 1]) & (commas[depth - 1] < place)).sum())
                    if segment[0] == 0 or segment[3] != "{":
                        rows.append(segment)
            for level, segment in open_.items():
                segment[-1] += int((commas[level] > since[level]).sum())
        rows += open_.values()
        yield pd.DataFrame([(*first[SPLIT], *s) for s in rows], columns=[c.split()[0] for c in SEGMENT.split(", ")])


MEMBER = "nth int, pos long, at long, whole boolean, keyed boolean, text string"


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Columns of MEMBER: members cut at the commas of the chosen list's or object's depth; parts of one where it crosses splits."""
    for first, texts in _by_split(frames):
        if pd.isna(first["in_string"]):
            raise RuntimeError(f"{first['file']} was split differently before; read it again")
        if pd.isna(first["start"]):
            continue
        reader, wanted, start, stop = _Reader(first["in_string"], first["depth"]), int(first["level"]) + 1, int(first["start"]), int(first["stop"])
        active, whole, kept, pos = start == -1, False, [], int(first["before"]) + int(first["base"])

        def rows(pos: int, whole: list[bool], text: list[str], first=first) -> pd.DataFrame:
            return pd.DataFrame({"nth": int(first["nth"]), "pos": np.arange(pos, pos + len(text)), "at": int(first["at"]), "whole": whole, "keyed": bool(first["keyed"]), "text": text})

        for text in texts:
            before, since = reader.read, 0
            places, marks, depths = reader.marks(text)
            if not active and before <= start < reader.read:
                active, whole, since = True, True, start - before + 1
            if not active:
                continue
            ends = places[(marks == _COMMA) & (depths == wanted) & (places >= since)].tolist()
            if before <= stop < reader.read:
                active = False
                ends = [*(e for e in ends if e < stop - before), stop - before]
            if ends:
                starts = [since, *(e + 1 for e in ends[:-1])]
                cut = [text[a:b] for a, b in zip(starts, ends, strict=True)]
                cut[0] = b"".join([*kept, cut[0]])
                yield rows(pos, [whole] + [True] * (len(cut) - 1), [c.decode() for c in cut])
                whole, kept, pos, since = True, [], pos + len(cut), ends[-1] + 1
            if active:
                kept.append(text[since:])
        if active:
            yield rows(pos, [False], [b"".join(kept).decode()])


def _placed(pieces: DataFrame, splits: DataFrame, n: int) -> DataFrame:
    """Pieces with what is known of their split, those of one split in order in one task."""
    if n <= MOST_SENT:
        return pieces.join(F.broadcast(splits), SPLIT, "left")
    return pieces.withColumn("nth", F.monotonically_increasing_id()).repartition(*SPLIT).sortWithinPartitions(*SPLIT, "nth").drop("nth").join(splits.hint("shuffle_merge"), SPLIT, "left").sortWithinPartitions(*SPLIT)


def _states(pieces: DataFrame) -> DataFrame:
    """(file, at, size, in_string, depth, last_depth): the reader's state at the start of each split.

    Effects of splits compose: quotes add up modulo two, and then every split's
    change of depth is known. One row a split takes part, no text.
    """
    effects = pieces.mapInPandas(_effects, "file string, at long, size long, odd int, outside long, inside long")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    in_string = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    states = effects.withColumn("in_string", in_string).withColumn("change", change)
    depth = F.coalesce(F.sum("change").over(before), F.lit(0))
    last = F.sum("change").over(Window.partitionBy("file"))
    return states.select(*SPLIT, "in_string", depth.alias("depth"), last.alias("last_depth"))


def _ranges(segments: DataFrame, containers: tuple[str, ...]) -> DataFrame:
    """(file, at, size, level, start, stop, base, keyed, n): the stretches that hold a document's records, and how many precede each."""
    place = F.struct("at", "start")
    order = Window.partitionBy("file", "level").orderBy("at", "start")
    opener = F.last(F.when(F.col("start") >= 0, place), ignorenulls=True).over(order)
    told = segments.withColumn("opener", opener)
    named = [F.when(F.col("key") == c, k) for k, c in enumerate(containers)]
    rank = F.when((F.col("level") == 1) & (F.col("kind") == "["), F.coalesce(*named, F.when(F.col("first") == "{", len(containers))))
    is_list = F.max((F.col("level") == 0) & (F.col("kind") == "["))
    chosen = told.groupBy("file").agg(is_list.alias("is_list"), F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "at", "start"))).alias("best"))
    listed = chosen.select("file", (~F.col("is_list") & F.col("best").isNotNull()).cast("int").alias("level"), (~F.col("is_list") & F.col("best").isNull()).alias("keyed"), F.struct("best.at", "best.start").alias("best"))
    mine = told.join(listed, ["file", "level"]).where((F.col("level") == 0) | (F.col("opener") == F.col("best")))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file", "level")
    empty = F.max(F.col("first").isin("]", "}")).over(whole)
    n = F.when(empty, 0).otherwise(F.sum("commas").over(whole) + 1)
    return mine.select(*SPLIT, "level", "start", "stop", F.coalesce(F.sum("commas").over(earlier), F.lit(0)).alias("base"), "keyed", n.alias("n"))


def _object(value: str) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def read_split_records(spark: SparkSession, path: str, containers: tuple[str, ...] = ()) -> DataFrame:
    """(pos, _key, record variant) from JSON files of one document each, of any size.

    Documents are those of ``tables.read_records``, with two differences: of
    several lists the first in the file counts, and a list is one of objects if
    its first member is. Text is never a row of more than a record's size nor
    in a task of more than a split's, and none is shuffled but the two ends of
    each split. It is read four times: for what each split does to the depth of
    brackets, for the brackets that hold the records, and for the records and
    the ends. Broken brackets are an error, as far as the end of a document
    tells; one that lacks no more than its last brace is read.
    """
    pieces = _pieces(spark, path)
    states = cut_lineage(_states(pieces))
    n = states.count()
    segments = cut_lineage(_placed(pieces, states.drop("last_depth"), n).mapInPandas(_segments, SEGMENT))
    ranges = cut_lineage(_ranges(segments, containers))
    files = states.groupBy("file").agg(F.max("last_depth").alias("d")).join(ranges.groupBy("file").agg(F.max("n").alias("n"), F.max("keyed").alias("keyed")), "file", "left")
    broken = files.where((~F.col("d").isin(0, -1)) | F.col("n").isNull()).select("file").head()
    if broken:
        raise ValueError(f"unsupported annotation payload: {broken.file}")
    order = Window.orderBy("file")
    files = cut_lineage(files.select("file", "keyed", F.row_number().over(order).alias("nth"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))

    splits = states.drop("last_depth").join(ranges.drop("keyed", "n"), SPLIT, "left").join(files, "file", "left")
    cut = _placed(pieces, splits, n).mapInPandas(_members, MEMBER)
    ends = cut.where("NOT whole").groupBy("nth", "pos", "keyed").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    joined = ends.select("pos", "keyed", F.array_join("parts.text", "").alias("text"))
    members = cut.where("whole").select("pos", "keyed", "text").unionByName(joined).where(F.rlike("text", F.lit(r"[^ \t\r\n]")))
    named = F.get(F.map_entries(F.expr("CAST(parse_json('{' || text || '}') AS map<string,variant>)")), F.lit(0))
    entry = F.when(F.col("keyed"), named).otherwise(F.struct(F.lit(None).cast("string").alias("key"), F.parse_json("text").alias("value")))
    parsed = members.select("pos", "keyed", entry.alias("entry"))
    rows = parsed.select("pos", "keyed", F.col("entry.key").alias("_key"), F.col("entry.value").alias("record"))
    checked = F.when(_object("record"), True).when(F.col("keyed") & ~_object("record"), F.raise_error(F.lit("unsupported annotation payload")).cast("boolean")).otherwise(False)
    return rows.where(checked).select("pos", "_key", "record")
