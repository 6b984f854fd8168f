"""The scene catalogue: search, ranking, pairing, diagnosis, compatibility of rasters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneweave.functions import boxes, lookup, scenes
from sceneweave.operators.cluster import cut_lineage, join_skewed

COREGISTRATION_IOU, GSD_TOLERANCE = 0.90, 0.05
#: By how much a split of a leaf may raise the sum of squared counts.
GROWTH = 1.1
#: Pairs of rasters that a task tells of.
PAIRS = 4_000_000
SIZES, DISTANCES = "pixel dimensions differ", "ground sample distance differs"


def _optical(collection: Column) -> Column:
    return collection.isin([c for c, kind in lookup.COLLECTIONS.items() if kind == "optical"])


def overlaps(west: float, south: float, east: float, north: float) -> Column:
    return (F.col("x1") <= east) & (F.col("x2") >= west) & (F.col("y1") <= north) & (F.col("y2") >= south)


def search_scenes(catalogue: DataFrame, collection: str, bbox: tuple[float, float, float, float], start: Column | None = None, end: Column | None = None, max_cloud: float | None = 20.0) -> DataFrame:
    """Scenes of a collection over a box and within dates (by default the last 60 days).

    The cloud limit is strict, and concerns optical collections only; unknown
    cloud does not pass it. Filters are on plain columns, so that they reach
    the scan.
    """
    start = F.current_date() - F.expr("INTERVAL 60 DAYS") if start is None else start
    end = F.current_timestamp() if end is None else end
    found = catalogue.where((F.col("collection") == collection) & overlaps(*bbox) & (F.col("datetime") >= start) & (F.col("datetime") <= end))
    if max_cloud is not None and lookup.COLLECTIONS.get(collection) == "optical":
        found = found.where(F.col("cloud_cover") < max_cloud)
    return found


def newest(catalogue: DataFrame, limit: int = 12) -> DataFrame:
    """A page of the newest scenes, 1 to 50 of them."""
    return catalogue.orderBy(F.desc("datetime"), "id").limit(min(max(limit, 1), 50))


def newest_per_area(catalogue: DataFrame, limit: int = 12) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("area_id").orderBy(F.desc("datetime"), "id"))
    return catalogue.withColumn("_r", rank).where(F.col("_r") <= min(max(limit, 1), 50)).drop("_r")


def cloud_rank() -> Column:
    """Unknown cloud ranks as full cloud; ties go to the smaller id."""
    return F.struct(F.coalesce("cloud_cover", F.lit(100.0)).alias("c"), F.col("id"))


def clearest(catalogue: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, cloud_cover) of the scene with the least cloud."""
    best = catalogue.groupBy(*by).agg(F.min_by(F.struct("id", "cloud_cover"), cloud_rank()).alias("s"))
    return best.select(*by, "s.id", "s.cloud_cover")


def pair_crossmodal(catalogue: DataFrame, max_cloud: float = 8.0, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(area_id, optical_id, sar_id): the clearest optical scene below the limit and the newest radar scene; areas with only one are left out."""
    window = F.lit(True) if start is None else (F.col("datetime") >= start) & (F.col("datetime") <= end)
    optical = _optical(F.col("collection")) & (F.col("cloud_cover") < max_cloud) & window
    radar = ~_optical(F.col("collection")) & window
    best = catalogue.groupBy("area_id").agg(
        F.min_by("id", F.when(optical, cloud_rank())).alias("optical_id"),
        F.min_by("id", F.when(radar, F.struct((-F.unix_micros(F.col("datetime").cast("timestamp"))).alias("t"), F.col("id")))).alias("sar_id"),
    )
    return best.where("optical_id IS NOT NULL AND sar_id IS NOT NULL")


def pair_bitemporal(catalogue: DataFrame, before: tuple[Column, Column], after: tuple[Column, Column]) -> DataFrame:
    """(area_id, before_id, after_id): the clearest optical scene of each window."""
    within = lambda w: _optical(F.col("collection")) & (F.col("datetime") >= w[0]) & (F.col("datetime") < w[1])
    best = catalogue.groupBy("area_id").agg(F.min_by("id", F.when(within(before), cloud_rank())).alias("before_id"), F.min_by("id", F.when(within(after), cloud_rank())).alias("after_id"))
    return best.where("before_id IS NOT NULL AND after_id IS NOT NULL")


def diagnose(catalogue: DataFrame, requests: DataFrame, limit: int = 12) -> DataFrame:
    """(request_id, kept, filtered_out, clearest, hint) for requests (request_id, collection, area_id, max_cloud).

    filtered_out and hint concern optical requests with a limit that nothing
    passed. Counts stop at the page limit.
    """
    joined = requests.join(catalogue.select(F.col("collection"), "area_id", "cloud_cover", "id"), ["collection", "area_id"], "left")
    passes = F.col("id").isNotNull() & (F.col("max_cloud").isNull() | ~_optical(F.col("collection")) | (F.col("cloud_cover") < F.col("max_cloud")))
    counts = joined.groupBy("request_id", "collection", "max_cloud").agg(F.least(F.count_if(passes), F.lit(limit)).alias("kept"), F.least(F.count("id"), F.lit(limit)).alias("all"), F.min("cloud_cover").alias("clearest"))
    empty = (F.col("kept") == 0) & F.col("max_cloud").isNotNull() & _optical(F.col("collection"))
    clearest_text = F.when(F.col("clearest").isNotNull(), F.format_string("%.0f%%", F.bround("clearest", 0))).otherwise("unknown")
    some = F.concat(F.col("all").cast("string"), F.lit(" acquisition(s) exist here, but none below "), F.format_string("%.0f%%", "max_cloud"), F.lit(" cloud -- the clearest is "), clearest_text, F.lit(". Raise the threshold, widen the dates, or use Sentinel-1: radar is unaffected by the cloud that makes optical unusable."))
    none = F.lit("No acquisitions at all over this footprint in this window. Widen the date range or move the area of interest.")
    return counts.select("request_id", "kept", F.when(empty, F.col("all")).alias("filtered_out"), F.when(empty, F.col("clearest")).alias("clearest"), F.when(empty & (F.col("all") > 0), some).when(empty, none).otherwise("").alias("hint"))


def partly_said(overlap: Column) -> Column:
    return F.format_string("extents only partially overlap (IoU %.2f)", overlap)


def metres(distance: Column) -> Column:
    return F.format_string("%.2f m", distance)


def report_on(x: Column, y: Column, geo_a: Column, both: Column, crs: Column, overlap: Column, partly: Column, sized: Column, other_crs: Column, apart: Column) -> list[Column]:
    """The columns of ``pair_report`` from two raster structs (width, height, gsd_m), and from what is known of their places and the words for it."""
    size = (x["width"] == y["width"]) & (x["height"] == y["height"])
    relative = F.abs(x["gsd_m"] - y["gsd_m"]) / F.greatest(x["gsd_m"], y["gsd_m"])
    known = both & (x["gsd_m"] > 0) & (y["gsd_m"] > 0)
    gsd = F.coalesce(known & (relative <= GSD_TOLERANCE), F.lit(False))
    extent = F.coalesce(overlap >= COREGISTRATION_IOU, F.lit(False))
    same = (crs & extent) | (~(crs & extent) & size & ~geo_a)
    said = F.array_compact(
        F.array(
            F.when(~size, sized),
            F.when(both & ~crs, other_crs),
            F.when(both & ~extent & (overlap > 0), partly),
            F.when(both & (overlap == 0), F.lit("extents do not overlap: images cover different ground")),
            F.when(known & ~gsd, apart),
            F.when(~both, F.lit("one or both inputs are not georeferenced; co-registration assumed from identical pixel dimensions")),
        )
    )
    return [F.coalesce(size, F.lit(False)).alias("size_match"), F.coalesce(crs, F.lit(False)).alias("crs_match"), overlap.alias("extent_iou"), gsd.alias("gsd_match"), F.coalesce(same, F.lit(False)).alias("coregistered"), said.alias("warnings")]


def differ(what: str, x: Column, y: Column) -> Column:
    return F.concat(F.lit(f"{what}: "), x, F.lit(" vs "), y)


def dimensions(width: Column, height: Column) -> Column:
    return F.concat(width, F.lit("x"), height)


def pair_report(a: str = "a", b: str = "b") -> list[Column]:
    """Columns size_match, crs_match, extent_iou, gsd_match, coregistered, warnings for two raster structs.

    A raster has width, height, crs, bounds (a box struct) and gsd_m.
    """
    x, y = F.col(a), F.col(b)
    geo_a, geo_b = x["crs"].isNotNull() & x["bounds"].isNotNull(), y["crs"].isNotNull() & y["bounds"].isNotNull()
    both = geo_a & geo_b
    overlap = F.when(both, boxes.iou(x["bounds"], y["bounds"], None))
    words = [differ(what, of(x), of(y)) for what, of in ((SIZES, lambda r: dimensions(r["width"], r["height"])), ("CRS differs", lambda r: r["crs"]), (DISTANCES, lambda r: metres(r["gsd_m"])))]
    return report_on(x, y, geo_a, both, both & (x["crs"] == y["crs"]), overlap, partly_said(overlap), *words)


def check_named_pairs(pairs: DataFrame, rasters: DataFrame) -> DataFrame:
    """The checks for ``pairs`` (a_id, b_id) of rasters (id, width, height, crs, bounds, gsd_m), whatever their CRS, and without one too.

    Pairs with an id that no raster has are left out.
    """
    raster = F.struct("width", "height", "crs", "bounds", "gsd_m")
    joined = pairs.join(rasters.select(F.col("id").alias("a_id"), raster.alias("a")), "a_id").join(rasters.select(F.col("id").alias("b_id"), raster.alias("b")), "b_id")
    return joined.select("a_id", "b_id", *pair_report())


def _leaves(boxed: DataFrame, most: int, rounds: int) -> DataFrame:
    """(id, crs, x1, y1, x2, y2, level, cx, cy, n): boxes in units of the coarsest cell, filed under the leaves of a quadtree that they touch.

    A round splits the leaves of over ``most`` boxes into their quarters, unless
    the sum of squared counts grows beyond GROWTH: boxes that cover the same
    ground stay together, for splitting would only copy them. A crowd within
    one quarter may gain nothing for some rounds, and is split further down.
    """
    cell = ["crs", "level", "cx", "cy"]

    def quarters(axis: str) -> Column:
        """The halves of a cell along an axis that a box touches, at the level below."""
        scale, first = F.pow(F.lit(2.0), F.col("level")), F.col(f"c{axis}") * 2
        return F.explode(F.sequence(F.greatest(F.floor(F.col(f"{axis}1") * scale), first), F.least(F.floor(F.col(f"{axis}2") * scale), first + 1)))

    def counted(filed: DataFrame) -> DataFrame:
        return filed.groupBy(*cell).agg(F.count("*").alias("n"))

    whole = {f"c{axis}": F.explode(F.sequence(F.floor(f"{axis}1"), F.floor(f"{axis}2"))) for axis in "xy"}
    filed = cut_lineage(boxed.withColumn("level", F.lit(0)).withColumn("cx", whole["cx"]).withColumn("cy", whole["cy"]))
    total, done = filed.count(), []
    for _ in range(rounds):
        sizes = cut_lineage(counted(filed).where(F.col("n") > most))
        if sizes.isEmpty():
            break
        mine = join_skewed(filed, sizes.withColumn("m", F.col("n")), cell, "n", total, "inner")
        split = mine.select("id", "crs", "x1", "y1", "x2", "y2", (F.col("level") + 1).alias("level"), "cx", "cy", "m")
        split = split.withColumn("qx", quarters("x")).withColumn("qy", quarters("y"))
        counts = split.groupBy("crs", "level", "cx", "cy", "qx", "qy").agg(F.count("*").alias("n"), F.first("m").alias("m"))
        worth = counts.groupBy("crs", "level", "cx", "cy").agg(F.sum(F.pow("n", F.lit(2.0))).alias("after"), F.first("m").alias("m")).where(F.col("after") <= GROWTH * F.pow("m", F.lit(2.0)))
        worth = cut_lineage(worth.select(*cell, F.col("m").alias("size")))
        parents = worth.withColumn("level", F.col("level") - 1)
        # Leaves that were not worth a split are done; so are all that are small.
        hot = join_skewed(filed, parents.withColumn("splits", F.lit(True)), cell, "size", total, "left")
        done.append(cut_lineage(hot.where("splits IS NULL").select(*filed.columns)))
        again = join_skewed(split.drop("m"), worth, cell, "size", total, "inner")
        filed = cut_lineage(again.select("id", "crs", "x1", "y1", "x2", "y2", "level", F.col("qx").alias("cx"), F.col("qy").alias("cy")))
    leaves = reduce(DataFrame.unionByName, [*done, filed])
    return join_skewed(leaves, counted(leaves).withColumn("size", F.col("n")), cell, "size", total)


def placed() -> Column:
    """Whether a raster has a CRS and a box whose sides are numbers."""
    return F.col("crs").isNotNull() & F.forall(F.array(*[F.col(f"bounds.{s}") for s in ("x1", "y1", "x2", "y2")]), lambda v: v.isNotNull() & ~F.isnan(v))


def pair_units(rasters: DataFrame, cell: float | None = None, most: int = 1000, rounds: int = 16) -> DataFrame:
    """(crs, level, cx, cy, i, j, block, id, x1, y1, r): units of work in which rasters, or places (id, crs, bounds), meet; see ``check_pairs``."""
    known = rasters.where(placed())
    if cell is None:
        longest = F.max(F.greatest(F.abs(F.col("bounds.x2") - F.col("bounds.x1")), F.abs(F.col("bounds.y2") - F.col("bounds.y1"))))
        cell = known.agg(longest).head()[0] or 1.0
    ends = {f"{axis}{k}": end(f"bounds.{axis}1", f"bounds.{axis}2") for k, end in ((1, F.least), (2, F.greatest)) for axis in "xy"}
    leaves = _leaves(known.select("id", "crs", *[(v / cell).alias(c) for c, v in ends.items()]), most, rounds)
    blocks = F.ceil(F.col("n") / most)
    dealt = leaves.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.join(known.select("id", F.struct(*[c for c in known.columns if c != "id"]).alias("r")), "id")
    return dealt.select("crs", "level", "cx", "cy", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "x1", "y1", "r")


def check_pairs(rasters: DataFrame, cell: float | None = None, least_iou: float = 0.0, most: int = 1000, rounds: int = 16) -> DataFrame:
    """(a_id, b_id, overlap and checks) for all pairs of rasters (id, width, height, crs, bounds, gsd_m) of one CRS that overlap.

    Boxes in different CRS have no common ground to search; ``check_named_pairs``
    compares given pairs. Ids are unique; boxes with a null or NaN side meet nothing.

    Rasters with the very same box are one place. Places are filed under the
    leaves that they touch of a quadtree, whose coarsest cells are of ``cell``,
    or else of the longest side of all boxes; leaves of over ``most`` places are
    split for up to ``rounds`` rounds. What then still holds more (boxes over
    the same ground) is dealt into blocks of about ``most``, and each two blocks
    are a unit of work of their own. So places meet by an equality, and no unit
    holds more than about twice ``most``. Two places are found in one leaf only:
    that of the corner of their intersection.

    What the checks say is told once for each two kinds of raster in each two
    places; then each raster of a kind meets each, in blocks of about ``most``,
    dealt by the number of their pairs.
    """
    return each_pair(pair_kinds(rasters, cell, least_iou, most, rounds))


def pair_kinds(rasters: DataFrame, cell: float | None = None, least_iou: float = 0.0, most: int = 1000, rounds: int = 16) -> DataFrame:
    """(a_ids, b_ids, overlap and checks): what ``check_pairs`` says of each of ``a_ids`` with each larger one of ``b_ids``; see ``each_pair``."""
    known = rasters.where(placed())
    places = cut_lineage(known.groupBy("crs", "bounds").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    dealt = cut_lineage(pair_units(places, cell, most, rounds))
    unit = ["crs", "level", "cx", "cy", "i", "j"]
    left, right = (dealt.select(*unit, *[F.col(c).alias(f"{s}_{c}") for c in ("block", "id", "x1", "y1")], F.col("r").alias(s)) for s in "ab")
    met = left.join(right, unit).where("a_id <= b_id AND (i = j OR a_block != b_block)")
    scale = F.pow(F.lit(2.0), F.col("level"))
    corner = (F.floor(F.greatest("a_x1", "b_x1") * scale) == F.col("cx")) & (F.floor(F.greatest("a_y1", "b_y1") * scale) == F.col("cy"))
    meet = [F.least(f"a.bounds.{k}2", f"b.bounds.{k}2") > F.greatest(f"a.bounds.{k}1", f"b.bounds.{k}1") for k in "xy"]
    found = met.where(corner & meet[0] & meet[1]).select("a_id", "b_id", F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n"), boxes.iou(F.col("a.bounds"), F.col("b.bounds"), None).alias("overlap"))
    # Kept here, so that filters and words below do not take the overlap apart again: methods that long are never compiled.
    found = cut_lineage(found).where((F.col("overlap") > 0) & (F.col("overlap") >= least_iou))
    return _kinds_of(known, places, found, most)


def _kinds_of(known: DataFrame, places: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """Pairs of places ``found`` (a_id, b_id, a_n, b_n, overlap) as pairs of the kinds of raster of ``known`` there, either way round."""
    blocks = lambda n: F.ceil(F.col(n) / most)
    own = known.join(places.select("crs", "bounds", F.col("id").alias("place"), "n"), ["crs", "bounds"]).withColumn("block", F.pmod(F.xxhash64("id"), blocks("n")))
    kinds = own.groupBy("place", "block", "width", "height", "gsd_m").agg(F.collect_list("id").alias("ids"))
    kind = F.struct("ids", "width", "height", "gsd_m", dimensions(F.col("width"), F.col("height")).alias("dimensions"), metres(F.col("gsd_m")).alias("metres"))
    crowds = kinds.groupBy("place", "block").agg(F.collect_list(kind).alias("kinds"))
    pairs = found
    for side in "ab":
        pairs = pairs.withColumn(f"{side}_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks(f"{side}_n") - 1)))
    pairs = pairs.where("a_id <> b_id OR a_block <= b_block").drop("a_n", "b_n").withColumn("partly", partly_said(F.col("overlap")))
    for side in "ab":
        key = [f"{side}_id", f"{side}_block"]
        pairs = pairs.join(crowds.select(F.col("place").alias(key[0]), F.col("block").alias(key[1]), F.col("kinds").alias(f"{side}_kinds")), key)
    # Adaptive execution sees the bytes of crowds, not how many pairs come out of them.
    total = found.agg(F.sum(F.col("a_n") * F.col("b_n"))).head()[0] or 0
    pairs = pairs.repartition(max(1, -(-total // PAIRS)), "a_id", "a_block", "b_id", "b_block")
    way = lambda a, b: F.struct(F.col(f"{a}_kinds").alias("a"), F.col(f"{b}_kinds").alias("b"))
    alone = (F.col("a_id") == F.col("b_id")) & (F.col("a_block") == F.col("b_block"))
    ways = pairs.select("overlap", "partly", F.explode(F.when(alone, F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))).alias("w"))
    met = ways.select("overlap", "partly", F.explode("w.a").alias("a"), F.col("w.b").alias("b")).select("overlap", "partly", "a", F.explode("b").alias("b"))
    x, y, yes = F.col("a"), F.col("b"), F.lit(True)
    report = report_on(x, y, yes, yes, yes, F.col("overlap"), F.col("partly"), differ(SIZES, x["dimensions"], y["dimensions"]), F.lit(None).cast("string"), differ(DISTANCES, x["metres"], y["metres"]))
    return met.select(F.col("a.ids").alias("a_ids"), F.col("b.ids").alias("b_ids"), *report)


def each_pair(kinds: DataFrame) -> DataFrame:
    """``kinds`` (a_ids, b_ids, any columns) as one row for each of ``a_ids`` with each larger one of ``b_ids``: a_id, b_id, those columns."""
    told = [c for c in kinds.columns if c not in ("a_ids", "b_ids")]
    return kinds.select(F.explode("a_ids").alias("a_id"), "b_ids", *told).select("a_id", F.explode("b_ids").alias("b_id"), *told).where("a_id < b_id")


def infer_sets(images: DataFrame) -> DataFrame:
    """(set_id, n, config, roles, reject) from (set_id, position, modality).

    One image is single; two are a cross-modal pair if one of them alone is
    radar, else bi-temporal; more than two are rejected.
    """
    sar = F.col("modality") == "sar"
    sets = images.groupBy("set_id").agg(F.count("*").alias("n"), F.bool_or(sar).alias("has_sar"), F.bool_or(~sar).alias("has_other"), F.array_sort(F.collect_list(F.struct("position", "modality"))).alias("i"))
    config = F.when(F.col("n") == 1, "single").when(F.col("n") > 2, F.lit(None)).when(F.col("has_sar") & F.col("has_other"), "crossmodal_pair").otherwise("bitemporal_pair")
    sets = sets.withColumn("config", config)
    roles = F.when(F.col("config") == "single", "single").when(F.col("config") == "bitemporal_pair", "before,after").when(F.col("config") == "crossmodal_pair", F.array_join(F.transform("i", lambda x: F.when(x["modality"] == "sar", "sar").otherwise("optical")), ","))
    return sets.select("set_id", "n", "config", roles.alias("roles"), F.when(F.col("n") > 2, F.concat(F.col("n").cast("string"), F.lit(" images supplied; one or two are supported"))).alias("reject"))


def describe_rasters(rasters: DataFrame) -> DataFrame:
    """``rasters`` (path, width, height, band_count, dtype, crs, bounds, pixel_x) with gsd_m, georeferenced and modality."""
    geo = F.col("crs").isNotNull() & F.col("bounds").isNotNull()
    gsd = scenes.ground_sample_distance(F.col("pixel_x"), F.col("crs"), F.col("bounds.y1"), F.col("bounds.y2"))
    name = F.element_at(F.split("path", "/"), -1)
    return rasters.withColumns({"gsd_m": gsd, "georeferenced": geo, "modality": scenes.modality(name, F.col("band_count"), F.col("dtype"), geo)})
