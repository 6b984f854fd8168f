"""Raster measurement over pixel tables: (scene_id, band, y, x, v), one row per pixel.

Thresholds come from histograms: a scene of any size is 256 counts after the
map side, and quadrants are four. Percentiles are exact, by selection in bounded
memory; ``approximate`` takes a sketch instead, in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneweave.functions import scenes
from sceneweave.operators.selection import exact_percentiles

BINS = 256
QUIET = 0.02


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def to_db(v: Column) -> Column:
    return 10.0 * F.log10(F.greatest(v, F.lit(1e-6)))


def norm_diff(a: Column, b: Column) -> Column:
    return F.when(F.abs(a + b) > 1e-6, (a - b) / (a + b)).otherwise(0.0)


def percentiles(pixels: DataFrame, keys: list[str], shares: tuple[float, ...], value: str, approximate: bool = False) -> DataFrame:
    """(keys, p): percentiles of the finite values of each group."""
    usable = pixels.select(*keys, F.when(finite(F.col(value)), F.col(value)).alias("v"))
    if approximate:
        return usable.groupBy(*keys).agg(F.percentile_approx("v", list(shares), 100_000).alias("p"))
    return exact_percentiles(usable, keys, shares)


def stretch_limits(pixels: DataFrame, keys: list[str], low: float = 0.02, high: float = 0.98, value: str = "v", approximate: bool = False) -> DataFrame:
    """(keys, lo, hi): percentiles of the finite values, or their range where the percentiles are equal."""
    limits = percentiles(pixels, keys, (0.0, low, high, 1.0), value, approximate)
    flat = F.col("p")[2] <= F.col("p")[1]
    return limits.select(*keys, F.when(flat, F.col("p")[0]).otherwise(F.col("p")[1]).alias("lo"), F.when(flat, F.col("p")[3]).otherwise(F.col("p")[2]).alias("hi"))


def stretch(pixels: DataFrame, keys: tuple[str, ...] = ("scene_id", "band"), low: float = 0.02, high: float = 0.98, value: str = "v", approximate: bool = False) -> DataFrame:
    """``pixels`` with level, 0 to 255, cut off below; 0 for flat bands and values that are not finite."""
    limits = stretch_limits(pixels, list(keys), low, high, value, approximate)
    share = F.least(F.greatest((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    level = F.when(finite(F.col(value)) & (F.col("hi") > F.col("lo")), F.floor(share * 255.0)).otherwise(0).cast("int")
    return pixels.join(limits, list(keys)).withColumn("level", level).drop("lo", "hi")


def is_linear(pixels: DataFrame, rasters: DataFrame | None = None, reference_dtype: bool = False, approximate: bool = False) -> DataFrame:
    """(scene_id, linear): at most two bands, a float type, nothing negative, and a 99th percentile over eight times the median.

    The stored type comes from ``rasters`` (scene_id, dtype); with
    ``reference_dtype`` every raster counts as float.
    """
    usable = F.when(finite(F.col("v")), F.col("v"))
    stats = pixels.groupBy("scene_id").agg(F.count_distinct("band").alias("bands"), F.min(usable).alias("least")).join(percentiles(pixels, ["scene_id"], (0.5, 0.99), "v", approximate), "scene_id")
    typed = F.lit(True)
    if rasters is not None and not reference_dtype:
        stats = stats.join(rasters.select("scene_id", "dtype"), "scene_id", "left")
        typed = F.coalesce(F.col("dtype").startswith("float"), F.lit(False))
    skew = F.coalesce((F.col("p")[0] > 0) & (F.try_divide(F.col("p")[1], F.col("p")[0]) > 8.0), F.lit(False))
    return stats.select("scene_id", ((F.col("bands") <= 2) & typed & F.coalesce(F.col("least") >= 0, F.lit(False)) & skew).alias("linear"))


def decibels_where_linear(pixels: DataFrame, linear: DataFrame) -> DataFrame:
    return pixels.join(linear, "scene_id", "left").withColumn("v", F.when(F.coalesce("linear", F.lit(False)), to_db(F.col("v"))).otherwise(F.col("v"))).drop("linear")


def band_count(bands: int | None) -> Column:
    """Aggregate n: how many bands a scene has, by its largest band or by the layout of all scenes, whose bands may be absent."""
    return F.max("band" if bands is None else F.lit(bands)).alias("n")


def to_rgb(pixels: DataFrame, bands: int | None = None) -> DataFrame:
    """(scene_id, y, x, r, g, b): stretched preview bands, or band 1 as grey.

    Where the layout says how many ``bands`` scenes have, a scene that lacks some
    of them is no other kind of scene: those channels are null.
    """
    counts = pixels.groupBy("scene_id").agg(band_count(bands), F.min("band").alias("first"))
    choice = F.coalesce(scenes.preview_bands(F.col("n")), F.array(F.col("first"), F.col("first"), F.col("first")))
    wanted = counts.select("scene_id", F.posexplode(choice).alias("channel", "band"))
    needed = pixels.join(wanted.select("scene_id", "band").distinct(), ["scene_id", "band"], "left_semi")
    levels = stretch(needed).join(wanted, ["scene_id", "band"]).select("scene_id", "y", "x", "channel", "level")
    if bands is not None:
        # Places that only other bands cover have a row, too.
        others = pixels.join(wanted.select("scene_id", "band").distinct(), ["scene_id", "band"], "left_anti")
        levels = levels.unionByName(others.select("scene_id", "y", "x", F.lit(None).cast("int").alias("channel"), F.lit(None).cast("int").alias("level")))
    channel = lambda k, name: F.max(F.when(F.col("channel") == k, F.col("level"))).alias(name)
    return levels.groupBy("scene_id", "y", "x").agg(channel(0, "r"), channel(1, "g"), channel(2, "b"))


def to_gray(rgb: DataFrame) -> DataFrame:
    """(scene_id, y, x, gray) with gray in 0 to 1."""
    return rgb.select("scene_id", "y", "x", ((F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114) / 255.0).alias("gray"))


def sar_composite(pixels: DataFrame) -> DataFrame:
    """(scene_id, y, x, vv, vh, diff) from band 1 and band 2, already in dB."""
    band = lambda k: F.max(F.when(F.col("band") == k, F.col("v")))
    return pixels.groupBy("scene_id", "y", "x").agg(band(1).alias("vv"), band(2).alias("vh")).withColumn("diff", F.col("vv") - F.col("vh"))


def otsu(gray: DataFrame, key: str = "scene_id", value: str = "gray") -> DataFrame:
    """(key, cut): the threshold of largest variance between classes over 256 bins of 0 to 1; first maximum, 0.5 for a single bin.

    One row per bin leaves the map side, so a window holds 256 rows per key.
    """
    v = F.col(value)
    inside = gray.where(finite(v) & (v >= 0) & (v <= 1))
    hist = inside.withColumn("bin", F.least(F.floor(v * BINS), F.lit(BINS - 1)).cast("int")).groupBy(key, "bin").agg(F.count("*").cast("double").alias("c"))
    return otsu_of_counts(hist, gray.select(key).distinct(), key)


def otsu_of_counts(hist: DataFrame, keys: DataFrame, key: str = "scene_id") -> DataFrame:
    """(key, cut) for each of ``keys``, from counts (key, bin, c) of 256 bins."""
    centre = (F.col("bin") + 0.5) / BINS
    upto = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    sums = hist.select(key, "bin", F.sum("c").over(upto).alias("w0"), F.sum(F.col("c") * centre).over(upto).alias("s0"), F.sum("c").over(whole).alias("w"), F.sum(F.col("c") * centre).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    between = F.when(w1 > 0, F.col("w0") * w1 * gap * gap)
    best = sums.groupBy(key).agg(F.max_by(centre, F.when(between.isNotNull(), F.struct(F.round(between, 9), -F.col("bin")))).alias("cut"))
    return keys.join(best, key, "left").select(key, F.coalesce("cut", F.lit(0.5)).alias("cut"))


def quadrant_counts(hit: Column, y: str = "y", x: str = "x", h: str = "h", w: str = "w") -> list[Column]:
    """Aggregates nw, ne, sw, se: hits per quadrant, with edges at whole halves."""
    top, left = F.col(y) < F.floor(F.col(h) / 2), F.col(x) < F.floor(F.col(w) / 2)
    return [F.count_if(hit & top & left).alias("nw"), F.count_if(hit & top & ~left).alias("ne"), F.count_if(hit & ~top & left).alias("sw"), F.count_if(hit & ~top & ~left).alias("se")]


def quadrant_phrase(prefix: str = "") -> Column:
    """From nw, ne, sw, se: where a mask lies. Equal counts keep the order NW, NE, SW, SE."""
    names = [("north-west", "nw", 3), ("north-east", "ne", 2), ("south-west", "sw", 1), ("south-east", "se", 0)]
    counts = [F.col(prefix + c) for _, c, _ in names]
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(n.alias("n"), F.lit(k).alias("k"), F.lit(name).alias("name")) for n, (name, _, k) in zip(counts, names, strict=True)])))
    total = counts[0] + counts[1] + counts[2] + counts[3]
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return (
        F.when(total == 0, "nowhere")
        .when(first["n"] / total < 0.35, "spread across the scene")
        .when(second["n"] / total > 0.28, F.concat(F.lit("mainly "), first["name"], F.lit(" and "), second["name"]))
        .otherwise(F.concat(F.lit("mainly "), first["name"]))
    )


def sizes(pixels: DataFrame, key: str = "scene_id") -> DataFrame:
    return pixels.groupBy(key).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def quadrant_summary(mask: DataFrame, key: str = "scene_id") -> DataFrame:
    """(key, fraction, location) of a mask (key, y, x, hit)."""
    counted = mask.join(sizes(mask, key), key).groupBy(key).agg(F.avg(F.col("hit").cast("int")).alias("fraction"), *quadrant_counts(F.col("hit")))
    return counted.select(key, "fraction", quadrant_phrase().alias("location"))


def optical_indices(pixels: DataFrame, water_threshold: float = 0.0, builtup_threshold: float = 0.0, bands: int | None = None) -> DataFrame:
    """(scene_id, applicable, water_fraction, water_location, builtup_fraction, builtup_location, reason).

    ``bands`` is as in ``to_rgb``. Pixels without green or near-infrared take no
    part; a scene without any other has a null fraction, and water nowhere.
    """
    counts = pixels.groupBy("scene_id").agg(band_count(bands), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    for band in ("green", "nir", "swir"):
        counts = counts.withColumn(band, scenes.band_index(F.col("n"), band))
    band = lambda name: F.max(F.when(F.col("band") == F.col(name), F.col("v"))).alias(f"v_{name}")
    wide = pixels.join(counts.where("nir IS NOT NULL"), "scene_id").where("band IN (green, nir) OR band = swir").groupBy("scene_id", "h", "w", "y", "x").agg(band("green"), band("nir"), band("swir"))
    wide = wide.withColumn("water", norm_diff(F.col("v_green"), F.col("v_nir")) > water_threshold).withColumn("built", norm_diff(F.col("v_swir"), F.col("v_nir")) > builtup_threshold)
    wide = wide.withColumn("water", F.when(F.col("v_green").isNotNull() & F.col("v_nir").isNotNull(), F.col("water"))).withColumn("built", F.when(F.col("v_swir").isNotNull(), F.col("built")))
    q = lambda hit, p: [c.alias(f"{p}_{n}") for c, n in zip(quadrant_counts(hit), ("nw", "ne", "sw", "se"), strict=True)]
    sums = wide.groupBy("scene_id").agg(F.avg(F.col("water").cast("int")).alias("wf"), F.avg(F.col("built").cast("int")).alias("bf"), *q(F.col("water"), "water"), *q(F.coalesce("built", F.lit(False)), "built"))
    out = counts.join(sums, "scene_id", "left").fillna(0, [f"water_{n}" for n in ("nw", "ne", "sw", "se")])
    applicable = F.col("nir").isNotNull()
    return out.select(
        "scene_id",
        applicable.alias("applicable"),
        F.bround("wf", 4).alias("water_fraction"),
        F.when(applicable, quadrant_phrase("water_")).alias("water_location"),
        F.bround("bf", 4).alias("builtup_fraction"),
        F.when(F.col("bf").isNotNull(), quadrant_phrase("built_")).alias("builtup_location"),
        F.when(~applicable, F.concat(F.col("n").cast("string"), F.lit("-band input has no near-infrared band; NDWI and NDBI need one"))).alias("reason"),
    )


def sar_indices(gray: DataFrame, percentile: float | DataFrame = 95.0) -> DataFrame:
    """(scene_id, threshold, water_fraction, water_location, builtup_fraction, builtup_location) of grey radar pixels.

    ``percentile`` is that of built-up ground, for all scenes or by scene
    (scene_id, percentile).
    """
    shares = percentile.select("scene_id", F.array(F.col("percentile") / 100.0).alias("shares")) if isinstance(percentile, DataFrame) else (percentile / 100.0,)
    bright = exact_percentiles(gray, ["scene_id"], shares, "gray").select("scene_id", F.col("p")[0].alias("bright"))
    cuts = otsu(gray).join(bright, "scene_id").join(sizes(gray), "scene_id")
    marked = gray.join(cuts, "scene_id").withColumn("water", F.col("gray") < F.col("cut")).withColumn("built", F.col("gray") > F.col("bright"))
    q = lambda hit, p: [c.alias(f"{p}_{n}") for c, n in zip(quadrant_counts(hit), ("nw", "ne", "sw", "se"), strict=True)]
    sums = marked.groupBy("scene_id").agg(F.max("cut").alias("cut"), F.avg(F.col("water").cast("int")).alias("wf"), F.avg(F.col("built").cast("int")).alias("bf"), *q(F.col("water"), "water"), *q(F.col("built"), "built"))
    return sums.select("scene_id", F.bround("cut", 4).alias("threshold"), F.bround("wf", 4).alias("water_fraction"), quadrant_phrase("water_").alias("water_location"), F.bround("bf", 4).alias("builtup_fraction"), quadrant_phrase("built_").alias("builtup_location"))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, y, x, delta, diff) of two grey tables (pair_id, y, x, gray)."""
    delta = F.col("a") - F.col("b")
    return before.withColumnRenamed("gray", "b").join(after.withColumnRenamed("gray", "a"), ["pair_id", "y", "x"]).select("pair_id", "y", "x", delta.alias("delta"), F.abs(delta).alias("diff"))


def change_mask(pairs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per pair of ``pairs`` (pair_id, y, x, delta, diff): method, threshold, changed_area_frac, location, direction, delta, confidence.

    ``rules`` (pair_id, threshold, min_area_frac) may be null in either column:
    the cut is then Otsu's, the floor 0. A mask below the floor is dropped whole.
    """
    cuts = otsu(pairs, "pair_id", "diff").join(sizes(pairs, "pair_id"), "pair_id")
    if rules is None:
        cuts = cuts.withColumn("threshold", F.lit(None).cast("double")).withColumn("min_area_frac", F.lit(0.0))
    else:
        cuts = cuts.join(rules.select("pair_id", "threshold", "min_area_frac"), "pair_id", "left")
    cuts = cuts.withColumn("used", F.coalesce("threshold", "cut"))
    marked = pairs.join(cuts, "pair_id").withColumn("hit", F.col("diff") > F.col("used"))
    sums = marked.groupBy("pair_id").agg(
        F.max("used").alias("used"),
        F.max("threshold").alias("given"),
        F.coalesce(F.max("min_area_frac"), F.lit(0.0)).alias("floor"),
        F.avg(F.col("hit").cast("int")).alias("changed"),
        F.avg("diff").alias("mean"),
        F.avg(F.when(F.col("hit"), F.col("delta"))).alias("shift"),
        *quadrant_counts(F.col("hit")),
    )
    return change_report(sums)


def change_report(sums: DataFrame) -> DataFrame:
    """What is told of each pair, from its totals (used, given, floor, changed, mean, shift, nw, ne, sw, se)."""
    kept = F.col("changed") >= F.col("floor")
    sums = sums.withColumns({"location": F.when(kept, quadrant_phrase()).otherwise("nowhere"), "delta": F.when(kept, F.coalesce("shift", F.lit(0.0))).otherwise(0.0)}).withColumn("changed", F.when(kept, F.col("changed")).otherwise(0.0))
    direction = F.when(F.col("changed") < QUIET, "no significant change").when(F.col("delta") > 0.02, "brightened").when(F.col("delta") < -0.02, "darkened").otherwise("mixed")
    return sums.select(
        "pair_id",
        F.when(F.col("given").isNull(), "otsu").otherwise("explicit").alias("method"),
        F.bround("used", 4).alias("threshold"),
        F.bround("changed", 4).alias("changed_area_frac"),
        F.col("location").alias("change_location"),
        direction.alias("direction"),
        F.bround("delta", 4).alias("mean_intensity_delta"),
        F.bround(F.least(0.5 + F.abs(F.col("mean") - F.col("used")) * 2.0, F.lit(0.9)), 3).alias("confidence"),
    )


def replan_rules(first: DataFrame, quiet: float = 0.02, scale: float = 0.55) -> DataFrame:
    """(pair_id, threshold, min_area_frac) for a second pass: quiet results of an Otsu cut, at a lower one."""
    lowered = F.bround(F.greatest(F.col("threshold") * scale, F.lit(0.02)), 4)
    quiet_rows = first.where((F.col("method") == "otsu") & (F.col("changed_area_frac") < quiet) & (lowered < F.col("threshold")))
    return quiet_rows.select("pair_id", lowered.alias("threshold"), F.lit(0.0).alias("min_area_frac"))


def replan_change(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """``first`` with attempt 1, and a second attempt for its quiet pairs. There is no third."""
    rules = replan_rules(first)
    again = change_mask(pairs.join(rules.select("pair_id"), "pair_id", "left_semi"), rules)
    return first.withColumn("attempt", F.lit(1)).unionByName(again.withColumn("attempt", F.lit(2)))


def resize(pixels: DataFrame, height: int, width: int, keys: tuple[str, ...] = ("scene_id", "band")) -> DataFrame:
    """Nearest neighbours on a grid of height x width: target y reads source row floor(y * h / height).

    Each source pixel knows which target rows and columns read it, so there is
    no join with a grid.
    """
    shape = pixels.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    read = lambda at, size, target: F.filter(F.sequence(F.floor(F.col(at) * target / F.col(size)).cast("int"), F.least(F.ceil((F.col(at) + 1) * target / F.col(size)), F.lit(target - 1)).cast("int")), lambda t: F.floor(t * F.col(size) / target) == F.col(at))
    placed = pixels.join(shape, list(keys)).withColumn("ty", F.explode(read("y", "h", height))).withColumn("tx", F.explode(read("x", "w", width)))
    return placed.select(*keys, F.col("ty").alias("y"), F.col("tx").alias("x"), *[c for c in pixels.columns if c not in (*keys, "y", "x")])


def stack_bands(pixels: DataFrame, bands: list[int], size: int = 120) -> tuple[DataFrame, DataFrame]:
    """The named bands of each scene on one grid; and the scenes that lack any of them (scene_id, missing)."""
    have = pixels.groupBy("scene_id").agg(F.collect_set("band").alias("have"))
    missing = F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(b) for b in bands]), "have")), ",")
    lacking = have.select("scene_id", missing.alias("missing")).where("missing <> ''")
    wanted = pixels.where(F.col("band").isin(bands)).join(lacking.select("scene_id"), "scene_id", "left_anti")
    return resize(wanted, size, size), lacking


def tile_histograms(tiles: DataFrame) -> DataFrame:
    """(scene_id, bin, c) of packed tiles (scene_id, values array<float in 0..1>): the form for large scenes.

    A tile is counted in one expression, so pixels never become rows before the
    map-side sum. A null keeps its place in a tile and counts in the last bin.
    """
    bins = F.transform("values", lambda v: F.least(F.floor(v.cast("double") * BINS), F.lit(BINS - 1)).cast("int"))
    return tiles.select("scene_id", F.explode(bins).alias("bin")).groupBy("scene_id", "bin").agg(F.count("*").alias("c"))
