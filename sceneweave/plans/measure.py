"""What is measured of image sets before a question is asked: the check of each pair, masks, indices, a second pass.

Sets refer to scenes. Each distinct scene is read once and each distinct pair of
scenes measured once, however many sets refer to them; results are joined to the
sets at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneweave.functions import lookup, scenes
from sceneweave.operators import raster
from sceneweave.operators.cluster import cut_lineage
from sceneweave.operators.scenes import check_named_pairs

DEFAULT_PERCENTILE = 95.0


def check_sets(images: DataFrame, rasters: DataFrame) -> DataFrame:
    """(set_id, gsd_m, pixels, first, second, coregistered, check_warnings) of images (set_id, position, scene_id).

    The finest ground sample distance and the largest size of a set count.
    ``rasters`` is (id, width, height, crs, bounds, gsd_m); images of scenes that
    it lacks are left out. One image is registered with itself.
    """
    known = images.join(rasters.select(F.col("id").alias("scene_id"), "width", "height", "gsd_m"), "scene_id")
    sets = known.groupBy("set_id").agg(
        F.min(F.when(F.col("gsd_m") > 0, F.col("gsd_m"))).alias("gsd_m"),
        F.max(F.col("width") * F.col("height")).alias("pixels"),
        F.min_by("scene_id", "position").alias("first"),
        F.max_by("scene_id", "position").alias("second"),
        F.count("*").alias("n"),
    )
    pairs = sets.where("n = 2").select(F.col("first").alias("a_id"), F.col("second").alias("b_id")).distinct()
    report = check_named_pairs(pairs, rasters).select(F.col("a_id").alias("first"), F.col("b_id").alias("second"), F.lit(2).cast("long").alias("n"), "coregistered", "warnings")
    checked = sets.join(report, ["first", "second", "n"], "left").withColumn("coregistered", F.coalesce("coregistered", F.col("n") == 1))
    said = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.when(F.col("coregistered"), F.array().cast("array<string>")).otherwise(F.array(F.lit(lookup.NOT_COREGISTERED))))
    return checked.select("set_id", "gsd_m", "pixels", "first", "second", "coregistered", said.alias("check_warnings"))


def measure_changes(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """``pairs`` (first, second, min_area_frac) with both attempts at a change mask.

    Columns: change (the last attempt that was made), change_first, change_second
    (null where the first was not quiet), as structs of what ``change_mask`` gives.
    The second attempt keeps the floor and lowers the cut; there is no third.
    """
    named = pairs.withColumn("pair_id", F.concat_ws("-", "first", "second"))
    used = named.select(F.col("first").alias("scene_id")).union(named.select("second")).distinct()
    # Percentiles read their input several times: it is found once.
    gray = cut_lineage(raster.to_gray(raster.to_rgb(cut_lineage(pixels.join(used, "scene_id", "left_semi")))))
    of = lambda which: named.select("pair_id", F.col(which).alias("scene_id")).join(gray, "scene_id").drop("scene_id")
    differences = cut_lineage(raster.paired(of("first"), of("second")))
    rules = named.select("pair_id", F.lit(None).cast("double").alias("threshold"), "min_area_frac")
    first = cut_lineage(raster.change_mask(differences, rules))
    again = raster.replan_rules(first).drop("min_area_frac").join(named.select("pair_id", "min_area_frac"), "pair_id")
    second = raster.change_mask(differences.join(again, "pair_id", "left_semi"), again)
    whole = lambda frame, name: frame.select("pair_id", F.struct(*[c for c in frame.columns if c != "pair_id"]).alias(name))
    both = named.join(whole(first, "change_first"), "pair_id").join(whole(second, "change_second"), "pair_id", "left")
    return both.select("first", "second", F.coalesce("change_second", "change_first").alias("change"), "change_first", "change_second")


def measure_optical(scenes_wanted: DataFrame, pixels: DataFrame) -> DataFrame:
    """(scene_id, optical): the optical indices of the wanted scenes (scene_id)."""
    indices = raster.optical_indices(pixels.join(scenes_wanted.distinct(), "scene_id", "left_semi"))
    return indices.select("scene_id", F.struct(*[c for c in indices.columns if c != "scene_id"]).alias("optical"))


def measure_radar(scenes_wanted: DataFrame, pixels: DataFrame) -> DataFrame:
    """(scene_id, percentile, radar): the radar indices of the wanted scenes (scene_id, percentile), from the first band, in dB where it is linear."""
    wanted = cut_lineage(pixels.join(scenes_wanted.select("scene_id").distinct(), "scene_id", "left_semi"))
    decibels = cut_lineage(raster.decibels_where_linear(wanted, raster.is_linear(wanted)).where("band = 1"))
    gray = cut_lineage(raster.stretch(decibels).select("scene_id", "y", "x", (F.col("level") / 255.0).alias("gray")))
    found = None
    for percentile in (92.0, DEFAULT_PERCENTILE):  # all that parameters can be
        own = scenes_wanted.where(F.col("percentile") == percentile).select("scene_id").distinct()
        indices = raster.sar_indices(gray.join(own, "scene_id", "left_semi"), percentile)
        part = indices.select("scene_id", F.lit(percentile).alias("percentile"), F.struct(*[c for c in indices.columns if c != "scene_id"]).alias("radar"))
        found = part if found is None else found.unionByName(part)
    return found


def measure_sets(sets: DataFrame, images: DataFrame, rasters: DataFrame, pixels: DataFrame, unknown_floor: float | None = None) -> DataFrame:
    """One row per set of ``sets`` (set_id, config), with its check and all that its configuration lets measure.

    ``images`` is (set_id, position, modality, scene_id), ``rasters`` as in
    ``check_sets``, ``pixels`` (scene_id, band, y, x, v). Pairs in time have a
    change mask, and a second attempt where the first was quiet; pairs of sensors
    have the indices of both. Single images are not measured. ``unknown_floor``
    is that of pairs whose ground sample distance nobody knows; they have none by
    default.
    """
    checked = cut_lineage(sets.where("config IS NOT NULL").select("set_id", "config").join(check_sets(images, rasters), "set_id"))
    timed = checked.where("config = 'bitemporal_pair'")
    floors = timed.select("first", "second", F.coalesce(scenes.change_floor(F.col("gsd_m"), F.col("pixels")), F.lit(unknown_floor or 0.0)).alias("min_area_frac")).distinct()
    changes = measure_changes(floors, pixels)
    crossed = images.join(checked.where("config = 'crossmodal_pair'").select("set_id", "gsd_m"), "set_id")
    radar_sets = crossed.where("modality = 'sar'").select("set_id", "scene_id", F.coalesce(scenes.builtup_percentile(F.col("gsd_m")), F.lit(DEFAULT_PERCENTILE)).alias("percentile"))
    optical_sets = crossed.where("modality <> 'sar'").select("set_id", "scene_id")
    radar = radar_sets.join(measure_radar(radar_sets.select("scene_id", "percentile"), pixels), ["scene_id", "percentile"]).select("set_id", "radar")
    optical = optical_sets.join(measure_optical(optical_sets.select("scene_id"), pixels), "scene_id").select("set_id", "optical")
    joined = checked.join(timed.select("set_id", "first", "second").join(changes, ["first", "second"]).drop("first", "second"), "set_id", "left").join(radar, "set_id", "left").join(optical, "set_id", "left")
    quiet = F.format_string("first pass found %.2f%% changed, below the 2%% floor; retrying at %s instead of the Otsu split %s", F.col("change_first.changed_area_frac") * 100.0, F.col("change_second.threshold").cast("string"), F.col("change_first.threshold").cast("string"))
    return joined.select(
        "set_id",
        "gsd_m",
        "pixels",
        "coregistered",
        "check_warnings",
        F.col("change.changed_area_frac").alias("changed_area_frac"),
        F.col("change.change_location").alias("change_location"),
        F.col("change.direction").alias("direction"),
        F.col("radar.water_fraction").alias("sar_water_fraction"),
        F.col("radar.builtup_fraction").alias("sar_builtup_fraction"),
        F.col("radar.water_location").alias("sar_water_location"),
        F.col("optical.water_fraction").alias("optical_water_fraction"),
        F.col("optical.builtup_fraction").alias("optical_builtup_fraction"),
        F.col("change_first.confidence").alias("change_confidence"),
        F.col("change_second.confidence").alias("change_confidence_2"),
        F.col("change_second.threshold").alias("change_threshold_2"),
        F.when(F.col("change_second").isNotNull(), quiet).alias("change_reason_2"),
    )
