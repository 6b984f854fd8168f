"""Queries and SQL of the scene catalogue and of raster metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneweave.functions import boxes, scenes, text
from sceneweave.operators import scenes as ops
from sceneweave.plans.fixtures import view, view_sql
from sceneweave.sources import tables

BBOX = (70.5, 10.5, 72.0, 11.5)
START, END, MIDDLE = "2024-01-01", "2030-01-01", "2024-01-15"


def _ts(value):
    return F.lit(value).cast("timestamp_ntz")


def _rasters(spark, sf):
    r = view(spark, sf, "rasters")
    bounds = F.when(F.col("id") % 11 != 0, boxes.box(F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2")))
    return ops.describe_rasters(r.withColumn("bounds", bounds).withColumn("path", F.concat(F.lit("/in/"), "name")))


def a4_flatten_scenes(spark, sf):
    s = view(spark, sf, "scenes")
    feature = F.to_json(F.struct("id", "collection", F.array("x1", "y1", "x2", "y2").alias("bbox"), F.struct(F.date_format(F.col("datetime"), "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover")).alias("properties")))
    f = tables.flatten_scenes(s.select(feature.alias("value")))
    return f.select(F.col("id").cast("long").alias("id"), "collection", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.round("cloud_cover", 6).alias("cloud_cover"), F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"))


def b6_search_scenes(spark, sf):
    s = view(spark, sf, "scenes")
    optical = ops.search_scenes(s, "sentinel-2-l2a", BBOX, _ts(START), _ts(END), 20.0)
    radar = ops.search_scenes(s, "sentinel-1-rtc", BBOX, _ts(START), _ts(END), 20.0)
    return optical.union(radar).select("id", "collection", F.round("cloud_cover", 6).alias("cloud_cover"))


def d3_newest(spark, sf):
    return ops.newest(view(spark, sf, "scenes"), 500).select("id", "area_id")


def d3_newest_per_area(spark, sf):
    return ops.newest_per_area(view(spark, sf, "scenes"), 12).select("area_id", "id")


def d4_clearest(spark, sf):
    s = view(spark, sf, "scenes").where("collection = 'sentinel-2-l2a'")
    return ops.clearest(s, ["area_id"]).select("area_id", "id", F.round("cloud_cover", 6).alias("cloud_cover"))


def c6_pair_crossmodal(spark, sf):
    return ops.pair_crossmodal(view(spark, sf, "scenes"), 8.0)


def c7_pair_bitemporal(spark, sf):
    return ops.pair_bitemporal(view(spark, sf, "scenes"), (_ts(START), _ts(MIDDLE)), (_ts(MIDDLE), _ts(END)))


CHECKS = ["size_match", "crs_match", "gsd_match", "coregistered"]


def c5_check_pairs(spark, sf):
    """Figures are rounded and words joined before kinds of raster become pairs."""
    k = ops.pair_kinds(_rasters(spark, sf).select("id", "width", "height", "crs", "bounds", "gsd_m"))
    return ops.each_pair(k.select("a_ids", "b_ids", *CHECKS, F.round("extent_iou", 6).alias("extent_iou"), F.array_join("warnings", "; ").alias("warnings")))


def c5_check_named_pairs(spark, sf):
    """Each raster with the next two by id: the same or another CRS, no CRS, no bounds, and any overlap."""
    r = _rasters(spark, sf).select("id", "width", "height", "crs", "bounds", "gsd_m")
    pairs = r.select(F.col("id").alias("a_id"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("b_id"))
    p = ops.check_named_pairs(pairs, r)
    return p.select("a_id", "b_id", *CHECKS, F.round("extent_iou", 6).alias("extent_iou"), F.array_join("warnings", "; ").alias("warnings"))


def f9_diagnose(spark, sf):
    s = view(spark, sf, "scenes")
    asked = s.select("area_id").distinct().select((F.col("area_id") * 10).alias("request_id"), F.lit("sentinel-2-l2a").alias("collection"), "area_id", F.lit(0.001).alias("max_cloud"))
    asked = asked.union(s.select("area_id").distinct().select(F.col("area_id") * 10 + 1, F.lit("sentinel-2-l2a"), "area_id", F.lit(50.0))).union(s.select("area_id").distinct().select(F.col("area_id") * 10 + 2, F.lit("sentinel-2-l2a"), F.col("area_id") + 100, F.lit(50.0)))
    d = ops.diagnose(s, asked)
    return d.select("request_id", F.col("kept").cast("long").alias("kept"), F.col("filtered_out").cast("long").alias("filtered_out"), F.round("clearest", 6).alias("clearest"), "hint")


def e20_modality(spark, sf):
    return _rasters(spark, sf).select("id", "modality")


def e21_gsd(spark, sf):
    return _rasters(spark, sf).select("id", F.round("gsd_m", 6).alias("gsd_m"))


def e22_utm_epsg(spark, sf):
    s = view(spark, sf, "scenes").select("id", ((F.col("x1") + F.col("x2")) / 2 - (F.col("id") % 5) * 40).alias("lon"), ((F.col("y1") + F.col("y2")) / 2 - (F.col("id") % 2) * 30).alias("lat"))
    return s.select("id", scenes.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


def e23_grid_origin(spark, sf):
    s = view(spark, sf, "scenes").select("id", (F.col("x1") * 1000).alias("cx"), (F.col("y1") * 1000).alias("cy"))
    return s.select("id", scenes.snapped_origin(F.col("cx"), 1024, 10.0).alias("origin_x"), scenes.snapped_origin(F.col("cy"), 1024, 10.0, north=True).alias("origin_y"))


def e24_band_plan(spark, sf):
    return view(spark, sf, "rasters").select("id", *[scenes.band_index(F.col("band_count"), b).alias(b) for b in ("red", "nir", "swir")], F.array_join(scenes.preview_bands(F.col("band_count")).cast("array<string>"), ",").alias("preview"))


def e25_change_floor(spark, sf):
    r = _rasters(spark, sf)
    pixels = F.col("width") * F.col("height")
    return r.select("id", scenes.change_floor(F.col("gsd_m"), pixels).alias("floor"), scenes.builtup_percentile(F.col("gsd_m")).alias("percentile"), scenes.change_floor_reason(F.round("gsd_m", 6), pixels).alias("reason"))


def f14_infer_sets(spark, sf):
    return ops.infer_sets(view(spark, sf, "images"))


def e16_route(spark, sf):
    q = view(spark, sf, "queries").join(ops.infer_sets(view(spark, sf, "images")).select("set_id", "config"), "set_id").where("config IS NOT NULL")
    return q.select("run_id", text.route(F.col("query"), F.col("config")).alias("r")).select("run_id", "r.task", "r.rule", "r.confidence")


QUERIES = {f.__name__: f for f in [a4_flatten_scenes, b6_search_scenes, c5_check_pairs, c5_check_named_pairs, c6_pair_crossmodal, c7_pair_bitemporal, d3_newest, d3_newest_per_area, d4_clearest, e16_route, e20_modality, e21_gsd, e22_utm_epsg, e23_grid_origin, e24_band_plan, e25_change_floor, f9_diagnose, f14_infer_sets]}

SC = f"sc AS ({view_sql('scenes')})"
RA = f"""ra0 AS ({view_sql("rasters")}), ra AS (SELECT *, id % 11 <> 0 AS has_bounds, crs IS NOT NULL AND id % 11 <> 0 AS geo,
 CASE WHEN coalesce(crs LIKE '%4326%', FALSE) THEN pixel_x * 111320.0 * greatest(cos(radians(CASE WHEN id % 11 <> 0 THEN (by1 + by2) / 2.0 ELSE 0.0 END)), 0.01) ELSE pixel_x END AS gsd_m FROM ra0)"""
#: Two rasters side by side, and what the checks say about them.
PAIR = """p AS (SELECT a.id AS a_id, b.id AS b_id, a.width AS aw, b.width AS bw, a.height AS ah, b.height AS bh, a.crs AS ac, b.crs AS bc, a.gsd_m AS ag, b.gsd_m AS bg, a.geo AS ageo, a.geo AND b.geo AS geos,
 least(a.bx2, b.bx2) - greatest(a.bx1, b.bx1) AS w, least(a.by2, b.by2) - greatest(a.by1, b.by1) AS h FROM {join}),
q AS (SELECT *, aw = bw AND ah = bh AS size_match, geos AND ac = bc AS crs_match, CASE WHEN geos THEN CASE WHEN w > 0 AND h > 0 THEN w * h / (6.0 - w * h) ELSE 0.0 END END AS iou, geos AND abs(ag - bg) / greatest(ag, bg) <= 0.05 AS gsd_match FROM p)"""
REPORT = """SELECT * FROM (SELECT a_id, b_id, size_match, coalesce(crs_match, FALSE) AS crs_match, gsd_match, coalesce((crs_match AND iou >= 0.9) OR (NOT coalesce(crs_match AND iou >= 0.9, FALSE) AND size_match AND NOT ageo), FALSE) AS coregistered, round(CAST(iou AS DOUBLE), 6) AS extent_iou, concat_ws('; ',
 CASE WHEN NOT size_match THEN 'pixel dimensions differ: ' || aw || 'x' || ah || ' vs ' || bw || 'x' || bh END, CASE WHEN geos AND ac <> bc THEN 'CRS differs: ' || ac || ' vs ' || bc END,
 CASE WHEN geos AND iou < 0.9 AND iou > 0 THEN printf('extents only partially overlap (IoU %.2f)', CAST(iou AS DOUBLE)) END, CASE WHEN geos AND iou = 0 THEN 'extents do not overlap: images cover different ground' END,
 CASE WHEN geos AND NOT gsd_match THEN printf('ground sample distance differs: %.2f m vs %.2f m', CAST(ag AS DOUBLE), CAST(bg AS DOUBLE)) END, CASE WHEN NOT geos THEN 'one or both inputs are not georeferenced; co-registration assumed from identical pixel dimensions' END) AS warnings FROM q) z"""
SETS = f"""im AS ({view_sql("images")}), se AS (SELECT set_id, count(*) AS n, count(*) FILTER (WHERE modality = 'sar') AS s, string_agg(CASE WHEN modality = 'sar' THEN 'sar' ELSE 'optical' END, ',' ORDER BY position) AS xr FROM im GROUP BY set_id),
sets AS (SELECT set_id, n, CASE WHEN n = 1 THEN 'single' WHEN n > 2 THEN NULL WHEN s = 1 THEN 'crossmodal_pair' ELSE 'bitemporal_pair' END AS config, xr FROM se)"""
SEARCH = f"x1 <= {BBOX[2]} AND x2 >= {BBOX[0]} AND y1 <= {BBOX[3]} AND y2 >= {BBOX[1]} AND datetime >= TIMESTAMP '{START}' AND datetime <= TIMESTAMP '{END}'"
ROUTE = """CASE WHEN config = 'crossmodal_pair' THEN ['crossmodal_vqa', 'input_config=crossmodal_pair', '1.0']
 WHEN config = 'bitemporal_pair' THEN CASE m WHEN 1 THEN ['change_caption', 'bitemporal + \\bdescribe\\b', '0.85'] WHEN 3 THEN ['change_caption', 'bitemporal + \\bwhat changed\\b', '0.85'] WHEN 5 THEN ['change_caption', 'bitemporal + empty query', '0.9'] ELSE ['change_vqa', 'bitemporal + question', '0.9'] END
 ELSE CASE m WHEN 0 THEN ['grounding', 'single + \\bhighlight\\b', '0.9'] WHEN 1 THEN ['caption', 'single + \\bdescribe\\b', '0.85'] WHEN 2 THEN ['vqa', 'single + \\bhow many\\b', '0.9'] WHEN 3 THEN ['vqa', 'single + question mark', '0.75'] WHEN 4 THEN ['vqa', 'single + \\bhas\\b', '0.9'] WHEN 5 THEN ['caption', 'single + empty query', '0.9'] WHEN 6 THEN ['vqa', 'single + default', '0.6'] ELSE ['vqa', 'single + \\bis there\\b', '0.9'] END END"""
SQL = {
    "a4_flatten_scenes": f"WITH {SC} SELECT id, collection, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, round(cloud_cover, 6) AS cloud_cover, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM sc",
    "b6_search_scenes": f"WITH {SC} SELECT id, collection, round(cloud_cover, 6) AS cloud_cover FROM sc WHERE {SEARCH} AND (collection = 'sentinel-1-rtc' OR cloud_cover < 20)",
    "c5_check_pairs": f"WITH {RA}, {PAIR.format(join="ra a JOIN ra b ON a.id < b.id AND a.geo AND b.geo AND a.crs = b.crs")} {REPORT} WHERE extent_iou > 0",
    "c5_check_named_pairs": f"WITH {RA}, {PAIR.format(join="ra a JOIN ra b ON b.id IN (a.id + 1, a.id + 2)")} {REPORT}",
    "c6_pair_crossmodal": f"""WITH {SC}, o AS (SELECT area_id, id, row_number() OVER (PARTITION BY area_id ORDER BY cloud_cover, id) AS r FROM sc WHERE collection = 'sentinel-2-l2a' AND cloud_cover < 8), s AS (SELECT area_id, id, row_number() OVER (PARTITION BY area_id ORDER BY datetime DESC, id) AS r FROM sc WHERE collection = 'sentinel-1-rtc')
SELECT o.area_id, o.id AS optical_id, s.id AS sar_id FROM o JOIN s ON s.area_id = o.area_id AND o.r = 1 AND s.r = 1""",
    "c7_pair_bitemporal": f"""WITH {SC}, o AS (SELECT area_id, id, datetime < TIMESTAMP '{MIDDLE}' AS early, row_number() OVER (PARTITION BY area_id, datetime < TIMESTAMP '{MIDDLE}' ORDER BY coalesce(cloud_cover, 100), id) AS r FROM sc WHERE collection = 'sentinel-2-l2a' AND datetime >= TIMESTAMP '{START}' AND datetime < TIMESTAMP '{END}')
SELECT a.area_id, a.id AS before_id, b.id AS after_id FROM o a JOIN o b ON a.area_id = b.area_id AND a.early AND NOT b.early AND a.r = 1 AND b.r = 1""",
    "d3_newest": f"WITH {SC} SELECT id, area_id FROM sc ORDER BY datetime DESC, id LIMIT 50",
    "d3_newest_per_area": f"WITH {SC} SELECT area_id, id FROM sc QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY datetime DESC, id) <= 12",
    "d4_clearest": f"WITH {SC} SELECT area_id, id, round(cloud_cover, 6) AS cloud_cover FROM sc WHERE collection = 'sentinel-2-l2a' QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY coalesce(cloud_cover, 100), id) = 1",
    "e16_route": f"WITH {SETS}, q AS ({view_sql('queries')}), k AS (SELECT run_id, {ROUTE} AS r FROM (SELECT q.*, config, run_id % 8 AS m FROM q JOIN sets USING (set_id) WHERE config IS NOT NULL) z) SELECT run_id, r[1] AS task, r[2] AS rule, CAST(r[3] AS DOUBLE) AS confidence FROM k",
    "e20_modality": f"WITH {RA} SELECT id, CASE WHEN id % 5 = 0 THEN 'sar' WHEN id % 5 = 1 THEN 'optical' WHEN band_count <= 2 AND (dtype = 'float32' OR band_count = 2) THEN 'sar' WHEN band_count >= 4 THEN 'optical' WHEN geo THEN 'optical' ELSE 'rgb' END AS modality FROM ra",
    "e21_gsd": f"WITH {RA} SELECT id, round(CAST(gsd_m AS DOUBLE), 6) AS gsd_m FROM ra",
    "e22_utm_epsg": f"WITH {SC}, k AS (SELECT id, (x1 + x2) / 2 - id % 5 * 40 AS lon, (y1 + y2) / 2 - id % 2 * 30 AS lat FROM sc) SELECT id, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INT) + 1 AS INTEGER) AS epsg FROM k",
    "e23_grid_origin": f"WITH {SC} SELECT id, round_even((x1 * 1000 - 5120.0) / 10.0, 0) * 10.0 AS origin_x, round_even((y1 * 1000 + 5120.0) / 10.0, 0) * 10.0 AS origin_y FROM sc",
    "e24_band_plan": f"WITH {RA} SELECT id, CAST(CASE band_count WHEN 4 THEN 1 WHEN 12 THEN 4 WHEN 13 THEN 4 END AS INTEGER) AS red, CAST(CASE band_count WHEN 4 THEN 4 WHEN 12 THEN 8 WHEN 13 THEN 8 END AS INTEGER) AS nir, CAST(CASE band_count WHEN 12 THEN 11 WHEN 13 THEN 12 END AS INTEGER) AS swir, CASE WHEN band_count >= 12 THEN '4,3,2' WHEN band_count >= 3 THEN '1,2,3' END AS preview FROM ra",
    "e25_change_floor": f"WITH {RA}, k AS (SELECT id, gsd_m, width * height AS n, round_even(CAST(least(10000.0 / (width * height * gsd_m * gsd_m), 0.2) AS DOUBLE), 8) AS f FROM ra) SELECT id, f AS floor, CAST(CASE WHEN gsd_m >= 8 THEN 92.0 ELSE 95.0 END AS DOUBLE) AS percentile, printf('speckle floor %.6f of the scene, which is 1 ha at %.2f m/px', round(round_even(CAST(least(10000.0 / (n * round(gsd_m, 6) * round(gsd_m, 6)), 0.2) AS DOUBLE), 8), 6), round(gsd_m, 6)) AS reason FROM k",
    "f9_diagnose": f"""WITH {SC}, ar AS (SELECT DISTINCT area_id FROM sc), rq AS (SELECT area_id * 10 AS request_id, area_id, 0.001 AS mc FROM ar UNION ALL SELECT area_id * 10 + 1, area_id, 50.0 FROM ar UNION ALL SELECT area_id * 10 + 2, area_id + 100, 50.0 FROM ar),
k AS (SELECT request_id, mc, least(count(*) FILTER (WHERE cloud_cover < mc), 12) AS kept, least(count(id), 12) AS n, min(cloud_cover) AS c FROM rq LEFT JOIN sc ON sc.area_id = rq.area_id AND collection = 'sentinel-2-l2a' GROUP BY request_id, mc)
SELECT request_id, kept, CASE WHEN kept = 0 THEN n END AS filtered_out, CASE WHEN kept = 0 THEN round(c, 6) END AS clearest,
 CASE WHEN kept > 0 THEN '' WHEN n > 0 THEN n || ' acquisition(s) exist here, but none below ' || printf('%.0f', round_even(mc, 0)) || '% cloud -- the clearest is ' || coalesce(printf('%.0f', round_even(c, 0)) || '%', 'unknown') || '. Raise the threshold, widen the dates, or use Sentinel-1: radar is unaffected by the cloud that makes optical unusable.'
 ELSE 'No acquisitions at all over this footprint in this window. Widen the date range or move the area of interest.' END AS hint FROM k""",
    "f14_infer_sets": f"WITH {SETS} SELECT set_id, n, config, CASE config WHEN 'single' THEN 'single' WHEN 'bitemporal_pair' THEN 'before,after' WHEN 'crossmodal_pair' THEN xr END AS roles, CASE WHEN n > 2 THEN n || ' images supplied; one or two are supported' END AS reject FROM sets",
}
