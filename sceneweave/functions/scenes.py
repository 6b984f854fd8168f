"""Scene expressions: modality, ground sample distance, grids, band plans, parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneweave.functions import lookup, text


def _contains_any(name: Column, hints: list[str]) -> Column:
    return F.greatest(*[F.contains(name, F.lit(h)) for h in hints])


def modality(name: Column, band_count: Column, dtype: Column, georeferenced: Column) -> Column:
    """sar, optical or rgb: hints in the file name first, then bands and type. Hints match inside words."""
    low = F.lower(F.coalesce(name, F.lit("")))
    plain = F.when(georeferenced, "optical").otherwise("rgb")
    return (
        F.when(_contains_any(low, lookup.SAR_HINTS), "sar")
        .when(_contains_any(low, lookup.OPTICAL_HINTS), "optical")
        .when((band_count <= 2) & (dtype.startswith("float") | (band_count == 2)), "sar")
        .when(band_count <= 2, plain)
        .when(band_count >= 4, "optical")
        .otherwise(plain)
    )


def ground_sample_distance(pixel_x: Column, crs: Column, south: Column, north: Column) -> Column:
    """Metres per pixel; degrees are converted at the middle latitude; null for a zero width."""
    size = F.abs(pixel_x)
    latitude = F.coalesce((south + north) / 2.0, F.lit(0.0))
    degrees = size * lookup.METRES_PER_DEGREE * F.greatest(F.cos(F.radians(latitude)), F.lit(0.01))
    return F.when(size > 0, F.when(F.coalesce(F.contains(crs, F.lit("4326")), F.lit(False)), degrees).otherwise(size))


def utm_epsg(longitude: Column, latitude: Column) -> Column:
    """Zone code; longitude 180 gives zone 61."""
    zone = F.floor((longitude + 180.0) / 6.0).cast("int") + 1
    return F.when(latitude >= 0, 32600).otherwise(32700) + zone


def snapped_origin(centre: Column, size: int, resolution: float, north: bool = False) -> Column:
    """Edge of a grid around a projected centre, on a multiple of the resolution."""
    half = size * resolution / 2.0
    return F.bround((centre + half if north else centre - half) / resolution) * resolution


def band_index(band_count: Column, band: str) -> Column:
    """1-based place of a named band; null where the layout is unknown or lacks it."""
    out = F.lit(None).cast("int")
    for count, plan in lookup.BAND_PLANS.items():
        if band in plan:
            out = F.when(band_count == count, plan[band]).otherwise(out)
    return out


def preview_bands(band_count: Column) -> Column:
    """Bands for red, green, blue; null below three bands."""
    of = lambda *x: F.array(*[F.lit(i) for i in x])
    return F.when(band_count >= 12, of(4, 3, 2)).when(band_count >= 3, of(1, 2, 3))


def change_floor(gsd: Column, pixels: Column) -> Column:
    """One hectare as a fraction of the scene, within 0 to 0.2, to 8 places; null without a distance."""
    fraction = F.try_divide(F.lit(10_000.0), pixels * gsd * gsd)
    return F.when((gsd > 0) & (pixels > 0), F.bround(F.least(fraction, F.lit(0.2)), 8))


def change_floor_reason(gsd: Column, pixels: Column) -> Column:
    floor = change_floor(gsd, pixels)
    return F.when(floor.isNotNull(), F.format_string("speckle floor %s of the scene, which is 1 ha at %s m/px", text.fixed(text.rounded(floor, 6), 6), text.fixed(gsd, 2))).otherwise("no ground sample distance available; using tool defaults")


def builtup_percentile(gsd: Column) -> Column:
    """92 for pixels of 8 m and more, else 95; null without a distance."""
    return F.when(gsd > 0, F.when(gsd >= 8.0, 92.0).otherwise(95.0))
