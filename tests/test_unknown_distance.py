"""Change masks of a pair whose ground sample distance nobody knows."""

import pytest

from sceneweave.plans import measure


@pytest.mark.parametrize("floor,again", [(None, False), (0.2, True)])
def test_floor_of_a_pair_without_a_distance(spark, floor, again):
    """Six of 64 pixels changed: below the floor that is a quiet mask, which is measured again."""
    pixel = lambda s, y, x: 63.0 if s == 2 and y == 0 and x < 6 else float(8 * y + x)
    pixels = spark.createDataFrame([(s, b, y, x, pixel(s, y, x)) for s in (1, 2) for b in range(1, 5) for y in range(8) for x in range(8)], "scene_id long, band int, y int, x int, v double")
    sets = spark.createDataFrame([(7, "bitemporal_pair")], "set_id long, config string")
    images = spark.createDataFrame([(7, 0, "optical", 1), (7, 1, "optical", 2)], "set_id long, position int, modality string, scene_id long")
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rasters = spark.createDataFrame([(s, 8, 8, "EPSG:32643", (0.0, 0.0, 1.0, 1.0), None) for s in (1, 2)], f"id long, width int, height int, crs string, bounds {box}, gsd_m double")
    assert (measure.measure_sets(sets, images, rasters, pixels, floor).head()["change_threshold_2"] is not None) == again
