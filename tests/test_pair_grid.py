"""Overlapping rasters where most lie in one place: units of work stay small, and no pair is lost or told twice."""

import random

from pyspark.sql import functions as F

from sceneweave.operators import scenes

SCHEMA = "id int, width int, height int, crs string, bounds struct<x1:double,y1:double,x2:double,y2:double>, gsd_m double"


def crowded(rng):
    """Half of all boxes are small and within a hundredth of the plane, some are one and the same, a few cover all."""
    rows = []
    for k in range(1200):
        if k % 2:
            x, y, side = rng.uniform(5, 5.3), rng.uniform(5, 5.3), rng.uniform(0.001, 0.02)
        elif k % 20 == 0:
            x, y, side = -2.5, 3.25, 0.5
        elif k % 202 == 4:
            x, y, side = -10.0, -10.0, 25.0
        else:
            x, y, side = rng.uniform(-10, 10), rng.uniform(-10, 10), rng.uniform(0.1, 0.6)
        rows.append((k, 10, 10, "e" if k % 7 else "f", (x, y, x + side, y + side), 10.0))
    return rows


def brute(rows):
    out = set()
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            (p, q, r, s), (t, u, v, w) = a[4], b[4]
            if a[3] == b[3] and min(r, v) > max(p, t) and min(s, w) > max(q, u):
                out.add((a[0], b[0]))
    return out


def test_hot_cells_are_split_and_no_pair_is_lost(spark):
    rows = crowded(random.Random(3))
    r = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for cell, most in ((None, 40), (1.0, 1000)):
        got = [(p.a_id, p.b_id) for p in scenes.check_pairs(r, cell=cell, most=most, rounds=9).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    sizes = [u["count"] for u in scenes.pair_units(r, most=40, rounds=9).groupBy("crs", "level", "cx", "cy", "i", "j").count().collect()]
    assert max(sizes) <= 3 * 40
    assert max(u["level"] for u in scenes.pair_units(r, most=40, rounds=9).select("level").distinct().collect()) >= 4


def test_boxes_without_extent_or_place_meet_nothing(spark):
    rows = [(1, 10, 10, "e", (0.0, 0.0, 0.0, 0.0), 1.0), (2, 10, 10, "e", (0.0, 0.0, 0.0, 0.0), 1.0), (3, 10, 10, "e", (float("nan"), 0.0, 1.0, 1.0), 1.0), (4, 10, 10, None, (0.0, 0.0, 1.0, 1.0), 1.0), (5, 10, 10, "e", None, 1.0)]
    r = spark.createDataFrame(rows, SCHEMA)
    assert scenes.check_pairs(r).isEmpty() and scenes.check_pairs(r.where(F.lit(False))).isEmpty()


def test_copies_are_searched_once(spark, monkeypatch):
    """Rasters over the very same ground are one place to the search, and each pair of them has its own report."""
    boxes = [(0.0, 0.0, 2.0, 2.0), (0.05, 0.0, 2.05, 2.0), (1.0, 1.0, 3.0, 3.0), (9.0, 9.0, 10.0, 10.0)]
    rows = [(k, 10 + k % 2, 10, "ef"[k % 5 == 0], boxes[k * 7 % 4], [10.0, 10.4, 20.0, None][k % 3 if k % 11 else 3]) for k in range(60)]
    r = spark.createDataFrame(rows, SCHEMA)
    searched, units = [], scenes.pair_units
    monkeypatch.setattr(scenes, "pair_units", lambda places, *rest: searched.append(places.count()) or units(places, *rest))
    for most in (4, 1000):
        found = scenes.check_pairs(r, most=most)
        pairs = found.select("a_id", "b_id")
        assert {tuple(p) for p in pairs.collect()} == brute(rows) and pairs.count() == len(brute(rows))
        want = scenes.check_named_pairs(pairs, r).select(*found.columns)
        assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    assert searched == [len({(row[3], row[4]) for row in rows})] * 2
