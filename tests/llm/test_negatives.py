"""Hard negatives against a brute-force version: ties, hot labels, wide components, odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from sceneweave.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, shard int"


def brute(rows, anchors, k=5, n=10):
    def digit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        out = [math.floor(256 * x) for x in v]
        return out if max(map(abs, out)) < 2**63 else None

    usable = [(i, label, digit(v)) for i, v, label, *_ in rows if i is not None and label is not None and digit(v) is not None]
    out = []
    for a in anchors:
        own = min(((label, v) for i, label, v in usable if i == a), default=None)
        if own is None:
            continue
        scored = [(-sum(x * y for x, y in zip(own[1], v)), i, label) for i, label, v in usable if i != a and len(v) == len(own[1])]
        scored = sorted(s for s in scored if -(2**63) <= -s[0] < 2**63)
        for worth, positive, _ in [s for s in scored if s[2] == own[0]][:k]:
            band = [s for s in scored if s[2] != own[0] and 30 * -worth <= 100 * -s[0] <= 90 * -worth]
            out += [(a, positive, r, i, -worth, -score) for r, (score, i, _) in enumerate(band[:n], 1)]
    return Counter(out)


def mined(spark, rows, anchors, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return Counter(tuple(r) for r in negatives.mine(frame, frame.where(frame.vec_id.isin(anchors)), **more).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=11) * 0.2
    out = [(i, (centre + rng.normal(size=11) * 0.1).tolist(), int(i % 4 if i % 3 else 0), "clash", i) for i in range(240)]
    out += [(300 + i, out[7][1], i % 3, "ties", 0) for i in range(40)]
    out += [out[20], out[21], (20, out[30][1], 2, None, None)]
    out += [(400, None, 1, "", 0), (401, [], 1, "", 0), (402, [float("nan")] * 11, 1, "", 0), (403, [None] + [0.1] * 10, 1, "", 0), (404, [0.1] * 11, None, "", 0), (None, [0.1] * 11, 1, "", 0), (405, [0.1] * 5, 1, "", 0), (406, [0.0] * 11, 1, "", 0), (407, [-0.3] * 11, 0, "", 0)]
    return out


def test_matches_brute_force(spark, rows):
    anchors = [0, 20, 21, 40, 307, 400, 404, 405, 406, 407, 999]
    want = brute(rows, anchors)
    assert len(want) > 150
    assert mined(spark, rows, anchors) == want


def test_blocks_and_merges_do_not_matter(spark, rows):
    anchors = list(range(0, 240, 5))
    want = brute(rows, anchors)
    assert mined(spark, rows, anchors, block_bytes=2000, fan_in=2) == want


def test_wide_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=9) * 10.0 ** (i % 17)).tolist(), i % 2, "", 0) for i in range(60)] + [(60, [1e300] * 9, 0, "", 0)]
    assert mined(spark, rows, list(range(0, 61, 3))) == brute(rows, list(range(0, 61, 3)))


def test_empty_table(spark, rows):
    assert not mined(spark, rows[:0], [1])
    assert not mined(spark, rows, [])


def test_tables_hold_all_subset_sums_and_scores_are_looked_up():
    rng = np.random.default_rng(7)
    anchors, m = rng.integers(-500, 500, (5, 13)), rng.integers(-300, 300, (50, 13))
    tables = negatives.subset_sums(anchors, np.int64)
    assert tables.shape == (2, 256, 5)
    for byte in (0, 1, 77, 255):
        assert (tables[0, byte] == [sum(a[i] for i in range(8) if byte >> i & 1) for a in anchors]).all()
    depth = int(negatives.planes_needed(m).max())
    assert (negatives.looked_up(tables, negatives.bit_planes(m, depth)) == m @ anchors.T).all()
    assert negatives.components(negatives.bit_planes(m, depth)[3], 13) == m[3].tolist()


def test_a_label_of_most_rows_is_spread(spark):
    """Tiles are by ids, not labels: with one label of nine rows in ten, results stay whole and tiles even."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist(), 0 if i % 10 else 1, "", 0) for i in range(400)]
    groups = defaultdict(int)
    for a, positive, *_ in mined(spark, rows, list(range(0, 400, 40)), block_bytes=3000):
        groups[a, positive] += 1
    assert len(groups) == 50 and set(groups.values()) == {10}
