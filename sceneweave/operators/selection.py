"""Exact percentiles of groups of any size, in bounded memory, by distributed selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneweave.operators.cluster import cut_lineage

#: Values of a range that are sorted in one place.
LIMIT = 10_000
#: Ranges that a sketch proposes in a round, and its accuracy: its ranks are off by one in ``ACCURACY`` at most, far less than a range.
RANGES, ACCURACY = 256, 10_000


def _key_equal(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def exact_percentiles(values: DataFrame, keys: list[str], shares: tuple[float, ...] | DataFrame, value: str = "v", limit: int = LIMIT) -> DataFrame:
    """(keys, p array<double>): the shares' percentiles of each group's values, interpolated between neighbours; null values are left out.

    ``shares`` are the same for all groups, or a table (keys, shares
    array<double>) with one row a group; groups that it lacks have no row. A
    group without values, and a share outside 0 to 1, gives nulls.

    Groups of up to ``limit`` values are sorted as arrays. In larger ones each
    wanted rank has an open range of values that holds it, at first all of them.
    A sketch proposes ends closer to the rank, values below and between them are
    counted, and the rank either falls on an end, which is then its value, or the
    range shrinks to the inside, a hundredth of the values or so. When it holds
    ``limit`` values it is sorted. So no aggregate buffer holds more than a sketch
    or ``limit`` values, and results are exact whatever the sketch says.
    """
    present = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    sizes = cut_lineage(values.groupBy(*keys).agg(F.count(value).alias("n")))
    if isinstance(shares, DataFrame):
        wanted = sizes.alias("a").join(shares.alias("b"), _key_equal("a", "b", keys)).select(*[F.col(f"a.{k}") for k in keys], "n", "shares")
    else:
        wanted = sizes.withColumn("shares", F.array(*[F.lit(float(s)) for s in shares]))
    place = F.when(F.col("share").between(0.0, 1.0) & (F.col("n") > 0), (F.col("n") - 1) * F.col("share"))
    targets = wanted.select(*keys, "n", F.posexplode("shares").alias("i", "share")).withColumn("place", place)
    many = sizes.where(F.col("n") > limit)
    some_large = many.limit(1).count() > 0

    small = present.alias("a").join(many.alias("b"), _key_equal("a", "b", keys), "left_anti") if some_large else present
    sorted_small = small.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("s"))
    low, high = F.floor("place").cast("int"), F.ceil("place").cast("int")
    few = targets.where(F.col("n") <= limit).alias("a").join(sorted_small.alias("b"), _key_equal("a", "b", keys), "left")
    found = few.select(*[F.col(f"a.{k}") for k in keys], "i", "place", F.get("s", low).alias("x"), F.get("s", high).alias("y"))
    if some_large:
        ranked = targets.where(F.col("n") > limit).select(*keys, "i", "place", "n", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
        chosen = selected(present, ranked.where("rank IS NOT NULL").select(*keys, "n", "rank").distinct(), keys, limit)
        ends = ranked.alias("a").join(chosen.alias("b"), _key_equal("a", "b", [*keys, "rank"]), "left")
        ends = ends.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], "i", "place").agg(F.min("b.x").alias("x"), F.max("b.x").alias("y"))
        found = found.unionByName(ends)
    between = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise((F.ceil("place") - F.col("place")) * F.col("x") + (F.col("place") - F.floor("place")) * F.col("y"))
    listed = found.select(*keys, "i", between.alias("p")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("l"))
    return listed.select(*keys, F.col("l.p").alias("p"))


def selected(present: DataFrame, ranks: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, rank, x): the values of those ranks, from 0, of ``present`` (keys, v); ``ranks`` is (keys, n, rank)."""
    infinite = F.lit(float("inf"))
    # Between ``lo`` and ``hi``, both left out, are ``inside`` values; ``below`` values come before.
    state = ranks.select(*keys, "rank", (-infinite).alias("lo"), infinite.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(None).cast("double").alias("x"))
    state = cut_lineage(state)
    own = [F.col(f"a.{k}").alias(k) for k in keys]
    inside = (F.col("b.v") > F.col("a.lo")) & (F.col("b.v") < F.col("a.hi"))
    grid = [k / RANGES for k in range(RANGES + 1)]
    while (wide := state.where(F.col("x").isNull() & (F.col("inside") > limit))).limit(1).count():
        ranges = wide.select(*keys, "lo", "hi").distinct()
        sketch = ranges.alias("a").join(present.alias("b"), _key_equal("a", "b", keys) & inside).groupBy(*own, F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi")).agg(F.percentile_approx("b.v", grid, ACCURACY).alias("grid"))
        step = F.floor((F.col("rank") - F.col("below")) * RANGES / F.col("inside")).cast("int")
        near = wide.alias("a").join(sketch.alias("b"), _key_equal("a", "b", [*keys, "lo", "hi"])).select("a.*", F.get("grid", F.greatest(step - 1, F.lit(0))).alias("from"), F.get("grid", F.least(step + 2, F.lit(RANGES))).alias("to"))
        near = cut_lineage(near)
        v = F.col("b.v")
        met = near.alias("a").join(present.alias("b"), _key_equal("a", "b", keys) & inside)
        counts = met.groupBy(*own, F.col("a.rank").alias("rank")).agg(F.count_if(v < F.col("a.from")).alias("less"), F.count_if(v == F.col("a.from")).alias("at_from"), F.count_if((v > F.col("a.from")) & (v < F.col("a.to"))).alias("between"), F.count_if((v == F.col("a.to")) & (v > F.col("a.from"))).alias("at_to"))
        narrowed = near.alias("a").join(counts.alias("b"), _key_equal("a", "b", [*keys, "rank"])).select("a.*", "less", "at_from", "between", "at_to")
        r = F.col("rank") - F.col("below")
        less, to_from = F.col("less"), F.col("less") + F.col("at_from")
        to_between = to_from + F.col("between")
        # Beyond the proposed ends, should a sketch ever be that far off, the rest of the range is searched.
        case = F.when(r < less, 0).when(r < to_from, 1).when(r < to_between, 2).when(r < to_between + F.col("at_to"), 3).otherwise(4)
        narrowed = narrowed.withColumn("case", case)
        pick = lambda *x: F.element_at(F.array(*x), F.col("case") + 1)
        beyond = to_between + F.col("at_to")
        narrowed = narrowed.select(
            *keys,
            "rank",
            pick("lo", "lo", "from", "lo", "to").alias("lo"),
            pick("from", "hi", "to", "hi", "hi").alias("hi"),
            (F.col("below") + pick(F.lit(0).cast("long"), F.lit(0).cast("long"), to_from, F.lit(0).cast("long"), beyond)).alias("below"),
            pick(less, F.lit(0).cast("long"), F.col("between"), F.lit(0).cast("long"), F.col("inside") - beyond).alias("inside"),
            F.when(F.col("case") == 1, F.col("from")).when(F.col("case") == 3, F.col("to")).alias("x"),
        )
        state = cut_lineage(state.where(F.col("x").isNotNull() | (F.col("inside") <= limit)).unionByName(narrowed))
    open_ranges = state.where("x IS NULL")
    ranges = open_ranges.select(*keys, "lo", "hi").distinct()
    arrays = ranges.alias("a").join(present.alias("b"), _key_equal("a", "b", keys) & inside).groupBy(*own, F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi")).agg(F.array_sort(F.collect_list("b.v")).alias("s"))
    rest = open_ranges.alias("a").join(arrays.alias("b"), _key_equal("a", "b", [*keys, "lo", "hi"])).select(*[F.col(f"a.{k}") for k in keys], "rank", F.get("s", (F.col("rank") - F.col("below")).cast("int")).alias("x"))
    return state.where("x IS NOT NULL").select(*keys, "rank", "x").unionByName(rest)
