"""Exact quantiles of groups of any size, none of them sorted or held in a task.

For a large group a sketch brackets each wanted rank, and a second pass counts what lies below the bracket. A bracket that still
holds many values is split by quantiles of its own, again and again; one that turns out not to hold its rank is opened towards
the side where the rank lies. Linear interpolation between closest ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.runtime import broadcast_if, materialize

ACCURACY = 10_000
# Up to this many values an aggregation buffer holds the group, and one bracket's values are ordered in a task.
WHOLE = 2 * ACCURACY
SPLITS = 63  # values at which a bracket is split


def group_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    n_groups: int,
    interpolate: bool = True,
) -> DataFrame:
    """One row per group: ``n`` and the named exact quantiles of the non-null ``value``.

    ``n_groups`` is an upper bound for the number of groups. Without ``interpolate`` the value at the
    closest lower rank is taken.
    """
    groups = list(groups)
    names, wanted = list(probs), [float(p) for p in probs.values()]
    data = materialize(df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v")))
    sizes = data.groupBy(*groups).agg(F.count("*").alias("n"))
    exact = lambda rows: rows.groupBy(*groups).agg(F.count("*").alias("n"), F.percentile("_v", F.array(*map(F.lit, wanted))).alias("_p"))
    plain = lambda rows: exact(rows).select(*groups, "n", *[F.col("_p")[i].alias(m) for i, m in enumerate(names)])
    if not interpolate:
        return _selected(data, groups, names, wanted, n_groups, interpolate)
    large = materialize(sizes.filter(F.col("n") > WHOLE))
    if large.isEmpty():
        return plain(data)
    if not groups:
        return _selected(data, groups, names, wanted, n_groups, interpolate)
    keys = broadcast_if(large.select(*groups), n_groups)
    rest = _selected(data.join(keys, groups, "left_semi"), groups, names, wanted, n_groups, interpolate)
    return plain(data.join(keys, groups, "left_anti")).unionByName(rest)


def _selected(data: DataFrame, groups: list[str], names: list[str], wanted: list[float], n_groups: int, interpolate: bool) -> DataFrame:
    """The quantiles by brackets: rows (groups, name, n, pos, lo, hi, below, inside), lo and hi part of the bracket."""
    margin = 2 / ACCURACY
    low, high = [max(0.0, p - margin) for p in wanted], [min(1.0, p + margin) for p in wanted]
    sketch = data.groupBy(*groups).agg(
        F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", low + high, ACCURACY).alias("_q")
    )
    each = [
        F.struct(F.lit(m).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("pos"), F.col("_q")[i].alias("lo"), F.col("_q")[i + len(names)].alias("hi"), "_min", "_max")
        for i, (m, p) in enumerate(zip(names, wanted))
    ]
    keys = [*groups, "name"]
    bound = n_groups * len(names)
    rows = sketch.filter("n > 0").select(*groups, "n", F.explode(F.array(*each)).alias("b")).select(*groups, "n", "b.*")
    rows = materialize(rows)
    # what lies below and inside, for the brackets as they are and for those opened to either side
    placed = _meet(data, rows, groups, bound)
    counted = placed.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("lo")).alias("below"), F.count_if((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).alias("inside"))
    state = rows.join(broadcast_if(counted, bound), keys)
    under, over = F.floor("pos") < F.col("below"), F.ceil("pos") >= F.col("below") + F.col("inside")
    state = materialize(
        state.select(
            *keys, "n", "pos", F.when(under, F.col("_min")).otherwise(F.col("lo")).alias("lo"), F.when(over, F.col("_max")).otherwise(F.col("hi")).alias("hi"),
            F.when(under, 0).otherwise(F.col("below")).alias("below"),
            (F.when(over, F.col("n")).otherwise(F.col("below") + F.col("inside")) - F.when(under, 0).otherwise(F.col("below"))).alias("inside"),
        )
    )
    while True:
        wide = (F.col("inside") > WHOLE) & (F.col("lo") < F.col("hi"))
        split = state.filter(wide)
        if split.isEmpty():
            break
        state = materialize(state.filter(~wide).unionByName(_narrowed(data, split, groups, bound)))
    # single values, and few enough to be put in order
    ready = state.filter("lo = hi").select(*keys, "n", "pos", F.col("lo").alias("a"), F.col("lo").alias("b"))
    inside = _meet(data, state.filter("lo < hi"), groups, bound).filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    tally = inside.groupBy(*keys, "n", "pos", "below", "_v").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_v")  # at most WHOLE values of a bracket
    ranked = tally.withColumn("_cum", F.col("below") + F.sum("_c").over(upto))
    first = lambda rank: F.min(F.when(F.col("_cum") > rank, F.col("_v")))
    found = ready.unionByName(ranked.groupBy(*keys, "n", "pos").agg(first(F.floor("pos")).alias("a"), first(F.ceil("pos")).alias("b")))
    at = F.col("a")
    if interpolate:
        at = at + (F.col("pos") - F.floor("pos")) * (F.col("b") - F.col("a"))
    per = found.withColumn("q", at).groupBy(*groups).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("name") == m, F.col("q"))).alias(m) for m in names])
    if groups:
        return per
    # without any value there is one row of nulls
    return per.filter(F.col("n").isNotNull()) if not data.isEmpty() else per.select(F.lit(0).cast("bigint").alias("n"), *names)


def _meet(data: DataFrame, brackets: DataFrame, groups: list[str], bound: int) -> DataFrame:
    """Every value beside the brackets of its group."""
    small = broadcast_if(brackets, bound)
    return data.join(small, groups) if groups else data.join(F.broadcast(brackets), F.lit(True))


def _narrowed(data: DataFrame, split: DataFrame, groups: list[str], bound: int) -> DataFrame:
    """Each bracket cut down to the parts that hold its ranks; a value at which it is split is a part of its own."""
    keys = [*groups, "name"]
    inside = materialize(_meet(data, split, groups, bound).filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).select(*keys, "_v"))
    at = inside.groupBy(*keys).agg(F.percentile_approx("_v", [i / (SPLITS + 1) for i in range(1, SPLITS + 1)], ACCURACY).alias("_s"))
    part = 2 * F.size(F.filter("_s", lambda x: x < F.col("_v"))) + F.array_contains("_s", F.col("_v")).cast("int")
    parts = inside.join(broadcast_if(at, bound), keys).groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    upto = Window.partitionBy(*keys).orderBy("_part")  # at most 2 SPLITS + 1 parts
    cum = parts.withColumn("_cum", F.sum("_c").over(upto)).join(split.select(*keys, "n", "pos", "below"), keys)
    before, last = F.col("below") + F.col("_cum") - F.col("_c"), F.col("below") + F.col("_cum")
    holds = (last > F.floor("pos")) & (before <= F.ceil("pos"))
    kept = cum.filter(holds).groupBy(*keys, "n", "pos").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.min(before).alias("below"), F.sum("_c").alias("inside"))
    return kept.select(*keys, "n", "pos", "lo", "hi", "below", "inside")
