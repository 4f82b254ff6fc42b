"""Quality-control aggregates and profiles of a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_missing, transformed
from assaygrid.model import Assay
from assaygrid.operators.quantiles import group_quantiles
from assaygrid.operators.ranking import ordered, row_numbers
from assaygrid.runtime import broadcast_if

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def sample_stats(assay: Assay) -> DataFrame:
    """Per sample: quantified features, quartiles, range and sum of log10(1 + value) over values > 0."""
    logs = assay.observed("positive", F.log10(1 + F.col("value")))
    basic = logs.groupBy("sample_id").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("total_log")
    )
    quartiles = group_quantiles(logs, ["sample_id"], "value", QUARTILES, assay.n_samples)
    quartiles = quartiles.withColumnRenamed("n", "n_quantified")
    return (
        assay.samples.select("sample_id")
        .join(assay.per_sample(quartiles), "sample_id", "left")
        .join(assay.per_sample(basic), "sample_id", "left")
        .withColumn("n_quantified", F.coalesce("n_quantified", F.lit(0)).cast("bigint"))
    )


def matrix_stats(assay: Assay) -> DataFrame:
    """Rows, columns, cells of the grid and cells quantified (> 0)."""
    per_feature = assay.cells.groupBy("feature_id").agg(F.count_if(~is_missing(F.col("value"))).alias("q"))
    n_samples = F.lit(assay.n_samples).cast("bigint")
    return per_feature.agg(
        F.count("*").alias("n_features"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_quantified")
    ).select("n_features", n_samples.alias("n_samples"), (F.col("n_features") * n_samples).alias("n_cells"), "n_quantified")


def column_metric(assay: Assay, metric: str, transform: str = "none", zero_missing: bool = True) -> DataFrame:
    """One number per sample: ``count``, ``mean_raw``, ``mean_transformed`` or ``detection_rate``."""
    v = F.col("value")
    finite = ~is_missing(v, "null")
    used = ~is_missing(v, "zero") if zero_missing else finite
    expr = {
        "count": F.count_if(finite & (v > 0)).cast("double"),
        "mean_raw": F.avg(F.when(used, v)),
        "mean_transformed": F.avg(F.when(used, transformed(v, transform))),
        "detection_rate": F.avg(F.when(finite, (v > 0).cast("double"))),
    }[metric]
    per_sample = assay.cells.groupBy("sample_id").agg(expr.alias("metric"))
    return assay.samples.select("sample_id").join(assay.per_sample(per_sample), "sample_id", "left")


def missing_stats(assay: Assay, rule: str = "zero") -> DataFrame:
    """Missing cells over the whole grid, per sample and per feature: ``level, id, n_missing, n_total``."""
    seen = assay.cells.select("feature_id", "sample_id", (~is_missing(F.col("value"), rule)).cast("int").alias("seen"))
    # a zero row per sample keeps samples without any cell
    empty = assay.samples.select(F.lit(None).alias("feature_id"), "sample_id", F.lit(0).alias("seen"))
    counted = (
        seen.unionByName(empty)
        .groupingSets([[], ["sample_id"], ["feature_id"]], "sample_id", "feature_id")
        .agg(
            F.sum("seen").alias("n_seen"),
            F.grouping("sample_id").alias("gs"),
            F.grouping("feature_id").alias("gf"),
        )
        .filter((F.col("gf") == 1) | F.col("feature_id").isNotNull())
    )
    n_features = assay.cells.agg(F.count_distinct("feature_id")).scalar()
    n_samples = F.lit(assay.n_samples).cast("bigint")
    level = F.when((F.col("gs") == 1) & (F.col("gf") == 1), "total").when(F.col("gs") == 0, "sample").otherwise("feature")
    total = F.when(level == "total", n_features * n_samples).when(level == "sample", n_features).otherwise(n_samples)
    return counted.select(
        level.alias("level"),
        F.coalesce("sample_id", F.col("feature_id").cast("string"), F.lit("all")).alias("id"),
        (total - F.col("n_seen")).alias("n_missing"),
        total.alias("n_total"),
    )


def top_rows(assay: Assay, n: int = 10) -> DataFrame:
    """The ``n`` features with the largest sum of finite values."""
    v = F.col("value")
    sums = assay.cells.groupBy("feature_id").agg(F.sum(F.when(~is_missing(v, "null"), v)).alias("total"))
    return sums.orderBy(F.desc_nulls_last("total"), "feature_id").limit(n)


def composition(assay: Assay, chosen: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Share of each cell in its sample, over the chosen features, with ``exclude`` left out beforehand.

    ``chosen`` and ``exclude`` are frames of ``feature_id``.
    """
    cells = assay.observed("positive")
    if chosen is not None:
        cells = cells.join(chosen.select("feature_id"), "feature_id", "left_semi")
    if exclude is not None:
        cells = cells.join(exclude.select("feature_id"), "feature_id", "left_anti")
    totals = cells.groupBy("sample_id").agg(F.sum("value").alias("total"))
    return cells.join(assay.per_sample(totals), "sample_id").select(
        "feature_id", "sample_id", "value", (F.col("value") / F.col("total")).alias("share")
    )


def zscore_rows(cells: DataFrame, ddof: int = 0, floor: float = 0.0) -> DataFrame:
    """Cells with ``z``: mean 0 and sd 1 per feature; 0 where a feature does not vary."""
    w = Window.partitionBy("feature_id")
    sd = F.stddev_pop("value").over(w) if ddof == 0 else F.stddev_samp("value").over(w)
    diff = F.col("value") - F.avg("value").over(w)
    scaled = cells.withColumn("_sd", sd).withColumn("_diff", diff)
    z = F.when(F.col("_sd") > floor, F.col("_diff") / F.col("_sd")).otherwise(F.lit(0.0))
    return scaled.withColumn("z", F.when(F.col("value").isNotNull(), z)).drop("_sd", "_diff")


def ranked_intensity(assay: Assay, log: bool = False) -> DataFrame:
    """Features of every sample from the highest value down, ties by id."""
    value = F.log10(1 + F.col("value")) if log else F.col("value")
    ranked = row_numbers(
        assay.observed("positive"), [("value", False), ("feature_id", True)], ["sample_id"], assay.n_samples
    )
    return ranked.withColumn("value", value)


def cumulative_pct(assay: Assay) -> DataFrame:
    """Running percentage of the sample's total in descending order of value."""
    laid = ordered(
        assay.observed("positive"), [("value", False), ("feature_id", True)], ["sample_id"], assay.n_samples
    )
    run = laid.running("rank", "sum", F.lit(1).cast("bigint")).running("cum", "sum", F.col("value")).result()
    totals = run.groupBy("sample_id").agg(F.sum("value").alias("total"))
    return run.join(assay.per_sample(totals), "sample_id").select(
        "sample_id", "feature_id", "rank", (100 * F.col("cum") / F.col("total")).alias("cum_pct")
    )


def top_with_other(assay: Assay, n: int) -> DataFrame:
    """The ``n`` largest features of every sample and one ``Other`` row for the rest.

    The rank filter prunes to ``n`` rows per sample before the shuffle; the rest is total minus top.
    """
    cells = assay.observed("positive")
    w = Window.partitionBy("sample_id").orderBy(F.desc("value"), "feature_id")
    top = cells.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    totals = cells.groupBy("sample_id").agg(F.sum("value").alias("total"), F.count("*").alias("n_all"))
    kept = top.groupBy("sample_id").agg(F.sum("value").alias("kept"), F.count("*").alias("n_kept"))
    other = (
        assay.per_sample(totals)
        .join(assay.per_sample(kept), "sample_id")
        .filter(F.col("n_all") > F.col("n_kept"))
        .select("sample_id", F.lit("Other").alias("label"), (F.col("total") - F.col("kept")).alias("value"))
    )
    return top.select("sample_id", F.col("feature_id").cast("string").alias("label"), "value").unionByName(other)


def contaminant_share(assay: Assay, flag: Column) -> DataFrame:
    """Percentage of each sample's total that comes from features where ``flag`` (on annotations) holds."""
    marked = assay.features.select("feature_id", flag.alias("cont"))
    return (
        assay.observed("positive")
        .join(marked, "feature_id", "left")
        .groupBy("sample_id")
        .agg(
            F.sum(F.when(F.col("cont"), F.col("value")).otherwise(0.0)).alias("contaminant"),
            F.sum("value").alias("total"),
        )
        .withColumn("pct", 100 * F.col("contaminant") / F.col("total"))
    )


def histogram(df: DataFrame, col: str, low: float, high: float, width: float, groups: tuple[str, ...] = ()) -> DataFrame:
    """Counts in fixed-width bins over [low, high]; the last bin includes ``high``."""
    last = round((high - low) / width) - 1
    v = F.col(col)
    slot = F.least(F.floor((v - low) / width), F.lit(last).cast("bigint"))
    return (
        df.filter((v >= low) & (v <= high))
        .groupBy(*groups, slot.alias("bin"))
        .agg(F.count("*").alias("n"))
        .withColumn("bin_start", low + F.col("bin") * width)
    )


def kde(df: DataFrame, col: str, grid: int, groups: list[str], n_groups: int) -> DataFrame:
    """Gaussian kernel density per group on ``grid`` points.

    Bandwidth 0.9 min(sd, IQR / 1.34) n^-0.2 with quartiles at the closest lower rank; the range runs
    2.5 bandwidths past the data. The curve is not divided by sqrt(2 pi).
    """
    data = df.filter(F.col(col).isNotNull())
    spread = data.groupBy(*groups).agg(
        F.count(col).alias("n"), F.stddev_pop(col).alias("sd"), F.min(col).alias("lo"), F.max(col).alias("hi")
    )
    quart = group_quantiles(data, groups, col, {"q1": 0.25, "q3": 0.75}, n_groups, interpolate=False).drop("n")
    raw = 0.9 * F.least("sd", (F.col("q3") - F.col("q1")) / 1.34) * F.pow("n", F.lit(-0.2))
    flat = F.coalesce(F.nullif((F.col("hi") - F.col("lo")) / 20, F.lit(0.0)), F.lit(0.1))
    shape = spread.join(quart, groups).withColumn("bw", F.when(raw > 0, raw).otherwise(flat))
    first, last = F.col("lo") - 2.5 * F.col("bw"), F.col("hi") + 2.5 * F.col("bw")
    xs = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda g: first + (last - first) * g / (grid - 1))
    shape = shape.select(*groups, "n", "bw", xs.alias("xs"))
    # equal values are merged first; a value meets the points of its own group's grid only
    counts = data.groupBy(*groups, F.col(col).alias("v")).agg(F.count("*").alias("c"))
    z = (F.col("x") - F.col("v")) / F.col("bw")
    return (
        counts.join(broadcast_if(shape, n_groups, 16 * grid + 64), groups)
        .select(*groups, "n", "bw", "v", "c", F.posexplode("xs").alias("point", "x"))
        .groupBy(*groups, "point")
        .agg(
            F.first("x").alias("x"),
            (F.sum(F.col("c") * F.exp(-0.5 * z * z)) / F.first(F.col("n") * F.col("bw"))).alias("density"),
        )
    )


def p_histogram(df: DataFrame, p: str = "p") -> DataFrame:
    """Counts of p by decade: floor(log10 p)."""
    decade = F.floor(F.log10(F.greatest(F.col(p), F.lit(1e-300))))
    return df.filter(F.col(p).isNotNull()).groupBy(decade.alias("decade")).agg(F.count("*").alias("n"))


def abs_max(cells: DataFrame) -> DataFrame:
    """Largest absolute value per sample, per feature and over the table: ``level, id, abs_max``."""
    sets = cells.groupingSets([[], ["sample_id"], ["feature_id"]], "sample_id", "feature_id").agg(
        F.max(F.abs("value")).alias("abs_max"),
        F.grouping("sample_id").alias("gs"),
        F.grouping("feature_id").alias("gf"),
    )
    level = F.when((F.col("gs") == 1) & (F.col("gf") == 1), "table").when(F.col("gs") == 0, "sample").otherwise("feature")
    return sets.select(
        level.alias("level"),
        F.coalesce("sample_id", F.col("feature_id").cast("string"), F.lit("all")).alias("id"),
        "abs_max",
    )
