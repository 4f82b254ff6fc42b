"""Sample against sample: correlation, distances, paired views and outlier calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_missing, transformed
from assaygrid.model import Assay
from assaygrid.operators.pairs import BLOCK, index_samples, named, pair_sums, pearson, rank_sums, spearman
from assaygrid.operators.qc import QUARTILES
from assaygrid.operators.quantiles import group_quantiles
from assaygrid.operators.ranking import row_numbers
from assaygrid.runtime import materialize


def working_cells(assay: Assay, transform: str = "log10p1", rule: str = "zero") -> DataFrame:
    """Observed cells on the shared QC scale."""
    kept = assay.cells.filter(~is_missing(F.col("value"), rule))
    return kept.withColumn("value", transformed(F.col("value"), transform))


def _sums(assay: Assay, cells: DataFrame, extra: bool = False) -> tuple[DataFrame, DataFrame]:
    index = index_samples(assay.samples)
    entries = cells.join(assay.per_sample(index), "sample_id").select("feature_id", "idx", "value")
    return pair_sums(entries, "feature_id", assay.n_samples, extra), assay.per_sample(index)


def corr_matrix(assay: Assay, transform: str = "log10p1", rule: str = "zero") -> DataFrame:
    """Pearson r of every sample pair a < b over the features observed in both: ``a, b, n, r``."""
    sums, index = _sums(assay, working_cells(assay, transform, rule))
    r = pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    pairs = sums.filter("i < j").select("i", "j", F.col("n").cast("bigint").alias("n"), r.alias("r"))
    return named(pairs, index, "a", "b")


def spearman_matrix(assay: Assay, transform: str = "log10p1", rule: str = "zero") -> DataFrame:
    """Spearman r of every sample pair a < b, with ranks taken within the pair's shared features: ``a, b, n, r``.

    The work holds a few samples x samples matrices per task. Above ``pairs.BLOCK`` samples the pairs are
    done one pair of sample blocks after the other.
    """
    index = index_samples(assay.samples)
    cells = working_cells(assay, transform, rule).join(assay.per_sample(index), "sample_id").select("feature_id", "idx", "value")
    n_blocks = -(-assay.n_samples // BLOCK)
    half = BLOCK // 2
    if n_blocks <= 1:
        sums = rank_sums(cells, "feature_id", assay.n_samples)
    else:
        cells, sums = materialize(cells), None
        n_half = -(-assay.n_samples // half)
        for x in range(n_half):
            for y in range(x + 1, n_half):
                both = cells.filter((F.col("idx").between(x * half, x * half + half - 1)) | (F.col("idx").between(y * half, y * half + half - 1)))
                local = F.when(F.col("idx") < (x + 1) * half, F.col("idx") - x * half).otherwise(F.col("idx") - y * half + half)
                part = rank_sums(both.withColumn("idx", local), "feature_id", 2 * half)
                back = [F.when(F.col(c) < half, F.col(c) + x * half).otherwise(F.col(c) - half + y * half).alias(c) for c in ("i", "j")]
                part = part.select(*back, "n", "cross", "square_i", "square_j")
                sums = part if sums is None else sums.unionByName(part)
        sums = sums.dropDuplicates(["i", "j"])  # pairs inside a block come up with every partner
    r = spearman(*[F.col(c) for c in ("n", "cross", "square_i", "square_j")])
    return named(sums.select("i", "j", F.col("n").cast("bigint").alias("n"), r.alias("r")), assay.per_sample(index), "a", "b")


def corr_distance(corr: DataFrame, kind: str = "one_minus_r") -> DataFrame:
    """Distance from a correlation frame: ``one_minus_r`` or ``sqrt`` for sqrt(2 (1 - r))."""
    r = F.col("r")
    d = {"one_minus_r": 1 - r, "sqrt": F.sqrt(F.greatest(2 * (1 - r), F.lit(0.0)))}[kind]
    return corr.withColumn("distance", d)


def zscored_distance(assay: Assay, transform: str = "log10p1", rule: str = "zero") -> DataFrame:
    """Euclidean distance of z-scored samples over the features observed in both."""
    cells = working_cells(assay, transform, rule)
    stats = cells.groupBy("sample_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0)
    scaled = cells.join(assay.per_sample(stats), "sample_id").withColumn("value", z)
    sums, index = _sums(assay, scaled)
    d = F.sqrt(F.greatest(F.col("sxx") + F.col("syy") - 2 * F.col("sxy"), F.lit(0.0)))
    pairs = sums.filter("i < j").select("i", "j", F.col("n").cast("bigint").alias("n"), d.alias("distance"))
    return named(pairs, index, "a", "b")


def distance_of(metric: str) -> Column:
    """Distance from pair sums over all dimensions (nothing missing)."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    if metric == "euclidean":
        return F.sqrt(F.greatest(sxx + syy - 2 * sxy, F.lit(0.0)))
    if metric == "manhattan":
        return F.col("sabs")
    if metric == "correlation":
        return 1 - F.coalesce(pearson(n, sx, sy, sxx, syy, sxy), F.lit(0.0))
    if metric == "cosine":
        return F.when((sxx > 0) & (syy > 0), 1 - sxy / F.sqrt(sxx * syy)).otherwise(1.0)
    if metric == "bray_curtis":
        return F.when(sx + sy > 0, F.col("sabs") / (sx + sy)).otherwise(0.0)
    raise ValueError(f"unknown metric {metric!r}")


def pair_distance(assay: Assay, metric: str) -> DataFrame:
    """Distance of every sample pair a < b over all features; missing cells count as 0."""
    filled = assay.dense().withColumn("value", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))
    sums, index = _sums(assay, filled, extra=metric in ("manhattan", "bray_curtis"))
    pairs = sums.filter("i < j").select("i", "j", distance_of(metric).alias("distance"))
    return named(pairs, index, "a", "b")


def shared_distance(sums: DataFrame, metric: str = "euclidean", min_shared: int = 1) -> DataFrame:
    """Distance per shared dimension, from pair sums: ``i, j, n, distance``; null below ``min_shared``.

    Root mean square, mean absolute difference, 1 - r or 1 - cosine.
    """
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    if metric == "euclidean":
        d = F.sqrt(F.greatest(sxx + syy - 2 * sxy, F.lit(0.0)) / n)
    elif metric == "manhattan":
        d = F.col("sabs") / n
    elif metric == "pearson":
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        flat_x, flat_y = vx <= 1e-12 * sxx, vy <= 1e-12 * syy
        r = (sxy - sx * sy / n) / F.sqrt(vx * vy)
        d = F.when(n < 2, None).when(flat_x & flat_y, 0.0).when(flat_x | flat_y, 1.0).otherwise(F.greatest(1 - r, F.lit(0.0)))
    else:
        d = F.when((sxx == 0) | (syy == 0), 1.0).otherwise(F.greatest(1 - sxy / F.sqrt(sxx * syy), F.lit(0.0)))
    return sums.select("i", "j", F.col("n").cast("bigint").alias("n"), F.when(n >= min_shared, d).alias("distance"))


def pair_points(assay: Assay, x: str, y: str, transform: str = "log10p1", rule: str = "zero") -> DataFrame:
    """Features observed in both samples: ``feature_id, x, y``. One shuffle, no self join."""
    v, s = F.col("value"), F.col("sample_id")
    both = working_cells(assay, transform, rule).filter(s.isin(x, y)).groupBy("feature_id").agg(
        F.max(F.when(s == x, v)).alias("x"), F.max(F.when(s == y, v)).alias("y")
    )
    return both.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def qq(points: DataFrame) -> DataFrame:
    """Sorted values of both columns side by side: ``rank, x, y``."""
    ids = "feature_id"
    long = points.select(ids, F.inline(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v"))
    )))
    ranked = row_numbers(long, [("v", True), (ids, True)], ["axis"], 2)
    return ranked.groupBy("rank").agg(
        F.max(F.when(F.col("axis") == "x", F.col("v"))).alias("x"), F.max(F.when(F.col("axis") == "y", F.col("v"))).alias("y")
    )


def bland_altman(points: DataFrame, mode: str = "difference") -> DataFrame:
    """Agreement of y with x: ``mean, diff`` per feature.

    ``difference``: y - x against the mean. ``ratio``: log2(y / x) against the geometric mean, values > 0.
    """
    x, y = F.col("x"), F.col("y")
    if mode == "difference":
        return points.select("feature_id", ((x + y) / 2).alias("mean"), (y - x).alias("diff"))
    kept = points.filter((x > 0) & (y > 0))
    return kept.select("feature_id", F.sqrt(x * y).alias("mean"), F.log2(y / x).alias("diff"))


def agreement(ba: DataFrame) -> DataFrame:
    """Bias and limits of agreement (1.96 sd) of a Bland-Altman frame."""
    out = ba.agg(F.count("*").alias("n"), F.avg("diff").alias("bias"), F.stddev_samp("diff").alias("sd"))
    return out.select(
        "n", "bias", "sd", (F.col("bias") - 1.96 * F.col("sd")).alias("low"), (F.col("bias") + 1.96 * F.col("sd")).alias("high")
    )


def corr_to(assay: Assay, x: str, transform: str = "log10p1", rule: str = "zero") -> DataFrame:
    """Pearson r of every other sample against sample ``x``."""
    cells = working_cells(assay, transform, rule)
    base = cells.filter(F.col("sample_id") == x).select("feature_id", F.col("value").alias("xv"))
    joined = cells.filter(F.col("sample_id") != x).join(base, "feature_id")
    xv, v = F.col("xv"), F.col("value")
    sums = joined.groupBy("sample_id").agg(
        F.count("*").alias("n"),
        F.sum(xv).alias("sx"), F.sum(v).alias("sy"),
        F.sum(xv * xv).alias("sxx"), F.sum(v * v).alias("syy"), F.sum(xv * v).alias("sxy"),
    )
    r = pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return sums.select("sample_id", "n", r.alias("r"))


def outlier_metrics(assay: Assay, log: bool = True, with_corr: bool = True) -> DataFrame:
    """Per sample: missing fraction, median, IQR, population skewness and mean r with the others."""
    scale = F.log10(1 + F.col("value")) if log else F.col("value")
    cells = assay.observed("positive", scale)
    n_features = assay.cells.agg(F.count_distinct("feature_id")).scalar()
    quart = group_quantiles(cells, ["sample_id"], "value", QUARTILES, assay.n_samples)
    moments = cells.groupBy("sample_id").agg(F.skewness("value").alias("skew"))
    out = (
        assay.samples.select("sample_id")
        .join(assay.per_sample(quart), "sample_id", "left")
        .join(assay.per_sample(moments), "sample_id", "left")
        .select(
            "sample_id",
            (1 - F.coalesce("n", F.lit(0)) / n_features).alias("missing"),
            F.col("median"),
            (F.col("q3") - F.col("q1")).alias("iqr"),
            "skew",
        )
    )
    if with_corr and assay.n_samples >= 3:
        # r does not change under the pairs' order, so each pair counts for both of its samples
        sums, index = _sums(assay, cells)
        r = pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
        pairs = named(sums.filter("i < j").select("i", "j", r.alias("r")), index, "a", "b")
        both = pairs.select(F.explode(F.array("a", "b")).alias("sample_id"), "r")
        out = out.join(assay.per_sample(both.groupBy("sample_id").agg(F.avg("r").alias("mean_r"))), "sample_id", "left")
    return out


def modified_z(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``z_<col>`` = 0.6745 (x - median) / MAD for each column; null where the MAD is 0.

    ``df`` has a row per sample. It is read several times, so it should be a stored table.
    """
    centred = df.withColumn("_c", df.agg(F.struct(*[F.median(c).alias(c) for c in cols])).scalar())
    mads = F.struct(*[F.median(F.abs(F.col(c) - F.col(f"_c.{c}"))).alias(c) for c in cols])
    scored = centred.withColumn("_m", centred.agg(mads).scalar())
    z = [
        F.when(F.col(f"_m.{c}") > 0, 0.6745 * (F.col(c) - F.col(f"_c.{c}")) / F.col(f"_m.{c}")).alias(f"z_{c}")
        for c in cols
    ]
    return scored.select(*df.columns, *z)


def outliers(metrics: DataFrame, threshold: float = 3.5, min_flags: int = 2) -> DataFrame:
    """z of every metric, flags, score (largest absolute z) and the call.

    Missing counts on the high side only, mean r on the low side only, the rest on both.
    """
    names = [c for c in metrics.columns if c != "sample_id"]
    out = modified_z(materialize(metrics), names)
    flags = []
    for name in names:
        z = F.col(f"z_{name}")
        hit = {"missing": z > threshold, "mean_r": z < -threshold}.get(name, F.abs(z) > threshold)
        flags.append(F.coalesce(hit, F.lit(False)).cast("int"))
    score = F.greatest(*[F.coalesce(F.abs(f"z_{n}"), F.lit(0.0)) for n in names])
    total = sum(flags[1:], flags[0])
    return out.withColumn("n_flags", total).withColumn("score", score).withColumn("outlier", total >= min_flags)
