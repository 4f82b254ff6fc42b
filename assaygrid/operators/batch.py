"""Detection and correction of batch effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_missing
from assaygrid.model import Assay
from assaygrid.operators import blocks
from assaygrid.operators.meta import attach_meta
from assaygrid.operators.ordination import sample_pca
from assaygrid.operators.qc import histogram
from assaygrid.operators.quantiles import group_quantiles
from assaygrid.runtime import materialize

R2_HIGH = 0.3


def work_scale(assay: Assay, requested: str = "auto") -> str:
    """``log10`` when more than half of the observed values of the whole matrix exceed 100, else ``raw``."""
    if requested != "auto":
        return requested
    cells = assay.observed("positive")
    share = cells.agg(F.avg((F.col("value") > 100).cast("int"))).first()[0]
    return "log10" if share is not None and share > 0.5 else "raw"


def _work(v: Column, mode: str) -> Column:
    return F.log10(v) if mode == "log10" else v


def _batched(assay: Assay, col: str) -> DataFrame:
    return attach_meta(assay, col).withColumnRenamed(col, "batch_") if col != "batch_" else attach_meta(assay, col)


def batch_r2(assay: Assay, col: str, scale: str = "auto") -> DataFrame:
    """Share of each feature's variance explained by batch; 0 with fewer than two values or batches."""
    mode = work_scale(assay, scale)
    v = F.col("value")
    cells = _batched(assay, col).withColumn("value", F.when(~is_missing(v), _work(v, mode)))
    per = cells.groupBy("feature_id", "batch_").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    n, m = F.col("n"), F.col("m")
    total = per.groupBy("feature_id").agg(
        F.sum("n").alias("n"),
        F.count_if(n > 0).alias("batches"),
        F.sum(n * m).alias("s1"),
        F.sum(n * m * m).alias("s2"),
        F.sum(n * F.col("v")).alias("ssw"),
    )
    between = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))
    all_ = between + F.col("ssw")
    ok = (F.col("n") >= 2) & (F.col("batches") >= 2) & (all_ > 1e-12 * F.abs("s2"))
    r2 = F.least(F.lit(1.0), F.greatest(F.lit(0.0), between / all_))
    return total.select("feature_id", "n", F.coalesce(F.when(ok, r2), F.lit(0.0)).alias("r2"))


def batch_r2_summary(r2: DataFrame) -> DataFrame:
    """Mean, median and share of features at or above 0.3."""
    stats = r2.agg(
        F.count("*").alias("n_features"), F.avg("r2").alias("mean"), F.avg((F.col("r2") >= R2_HIGH).cast("int")).alias("high_share")
    )
    median = group_quantiles(r2, [], "r2", {"median": 0.5}, 1).select("median").scalar()
    return stats.withColumn("median", median)


def r2_histogram(r2: DataFrame, bins: int = 20) -> DataFrame:
    """``bin, n, bin_start``: features by the share that batch explains."""
    return histogram(r2, "r2", 0.0, 1.0, 1.0 / bins)


def eta_squared(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Share of one score's variance between labels, in [0, 1]; 0 without spread."""
    per = scores.filter(F.col(score).isNotNull()).groupBy(label).agg(
        F.count("*").alias("n"), F.avg(score).alias("m"), F.var_pop(score).alias("v")
    )
    n, m = F.col("n"), F.col("m")
    one = per.agg(F.sum("n").alias("n"), F.sum(n * m).alias("s1"), F.sum(n * m * m).alias("s2"), F.sum(n * F.col("v")).alias("ssw"))
    between = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))
    eta = F.when((F.col("n") >= 2) & (between + F.col("ssw") > 0), between / (between + F.col("ssw")))
    return one.select(F.coalesce(F.least(eta, F.lit(1.0)), F.lit(0.0)).alias("eta2"))


def batch_silhouette(scores: DataFrame, label: str = "label") -> DataFrame:
    """Silhouette of every sample by batch; the mean distance inside a batch of one is 0."""
    sil = blocks.silhouette(scores, label)
    a, b = F.coalesce("a", F.lit(0.0)), F.col("b")
    value = F.when(b.isNotNull() & (F.greatest(a, b) > 0), (b - a) / F.greatest(a, b))
    return sil.select("item_id", "label", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def batch_stats(assay: Assay, col: str) -> DataFrame:
    """Per batch: observed cells, mean and median, log10 mean, median and sd, missing share of the grid."""
    cells = _batched(assay, col).filter(~is_missing(F.col("value"))).withColumn("l", F.log10("value"))
    n_features = assay.cells.agg(F.count_distinct("feature_id")).scalar()
    sizes = assay.samples.select(F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.lit("(unassigned)")).alias("batch_"))
    sizes = sizes.groupBy("batch_").agg(F.count("*").alias("n_samples"))
    basic = cells.groupBy("batch_").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg("l").alias("log_mean"), F.coalesce(F.stddev_samp("l"), F.lit(0.0)).alias("log_sd")
    )
    raw = group_quantiles(cells, ["batch_"], "value", {"median": 0.5}, assay.n_samples).drop("n")
    log = group_quantiles(cells, ["batch_"], "l", {"log_median": 0.5}, assay.n_samples).drop("n")
    joined = sizes.join(basic, "batch_", "left").join(raw, "batch_", "left").join(log, "batch_", "left")
    total = F.col("n_features") * F.col("n_samples")
    return joined.withColumn("n_features", n_features).withColumn("missing_share", 1 - F.coalesce("n", F.lit(0)) / total).drop("n_features").withColumnRenamed("batch_", "batch")


def batch_metrics(assay: Assay, col: str, scale: str = "auto") -> DataFrame:
    """One row: R2 mean, median and high share, mean silhouette, eta squared of PC1 and PC2."""
    assay = assay.with_cells(materialize(assay.cells))  # every metric reads them
    summary = batch_r2_summary(materialize(batch_r2(assay, col, scale)))
    labels = assay.samples.select("sample_id", F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.lit("(unassigned)")).alias("label"))
    scores = materialize(sample_pca(assay, 2).scores.join(labels, "sample_id"))
    vectors = scores.select(F.col("sample_id").alias("item_id"), F.array("pc1", "pc2").alias("vec"), "label")
    sil = batch_silhouette(vectors).agg(F.avg("silhouette")).scalar()
    out = summary.withColumn("silhouette", sil)
    for i in (1, 2):
        out = out.withColumn(f"pc{i}_eta2", eta_squared(scores, f"pc{i}", "label").scalar())
    return out


def correct(
    assay: Assay, col: str, method: str = "median", covariate: str | None = None, shrink: bool = True, scale: str = "auto"
) -> DataFrame:
    """Observed cells moved to a common batch level; other cells stay as they are.

    Each value is compared with an anchor: its covariate group's mean in the feature, else the feature's
    median (``median``) or mean. ``median`` and ``mean`` subtract the batch's centre of the residuals.
    ``combat`` also scales: the residual, less the batch location, times pooled / batch scale. With
    ``shrink`` weak batch locations are drawn to 0 and batch variances to the pooled variance.

    All windows lie inside a feature (at most one cell per sample), so there is one shuffle.
    """
    mode = work_scale(assay, scale)
    cells = _batched(assay, col)
    if covariate is not None:
        groups = assay.samples.select("sample_id", F.coalesce(F.nullif(F.trim(F.col(covariate)), F.lit("")), F.lit("(unassigned)")).alias("_g"))
        cells = cells.join(assay.per_sample(groups), "sample_id", "left")
        n_levels = groups.agg(F.count_distinct("_g")).scalar()
        cells = cells.withColumn("_levels", n_levels)
    v = F.col("value")
    cells = cells.repartition("feature_id").withColumn("_x", F.when(~is_missing(v), _work(v, mode)))
    feat, bat = Window.partitionBy("feature_id"), Window.partitionBy("feature_id", "batch_")
    x = F.col("_x")
    centre = (F.median(x) if method == "median" else F.avg(x)).over(feat)
    anchor = centre
    if covariate is not None:
        group_mean = F.avg(x).over(Window.partitionBy("feature_id", "_g"))
        anchor = F.when(F.col("_levels") >= 2, group_mean).otherwise(centre)
    cells = cells.withColumn("_n", F.count(x).over(feat)).withColumn("_anchor", anchor)
    cells = cells.withColumn("_r", x - F.col("_anchor"))
    r = F.col("_r")
    if method in ("median", "mean"):
        loc = (F.median(r) if method == "median" else F.avg(r)).over(bat)
        new = F.col("_anchor") + r - loc
    elif method == "combat":
        n_batches = assay.samples.agg(F.count_distinct(F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.lit("(unassigned)")))).scalar()
        cells = (
            cells.withColumn("_nb", F.count(r).over(bat))
            .withColumn("_loc", F.avg(r).over(bat))
            .withColumn("_sc", F.coalesce(F.stddev_samp(r).over(bat), F.lit(0.0)))
            .withColumn("_k", n_batches)
        )
        nb, loc, sc, k = F.col("_nb"), F.col("_loc"), F.col("_sc"), F.col("_k")
        seen = x.isNotNull()

        def over_batches(e: Column) -> Column:
            """Sum of a per-batch quantity: each of the batch's n cells carries 1/n of it."""
            return F.coalesce(F.sum(F.when(seen, e / nb)).over(feat), F.lit(0.0))

        cells = (
            cells.withColumn("_ss", over_batches(F.when(nb > 1, (nb - 1) * sc * sc).otherwise(0.0)))
            .withColumn("_df", F.round(over_batches(F.when(nb > 1, nb - 1).otherwise(0).cast("double"))))
            .withColumn("_locs", over_batches(loc))
            .withColumn("_locs2", over_batches(loc * loc))
            .withColumn("_noise", over_batches(F.when(sc > 0, sc * sc / nb).otherwise(0.0)))
            .withColumn("_noise_n", F.round(over_batches(F.when(sc > 0, F.lit(1.0)).otherwise(0.0))))
        )
        pooled = F.when(F.col("_df") > 0, F.sqrt(F.try_divide(F.col("_ss"), F.col("_df")))).otherwise(0.0)
        cells = cells.withColumn("_p", F.when(pooled > 0, pooled).otherwise(1.0))
        p = F.col("_p")
        if shrink:
            mean_loc = F.col("_locs") / k
            spread = F.when(k > 1, (F.col("_locs2") - k * mean_loc * mean_loc) / (k - 1)).otherwise(0.0)
            noise = F.when(F.col("_noise_n") > 0, F.try_divide(F.col("_noise"), F.col("_noise_n"))).otherwise(0.0)
            w = nb * F.greatest(F.lit(0.0), spread - noise)
            loc_adj = F.when((sc > 0) & (w > 0), loc * F.try_divide(w, w + sc * sc)).otherwise(0.0)
            nu = F.greatest(F.lit(1.0), F.col("_n") / k - 1)
            var = ((nb - 1) * sc * sc + nu * p * p) / ((nb - 1) + nu)
            sc_adj = F.when(nb <= 1, p).otherwise(F.sqrt(F.greatest(var, F.lit(1e-10))))
            loc_adj = F.when(k >= 2, loc_adj).otherwise(loc)
            sc_adj = F.when(k >= 2, sc_adj).otherwise(sc)
        else:
            loc_adj, sc_adj = loc, sc
        scale_by = F.when(sc_adj > 0, sc_adj).otherwise(p)
        new = F.col("_anchor") + p * (r - loc_adj) / scale_by
    else:
        raise ValueError(f"unknown method {method!r}")
    back = F.pow(F.lit(10.0), new) if mode == "log10" else new
    moved = F.when(x.isNotNull() & (F.col("_n") >= 2), back).otherwise(v)
    return cells.withColumn("_new", moved).select("feature_id", "sample_id", F.col("_new").alias("value"))


def batch_compare(before: Assay, after: Assay, col: str) -> DataFrame:
    """Metrics before and after, and their difference."""
    parts = [batch_metrics(a, col).withColumn("stage", F.lit(s)) for a, s in ((before, "before"), (after, "after"))]
    both = materialize(parts[0].unionByName(parts[1]))
    names = [c for c in both.columns if c not in ("stage", "n_features")]
    long = both.select("stage", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in names])))
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col("stage") == "before", F.col("v"))).alias("before"), F.max(F.when(F.col("stage") == "after", F.col("v"))).alias("after")
    )
    return wide.withColumn("delta", F.col("after") - F.col("before"))
