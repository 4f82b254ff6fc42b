"""Differential testing of every feature between groups of samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions import special
from assaygrid.functions.missing import is_missing
from assaygrid.model import Assay
from assaygrid.operators.qc import zscore_rows
from assaygrid.runtime import broadcast_if


def tested_cells(assay: Assay, col: str, log2: bool = True, zero_missing: bool = True) -> DataFrame:
    """Observed cells on the tested scale with their group."""
    v = F.col("value")
    kept = assay.cells.filter(~is_missing(v, "zero" if zero_missing else "null"))
    groups = assay.samples.select("sample_id", F.col(col).alias("group"))
    scaled = kept.withColumn("value", F.log2(1 + v)) if log2 else kept
    return scaled.join(assay.per_sample(groups), "sample_id")


def group_moments(
    assay: Assay, col: str, a: str, b: str, log2: bool = True, zero_missing: bool = True, min_valid: int = 1
) -> DataFrame:
    """One row per feature: n, mean and variance in groups ``a`` and ``b``. One shuffle, no pivot."""
    cells = tested_cells(assay, col, log2, zero_missing).filter(F.col("group").isin(a, b))
    v = F.col("value")
    stats = []
    for side, name in (("a", a), ("b", b)):
        x = F.when(F.col("group") == name, v)
        stats += [F.count(x).alias(f"n_{side}"), F.avg(x).alias(f"mean_{side}"), F.var_samp(x).alias(f"var_{side}")]
    moments = cells.groupBy("feature_id").agg(*stats)
    return moments.filter((F.col("n_a") >= min_valid) & (F.col("n_b") >= min_valid))


def log2fc(moments: DataFrame, log2: bool = True, pseudocount: float = 1.0) -> DataFrame:
    """B against A: difference on the log2 scale, else the log2 ratio of means plus ``pseudocount``."""
    a, b = F.col("mean_a"), F.col("mean_b")
    fc = b - a if log2 else F.log2((b + pseudocount) / (a + pseudocount))
    return moments.withColumn("log2fc", fc)


def _var(side: str) -> Column:
    return F.coalesce(F.col(f"var_{side}"), F.lit(0.0))


def ttest(moments: DataFrame, kind: str = "welch") -> DataFrame:
    """Add ``se, t, df, p`` for ``student`` (pooled), ``welch`` or ``limma`` (moderated)."""
    if kind == "limma":
        return moderated_t(moments)
    na, nb = F.col("n_a"), F.col("n_b")
    diff = F.col("mean_b") - F.col("mean_a")
    if kind == "student":
        df = (na + nb - 2).cast("double")
        pooled = F.try_divide((na - 1) * _var("a") + (nb - 1) * _var("b"), df)
        se = F.when(df > 0, F.sqrt(pooled * (1 / na + 1 / nb)))
    else:
        ua, ub = _var("a") / na, _var("b") / nb
        se = F.when((na >= 2) & (nb >= 2), F.sqrt(ua + ub))
        df = F.try_divide((ua + ub) * (ua + ub), F.try_divide(ua * ua, na - 1) + F.try_divide(ub * ub, nb - 1))
    out = moments.withColumn("se", se).withColumn("df", F.when(F.col("se") > 0, df))
    out = out.withColumn("t", F.when(F.col("se") > 0, diff / F.col("se")))
    return out.withColumn("p", special.t_two_sided(F.col("t"), F.col("df")))


def variance_prior(df: DataFrame, s2: str = "s2", d: str = "dg") -> tuple[float, float]:
    """Prior variance and its degrees of freedom from the moments of log s2: one aggregate row."""
    good = df.filter((F.col(s2) > 0) & (F.col(d) > 0))
    row = good.agg(
        F.count("*").alias("n"),
        F.avg(F.log(s2)).alias("mean"),
        F.var_samp(F.log(s2)).alias("var"),
        F.avg(special.trigamma(F.col(d) / 2)).alias("tri"),
    ).first()
    if row["n"] < 3:
        return float("nan"), math.inf
    spread = row["var"] - row["tri"]
    if spread <= 0:
        return math.exp(row["mean"]), math.inf
    d0 = 2 * special.trigamma_inverse(spread)
    return math.exp(row["mean"] + special.digamma_value(d0 / 2) - math.log(d0 / 2)), d0


def moderated_t(moments: DataFrame) -> DataFrame:
    """t with the pooled variance moved towards a prior fitted over all features."""
    na, nb = F.col("n_a"), F.col("n_b")
    dg = (na + nb - 2).cast("double")
    s2 = F.try_divide((na - 1) * _var("a") + (nb - 1) * _var("b"), dg)
    base = moments.withColumn("dg", dg).withColumn("s2", F.when(dg > 0, s2))
    s0, d0 = variance_prior(base)
    post = F.lit(s0) if math.isinf(d0) else (d0 * s0 + F.col("dg") * F.col("s2")) / (d0 + F.col("dg"))
    ok = F.col("s2").isNotNull()
    out = base.withColumn("s2_post", F.when(ok, post)).withColumn("df", F.when(ok, F.col("dg") + F.lit(d0)))
    out = out.withColumn("se", F.sqrt("s2_post") * F.sqrt(1 / na + 1 / nb))
    diff = F.col("mean_b") - F.col("mean_a")
    t = F.when(F.col("se") > 0, diff / F.col("se")).when(ok, F.signum(diff) * 1e12)
    p = special.t_two_sided(F.col("t"), F.col("df"))
    return out.withColumn("t", t).withColumn("p", F.when(F.col("se") > 0, p).when(ok, (diff == 0).cast("double")))


def effect_ci(df: DataFrame, alpha: float = 0.05, estimate: str = "log2fc") -> DataFrame:
    """Confidence interval of an estimate with its ``se`` and ``df``."""
    with_crit = df.withColumn("_crit", special.t_critical(alpha, F.col("df")))
    half = F.col("_crit") * F.col("se")
    return with_crit.withColumn("ci_low", F.col(estimate) - half).withColumn("ci_high", F.col(estimate) + half).drop("_crit")


def _group_stats(assay: Assay, col: str, groups: Sequence[str], log2: bool, zero_missing: bool) -> DataFrame:
    cells = tested_cells(assay, col, log2, zero_missing).filter(F.col("group").isin(list(groups)))
    return cells.groupBy("feature_id", "group").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
    )


def anova(assay: Assay, col: str, groups: Sequence[str], log2: bool = True, zero_missing: bool = True) -> DataFrame:
    """One-way ANOVA over groups with at least two values: ``f, df1, df2, p, eta2``, and the largest mean.

    The second aggregation reads at most one row per (feature, group).
    """
    per = _group_stats(assay, col, groups, log2, zero_missing).filter("n >= 2")
    n, m, v = F.col("n"), F.col("mean"), F.coalesce("var", F.lit(0.0))
    total = per.groupBy("feature_id").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(n * m).alias("s1"),
        F.sum(n * m * m).alias("s2"),
        F.sum((n - 1) * v).alias("ssw"),
        F.max_by("group", F.struct("mean", "group")).alias("max_group"),
        F.max("mean").alias("max_mean"),
    ).filter("k >= 2")
    between = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))
    out = total.withColumn("ssb", between).withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("n") - F.col("k"))
    f = F.when(F.col("ssw") > 0, (F.col("ssb") / F.col("df1")) / (F.col("ssw") / F.col("df2")))
    eta2 = F.when(F.col("ssb") + F.col("ssw") > 0, F.col("ssb") / (F.col("ssb") + F.col("ssw")))
    out = out.withColumn("f", f).withColumn("eta2", eta2)
    p = special.f_upper(F.col("f"), F.col("df1"), F.col("df2"))
    return out.withColumn("p", p).select("feature_id", "k", "n", "f", "df1", "df2", "p", "eta2", "max_group", "max_mean")


def kruskal(assay: Assay, col: str, groups: Sequence[str], log2: bool = True, zero_missing: bool = True) -> DataFrame:
    """Kruskal-Wallis H with tie correction and its chi-square p. Ranks lie inside a feature's samples."""
    cells = tested_cells(assay, col, log2, zero_missing).filter(F.col("group").isin(list(groups)))
    size = F.count("*").over(Window.partitionBy("feature_id", "group"))
    cells = cells.repartition("feature_id").withColumn("_size", size).filter("_size >= 2")
    ties = F.count("*").over(Window.partitionBy("feature_id", "value"))
    low = F.rank().over(Window.partitionBy("feature_id").orderBy("value"))
    ranked = cells.withColumn("_t", ties).withColumn("_r", low + (F.col("_t") - 1) / 2)
    per = ranked.groupBy("feature_id", "group").agg(
        F.count("*").alias("n"), F.sum("_r").alias("r"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties")
    )
    # each of t tied values contributes t^2 - 1, so a tie run adds t^3 - t
    out = per.groupBy("feature_id").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("ties").alias("ties")
    ).filter("k >= 2")
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    correction = 1 - F.col("ties") / (n * n * n - n)
    out = out.withColumn("h", F.when(correction > 0, h / correction))
    return out.withColumn("p", special.chi2_upper(F.col("h"), F.col("k") - 1)).select("feature_id", "k", "n", "h", "p")


def classify(df: DataFrame, p: str = "p_adj", cutoff: float = 0.05, min_log2fc: float = 1.0) -> DataFrame:
    """``sig``: up, down or ns."""
    passed = (F.col(p) <= cutoff) & (F.abs("log2fc") >= min_log2fc)
    sig = F.when(passed, F.when(F.col("log2fc") > 0, "up").otherwise("down")).otherwise("ns")
    return df.withColumn("sig", F.coalesce(sig, F.lit("ns")))


def sam_rule(df: DataFrame, s0: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """Joint rule on effect and error: \\|log2FC\\| / (SE + s0) >= t*, with SE taken from log2FC / t."""
    se = F.when(F.abs("t") > 0, F.abs(F.col("log2fc") / F.col("t")))
    scored = df.withColumn("sam_se", se).withColumn("sam_t", F.abs("log2fc") / (F.col("sam_se") + s0))
    scored = scored.withColumn("_crit", special.t_critical(alpha, F.col("df")))
    return scored.withColumn("sam_pass", F.coalesce(F.col("sam_t") >= F.col("_crit"), F.lit(False))).drop("_crit")


def volcano(df: DataFrame, y: str = "p_adj") -> DataFrame:
    """Effect against -log10 of the p-value, at most 300; without a p-value a feature has no height."""
    height = F.when(F.col(y).isNotNull(), -F.log10(F.greatest(F.col(y), F.lit(1e-300))))
    return df.select("feature_id", F.col("log2fc").alias("x"), height.alias("y"))


def ma(df: DataFrame) -> DataFrame:
    return df.select("feature_id", ((F.col("mean_a") + F.col("mean_b")) / 2).alias("x"), F.col("log2fc").alias("y"))


def group_heatmap(assay: Assay, tests: DataFrame, col: str, groups: Sequence[str], n: int = 40, zscore: bool = True) -> DataFrame:
    """Group means of the ``n`` features with the smallest p, optionally z-scored per feature."""
    top = tests.filter(F.col("p").isNotNull()).orderBy("p", "feature_id").limit(n).select("feature_id")
    per = _group_stats(assay, col, groups, True, True).join(broadcast_if(top, n), "feature_id", "left_semi")
    means = per.select("feature_id", F.col("group").alias("sample_id"), F.col("mean").alias("value"))
    out = zscore_rows(means, ddof=0) if zscore else means.withColumn("z", F.col("value"))
    return out.select("feature_id", F.col("sample_id").alias("group"), F.col("value").alias("mean"), "z")


def quant_table(assay: Assay, col: str, log2: bool = True) -> DataFrame:
    """One column per sample with the tested values; the sample list is the pivot's value list."""
    names = [r[0] for r in assay.samples.select("sample_id").orderBy("sample_id").collect()]
    cells = tested_cells(assay, col, log2)
    return cells.groupBy("feature_id").pivot("sample_id", names).agg(F.first("value"))


def group_boxes(assay: Assay, col: str, log2: bool = True) -> DataFrame:
    """Quartiles of each feature within each group; a group holds at most one value per sample."""
    v = F.col("value")
    return tested_cells(assay, col, log2).groupBy("feature_id", "group").agg(
        F.count("*").alias("n"), F.min(v).alias("min"), F.percentile(v, F.lit(0.25)).alias("q1"), F.median(v).alias("median"),
        F.percentile(v, F.lit(0.75)).alias("q3"), F.max(v).alias("max"),
    )


def anova_filter(df: DataFrame, min_eta2: float = 0.02, min_f: float = 0.0) -> DataFrame:
    """Effect-size and statistic cutoffs of the multi-group view."""
    return df.filter((F.col("eta2") >= min_eta2) & (F.col("f") >= min_f))
