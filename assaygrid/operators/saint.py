"""Bait-prey interaction scoring against control purifications.

The assay's samples carry ``status`` (T or C) and ``bait``; its features carry ``prey``. A value that is
null, NaN or exactly 0 is missing, also after log2 (so an intensity of 1 is missing).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_missing
from assaygrid.model import Assay
from assaygrid.operators.quantiles import group_quantiles
from assaygrid.operators.ranking import join_counted
from assaygrid.runtime import materialize

LOG2_4 = 2.0


def assign_status(samples: DataFrame, status: str | None = None, col: str | None = None, control: str = "", treatment: str = "", bait: str = "bait") -> DataFrame:
    """``status`` and ``bait`` of every sample: a status column as it is, or two values of a meta column."""
    if status is not None:
        mark = F.upper(F.trim(F.coalesce(F.col(status).cast("string"), F.lit(""))))
    else:
        value = F.trim(F.col(col))
        mark = F.when(value == control, "C").when(value == treatment if treatment else value != control, "T").otherwise("")
    named = F.coalesce(F.col(bait).cast("string"), F.lit(""))
    return samples.withColumn("status", mark).withColumn("bait", named)


def _present(v: Column) -> Column:
    return ~is_missing(v, "zero")


def _part(assay: Assay, status: str) -> DataFrame:
    """Dense cells of the samples with one status, with their prey."""
    chosen = assay.samples.filter(F.col("status") == status).select("sample_id", "bait")
    cells = assay.dense().join(assay.per_sample(chosen), "sample_id")
    return cells.join(assay.features.select("feature_id", "prey"), "feature_id")


def control_scale(assay: Assay) -> DataFrame:
    """Factor that brings the mean control value to the mean test value: one row."""
    groups = assay.per_sample(assay.samples.select("sample_id", "status"))
    v = F.when(_present(F.col("value")), F.col("value"))
    cells = assay.cells.join(groups, "sample_id")
    means = cells.agg(F.avg(F.when(F.col("status") == "T", v)).alias("t"), F.avg(F.when(F.col("status") == "C", v)).alias("c"))
    ok = (F.col("t") != 0) & (F.col("c") != 0)
    return means.select(F.coalesce(F.when(ok, F.col("t") / F.col("c")), F.lit(1.0)).alias("factor"))


def impute_controls(assay: Assay, normalise: bool = False) -> DataFrame:
    """Controls without gaps: 0.9 x the prey's minimum in that control, else 0.9 x the prey's minimum, else the overall minimum."""
    cells = _part(assay, "C")
    if normalise:
        cells = cells.withColumn("_f", control_scale(assay).scalar()).withColumn("value", F.col("value") * F.col("_f")).drop("_f")
    v = F.when(_present(F.col("value")), F.col("value"))
    cells = materialize(cells.withColumn("value", v))
    by_column = cells.groupBy("prey", "sample_id").agg(F.min("value").alias("_col"), F.count("*").alias("_n"))
    by_prey = cells.groupBy("prey").agg(F.min("value").alias("_prey"))
    lowest = cells.agg(F.coalesce(F.min("value"), F.lit(1.0))).scalar()
    lookup = by_column.join(by_prey, "prey").withColumn("_all", lowest)
    filled = F.coalesce("value", F.col("_col") * 0.9, F.col("_prey") * 0.9, F.col("_all"))
    return join_counted(cells, lookup, ["prey", "sample_id"], "_n").select("feature_id", "prey", "sample_id", filled.alias("value"))


def _raised(stats: DataFrame, floor: float) -> DataFrame:
    """Standard deviations below the median of the positive ones are raised to it."""
    stats = materialize(stats)
    median = group_quantiles(stats.filter(F.col("sd") > floor), [], "sd", {"m": 0.5}, 1).select("m").scalar()
    return stats.withColumn("_m", median).withColumn("sd", F.greatest("sd", F.coalesce("_m", "sd"))).drop("_m")


def control_stats(controls: DataFrame, top: int | None = None) -> DataFrame:
    """log2 mean and sd of the control values per feature, of all or of the ``top`` largest."""
    logs = controls.withColumn("value", F.log2("value")).filter(_present(F.col("value")))
    if top is not None:
        w = Window.partitionBy("feature_id").orderBy(F.desc("value"))  # one value per control sample
        logs = logs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    stats = logs.groupBy("feature_id").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    return _raised(stats, 1e-10)


def test_cells(assay: Assay) -> DataFrame:
    """Observed test values on the log2 scale with sample, bait and prey."""
    chosen = assay.per_sample(assay.samples.filter("status = 'T'").select("sample_id", "bait"))
    kept = assay.cells.filter(_present(F.col("value"))).join(chosen, "sample_id").withColumn("value", F.log2("value"))
    return kept.filter(_present(F.col("value"))).join(assay.features.select("feature_id", "prey"), "feature_id")


def test_stats(tests: DataFrame) -> DataFrame:
    """log2 mean and sd of each feature's test values."""
    stats = tests.groupBy("feature_id").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    return _raised(stats, 0.0)


def _density(x: Column, mu: Column, sd: Column) -> Column:
    z = (x - mu) / sd
    return F.when((sd > 0) & (mu != 0) & (x != 0), F.pow(F.lit(2.0), -F.least(z * z / 2, F.lit(32.0))) / sd)


def likelihoods(tests: DataFrame, control: DataFrame, test: DataFrame) -> DataFrame:
    """False and true likelihood of every test value: ``lik_false, lik_true`` (null when undefined)."""
    c = control.select("feature_id", F.col("mean").alias("mu_f"), F.col("sd").alias("sd_f"))
    t = test.select("feature_id", F.col("mean").alias("mu_all"), F.col("sd").alias("sd_t"))
    shift = F.when(F.col("mu_all") == 0, LOG2_4).otherwise(F.greatest(F.col("mu_all") - F.col("mu_f"), F.lit(LOG2_4)))
    rows = tests.join(c, "feature_id", "left").join(t, "feature_id", "left").withColumn("mu_t", F.col("mu_f") + shift)
    x = F.col("value")
    return rows.select(
        "feature_id", "sample_id", "bait", "prey",
        _density(F.greatest(x, F.col("mu_f")), F.col("mu_f"), F.col("sd_f")).alias("lik_false"),
        _density(F.least(x, F.col("mu_t")), F.col("mu_t"), F.col("sd_t")).alias("lik_true"),
    )


def fit_prior(lik: DataFrame, max_rounds: int = 100, tolerance: float = 0.01) -> dict[str, float]:
    """Prior weight ``beta`` (in [-2, 2]) by alternating labels and prior; each round is one aggregate.

    With labels fixed the best weight is log2(n1 / n0). Cells without a likelihood take no part.
    ``lik`` is read once per round, so it should be a stored table.
    """
    lik = lik.filter("lik_false IS NOT NULL AND lik_true IS NOT NULL")
    used, beta, old = 0, 0.0, None
    for _ in range(max_rounds):
        chosen = F.lit(2.0**beta) * F.col("lik_true") > F.col("lik_false")
        row = lik.agg(
            F.count("*").alias("n"), F.count_if(chosen).alias("n1"),
            F.sum(F.log(F.when(chosen, F.col("lik_true")).otherwise(F.col("lik_false")))).alias("s"),
            F.sum(F.log("lik_false")).alias("s0"),
        ).first()
        n, n1 = row["n"], row["n1"]
        if not n:
            break
        used = n
        if old is None:
            old = row["s0"] - n * math.log(2)
        beta = -2.0 if n1 == 0 else 2.0 if n1 == n else min(2.0, max(-2.0, math.log2(n1 / (n - n1))))
        new = row["s"] + n1 * beta * math.log(2) - n * math.log1p(2.0**beta)
        if new >= old and abs(new - old) < tolerance:
            break
        old = new
    return {"beta": beta, "cells": used}


def avg_p(lik: DataFrame, samples: DataFrame, beta: float, top: int | None = None) -> DataFrame:
    """``bait, prey, n_rep, avg_p``: mean over replicates of each replicate's mean score, four decimals.

    The prior weight enters as e^beta here, although the fit uses 2^beta. A replicate without a score
    counts as 0; scores of 0 are missing. ``top`` keeps the largest replicate scores only.
    """
    weight = math.exp(beta)
    up = weight * F.col("lik_true")
    scored = lik.withColumn("score", up / (up + F.col("lik_false")))
    per_rep = scored.groupBy("bait", "prey", "sample_id").agg(F.coalesce(F.avg(F.when(F.col("score") != 0, F.col("score"))), F.lit(0.0)).alias("s"))
    reps = samples.filter("status = 'T'").groupBy("bait").agg(F.count("*").alias("n_rep"))
    if top is not None:
        w = Window.partitionBy("bait", "prey").orderBy(F.desc("s"))  # one value per replicate
        per_rep = per_rep.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    total = per_rep.groupBy("bait", "prey").agg(F.sum("s").alias("s")).join(reps, "bait")
    raw = F.col("s") / (F.col("n_rep") if top is None else F.least("n_rep", F.lit(top)))
    return total.select("bait", "prey", "n_rep", (F.floor(raw * 10000 + 0.5) / 10000).alias("avg_p"))


def bfdr(scores: DataFrame) -> DataFrame:
    """Add ``bfdr``: 1 - mean of all strictly larger scores; 0 for the largest, null for a score of 0.

    Scores have four decimals, so there are at most 10,001 distinct ones to order.
    """
    counts = scores.filter("avg_p <> 0").groupBy("avg_p").agg(F.count("*").alias("n"))
    steps = F.round(F.col("avg_p") * 10000).cast("bigint")  # whole units keep the sums exact
    before = Window.orderBy(F.desc("avg_p")).rowsBetween(Window.unboundedPreceding, -1)
    run = counts.withColumn("s", F.sum(steps * F.col("n")).over(before)).withColumn("c", F.sum("n").over(before))
    value = F.when(F.col("c").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("s") / (F.col("c") * 10000)))
    lookup = run.select("avg_p", value.alias("bfdr"))
    return scores.join(F.broadcast(lookup), "avg_p", "left")


def saint(assay: Assay, normalise: bool = False, top_control: int | None = None, top_rep: int | None = None) -> DataFrame:
    """The whole analysis: ``bait, prey, n_rep, avg_p, bfdr, confidence``."""
    assay = assay.with_cells(materialize(assay.cells))
    control = control_stats(impute_controls(assay, normalise), top_control)
    tests = materialize(test_cells(assay))
    lik = materialize(likelihoods(tests, control, test_stats(tests)))
    scores = materialize(avg_p(lik, assay.samples, fit_prior(lik)["beta"], top_rep))
    return confidence(bfdr(scores))


def confidence(scores: DataFrame) -> DataFrame:
    """``high`` (BFDR <= 0.01, AvgP >= 0.8), ``medium`` (0.05, 0.5) or ``low``."""
    def passes(b: float, p: float) -> Column:
        return F.coalesce((F.col("bfdr") <= b) & (F.col("avg_p") >= p), F.lit(False))

    return scores.withColumn("confidence", F.when(passes(0.01, 0.8), "high").when(passes(0.05, 0.5), "medium").otherwise("low"))


def protein_log10(assay: Assay) -> DataFrame:
    """Mean log10 per prey over all its rows and all samples; missing and non-positive values count as 1."""
    v = F.col("value")
    per_row = assay.cells.groupBy("feature_id").agg(F.sum(F.when(~is_missing(v), F.log10(v)).otherwise(0.0)).alias("s"))
    rows = per_row.join(assay.features.select("feature_id", "prey"), "feature_id")
    return rows.groupBy("prey").agg((F.sum("s") / (F.count("*") * assay.n_samples)).alias("log10_mean"))


def bait_log2fc(assay: Assay, top: int | None = None) -> DataFrame:
    """Mean over a prey's rows of (bait mean - mean of the controls, or of the ``top`` largest) on log2; missing counts as 1."""
    groups = assay.samples.select("sample_id", "status", "bait")
    v = F.when(~is_missing(F.col("value")), F.log2("value"))
    cells = assay.cells.withColumn("l", v).filter("l IS NOT NULL").join(assay.per_sample(groups), "sample_id")
    controls = assay.samples.filter("status = 'C'").count()
    used = controls if top is None else min(top, controls)
    # a feature has at most one value per control; absent ones are zeros in the sorted list
    own = F.collect_list(F.when(F.col("status") == "C", F.col("l")))
    base = cells.groupBy("feature_id").agg(own.alias("c"))
    padded = F.concat("c", F.array_repeat(F.lit(0.0), F.lit(controls) - F.size("c")))
    largest = F.slice(F.sort_array(padded, False), 1, used)
    base = base.select("feature_id", (F.aggregate(largest, F.lit(0.0), lambda a, x: a + x) / used).alias("control"))
    per_bait = cells.filter("status = 'T'").groupBy("feature_id", "bait").agg(F.sum("l").alias("s"))
    sizes = assay.samples.filter("status = 'T'").groupBy("bait").agg(F.count("*").alias("n"))
    # every row meets every bait, whether or not it was seen there
    baits = sizes.agg(F.sort_array(F.collect_list(F.struct("bait", "n")))).scalar()
    grid = base.join(assay.features.select("feature_id", "prey"), "feature_id").withColumn("_b", baits).select("feature_id", "prey", "control", F.inline("_b"))
    rows = grid.join(per_bait, ["feature_id", "bait"], "left").fillna(0.0, ["s"])
    return rows.groupBy("bait", "prey").agg(F.avg(F.col("s") / F.col("n") - F.col("control")).alias("log2fc"))


def network(scores: DataFrame, expression: DataFrame, max_bfdr: float = 0.05, min_avg_p: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Edges under the thresholds, and nodes with their smallest BFDR, roles and mean expression."""
    edges = scores.filter((F.col("bfdr") <= max_bfdr) & (F.col("avg_p") >= min_avg_p)).select(
        F.trim("bait").alias("source"), F.trim("prey").alias("target"), "avg_p", "bfdr"
    )
    ends = edges.select(F.col("source").alias("id"), "bfdr", F.lit(True).alias("b"), F.lit(False).alias("p")).unionByName(
        edges.select(F.col("target").alias("id"), "bfdr", F.lit(False).alias("b"), F.lit(True).alias("p"))
    )
    nodes = ends.groupBy("id").agg(F.min("bfdr").alias("min_bfdr"), F.bool_or("b").alias("is_bait"), F.bool_or("p").alias("is_prey"))
    known = expression.select(F.col("prey").alias("id"), F.col("log10_mean").alias("expression"))
    return edges, nodes.join(known, "id", "left")
