"""Adjustment of p-values over any number of tests. Rows without a p-value take no part."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.operators.ranking import join_counted, ordered
from assaygrid.runtime import materialize

LAMBDAS = [round(0.05 * i, 2) for i in range(20)]


def _step_up(df: DataFrame, p: str, out: str, factor: float = 1.0) -> DataFrame:
    """factor * m * p / rank, made monotone from the largest p down, at most 1.

    Equal p-values are counted before they are ordered, so p = 1 on a third of all rows is one row.
    The tests are stored first, as they are read more than once and are far smaller than their cells.
    """
    df = materialize(df)
    tested = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    counts = tested.groupBy(p).agg(F.count("*").alias("_n"))
    m = tested.agg(F.count("*")).scalar()
    ranked = ordered(counts, [(p, True)]).running("_rank", "sum", F.col("_n"))
    scaled = ranked.df.withColumn("_m", m).withColumn("_raw", factor * F.col("_m") * F.col(p) / F.col("_rank"))
    adjusted = ranked.on(scaled).running(out, "min", F.col("_raw"), reverse=True).result()
    lookup = adjusted.select(p, "_n", F.least(F.col(out), F.lit(1.0)).alias(out))
    done = join_counted(tested, lookup, [p], "_n").drop("_n")
    rest = df.filter(F.col(p).isNull() | F.isnan(p)).withColumn(out, F.lit(None).cast("double"))
    return done.select(*df.columns, out).unionByName(rest)


def benjamini_hochberg(df: DataFrame, p: str = "p", out: str = "p_adj") -> DataFrame:
    return _step_up(df, p, out)


def bonferroni(df: DataFrame, p: str = "p", out: str = "p_adj") -> DataFrame:
    m = df.filter(F.col(p).isNotNull() & ~F.isnan(p)).agg(F.count("*")).scalar()
    return df.withColumn("_m", m).withColumn(out, F.least(F.col(p) * F.col("_m"), F.lit(1.0))).drop("_m")


def pi0_smoother(df: DataFrame, p: str = "p", method: str = "smoother") -> tuple[float, list[float]]:
    """Share of true nulls from counts at 20 lambdas, taken in one pass.

    ``smoother``: the last value of a cubic smoothing spline with 3 df; ``minimum``: the smallest of the 20 shares.
    """
    if method not in ("smoother", "minimum"):
        raise ValueError(f"unknown method {method!r}")
    counts = df.filter(F.col(p).isNotNull() & ~F.isnan(p)).agg(
        F.count("*").alias("m"), *[F.count_if(F.col(p) >= x).alias(f"c{i}") for i, x in enumerate(LAMBDAS)]
    ).first()
    if not counts["m"]:
        return float("nan"), []
    curve = [counts[f"c{i}"] / counts["m"] / (1 - x) for i, x in enumerate(LAMBDAS)]
    at_end = _smooth(np.array(LAMBDAS), np.array(curve), 3.0)[-1] if method == "smoother" else min(curve)
    return float(min(1.0, max(0.0, at_end))), curve


def _smooth(x: np.ndarray, y: np.ndarray, df: float) -> np.ndarray:
    """Fitted values of the natural cubic smoothing spline whose smoother matrix has trace ``df``.

    Uses the eigenvalues of the roughness matrix: trace = sum 1 / (1 + lambda d), solved by bisection.
    """
    h = np.diff(x)
    k = len(x) - 2
    q = np.zeros((len(x), k))
    r = np.zeros((k, k))
    for j in range(k):
        q[j : j + 3, j] = [1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < k:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    d, u = np.linalg.eigh(q @ np.linalg.solve(r, q.T))
    d = np.maximum(d, 0)
    d[np.argsort(d)[:2]] = 0  # straight lines are not penalised
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        if (1 / (1 + np.exp(mid) * d)).sum() > df:
            low = mid
        else:
            high = mid
    return u @ ((u.T @ y) / (1 + np.exp((low + high) / 2) * d))


def storey(df: DataFrame, p: str = "p", out: str = "q", method: str = "smoother") -> DataFrame:
    """q-values: step-up scaled by the estimated share of true nulls."""
    df = materialize(df)
    pi0, _ = pi0_smoother(df, p, method)
    return _step_up(df, p, out, factor=pi0)


def p_adjust(df: DataFrame, method: str = "bh", p: str = "p", out: str = "p_adj") -> DataFrame:
    if method == "none":
        return df.withColumn(out, F.col(p))
    return {"bh": benjamini_hochberg, "bonferroni": bonferroni, "storey": storey}[method](df, p, out)
