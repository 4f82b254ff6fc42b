"""Single-sample gene-set scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions.special import _gamma_q_np
from assaygrid.model import Assay
from assaygrid.operators.enrich import walk
from assaygrid.operators.qc import zscore_rows
from assaygrid.operators.ranking import average_ranks, row_numbers
from assaygrid.runtime import materialize

PAIRS = 500_000  # pairs of values whose kernel is computed together
DIGITS = 9  # log odds are rounded, so that the order of a sum does not decide a rank
# Abramowitz and Stegun 7.1.26.
AS_P = 0.3275911
AS_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def usable_genes(assay: Assay) -> DataFrame:
    """Features with a finite value in every sample and some variance."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v)
    stats = assay.cells.groupBy("feature_id").agg(F.count_if(finite).alias("n"), F.stddev_samp(F.when(finite, v)).alias("sd"))
    return stats.filter((F.col("n") == assay.n_samples) & (F.col("sd") > 0)).select("feature_id")


def _phi(z: np.ndarray) -> np.ndarray:
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + AS_P * x)
    erf = 1 - sum(a * t ** (i + 1) for i, a in enumerate(AS_A)) * np.exp(-x * x)
    return 0.5 * (1 + np.sign(z) * erf)


def _log_odds(kernel: str):
    """Kernel estimate of each gene's distribution at its own values, as log odds; many genes of one length at a time."""

    def estimate(x: np.ndarray) -> np.ndarray:
        own, others = x[:, :, None], x[:, None, :]
        if kernel == "poisson":
            shape = (*x.shape, x.shape[1])
            k, rate = (np.broadcast_to(v, shape).ravel() for v in (np.floor(own), others + 0.5))
            return np.where(k < 0, 0.0, np.where(rate <= 0, 1.0, _gamma_q_np(k + 1, np.maximum(rate, 1e-300)))).reshape(shape).mean(axis=2)
        width = x.std(axis=1, ddof=1) / 4
        width = np.where(width > 0, width, 0.001)
        return _phi((own - others) / width[:, None, None]).mean(axis=2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["values"].map(len).to_numpy()
            for length in np.unique(lengths):
                rows = pdf[lengths == length]
                x = np.stack([np.asarray(v, dtype=float) for v in rows["values"]])
                # a series is as long as the largest value beside it needs, so genes of like size go together
                order = np.argsort(x.max(axis=1), kind="stable")
                if kernel == "poisson":
                    order = order[~(x[order].min(axis=1) < -0.5)]
                for at in np.array_split(order, -(-len(order) * int(length) ** 2 // PAIRS) or 1):
                    if not len(at):
                        continue
                    lt = estimate(x[at])
                    with np.errstate(divide="ignore"):
                        z = -np.log((1 - lt) / lt)
                    ids = rows.iloc[at]
                    yield pd.DataFrame(
                        {"feature_id": np.repeat(ids["feature_id"].to_numpy(), length), "sample_id": np.concatenate(list(ids["ids"])), "value": np.round(z, DIGITS).ravel()}
                    )

    return run


def gene_cdf(assay: Assay, kernel: str = "gaussian") -> DataFrame:
    """Log odds of every usable cell within its gene: ``feature_id, sample_id, value``.

    ``kernel``: ``gaussian``, ``poisson`` (for whole, non-negative values) or ``ecdf``, whatever the number of samples.

    A gene's values (one per sample) are one row, so the pairwise kernel stays inside a task.
    """
    if kernel not in ("gaussian", "poisson", "ecdf"):
        raise ValueError(f"unknown kernel {kernel!r}")
    cells = assay.cells.join(usable_genes(assay), "feature_id", "left_semi")
    if kernel == "ecdf":
        w = Window.partitionBy("feature_id").orderBy("value")
        lt = F.cume_dist().over(w)
        ranked = cells.withColumn("_lt", lt)
        odds = F.when(F.col("_lt") >= 1, F.lit(float("inf"))).otherwise(-F.log((1 - F.col("_lt")) / F.col("_lt")))
        return ranked.select("feature_id", "sample_id", odds.alias("value"))
    rows = cells.groupBy("feature_id").agg(F.collect_list(F.struct("sample_id", "value")).alias("r"))
    rows = rows.select("feature_id", F.col("r.sample_id").alias("ids"), F.col("r.value").alias("values"))
    kinds = dict(assay.cells.dtypes)
    schema = f"feature_id {kinds['feature_id']}, sample_id {kinds['sample_id']}, value double"
    return rows.mapInPandas(_log_odds(kernel), schema)


def feature_sets(sets: DataFrame, features: DataFrame, genes: DataFrame, min_size: int = 10, max_size: int = 500) -> DataFrame:
    """Sets as usable features: ``set_name, feature_id``, inside the size limits.

    ``features(feature_id, symbol)`` names each feature's symbol.
    """
    named = features.select("feature_id", F.upper(F.trim("symbol")).alias("symbol")).join(genes, "feature_id", "left_semi")
    members = sets.select("set_name", F.upper(F.trim("symbol")).alias("symbol")).distinct().join(named, "symbol")
    members = members.select("set_name", "feature_id").distinct()
    sizes = members.groupBy("set_name").agg(F.count("*").alias("s")).filter(F.col("s").between(min_size, max_size))
    return members.join(sizes.select("set_name"), "set_name", "left_semi")


def gsva(assay: Assay, members: DataFrame, kernel: str = "gaussian", tau: float = 1.0, max_diff: bool = True, abs_ranking: bool = False) -> DataFrame:
    """Classic score of every set and sample: ``set_name, sample_id, score``.

    Features are ranked within each sample by their log odds, ties by id; the running sum visits the
    set's features only.
    """
    z = gene_cdf(assay, kernel)
    ranked = row_numbers(z, [("value", False), ("feature_id", True)], ["sample_id"], assay.n_samples, out="dpos")
    per_sample = ranked.groupBy("sample_id").agg(F.count("*").alias("p"))
    ranked = ranked.join(assay.per_sample(per_sample), "sample_id")
    rank = F.col("p") - F.col("dpos") + 1
    w = F.pow(F.abs(F.col("p") / 2 - rank), F.lit(float(tau)))
    hits = ranked.select("feature_id", "sample_id", "p", (F.col("dpos") - 1).alias("pos"), w.alias("w")).join(members, "feature_id")
    out = walk(hits.drop("feature_id"), ["set_name", "sample_id", "p"], F.col("p"))
    if max_diff:
        score = F.col("high") - F.col("low") if abs_ranking else F.col("high") + F.col("low")
    else:
        score = F.col("es")
    return out.select("set_name", "sample_id", score.alias("score"))


def ssgsea(assay: Assay, members: DataFrame, alpha: float = 0.25, normalise: bool = True) -> DataFrame:
    """Rank-weighted score of every set and sample, divided by the range over all of them."""
    cells = materialize(assay.cells.join(usable_genes(assay), "feature_id", "left_semi"))
    ranks = average_ranks(cells, "value", ["sample_id"], assay.n_samples)
    placed = row_numbers(ranks, [("rank", False), ("feature_id", True)], ["sample_id"], assay.n_samples, out="pos")
    per_sample = placed.groupBy("sample_id").agg(F.count("*").alias("p"))
    hits = placed.join(assay.per_sample(per_sample), "sample_id").join(members, "feature_id")
    ra, term = F.pow("rank", F.lit(float(alpha))), F.col("p") - F.col("pos") + 1
    agg = hits.groupBy("set_name", "sample_id", "p").agg(
        F.count("*").alias("k"), F.sum(ra * term).alias("num"), F.sum(ra).alias("w"), F.sum(term).alias("r")
    )
    p = F.col("p")
    es = F.col("num") / F.col("w") - (p * (p + 1) / 2 - F.col("r")) / (p - F.col("k"))
    scored = agg.select("set_name", "sample_id", F.when((F.col("w") > 0) & (F.col("k") < p), es).otherwise(0.0).alias("score"))
    if not normalise:
        return scored
    scored = materialize(scored)
    span = scored.agg(F.max("score") - F.min("score")).scalar()
    spread = scored.withColumn("_s", span)
    return spread.withColumn("score", F.when(F.col("_s") > 0, F.col("score") / F.col("_s")).otherwise(F.col("score"))).drop("_s")


def _standardised(assay: Assay) -> DataFrame:
    cells = assay.cells.join(usable_genes(assay), "feature_id", "left_semi")
    return zscore_rows(cells, ddof=1).select("feature_id", "sample_id", "z")


def zscore_sets(assay: Assay, members: DataFrame) -> DataFrame:
    """Combined z: sum of a set's z-scores over the root of its size."""
    joined = _standardised(assay).join(members, "feature_id")
    return joined.groupBy("set_name", "sample_id").agg((F.sum("z") / F.sqrt(F.count("*"))).alias("score"))


def plage(assay: Assay, members: DataFrame) -> DataFrame:
    """First right singular vector of each set's standardised rows; its largest entry is positive.

    A group is one set: at most the size limit of features times the samples.
    """
    kinds = dict(assay.cells.dtypes)

    def vector(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="feature_id", columns="sample_id", values="z").sort_index(axis=1)
        m = wide.to_numpy()
        values, vectors = np.linalg.eigh(m.T @ m)
        v = vectors[:, -1]
        v = v * (np.sign(v[np.argmax(np.abs(np.round(v, 9)))]) or 1)
        return pd.DataFrame({"set_name": pdf["set_name"].iloc[0], "sample_id": wide.columns, "score": v})

    joined = _standardised(assay).join(members, "feature_id")
    return joined.groupBy("set_name").applyInPandas(vector, f"set_name string, sample_id {kinds['sample_id']}, score double")


def top_sets(scores: DataFrame, n: int = 100) -> DataFrame:
    """Sets whose score varies most over samples."""
    return scores.groupBy("set_name").agg(F.var_samp("score").alias("variance")).orderBy(F.desc("variance"), "set_name").limit(n)
