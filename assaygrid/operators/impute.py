"""Imputation of missing cells. Every method returns the dense grid with an ``imputed`` mark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_missing
from assaygrid.functions.rng import normal
from assaygrid.model import Assay
from assaygrid.operators.qc import kde
from assaygrid.operators import blocks
from assaygrid.operators.quantiles import group_quantiles
from assaygrid.runtime import discard, materialize


def grid(assay: Assay, rule: str = "zero") -> DataFrame:
    """Dense grid with ``missing`` per cell; the original value is kept beside it."""
    return assay.dense().withColumn("missing", is_missing(F.col("value"), rule))


def _filled(cells: DataFrame, fill: Column) -> DataFrame:
    use = F.col("missing") & fill.isNotNull()
    return cells.select(
        "feature_id", "sample_id", F.when(use, fill).otherwise(F.col("value")).alias("value"), use.alias("imputed")
    )


def simple(assay: Assay, method: str, rule: str = "zero") -> DataFrame:
    """``median`` or ``mean`` per sample, ``global_min`` or ``zero``.

    Without any observed value a sample stays as it is (median) or gets 0 (mean); so does the whole matrix.
    """
    cells = grid(assay, rule)
    seen = assay.cells.filter(~is_missing(F.col("value"), rule))
    if method == "zero":
        return _filled(cells, F.lit(0.0))
    if method == "global_min":
        low = seen.agg(F.coalesce(F.min("value"), F.lit(0.0))).scalar()
        return _filled(cells.withColumn("_fill", low), F.col("_fill"))
    if method == "mean":
        stats = seen.groupBy("sample_id").agg(F.avg("value").alias("_fill"))
        return _filled(cells.join(assay.per_sample(stats), "sample_id", "left"), F.coalesce("_fill", F.lit(0.0)))
    if method == "median":
        stats = group_quantiles(seen, ["sample_id"], "value", {"_fill": 0.5}, assay.n_samples).drop("n")
        return _filled(cells.join(assay.per_sample(stats), "sample_id", "left"), F.col("_fill"))
    raise ValueError(f"unknown method {method!r}")


DOWNSHIFT, WIDTH = 1.8, 0.3  # of the draws for low values, in standard deviations


def min_prob(assay: Assay, downshift: float = DOWNSHIFT, width: float = WIDTH, seed: int = 1, rule: str = "zero") -> DataFrame:
    """Draws from N(mean - downshift sd, width sd) of each sample's log10(1 + value), back-transformed, at least 0.

    Samples with fewer than two observed values stay as they are. Draws depend on (seed, feature, sample) only.
    """
    stats, fill = _draws(assay, downshift, width, seed, rule)
    return _filled(grid(assay, rule).join(assay.per_sample(stats), "sample_id", "left"), fill)


def _draws(assay: Assay, downshift: float, width: float, seed: int, rule: str) -> tuple[DataFrame, Column]:
    """Per sample (sample_id, n, m, sd) of the observed values, and the draw of a cell beside them."""
    seen = assay.cells.filter(~is_missing(F.col("value"), rule)).withColumn("l", F.log10(1 + F.col("value")))
    stats = seen.groupBy("sample_id").agg(F.count("*").alias("n"), F.avg("l").alias("m"), F.stddev_samp("l").alias("sd"))
    z = normal(str(seed), F.col("feature_id"), F.col("sample_id"))
    log = F.col("m") - downshift * F.col("sd") + z * F.greatest(width * F.col("sd"), F.lit(1e-10))
    return stats.filter("n >= 2"), F.greatest(F.lit(0.0), F.pow(F.lit(10.0), log) - 1)


def _row_vectors(assay: Assay, rule: str, by: str | None = None) -> DataFrame:
    """One row per feature: values in sample order (null where missing), the same as they were (``raw``), the count of
    missing ones and, with ``by``, the largest missing fraction of any sample group."""
    cells = grid(assay, rule)
    value = F.when(~F.col("missing"), F.col("value"))
    entry = F.struct("sample_id", value.alias("v"), F.col("value").alias("raw"))
    aggs = [F.sort_array(F.collect_list(entry)).alias("e"), F.sum(F.col("missing").cast("int")).alias("n_missing")]
    if by is None:
        rows = cells.groupBy("feature_id").agg(*aggs)
    else:
        groups = assay.samples.select("sample_id", F.coalesce(F.col(by), F.lit("")).alias("g"))
        cells = cells.join(assay.per_sample(groups), "sample_id")
        per_group = cells.groupBy("feature_id", "g").agg(
            F.collect_list(entry).alias("e"), F.sum(F.col("missing").cast("int")).alias("m"), F.count("*").alias("size")
        )
        rows = per_group.groupBy("feature_id").agg(
            F.sort_array(F.flatten(F.collect_list("e"))).alias("e"), F.sum("m").alias("n_missing"),
            F.max(F.col("m") / F.col("size")).alias("worst"),
        )
    return rows.select(F.col("feature_id").alias("item_id"), F.col("e.v").alias("vec"), F.col("e.raw").alias("raw"), *rows.columns[2:])


FEW_PAIRS = 64  # pairs of blocks up to which each is computed without looking for those that matter


def _distance_kernel(metric: str, min_shared: int, k: int):
    """Nearest complete rows of every incomplete row, over the columns the incomplete row has."""

    def kernel(row: dict) -> Iterator[pd.DataFrame]:
        q_ids, d_ids = np.asarray(row["q_ids"]), np.asarray(row["d_ids"])
        q, d = blocks.matrix(row["q_vecs"], len(q_ids)), blocks.matrix(row["d_vecs"], len(d_ids))
        w = (~np.isnan(q)).astype(float)
        q0 = np.nan_to_num(q)
        n = w.sum(1)[:, None]
        if metric in ("euclidean", "manhattan"):
            enough = n[:, 0] >= max(min_shared, 1)
            q_ids, q = q_ids[enough], q[enough]
            i, j, dist = blocks.nearest_in(q, d, d_ids, k, np.full(len(q), np.inf), metric, masked=True)
            yield pd.DataFrame({"item_id": q_ids[i], "donor": d_ids[j], "distance": dist})
            return
        sqq, sdd, sqd = (q0 * q0).sum(1)[:, None], w @ (d * d).T, q0 @ d.T
        if metric == "pearson":
            sq, sd = q0.sum(1)[:, None], w @ d.T
            m = np.maximum(n, 1)
            vq, vd = sqq - sq * sq / m, sdd - sd * sd / m
            flat_q, flat_d = vq <= 1e-12 * sqq, vd <= 1e-12 * sdd
            with np.errstate(all="ignore"):
                r = (sqd - sq * sd / m) / np.sqrt(vq * vd)
            dist = np.where(flat_q & flat_d, 0.0, np.where(flat_q | flat_d, 1.0, np.maximum(1 - r, 0)))
            dist[(n < 2).repeat(len(d), 1)] = np.inf
        else:
            with np.errstate(all="ignore"):
                dist = np.where((sqq == 0) | (sdd == 0), 1.0, np.maximum(1 - sqd / np.sqrt(sqq * sdd), 0))
        dist[(n < max(min_shared, 1)).repeat(len(d), 1)] = np.inf
        i, j = blocks.top_k(dist, d_ids, k)
        yield pd.DataFrame({"item_id": q_ids[i], "donor": d_ids[j], "distance": dist[i, j]})

    return kernel


def _neighbours(incomplete: DataFrame, donors: DataFrame, k: int, metric: str, min_shared: int) -> DataFrame:
    """Top ``k`` donors of every incomplete row with their values: ``item_id, donor, distance, values, rank``.

    Only ids and distances leave the block pairs; the values are joined to the donors that remain. Where there are many pairs of
    blocks, ``euclidean`` and ``manhattan`` compute those that can hold a nearest donor.
    """
    size = donors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    kind = dict(incomplete.dtypes)["item_id"]
    schema = f"item_id {kind}, donor {kind}, distance double"
    if not size["n"]:
        return incomplete.sparkSession.createDataFrame([], schema + ", values array<double>, rank int")
    n_queries = blocks.block_count(incomplete.count(), size["dim"])
    n_donors = blocks.block_count(size["n"], size["dim"])
    nan = F.transform("vec", lambda v: F.coalesce(v, F.lit(float("nan"))))
    queries, donors = incomplete.select("item_id", nan.alias("vec")), donors.select("item_id", "vec")
    if metric in ("euclidean", "manhattan") and n_queries * n_donors > FEW_PAIRS:
        near = blocks.near_blocks(queries, by_halves=True, bounded=False), blocks.near_blocks(donors, by_halves=True)
        best = blocks.nearest_pruned(*near, k, kind, "donor", metric, masked=True, own=False, least_shared=min_shared).neighbors
        discard(near[0].rows, near[1].rows)
    else:
        q, d = blocks.pack(queries, n_queries, "q"), blocks.pack(donors, n_donors, "d")
        found = blocks.Pairs(q, d, n_queries, n_donors).reduce(_distance_kernel(metric, min_shared, k), schema)
        w = Window.partitionBy("item_id").orderBy("distance", "donor")
        best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(donors.select(F.col("item_id").alias("donor"), F.col("vec").alias("values")), "donor").select("item_id", "donor", "distance", "values", "rank")


WEIGHTS = {"inverse": lambda d, r: 1 / np.maximum(d, 1e-8), "uniform": lambda d, r: np.ones(len(d)), "rank": lambda d, r: 1 / r}


def _weighted(neighbours: DataFrame, weight: str) -> DataFrame:
    """Weighted means of the donors' values: ``item_id, fill``, one entry per position."""
    w = {"inverse": 1 / F.greatest(F.col("distance"), F.lit(1e-8)), "uniform": F.lit(1.0), "rank": 1 / F.col("rank")}[weight]
    rows = neighbours.withColumn("w", w).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "w", "values"))).alias("e"))  # at most k
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["w"])
    places = F.sequence(F.lit(0), F.size(F.col("e")[0]["values"]) - 1)
    return rows.select("item_id", F.transform(places, lambda i: F.aggregate("e", F.lit(0.0), lambda a, x: a + x["w"] * F.get(x["values"], i)) / total).alias("fill"))


FEW_DONORS = 1_000_000  # numbers of the donors that every task may hold; then rows are filled where they lie


def _beside_few(donors: DataFrame, k: int, metric: str, weight: str, min_shared: int):
    """The weighted means of a row's nearest donors as a function of its values, for donors that are few enough for every task to hold."""
    table = donors.select("item_id", "vec").orderBy("item_id").toArrow()  # at most FEW_DONORS numbers; places follow the ids
    held = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    shared = donors.sparkSession.sparkContext.broadcast(held)
    kernel, size = _distance_kernel(metric, min_shared, k), 2048

    def fills(vec: pd.Series) -> pd.Series:
        d, out = shared.value, []
        for at in range(0, len(vec), size):
            q = np.stack([np.asarray(v, dtype=float) for v in vec.iloc[at : at + size]])
            ends = [(start, min(len(d), start + size)) for start in range(0, len(d), size)]
            found = [one for a, b in ends for one in kernel({"q_ids": np.arange(len(q)), "q_vecs": q, "d_ids": np.arange(a, b), "d_vecs": d[a:b]})]
            i, j, dist = (np.concatenate([f[c].to_numpy() for f in found]) for c in ("item_id", "donor", "distance"))
            best = np.lexsort((j, dist, i))
            i, j, dist = i[best], j[best], dist[best]
            rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
            i, j, w = i[rank <= k], j[rank <= k], WEIGHTS[weight](dist, rank)[rank <= k]
            total, fill = np.bincount(i, w, len(q)), np.zeros(q.shape)
            np.add.at(fill, i, w[:, None] * d[j])
            served = np.bincount(i, minlength=len(q)) > 0
            out += [f / t if s else None for f, t, s in zip(fill, total, served)]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(fills, "array<double>")


def _fallbacks(assay: Assay, rule: str, fallback: str) -> DataFrame:
    """Value per sample for cells without a neighbour, from the observed cells."""
    seen = assay.cells.filter(~is_missing(F.col("value"), rule))
    if fallback == "median":
        stats = group_quantiles(seen, ["sample_id"], "value", {"fb": 0.5}, assay.n_samples).drop("n")
    elif fallback == "mean":
        stats = seen.groupBy("sample_id").agg(F.avg("value").alias("fb"))
    elif fallback == "global_min":
        return assay.samples.select("sample_id").withColumn("fb", seen.agg(F.coalesce(F.min("value"), F.lit(0.0))).scalar())
    else:
        return assay.samples.select("sample_id", F.lit(0.0).alias("fb"))
    return assay.samples.select("sample_id").join(assay.per_sample(stats), "sample_id", "left").fillna(0.0, ["fb"])


def transpose(assay: Assay) -> Assay:
    """Features as samples and samples as features, for imputation along the other axis."""
    cells = assay.cells.select(F.col("sample_id").alias("feature_id"), F.col("feature_id").cast("string").alias("sample_id"), "value")
    return Assay(cells, cells.select("sample_id").distinct())


def knn(
    assay: Assay,
    k: int = 5,
    metric: str = "euclidean",
    weight: str = "inverse",
    min_shared: int = 1,
    fallback: str = "median",
    max_missing: float = 1.0,
    max_missing_group: float = 1.0,
    by: str | None = None,
    mode: str = "waves",
    rule: str = "zero",
) -> DataFrame:
    """Nearest-neighbour imputation of features from complete features.

    ``waves`` fills rows in ascending number of missing cells; rows filled so far serve as donors for
    later waves (one wave per distinct count, each stored). Rows inside a wave do not see each other,
    which is the one difference from a strictly sequential order. ``complete`` uses complete rows only.
    Rows over a cap (strictly more missing than ``max_missing`` overall, or than ``max_missing_group``
    in any group of ``by``) stay as they are and are no donors.
    """
    grouped = by if max_missing_group < 1 else None
    assay = assay.with_cells(materialize(assay.cells))
    rows = _row_vectors(assay, rule, grouped)
    n = assay.n_samples
    over = (F.col("n_missing") > max_missing * n) if max_missing < 1 else F.lit(False)
    if grouped:
        over = over | (F.col("worst") > max_missing_group)
    rows = materialize(rows.withColumn("skipped", (F.col("n_missing") > 0) & over))
    work = rows.filter(~F.col("skipped")).select("item_id", "vec", "n_missing")
    names = assay.sample_ids()
    fb = assay.per_sample(_fallbacks(assay, rule, fallback))
    order = fb.agg(F.sort_array(F.collect_list(F.struct("sample_id", "fb")))).scalar()

    def fill(queries: DataFrame, donors: DataFrame) -> DataFrame:
        size = donors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
        if size["n"] and size["n"] * size["dim"] <= FEW_DONORS:
            fills = _beside_few(donors, k, metric, weight, min_shared)
            joined = queries.withColumn("fill", fills(F.transform("vec", lambda v: F.coalesce(v, F.lit(float("nan"))))))
        else:
            joined = queries.join(_weighted(_neighbours(queries, donors, k, metric, min_shared), weight), "item_id", "left")
        value = F.transform(
            "vec", lambda v, i: F.coalesce(v, F.get(F.col("fill"), i), F.get(F.col("_fb"), i)["fb"])
        )
        joined = joined.withColumn("_fb", order)
        return joined.select("item_id", value.alias("vec"))

    complete = work.filter("n_missing = 0").select("item_id", "vec")
    incomplete = work.filter("n_missing > 0")
    if mode == "complete":
        done = fill(incomplete, complete)
    else:
        # at most one wave per possible count of missing cells
        counts = sorted(r[0] for r in incomplete.select("n_missing").distinct().collect())
        pool, done = complete, None
        for c in counts:
            wave = materialize(fill(incomplete.filter(F.col("n_missing") == c), pool))
            done = wave if done is None else done.unionByName(wave)
            pool = pool.unionByName(wave)
        done = complete.limit(0) if done is None else done
    # the row vectors hold all that the result needs
    whole = rows.select("item_id", "vec", "raw").join(done.withColumnRenamed("vec", "new"), "item_id", "left").withColumn("_names", names)
    new = F.coalesce("new", F.array_repeat(F.lit(None).cast("double"), F.size("vec")))
    cells = whole.select(
        F.col("item_id").alias("feature_id"),
        F.inline(F.arrays_zip(F.col("_names").alias("sample_id"), F.col("raw").alias("value"), F.col("vec").alias("seen"), new.alias("new"))),
    )
    return _filled(cells.withColumn("missing", F.col("seen").isNull()), F.col("new"))


def knn_then_minprob(assay: Assay, seed: int = 1, rule: str = "zero", **options) -> DataFrame:
    """KNN within its caps, then MinProb for what is left, with statistics of the original values."""
    first = knn(assay, rule=rule, **options).filter("feature_id IS NOT NULL AND sample_id IS NOT NULL")
    stats, fill = _draws(assay, DOWNSHIFT, WIDTH, seed, rule)
    joined = first.join(assay.per_sample(materialize(stats)), "sample_id", "left").withColumn("_mp", F.coalesce(fill, F.col("value")))
    left = ~F.col("imputed") & is_missing(F.col("value"), rule)
    return joined.select(
        "feature_id", "sample_id", F.when(left, F.col("_mp")).otherwise(F.col("value")).alias("value"),
        (F.col("imputed") | (left & F.col("_mp").isNotNull())).alias("imputed"),
    )


def imputed_mask(result: DataFrame) -> DataFrame:
    return result.filter("imputed").select("feature_id", "sample_id")


def impute_summary(result: DataFrame) -> DataFrame:
    """Per sample: missing share before, and mean of log10(1 + value) of measured and filled cells."""
    log = F.log10(1 + F.col("value"))
    return result.groupBy("sample_id").agg(
        F.avg(F.col("imputed").cast("int")).alias("missing_before"),
        F.avg(F.when(~F.col("imputed"), log)).alias("mean_measured"),
        F.avg(F.when(F.col("imputed"), log)).alias("mean_imputed"),
    )


def impute_densities(result: DataFrame, grid: int = 64) -> DataFrame:
    """``stage, point, x, density`` of log10(1 + value): ``before`` over the measured cells, ``after`` over all."""
    logs = result.select(F.log10(1 + F.col("value")).alias("value"), "imputed")
    both = logs.filter("NOT imputed").withColumn("stage", F.lit("before")).unionByName(logs.withColumn("stage", F.lit("after")))
    return kde(both, "value", grid, ["stage"], 2)
