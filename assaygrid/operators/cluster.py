"""Clustering of vector items ``vectors(item_id, vec)``."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_missing
from assaygrid.model import Assay
from assaygrid.operators import blocks
from assaygrid.operators.filters import keep_rows
from assaygrid.operators.ordination import pca
from assaygrid.operators.ranking import row_numbers
from assaygrid.runtime import broadcast_if, discard, materialize

VIEW_SIZES = [500, 250, 100, 50, 20, 10]
LEVELS = 11


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.select("item_id", "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))


def _best_model(data: DataFrame, k: int, n_init: int, seed: int, init: str = "k-means||", max_iter: int = 300, out: str = "cluster") -> KMeansModel:
    best = None
    for i in range(n_init):
        algorithm = KMeans(k=k, seed=seed + i, initMode=init, maxIter=max_iter, tol=1e-6, featuresCol="features", predictionCol=out)
        model = algorithm.fit(data)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def kmeans(vectors: DataFrame, k: int, n_init: int = 10, seed: int = 42, init: str = "k-means||", max_iter: int = 300) -> tuple[DataFrame, float]:
    """Best of ``n_init`` seeded runs by inertia: assignments ``item_id, vec, cluster`` and the inertia."""
    data = materialize(_features(vectors))
    best = _best_model(data, k, n_init, seed, init, max_iter)
    return best.transform(data).select("item_id", "vec", "cluster"), best.summary.trainingCost


def assignments(clustered: DataFrame, with_silhouette: bool = True) -> DataFrame:
    """Cluster, cluster size, silhouette and first two components of every item."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("size"))
    scores, _, _ = pca(clustered, 2)
    out = clustered.select("item_id", "cluster").join(sizes, "cluster").join(scores, "item_id")
    if with_silhouette:
        sil = blocks.silhouette(clustered, "cluster").select("item_id", "silhouette")
        out = out.join(sil, "item_id")
    return out


def k_sweep(vectors: DataFrame, k_min: int = 2, k_max: int = 10, n_init: int = 3, seed: int = 42, with_silhouette: bool = True) -> DataFrame:
    """Inertia and mean silhouette for every k; the distances between items are computed once for all of them."""
    data = materialize(_features(vectors))
    sizes = list(range(k_min, k_max + 1))
    models = [_best_model(data, k, n_init, seed, out=f"cluster_{k}") for k in sizes]
    means = {}
    if with_silhouette and sizes:
        labelled = data
        for model in models:
            labelled = model.transform(labelled)
        scored = blocks.silhouettes(labelled, [f"cluster_{k}" for k in sizes])
        means = {r["labelling"]: r["mean"] for r in scored.groupBy("labelling").agg(F.avg("silhouette").alias("mean")).collect()}
    rows = [(k, float(model.summary.trainingCost), means.get(i)) for i, (k, model) in enumerate(zip(sizes, models))]
    return vectors.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def elbow(sweep: DataFrame) -> DataFrame:
    """k farthest from the straight line between the ends of the normalised inertia curve."""
    ends = sweep.agg(F.struct(
        F.min("k").alias("k0"), F.max("k").alias("k1"), F.max_by("inertia", -F.col("k")).alias("i0"), F.max_by("inertia", "k").alias("i1")
    )).scalar()
    e = sweep.withColumn("_e", ends)
    x = (F.col("k") - F.col("_e.k0")) / F.coalesce(F.nullif(F.col("_e.k1") - F.col("_e.k0"), F.lit(0)), F.lit(1))
    y = (F.col("inertia") - F.col("_e.i1")) / F.coalesce(F.nullif(F.col("_e.i0") - F.col("_e.i1"), F.lit(0.0)), F.lit(1.0))
    scored = e.withColumn("d", F.round(F.abs(x + y - 1) / math.sqrt(2), 12))
    return scored.agg(F.max_by("k", F.struct("d", -F.col("k"))).alias("k"))


def choose_k(sweep: DataFrame, by: str = "silhouette") -> DataFrame:
    """Best k by silhouette (first on ties), or by elbow when asked or without silhouettes."""
    best = sweep.filter("silhouette IS NOT NULL").agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))
    if by == "elbow":
        return elbow(sweep)
    return best.withColumn("_e", elbow(sweep).scalar()).select(F.coalesce("k", "_e").alias("k"))


def bisecting(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Top-down divisive clustering."""
    data = materialize(_features(vectors))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).select("item_id", "cluster")


# ---- self-organising map -------------------------------------------------


def unit_position(topology: str, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Axial coordinates of hexagonal units (odd rows shifted right), or row and column."""
    if topology == "hex":
        return np.stack([col - (row - row % 2) // 2, row], axis=1).astype(float)
    return np.stack([col, row], axis=1).astype(float)


def lattice_distance(topology: str, rows: int, cols: int) -> np.ndarray:
    """Steps between units on a hexagonal map, straight-line distance on a rectangular one."""
    grid = np.indices((rows, cols)).reshape(2, -1)
    pos = unit_position(topology, grid[0], grid[1])
    diff = pos[:, None, :] - pos[None, :, :]
    if topology == "hex":
        return (np.abs(diff[..., 0]) + np.abs(diff[..., 1]) + np.abs(diff.sum(-1))) / 2
    return np.sqrt((diff**2).sum(-1))


def _unit_sums(code: np.ndarray):
    """Per task: how many items each unit wins and the sum of their vectors, the number last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, dim = code.shape
        total = np.zeros((units, dim + 1))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, dim)
            win = ((code**2).sum(1)[None, :] - 2 * x @ code.T).argmin(axis=1)
            np.add.at(total, win, np.concatenate([x, np.ones((len(x), 1))], axis=1))
        used = np.flatnonzero(total[:, dim])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], ["unit", "total"])

    return run


def som(
    vectors: DataFrame, rows: int = 6, cols: int = 6, epochs: int = 40, topology: str = "hex", kernel: str = "gaussian",
    init: str = "pca", sigma: float | None = None, seed: int = 42,
) -> np.ndarray:
    """Batch self-organising map: the codebook, one row per unit.

    Per epoch each task reduces its items to one sum per unit; the codebook (units x dimensions) is the
    only thing exchanged. The result does not depend on the order of items.
    """
    data = materialize(vectors.select("item_id", F.col("vec").cast("array<double>").alias("vec")))
    units = rows * cols
    if init == "pca":
        scores, loadings, variance = pca(data, 2)
        load = np.array([[r["pc1"], r["pc2"]] for r in loadings.orderBy("dim").collect()])
        sd = np.sqrt(np.maximum([r["eigenvalue"] for r in variance.orderBy("component").collect()], 1e-12))
        mean = np.array(data.select(Summarizer.mean(array_to_vector(F.col("vec")))).first()[0])
        r, c = np.indices((rows, cols)).reshape(2, -1)
        fy = (r - (rows - 1) / 2) / max((rows - 1) / 2, 0.5)
        fx = (c - (cols - 1) / 2) / max((cols - 1) / 2, 0.5)
        code = mean + np.outer(fx * sd[0], load[:, 0]) + np.outer(fy * sd[1], load[:, 1])
    else:
        picks = data.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item_id").cast("string")))).limit(units).collect()
        code = np.array([picks[i % len(picks)]["vec"] for i in range(units)], dtype=float)
    steps = lattice_distance(topology, rows, cols)
    start = sigma or max(1.0, min(rows, cols) / 2)
    dim = code.shape[1]
    for epoch in range(epochs):
        frac = epoch / (epochs - 1) if epochs > 1 else 1.0
        radius = max(0.5, start * (1 - 0.75 * frac))
        weight = (steps <= radius).astype(float) if kernel == "bubble" else np.exp(-(steps**2) / (2 * radius**2))
        parts = data.select("vec").mapInArrow(_unit_sums(code), "unit int, total array<double>")
        sums = parts.select("unit", array_to_vector(F.col("total")).alias("total")).groupBy("unit").agg(Summarizer.sum(F.col("total")).alias("total"))
        n, total = np.zeros(units), np.zeros_like(code)
        for r in sums.collect():  # at most one row per unit
            found = r["total"].toArray()
            n[r["unit"]], total[r["unit"]] = found[dim], found[:dim]
        mass = weight @ n
        code = np.where(mass[:, None] > 1e-12, (weight @ total) / np.maximum(mass, 1e-12)[:, None], code)
    return code


def som_match(vectors: DataFrame, code: np.ndarray) -> DataFrame:
    """Best and second-best unit of every item and the distance to the best."""
    kind = dict(vectors.dtypes)["item_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([np.asarray(v, dtype=float) for v in pdf["vec"]])
            d = blocks.euclidean(x, code)
            order = np.argsort(d, axis=1, kind="stable")
            second = order[:, 1] if code.shape[0] > 1 else order[:, 0]
            yield pd.DataFrame({"item_id": pdf["item_id"], "unit": order[:, 0], "second": second, "distance": np.take_along_axis(d, order[:, :1], 1)[:, 0]})

    return vectors.select("item_id", "vec").mapInPandas(run, f"item_id {kind}, unit int, second int, distance double")


def som_quality(matches: DataFrame, rows: int, cols: int, topology: str = "hex") -> DataFrame:
    """Quantization error and topographic error (runner-up not a lattice neighbour)."""
    steps = lattice_distance(topology, rows, cols)
    far = [(int(i), int(j)) for i, j in zip(*np.nonzero(steps > 1.0001))]
    lookup = matches.sparkSession.createDataFrame(far, "unit int, second int").withColumn("bad", F.lit(1))
    marked = matches.join(broadcast_if(lookup, len(far)), ["unit", "second"], "left")
    return marked.agg(F.avg("distance").alias("quantization_error"), F.avg(F.coalesce("bad", F.lit(0))).alias("topographic_error"))


def som_units(matches: DataFrame, code: np.ndarray, rows: int, cols: int, topology: str = "hex") -> DataFrame:
    """Per unit: row, column, hits and mean distance to its lattice neighbours (U-matrix)."""
    steps, d = lattice_distance(topology, rows, cols), blocks.euclidean(code, code)
    near = (steps > 0) & (steps <= 1.0001)
    u = (d * near).sum(1) / np.maximum(near.sum(1), 1)
    table = [(i, i // cols, i % cols, float(u[i])) for i in range(rows * cols)]
    units = matches.sparkSession.createDataFrame(table, "unit int, row int, col int, u_distance double")
    hits = matches.groupBy("unit").agg(F.count("*").alias("hits"))
    return units.join(broadcast_if(hits, rows * cols), "unit", "left").fillna(0, ["hits"])


def som_clusters(spark, code: np.ndarray, k: int | None = None, seed: int = 42) -> DataFrame:
    """Groups of units by k-means on the codebook; k from 2..8 by silhouette unless given."""
    units = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(code)], "item_id int, vec array<double>")
    if k is None:
        sweep = k_sweep(units, 2, min(8, len(code) - 1), n_init=2, seed=seed)
        k = choose_k(sweep).first()["k"]
    clustered, _ = kmeans(units, k, 5, seed)
    return clustered.select(F.col("item_id").alias("unit"), "cluster")


# ---- threshold clusters ----------------------------------------------------


def components(nodes: DataFrame, edges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Smallest id of each node's connected component: ``item_id, label``.

    A round moves labels along edges and then to their label's label, so long chains shrink
    geometrically; every round is stored.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col(lo).alias("a"), F.col(hi).alias("b")), F.struct(F.col(hi).alias("a"), F.col(lo).alias("b")))).alias("e"))
    both = materialize(both.select("e.a", "e.b").distinct())
    before = materialize(nodes.select("item_id", F.col("item_id").alias("label")))
    state = before
    while True:
        lookup = state.select(F.col("item_id").alias("b"), F.col("label").alias("l"))
        offered = both.join(lookup, "b").groupBy(F.col("a").alias("item_id")).agg(F.min("l").alias("l"))
        moved = state.join(offered, "item_id", "left").select("item_id", "label", F.least("label", F.coalesce("l", "label")).alias("new"))
        far = state.select(F.col("item_id").alias("new"), F.col("label").alias("far"))
        stepped = materialize(moved.join(far, "new", "left").select("item_id", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        state = stepped.select("item_id", F.col("new").alias("label"))
        discard(before)
        before = stepped
        if stepped.filter("new <> label").isEmpty():
            discard(both)
            return state


def merge_labels(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after adding edges: only the labels they connect are components of their own."""
    a = state.select(F.col("item_id").alias("lo"), F.col("label").alias("la"))
    b = state.select(F.col("item_id").alias("hi"), F.col("label").alias("lb"))
    links = materialize(edges.join(a, "lo").join(b, "hi").filter("la <> lb").select("la", "lb").distinct())
    ends = links.select(F.explode(F.array("la", "lb")).alias("item_id")).distinct()
    merged = components(ends, links, "la", "lb").select(F.col("item_id").alias("label"), F.col("label").alias("_to"))
    return materialize(state.join(merged, "label", "left").select("item_id", F.coalesce("_to", "label").alias("label")))


def spanning_tree(vectors: DataFrame, computed: list[int] | None = None) -> DataFrame:
    """Minimum spanning tree of the Euclidean distances: ``lo, hi, distance``, ties by ids.

    Each round every component finds its shortest way out and components merge, so there are at most log2(items)
    rounds. Items lie in blocks of near ones; a block is computed for an item only if it holds another component and can be
    as near as the shortest way known out of the item's own, at first from its own block and from ways found in earlier
    rounds. ``computed`` receives the number of block pairs of each round. The tree holds all merge heights of single linkage.
    """
    kind = dict(vectors.dtypes)["item_id"]
    data = materialize(vectors.select("item_id", F.col("vec").cast("array<double>").alias("vec")))
    near = blocks.near_blocks(data)
    labels, tree, known = materialize(data.select("item_id", F.col("item_id").alias("label"))), None, None
    while True:
        if labels.select("label").distinct().limit(2).count() < 2:
            discard(data, near.rows)
            return tree
        found, pairs = blocks.nearest_outside(near, labels, known, kind)
        if computed is not None:
            computed.append(pairs)
        older, grown = (known, tree), found.select("lo", "hi", "distance").distinct()
        known = found if known is None else materialize(known.unionByName(found))
        tree = materialize(grown if tree is None else tree.unionByName(grown))
        merged = components(found.select(F.col("label").alias("item_id")), found.select(F.col("label").alias("lo"), F.col("other").alias("hi")))
        new = merged.select(F.col("item_id").alias("label"), F.col("label").alias("merged"))
        last, labels = labels, materialize(labels.join(new, "label").select("item_id", F.col("merged").alias("label")))
        discard(last, *older, *([] if found is known else [found]))


def threshold_clusters(vectors: DataFrame, height: float, tree: DataFrame | None = None) -> DataFrame:
    """Single-linkage clusters cut at ``height``: items joined by steps no longer than it."""
    tree = spanning_tree(vectors) if tree is None else tree
    return components(vectors, tree.filter(F.col("distance") <= height))


def cut_heights(tree: DataFrame, levels: int = LEVELS) -> list[float]:
    """Heights from below the lowest merge to above the highest, evenly spread over the distinct merges."""
    ranked = row_numbers(tree.select("distance").distinct(), [("distance", True)])
    n = ranked.count()
    wanted = [1 + min(n - 1, int(math.floor((i - 1) / (levels - 2) * (n - 1) + 0.5))) for i in range(1, levels - 1)]
    found = {r["rank"]: r["distance"] for r in ranked.filter(F.col("rank").isin([1, n, *wanted])).collect()}
    return [found[1] - 1e-9, *[found[w] for w in wanted], found[n] + 1e-9]


def level_labels(vectors: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Cluster of every item at ``levels`` cuts from finest to coarsest: ``item_id, level, cluster``.

    A cut starts from the labels of the finer one and adds the tree's steps between the two heights.
    """
    tree = spanning_tree(vectors)
    state, reached, out = vectors.select("item_id", F.col("item_id").alias("label")), -1.0, None
    for level, height in enumerate(cut_heights(tree, levels)):
        if level:
            state = merge_labels(state, tree.filter((F.col("distance") > reached) & (F.col("distance") <= height)))
        else:
            state = components(vectors, tree.filter(F.col("distance") <= height))
        reached = height
        cut = state.select("item_id", F.lit(level).alias("level"), F.col("label").alias("cluster"))
        out = cut if out is None else out.unionByName(cut)
    return out


# ---- feature rankings --------------------------------------------------------


def row_scores(assay: Assay) -> DataFrame:
    """Population variance and absolute sum of each feature, missing cells as 0: ``feature_id, variance, abs_sum``."""
    n = assay.n_samples
    v = F.when(~is_missing(F.col("value"), "null"), F.col("value")).otherwise(0.0)
    stats = assay.cells.groupBy("feature_id").agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.sum(F.abs(v)).alias("abs_sum"))
    return stats.select("feature_id", (F.col("ss") / n - F.pow(F.col("s") / n, F.lit(2))).alias("variance"), "abs_sum")


def row_views(assay: Assay, sizes: Sequence[int] = VIEW_SIZES) -> DataFrame:
    """Rank of each feature by variance and by absolute sum, among the ``max(sizes)`` best of either.

    Missing cells count as 0. ``in_var`` and ``in_sum`` name the smallest view a feature belongs to.
    """
    stats = row_scores(assay)
    limit = max(sizes)
    views = []
    for kind, col in (("variance", "variance"), ("abs_sum", "abs_sum")):
        top = stats.orderBy(F.desc(col), "feature_id").limit(limit).select("feature_id", F.col(col).alias("score"))
        ranked = row_numbers(top, [("score", False), ("feature_id", True)]).withColumn("rank", F.col("rank").cast("int"))
        smallest = F.array_min(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("rank")))
        views.append(ranked.withColumn("view", smallest).withColumn("kind", F.lit(kind)))
    return views[0].unionByName(views[1]).select("kind", "feature_id", "rank", "view", "score")


def top_variance(assay: Assay, n: int) -> Assay:
    """Cells of the ``n`` most variable features (population variance, missing as 0)."""
    top = row_scores(assay).orderBy(F.desc("variance"), "feature_id").limit(n).select("feature_id")
    return keep_rows(assay, broadcast_if(top, n))
