"""Ordination of samples and of vector items."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_missing
from assaygrid.model import Assay
from assaygrid.operators import blocks, eigen
from assaygrid.operators.pairs import index_samples
from assaygrid.operators.qc import zscore_rows
from assaygrid.operators.ranking import row_numbers
from assaygrid.runtime import materialize

CHI2_95 = 5.991464547107979  # fixed value: 95% point of chi-square with 2 degrees of freedom


def prep_cells(assay: Assay, log: bool = True, z_feature: bool = True, z_sample: bool = False) -> DataFrame:
    """Dense cells for ordination: non-finite to 0, log10(x + 1), z per feature, z per sample."""
    v = F.col("value")
    cells = assay.dense().withColumn("value", F.when(is_missing(v, "null"), 0.0).otherwise(v))
    if log:
        cells = cells.withColumn("value", F.log10(F.col("value") + 1))
    if z_feature:
        cells = zscore_rows(cells, ddof=0, floor=1e-12).withColumn("value", F.col("z")).drop("z")
    if z_sample:
        stats = cells.groupBy("sample_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
        z = F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0)
        cells = cells.join(assay.per_sample(stats), "sample_id").withColumn("value", z).drop("m", "s")
    return cells


@dataclass(frozen=True)
class Ordination:
    """``scores(sample_id, pc1..)`` and ``variance(component, eigenvalue, share_extracted, share_total)``."""

    scores: DataFrame
    variance: DataFrame


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Fix the sign of each column: its entry of largest size is positive."""
    top = np.abs(np.round(vectors, 9)).argmax(axis=0)
    signs = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1, signs)


def _rows(assay: Assay, cells: DataFrame) -> tuple[list[str], DataFrame]:
    """Sample names by place, and each feature's ``idx`` and ``x``; stored, since every product reads them."""
    index = index_samples(assay.samples)
    names = [r["sample_id"] for r in index.orderBy("idx").toLocalIterator()]
    entry = F.struct(F.col("idx").cast("int").alias("idx"), F.col("value").cast("double").alias("x"))
    rows = cells.join(assay.per_sample(index), "sample_id").groupBy("feature_id").agg(F.collect_list(entry).alias("e"))
    return names, materialize(rows.select(F.col("e.idx").alias("idx"), F.col("e.x").alias("x")))


def _squares(rows: DataFrame) -> float:
    return float(rows.agg(F.coalesce(F.sum(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0))).first()[0])


def _reported(names: list[str], found: eigen.Eigen, spark, total: float, grow: float = 1.0) -> Ordination:
    """Scores (vectors times the roots of the eigenvalues, times ``grow``) and shares of ``total``."""
    values = np.maximum(found.values, 0)
    scores = _signed(found.vectors) * np.sqrt(values) * grow
    cols = ", ".join(f"pc{i + 1} double" for i in range(len(values)))
    extracted = float(values.sum())
    shares = [
        (i + 1, float(e), float(e / extracted) if extracted else 0.0, float(e / total) if total > 0 else 0.0)
        for i, e in enumerate(values)
    ]
    return Ordination(
        spark.createDataFrame([(n, *map(float, s)) for n, s in zip(names, scores)], f"sample_id string, {cols}"),
        spark.createDataFrame(shares, "component int, eigenvalue double, share_extracted double, share_total double"),
    )


def sample_pca(assay: Assay, k: int = 2) -> Ordination:
    """PCA in sample space: samples centred over features, covariance over (features - 1).

    Missing cells sit at the sample's mean. The covariance of the samples is never formed: its leading vectors come
    from products with blocks of vectors, so samples x (k + 8) numbers are all that leaves Spark.
    """
    seen = assay.cells.filter(~is_missing(F.col("value"), "null"))
    means = seen.groupBy("sample_id").agg(F.avg("value").alias("_m"))
    moved = seen.join(assay.per_sample(means), "sample_id").withColumn("value", F.col("value") - F.col("_m"))
    names, rows = _rows(assay, moved)
    free = max(assay.cells.agg(F.count_distinct("feature_id")).first()[0] - 1, 1)
    product = eigen.gram(rows)
    found = eigen.leading(lambda q: product(q) / free, len(names), k)
    return _reported(names, found, assay.cells.sparkSession, _squares(rows) / free)


def sample_scores(assay: Assay, cells: DataFrame, k: int | None = None) -> Ordination:
    """PCA of samples as items with features as dimensions (features centred), through products with the sample Gram matrix.

    With all components the scores keep every Euclidean distance between samples, so clustering can
    run on them instead of on vectors as long as the feature list; samples x k numbers reach the driver.
    """
    names, rows = _rows(assay, cells)
    n = len(names)
    free = max(n - 1, 1)
    found = eigen.leading(eigen.centred(eigen.gram(rows), 1 / free), n, k or n)
    # features centred: squares less n times the squared means
    means = F.aggregate("x", F.lit(0.0), lambda a, x: a + x)
    lost = rows.agg(F.coalesce(F.sum(means * means), F.lit(0.0))).first()[0] / max(n, 1)
    # eigenvalues are variances; scores carry sqrt(n - 1) times the unit vectors
    return _reported(names, found, assay.cells.sparkSession, (_squares(rows) - lost) / free, np.sqrt(free))


def to_vectors(scores: DataFrame, key: str = "sample_id") -> DataFrame:
    """Score columns as ``item_id, vec``."""
    return scores.select(F.col(key).alias("item_id"), F.array(*[c for c in scores.columns if c != key]).alias("vec"))


def pca(vectors: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PCA of ``vectors(item_id, vec)``: scores, loadings and variance frames.

    Dimensions are centred; signs are fixed by each component's largest loading.
    """
    spark = vectors.sparkSession
    stored = vectors.select("item_id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    stats = vectors.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    by_dim = stats.orderBy("d").collect()  # one row per dimension
    mean, total = np.array([r["m"] for r in by_dim]), float(sum(r["v"] for r in by_dim))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(stored)
    load = _signed(np.asarray(model.pc.toArray()))
    flip = np.sign((load * np.asarray(model.pc.toArray())).sum(axis=0))
    shift = mean @ load
    raw = model.transform(stored).select("item_id", vector_to_array("pc").alias("p"))
    scores = raw.select(
        "item_id", *[(F.col("p")[i] * float(flip[i]) - float(shift[i])).alias(f"pc{i + 1}") for i in range(k)]
    )
    loadings = spark.createDataFrame(
        [(d, *map(float, row)) for d, row in enumerate(load)], "dim int, " + ", ".join(f"pc{i + 1} double" for i in range(k))
    )
    share = np.asarray(model.explainedVariance.toArray())
    kept = float(share.sum())
    variance = spark.createDataFrame(
        [(i + 1, float(s * total), float(s / kept) if kept else 0.0, float(s)) for i, s in enumerate(share)],
        "component int, eigenvalue double, share_extracted double, share_total double",
    )
    return scores, loadings, variance


def top_loadings(loadings: DataFrame, n: int = 20) -> DataFrame:
    """Dimensions with the largest absolute loading on any component."""
    cols = [c for c in loadings.columns if c.startswith("pc")]
    size = F.greatest(*[F.abs(c) for c in cols]) if len(cols) > 1 else F.abs(cols[0])
    return loadings.withColumn("size", size).orderBy(F.desc("size"), "dim").limit(n)


def ellipses(scores: DataFrame, group: str, x: str = "pc1", y: str = "pc2") -> DataFrame:
    """95% concentration ellipse per group of at least three points: centre, half axes and angle."""
    g = scores.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
        F.var_samp(x).alias("a"), F.var_samp(y).alias("c"), F.covar_samp(x, y).alias("b"),
    ).filter("n >= 3")
    mid = (F.col("a") + F.col("c")) / 2
    root = F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2)) + F.col("b") * F.col("b"))
    return g.select(
        group, "n", "cx", "cy",
        F.sqrt(CHI2_95 * (mid + root)).alias("major"),
        F.sqrt(CHI2_95 * F.greatest(mid - root, F.lit(0.0))).alias("minor"),
        (0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))).alias("angle"),
    )


def pcoa(distances: DataFrame, k: int = 3, negative: int | None = None) -> Ordination:
    """Principal coordinates of a frame ``a, b, distance`` (each pair once).

    The doubly centred matrix is never formed. Negative eigenvalues get share 0 and are reported with component 0: the
    lowest eigenvalue, and the part of all inertia that negative ones carry. They are sought at the lower end until
    one is not negative, or until ``negative`` of them are found, which makes that part a lower bound.
    """
    spark = distances.sparkSession
    ends = distances.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    index = materialize(row_numbers(ends, [("name", True)], out="place").select("name", (F.col("place") - 1).cast("int").alias("place")))
    names = [r["name"] for r in index.orderBy("place").toLocalIterator()]
    n = len(names)
    left, right = (index.select(F.col("name").alias(c), F.col("place").alias(p)) for c, p in (("a", "i"), ("b", "j")))
    pairs = materialize(distances.join(left, "a").join(right, "b").select("i", "j", (F.col("distance") * F.col("distance")).alias("w")))
    product = eigen.centred(eigen.symmetric(pairs), -0.5)
    found = eigen.leading(product, n, k)
    trace = float(pairs.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]) / max(n, 1)
    wanted = min(n, 8) if negative is None else min(n, max(negative, 1))
    while True:
        low = -eigen.leading(lambda q: -product(q), n, wanted).values
        if negative is not None or wanted == n or low[-1] >= -1e-9 * max(abs(found.values).max(initial=0.0), abs(low[0])):
            break
        wanted = min(n, 2 * wanted)
    size = float(-low[low < 0].sum())
    out = _reported(names, found, spark, trace + size)
    extra = spark.createDataFrame([(0, float(low[0]), 0.0, size / (trace + 2 * size) if trace + 2 * size else 0.0)], out.variance.schema)
    return Ordination(out.scores, out.variance.unionByName(extra))


def knn_search(vectors: DataFrame, k: int) -> blocks.Nearest:
    """The exact ``k`` nearest neighbours, and how many pairs of blocks that took."""
    stored = materialize(vectors.select("item_id", F.col("vec").cast("array<double>").alias("vec")))
    near = blocks.near_blocks(stored)
    return blocks.nearest_pruned(near, near, k, dict(vectors.dtypes)["item_id"])


def knn_graph(vectors: DataFrame, k: int) -> DataFrame:
    """Exact ``k`` nearest neighbours of every item: ``item_id, neighbor, distance, rank``."""
    return knn_search(vectors, k).neighbors


STEPS, CLOSE = 50, 1e-3  # bisections at most, and the entropy's distance from its target that ends them
LEAST_SHARE = 1e-20  # one-way shares that are not more count as 0
GUESSED, REFINED = 1000, 3  # sampled items whose distances give the first guess of a width; Newton steps over a larger sample
ASKED = 2  # widths of an item that one pass over the pairs adds up
POWERS = 13  # sums of powers for each of them, which tell the sums of the widths around


def _advance(low: float, high: float, step: int, known: list[tuple], target: float, near: Callable[[float], tuple | None]) -> tuple:
    """Bisections that are decided by ``known`` widths (width, sum of weights, entropy) and by ``near`` (sum and entropy of a width,
    if it can tell): low, high, step, and the width and sum found.

    The entropy with an item's own term, log(t) / t more, grows with the width, and so does the one without it where the weights sum
    to e or more; log(t) / t is at most 1 / e. So a middle beyond a width of too much entropy, or below one of too little, is decided
    without a sum of its own.
    """
    over = min((w for w, t, h in known if h + (0 if t >= np.e else np.log(t) / t - 1 / np.e) > target + CLOSE + 1e-9), default=np.inf)
    under = max((w for w, t, h in known if h + np.log(t) / t < target - CLOSE - 1e-9), default=0.0)
    steady = min((w for w, t, h in known if t >= np.e), default=np.inf)
    below = max((w for w, t, h in known if h < target - CLOSE - 1e-9), default=0.0)
    while step < STEPS:
        mid = (low + high) / 2
        if step < STEPS - 1 and mid >= over:
            high, step = mid, step + 1
        elif step < STEPS - 1 and (mid <= under or steady <= mid <= below):
            low, step = mid, step + 1
        elif (found := near(mid)) is not None:
            total, entropy = found
            step += 1
            if abs(entropy - target) < CLOSE or step == STEPS:
                return low, high, STEPS, mid, total
            low, high = (mid, high) if entropy < target else (low, mid)
        else:
            break
    return low, high, step, None, None


def _ask(low: float, high: float, known: list[tuple], target: float) -> list[float]:
    """Widths to add up next: the middle that has to be decided, and where the wanted entropy is expected."""
    less = max(((w, h) for w, _, h in known if h <= target), default=None)
    more = min(((w, h) for w, _, h in known if h > target and (less is None or w > less[0])), default=None)
    far = 1.1 ** (2 ** min(len(known) // 5, 7))
    first = (low + high) / 2
    if less is None or more is None:
        wanted = [less[0] * far] if less else [more[0] / far] if more else []
        return wanted if wanted and low < wanted[0] < high and len(known) < 60 else [first, *wanted]
    # beyond what is known around the wanted entropy, a width on the way to the middle can decide more than the middle itself
    first = min(first, more[0] * far) if first > more[0] else max(first, less[0] / far) if first < less[0] else first
    return [first, float(less[0] * (more[0] / less[0]) ** min(max((target - less[1]) / (more[1] - less[1]), 0.0), 1.0))]


def _around(width: float, centre: float, sums: np.ndarray, own: float, top: float) -> Callable[[float], tuple | None]:
    """Sum of weights and entropy of a width near ``width``, from sums of exp(-(d - c) / 2 width^2) (d - c)^m over squared distances d,
    c = ``centre``: the series of the exponential, where what it leaves out cannot change the entropy by 1e-10. No d is more than ``top``.
    """
    terms = [float(x) / math.factorial(m) for m, x in enumerate(sums)]
    base, last = 1 / (2 * width * width), float(sums[-1])

    def series(off: float, of: list[float]) -> float:
        out = 0.0
        for x in reversed(of):
            out = x - off * out
        return out

    def at(w: float) -> tuple | None:
        rate = 1 / (2 * w * w)
        off = rate - base
        if abs(off) > 2 * base or rate * centre > 700:
            return None
        scale = math.exp(-rate * centre)
        # terms hold 1 / m! of their sums; those of the first derivative are one further on
        zeroth, first = series(off, terms[:-1]), series(off, further)
        total = own + scale * zeroth
        if not total > 0:
            return None
        if off:
            reach = max(off * centre, -off * (top - centre), 0.0)
            most = scale * math.exp(reach) * last if reach < 600 else math.inf
            lost = most * abs(off) ** (POWERS - 1) / math.factorial(POWERS - 1), most * abs(off) ** (POWERS - 2) / math.factorial(POWERS - 2)
            if not rate * (centre * lost[0] + lost[1]) + lost[0] * (2 + abs(math.log(total))) < 1e-10 * total:
                return None
        return total, (scale * (centre * zeroth + first) * rate + (total - 1) * math.log(total)) / total

    further = [float(x) / math.factorial(m) for m, x in enumerate(sums[1:-1])]
    return at


def bandwidths(vectors: DataFrame, perplexity: float = 30.0) -> DataFrame:
    """item_id, vec, sigma, total: the Gaussian width at which an item's shares have the wanted perplexity, and the sum of its weights.

    Widths are bisected between 1e-10 and 1e4. What a bisection needs are two sums over an item's distances. A pass over block pairs
    adds up, for one or two widths of an item, powers of the distances under their weights, which tell the sums of all widths
    around (``_around``): mostly one pass decides all bisections, and no row holds an item's distances. Distances to a sample
    give the first guess; it decides which widths are added up, not the result.
    """
    kind = dict(vectors.dtypes)["item_id"]
    spark = vectors.sparkSession
    data = materialize(vectors.select("item_id", F.col("vec").cast("array<double>").alias("vec")))
    size = data.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    target = float(np.log(min(perplexity, max(n - 1, 1))))
    near = max(1, min(n, blocks.BLOCK_VALUES // dim))
    sample = data.orderBy(F.xxhash64("item_id")).limit(near).collect()  # at most BLOCK_VALUES numbers
    points = np.array([r["vec"] for r in sample], float).reshape(len(sample), -1)
    middle = points.mean(0) if len(points) else np.zeros(dim)
    shared = spark.sparkContext.broadcast((np.array([r["item_id"] for r in sample]), points))

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, v = shared.value
        for pdf in batches:
            asked, far = [], []
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                x = np.stack([np.asarray(x, float) for x in part["vec"]])
                far += np.sqrt(((x - middle) ** 2).sum(1)).tolist()
                all_sq = blocks.squares(x, v)
                other = part["item_id"].to_numpy()[:, None] != ids[None, :]
                lows, highs = np.full(len(part), 1e-10), np.full(len(part), 1e4)
                sq, others = all_sq[:, :GUESSED], other[:, :GUESSED] * max(n / len(ids[:GUESSED]), 1.0)
                with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                    for _ in range(20):
                        mid = (lows + highs) / 2 if _ < 8 else np.sqrt(lows * highs)
                        e = np.exp(-sq / (2 * mid**2)[:, None]) * others
                        total = 1 + e.sum(1)
                        little = ((sq * e).sum(1) / (2 * mid * mid) + (total - 1) * np.log(total)) / total < target
                        lows, highs = np.where(little, mid, lows), np.where(little, highs, mid)
                    many, centre = max(n / len(ids), 1.0), np.zeros(len(part))
                    for _ in range(REFINED):
                        rate = 1 / (2 * mid * mid)
                        e = np.exp(all_sq * -rate[:, None])
                        e *= other
                        one = np.einsum("ij,ij->i", e, all_sq)
                        total = e.sum(1)
                        mean = one / total
                        e *= all_sq
                        spread = np.einsum("ij,ij->i", e, all_sq) / total - mean * mean
                        sums = 1 + many * total
                        entropy = (rate * many * one + (sums - 1) * np.log(sums)) / sums
                        slope = one * (1 - np.log(sums) - (sums - 1) / sums + entropy) - rate * (spread + mean * mean) * total
                        turn = np.clip((target - entropy) * sums / (rate * many * slope), -0.5, 0.5)  # of the logarithm of the rate
                        fine = np.isfinite(turn) & np.isfinite(mean)
                        mid, centre = np.where(fine, mid * np.exp(-turn / 2), mid), np.where(fine, mean, centre)
                asked += [[float(w), _centre(w, c)] for w, c in zip(mid, centre)]
            yield pd.DataFrame({"item_id": pdf["item_id"], "low": 1e-10, "high": 1e4, "step": np.int32(0), "sigma": np.nan, "total": np.nan, "far": far, "known": [[]] * len(pdf), "asked": asked})

    def kernel(row: dict) -> Iterator[pd.DataFrame]:
        q_ids, d_ids = np.asarray(row["q_ids"]), np.asarray(row["d_ids"])
        widths = np.full((len(q_ids), ASKED, 2), np.nan)
        for i, r in enumerate(row["q_asked"]):
            widths[i, : len(r) // 2] = np.reshape(r, (-1, 2))
        q, d = blocks.matrix(row["q_vecs"], len(q_ids)), blocks.matrix(row["d_vecs"], len(d_ids))
        sums = np.zeros((len(q_ids), ASKED, POWERS))
        own = np.zeros(len(q_ids))
        step = max(1, blocks.TILE_VALUES // 8 // max(len(d), 1))
        for at in range(0, len(q), step):
            sq = blocks.squares(q[at : at + step], d)
            i, j = np.nonzero(q_ids[at : at + step, None] == d_ids[None, :])
            np.add.at(own, at + i, 1)
            for c in range(ASKED):
                some = np.flatnonzero(~np.isnan(widths[at : at + step, c, 0]))
                if not len(some):
                    continue
                w, centre = widths[at + some, c].T
                t = (sq if len(some) == len(sq) else sq[some]) - centre[:, None]
                with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                    e = t * (-1 / (2 * w**2))[:, None]
                    np.exp(e, out=e)
                    mine = np.isin(i, some)
                    e[np.searchsorted(some, i[mine]), j[mine]] = 0
                    ts = [None, t, t * t, None]
                    ts[3] = ts[2] * t
                    for m in range(0, POWERS, 4):
                        sums[at + some, c, m] = e.sum(1)
                        for more in range(1, min(4, POWERS - m)):
                            sums[at + some, c, m + more] = np.einsum("ij,ij->i", e, ts[more])
                        if m + 4 < POWERS:
                            e *= ts[2]
                            e *= ts[2]
        yield pd.DataFrame({"item_id": q_ids, "sums": list(np.concatenate([np.nan_to_num(sums.reshape(len(q_ids), -1)), own[:, None]], axis=1))})

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, low, high, step, far, known, asked, sums in zip(*(pdf[c] for c in ("item_id", "low", "high", "step", "far", "known", "asked", "sums"))):
                top = (far + furthest) ** 2 * (1 + 1e-9)
                told = [_around(w, c, sums[POWERS * i : POWERS * (i + 1)], sums[-1], top) for i, (w, c) in enumerate(np.reshape(asked, (-1, 2)).tolist())]
                facts, centre = [tuple(known[i : i + 3]) for i in range(0, len(known), 3)], 0.0
                for i, f in enumerate(told):
                    for factor in (1.0, 0.99, 1.01, 0.97, 1.03, 0.94, 1.1):
                        if (fact := f(asked[2 * i] * factor)) is not None:
                            facts.append((float(asked[2 * i] * factor), *fact))
                    zeroth, first = sums[POWERS * i : POWERS * i + 2]
                    centre = asked[2 * i + 1] + first / zeroth if zeroth > 0 else centre
                near = lambda w: next((x for f in told if (x := f(w)) is not None), None)  # noqa: B023, E731
                low, high, step, sigma, total = _advance(low, high, step, facts, target, near)
                wanted = list(dict.fromkeys(_ask(low, high, facts, target)))[:ASKED] if step < STEPS else []
                rows.append((item, low, high, step, sigma, total, far, [float(x) for f in facts for x in f], [x for w in wanted for x in (float(w), _centre(w, centre))]))
            yield pd.DataFrame(rows, columns=["item_id", "low", "high", "step", "sigma", "total", "far", "known", "asked"])

    fields = f"item_id {kind}, low double, high double, step int, sigma double, total double, far double, known array<double>, asked array<double>"
    state = materialize(data.dropDuplicates(["item_id"]).mapInPandas(guess, fields))
    furthest = state.agg(F.coalesce(F.max("far"), F.lit(0.0))).first()[0]
    n_blocks = blocks.block_count(n, dim)
    donors = materialize(blocks.pack(data, n_blocks, "d"))
    while going := state.filter(F.col("step") < STEPS).count():
        asking = data.join(state.filter(F.col("step") < STEPS).select("item_id", "asked"), "item_id")
        n_asking = blocks.block_count(going, dim)
        parts = blocks.Pairs(blocks.pack(asking, n_asking, "q", "asked"), donors, n_asking, n_blocks).reduce(kernel, f"item_id {kind}, sums array<double>")
        sums = parts.groupBy("item_id").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        moved = state.filter(F.col("step") < STEPS).join(sums, "item_id").mapInPandas(decide, fields)
        state = materialize(state.filter(F.col("step") >= STEPS).unionByName(moved))
    return data.join(state.select("item_id", "sigma", "total"), "item_id")


def _centre(width: float, mean: float) -> float:
    """The squared distance that powers are taken around: the mean under the weights, as long as exp stays in range."""
    return float(max(min(mean, 600 * width * width), 0.0)) if np.isfinite(mean) else 0.0


def affinities(vectors: DataFrame, perplexity: float = 30.0, widths: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """Symmetric Gaussian affinities ``item_id, neighbor, p`` at a wanted perplexity, or at given ``widths`` (as ``bandwidths``).

    An item's own weight counts in the normalisation and is then set to 0. A pair is a row if either item's share of the other
    is more than ``LEAST_SHARE``. ``packed`` gives them as rows of arrays ``item_id, neighbors, p, mass`` (the sum of p), several an item.
    Distances of two blocks serve the rows of both.
    """
    kind = dict(vectors.dtypes)["item_id"]
    known = bandwidths(vectors, perplexity) if widths is None else widths
    known = materialize(known.select("item_id", "vec", F.array("sigma", "total").alias("width")))
    n = known.count()

    def packs(ids: pa.Array, others: pa.Array, p: np.ndarray) -> pa.RecordBatch:
        """Rows of ``p`` without their zeros."""
        flat, sizes = p.ravel(), np.count_nonzero(p, axis=1)
        if sizes.sum() < len(flat):
            places = np.flatnonzero(flat)
            flat, places = flat[places], places % len(others)
        else:
            places = np.tile(np.arange(len(others)), len(ids))
        ends = np.cumsum(sizes[sizes > 0])
        offsets = pa.array(np.append(0, ends).astype("int32"))
        lists = [pa.ListArray.from_arrays(offsets, a) for a in (others.take(pa.array(places)), pa.array(flat))]
        return pa.RecordBatch.from_arrays([ids.filter(pa.array(sizes > 0)), *lists, pa.array(p.sum(1)[sizes > 0])], ["item_id", "neighbors", "p", "mass"])

    def kernel(one: dict, two: dict) -> Iterator[pa.RecordBatch]:
        q_ids, d_ids = one["ids"].values, two["ids"].values
        x, y = (blocks.matrix(s["vecs"].values.to_numpy(zero_copy_only=False), len(s["ids"].values)) for s in (one, two))
        q, d = (s["width"].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2) for s in (one, two))
        p = np.empty((len(x), len(y)))
        step = max(1, blocks.TILE_VALUES // 8 // max(len(y), 1))
        for at in range(0, len(x), step):
            rows = slice(at, at + step)
            sq = blocks.squares(x[rows], y)
            np.multiply(sq, (-1 / (2 * q[rows, 0] ** 2))[:, None], out=p[rows])
            np.exp(p[rows], out=p[rows])
            p[rows] /= q[rows, 1, None]
            if p[rows].min(initial=1) <= LEAST_SHARE:
                p[rows][p[rows] <= LEAST_SHARE] = 0
            sq *= (-1 / (2 * d[:, 0] ** 2))[None, :]
            np.exp(sq, out=sq)
            sq /= d[None, :, 1]
            if sq.min(initial=1) <= LEAST_SHARE:
                sq[sq <= LEAST_SHARE] = 0
            p[rows] += sq
        p[q_ids.to_numpy(zero_copy_only=False)[:, None] == d_ids.to_numpy(zero_copy_only=False)[None, :]] = 0
        p /= 2 * n
        yield packs(q_ids, d_ids, p)
        if one["block"].as_py() != two["block"].as_py():
            yield packs(d_ids, q_ids, np.ascontiguousarray(p.T))

    found = blocks.self_pairs(known, "width").reduce_once(kernel, f"item_id {kind}, neighbors array<{kind}>, p array<double>, mass double")
    if packed:
        return found
    return found.select("item_id", F.inline(F.arrays_zip(F.col("neighbors").alias("neighbor"), "p")))
