"""All-pairs work on vectors, block against block.

Items are hashed into blocks of bounded size and each block is one row of packed arrays. Blocks
meet in the cells of a grid; a task reduces the block pairs of a cell to what the caller needs
 (nearest neighbours, sums per label, nearest item outside a component), so item pairs are
never rows of a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from assaygrid.runtime import discard, materialize

BLOCK_VALUES = 500_000  # numbers per block
NEAR_VALUES = 2_000_000  # numbers of the differences taken at once
TILE_VALUES = 500_000  # numbers of a tile of distances, few enough for a core's cache
BOUND_VALUES = 4_000_000  # numbers of all blocks' centres and corners that tasks may hold; beyond it every pair of blocks is computed


def block_count(n: int, dim: int) -> int:
    size = max(16, min(2048, BLOCK_VALUES // max(dim, 1)))
    return max(1, -(-n // size))


def pack(vectors: DataFrame, n_blocks: int, prefix: str, extra: str | None = None) -> DataFrame:
    """``vectors(item_id, vec)`` as one row per block: ids, the vectors end to end, and ``extra`` values.

    Blocks come from a hash of the id, so their sizes are even whatever the data.
    """
    fields = ["item_id", "vec"] + ([extra] if extra else [])
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int")
    rows = vectors.groupBy(block.alias(f"{prefix}_block")).agg(F.collect_list(F.struct(*fields)).alias("r"))
    cols = [F.col("r.item_id").alias(f"{prefix}_ids"), F.flatten("r.vec").alias(f"{prefix}_vecs")]
    if extra:
        cols.append(F.col(f"r.{extra}").alias(f"{prefix}_{extra}"))
    return rows.select(f"{prefix}_block", *cols)


CELL = 8  # blocks on a side of a cell at most, which bounds what a task holds


@dataclass(frozen=True)
class Pairs:
    """Every query block beside every donor block, in cells of a grid.

    A cell holds a few query blocks and a few donor blocks and is one task's work: a block is copied once per
    cell of its row or column, not once per block it meets, and travels to Python once per cell.
    """

    queries: DataFrame
    donors: DataFrame
    n_queries: int
    n_donors: int

    def reduce(self, kernel: Callable[[dict], Iterator[pd.DataFrame]], schema: str, most: int = CELL) -> DataFrame:
        """What ``kernel`` makes of each block pair (``q_*`` and ``d_*`` arrays), as one frame.

        A task holds what a cell makes until it is done: ``most`` blocks on a side keep it small where that is much.
        """
        # cells are smaller while there are few blocks, so that all cores have work
        side = max(1, min(most, math.isqrt(self.n_queries * self.n_donors // 64)))
        rows, cols = -(-self.n_queries // side), -(-self.n_donors // side)
        q = self.queries.withColumn("_i", F.expr(f"q_block div {side}")).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cols - 1).cast("bigint"))))
        d = self.donors.withColumn("_j", F.expr(f"d_block div {side}")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint"))))
        names = [f.split(":")[0].strip().split(" ")[0] for f in schema.split(",")]

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            ours, theirs = left.to_dict("records"), right.to_dict("records")
            found = [part for mine in ours for other in theirs for part in kernel({**mine, **other})]
            return pd.concat(found) if found else pd.DataFrame(columns=names)

        return q.groupBy("_i", "_j").cogroup(d.groupBy("_i", "_j")).applyInPandas(meet, schema)

    def reduce_once(self, kernel: Callable[[dict, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``kernel`` makes of each unordered pair of blocks of a set with itself (``block``, ``ids``, ``vecs`` and extra
        fields of both); one pair is one task's work at a time."""
        q = self.queries.withColumn("_j", F.explode(F.sequence(F.col("q_block"), F.lit(self.n_queries - 1))))
        d = self.donors.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("d_block"))))

        def fields(t: pa.Table, side: str) -> dict:
            return {n.removeprefix(f"{side}_"): v for n, c in zip(t.column_names, t.columns) if n.startswith(f"{side}_") for v in [c[0]]}

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            found = list(kernel(fields(left, "q"), fields(right, "d"))) if left.num_rows and right.num_rows else []
            return pa.Table.from_batches(found, None if found else kinds)

        kinds = to_arrow_schema(_parse_datatype_string(schema))
        return q.groupBy("q_block", "_j").cogroup(d.groupBy("_i", "d_block")).applyInArrow(meet, schema)


def matrix(values: np.ndarray, rows: int) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(rows, -1)


def euclidean(q: np.ndarray, d: np.ndarray, tiled: bool = True) -> np.ndarray:
    """Distances with the direct difference where the expanded form loses digits; in tiles that a core's cache holds.

    Tiles can round a pair's distance differently from its two ends; the spanning tree goes without them.
    """
    out = squares(q, d, tiled)
    return np.sqrt(out, out=out)


def squares(q: np.ndarray, d: np.ndarray, tiled: bool = True) -> np.ndarray:
    """Squared distances, as in ``euclidean``."""
    out = np.empty((len(q), len(d)))
    step = max(1, TILE_VALUES // 2 // max(1, len(d)) if tiled else len(q))
    qq, dd = (q * q).sum(1), (d * d).sum(1)
    for at in range(0, len(q), step):
        sq = out[at : at + step]
        np.matmul(q[at : at + step], d.T, out=sq)
        sq *= 2
        # the squares first, so that a pair has one distance from both of its ends
        np.subtract(qq[at : at + step, None] + dd[None, :], sq, out=sq)
        # few pairs are below the largest bound; of them those below their own are measured
        i, j = np.nonzero(sq < 1e-6 * (qq[at : at + step].max(initial=0.0) + dd.max(initial=0.0)))
        close = sq[i, j] < 1e-6 * (qq[at + i] + dd[j])
        i, j = i[close], j[close]
        part = max(1, NEAR_VALUES // max(1, q.shape[1]))
        for n in range(0, len(i), part):
            diff = q[at + i[n : n + part]] - d[j[n : n + part]]
            sq[i[n : n + part], j[n : n + part]] = (diff * diff).sum(1)
        np.maximum(sq, 0, out=sq)
    return out


def top_k(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` smallest finite entries of every row, ties by id, best first."""
    order = np.argsort(ids, kind="stable")
    d = dist[:, order]
    if k < d.shape[1]:
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero((d <= limit) & np.isfinite(d))
    else:
        rows, cols = np.nonzero(np.isfinite(d))
    best = np.lexsort((cols, d[rows, cols], rows))
    rows, cols = rows[best], cols[best]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], order[cols[place < k]]


def distances_at(q: np.ndarray, d: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str = "euclidean", masked: bool = False) -> np.ndarray:
    """Distances of rows ``i`` of ``q`` from rows ``j`` of ``d`` by direct differences, the same whatever else is compared.

    ``masked``: roots of mean squares (``manhattan``: means of sizes) over the dimensions that the row of ``q`` has (no NaN).
    """
    total = np.zeros(len(i))
    for c in range(q.shape[1]):
        gap = q[i, c] - d[j, c]
        if masked:
            gap = np.nan_to_num(gap, nan=0.0, posinf=np.inf, neginf=-np.inf)
        total += np.abs(gap) if metric == "manhattan" else gap**2
    if masked:
        total /= np.maximum((~np.isnan(q)).sum(1), 1)[i]
    return total if metric == "manhattan" else np.sqrt(total)


def nearest_in(
    q: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, limit: np.ndarray, metric: str = "euclidean", masked: bool = False, own: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, column numbers and distances of the ``k`` nearest rows of ``d`` for every row of ``q``, ties by id, best first.

    Only distances up to ``limit`` count, and ``own`` names the id that a row leaves out. Sums of a tile, in single precision,
    tell which pairs can be among them, with a margin for rounding; only those are measured.
    """
    have = ~np.isnan(q) if masked else np.ones(q.shape, bool)
    n = np.maximum(have.sum(1), 1) if masked else np.ones(len(q))
    centre = d.mean(0)
    x, y = np.where(have, q - centre, 0.0), d - centre
    top = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
    kind = np.float32 if top < 1e6 else np.float64  # squares and their sums stay in range
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    dim = q.shape[1]
    eps = 4 * (2 * dim + 4) * np.finfo(kind).eps
    if metric == "manhattan":
        margin = eps * (np.abs(x).sum(1) + np.abs(y).sum(1).max(initial=0.0))
        bound = limit * n * (1 + 1e-9) + margin
        ys, xs, w = y.astype(kind), x.astype(kind), have.astype(kind)
        step = max(1, TILE_VALUES // 4 // max(len(d), 1))
    else:
        margin = eps * (xx + yy.max(initial=0.0))
        bound = limit * limit * n * (1 + 1e-9) + margin
        left = np.concatenate([-2 * x, have, xx[:, None]], axis=1).astype(kind)
        right = np.ascontiguousarray(np.concatenate([y, y * y, np.ones((len(d), 1))], axis=1).astype(kind).T)
        step = max(1, TILE_VALUES // max(len(d), 1))
    found = []
    for at in range(0, len(q), step):
        rows = slice(at, at + step)
        if metric == "manhattan":
            sums = np.zeros((len(x[rows]), len(d)), kind)
            for c in range(dim):
                gap = xs[rows, c, None] - ys[None, :, c]
                np.abs(gap, out=gap)
                if not have[rows, c].all():
                    gap *= w[rows, c, None]
                sums += gap
        else:
            sums = left[rows] @ right
        most = bound[rows].copy()
        free = np.flatnonzero(~np.isfinite(most))
        if len(free) and len(d) > k:
            if own is not None:
                a, b = np.nonzero(own[rows][free, None] == d_ids[None, :])
                sums[free[a], b] = np.inf
            most[free] = np.partition(sums[free], k - 1, axis=1)[:, k - 1] + 2 * margin[rows][free]
        i, j = np.nonzero(~(sums > most.astype(kind)[:, None] * kind(1 + 1e-6)))
        i += at
        if own is not None:
            other = own[i] != d_ids[j]
            i, j = i[other], j[other]
        dist = distances_at(q, d, i, j, metric, masked)
        near = (dist <= limit[i]) & np.isfinite(dist)
        found.append((i[near], j[near], dist[near]))
    i, j, dist = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    best = np.lexsort((np.argsort(np.argsort(d_ids, kind="stable"), kind="stable")[j], dist, i))
    i, j, dist = i[best], j[best], dist[best]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], dist[kept]


def self_pairs(vectors: DataFrame, extra: str | None = None) -> Pairs:
    """Block pairs of a set with itself. ``vectors`` should be a stored table."""
    first = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n = block_count(first["n"], first["dim"] or 1)
    return Pairs(pack(vectors, n, "q", extra), pack(vectors, n, "d", extra), n, n)


# ---- blocks of near items, and the pairs of them that can matter ----------------------------------


@dataclass(frozen=True)
class Bounds:
    """Of every block: its number, its items, centre and radius, and its corners (least and largest of each dimension)."""

    block: np.ndarray
    size: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def least(self, q: np.ndarray, have: np.ndarray | None = None, metric: str = "euclidean") -> np.ndarray:
        """Rows x blocks: no item of the block is nearer to the row than this, less what rounding can lose.

        With ``have`` (1 where a row has the dimension, else 0) distances are roots of mean squares (``manhattan``: means of
        sizes) over those.
        """
        out = np.empty((len(q), len(self.block)))
        for b in range(len(self.block)):
            gap = np.maximum(np.maximum(self.low[b] - q, q - self.high[b]), 0)
            if have is None:
                out[:, b] = np.maximum(np.sqrt((gap * gap).sum(1)), np.sqrt(((q - self.centre[b]) ** 2).sum(1)) - self.radius[b])
            elif metric == "manhattan":
                out[:, b] = (gap * have).sum(1) / np.maximum(have.sum(1), 1)
            else:
                out[:, b] = np.sqrt((gap * gap * have).sum(1) / np.maximum(have.sum(1), 1))
        return out * (1 - 1e-9) - 1e-9 * (1 + np.abs(q).max(initial=0.0))


@dataclass(frozen=True)
class Near:
    """Vectors in blocks of near items: stored rows (block, ids, vecs and what else they carry), and the blocks' bounds.

    Without ``bounds`` (too many blocks for tasks to hold) nothing is known of them and no pair is left out.
    """

    rows: DataFrame
    bounds: Bounds | None
    n_blocks: int


HALVES_SAMPLE = 16  # sampled items per block that decide where halves end


def halves(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of each cut of a tree that halves the sample where it is widest; node i has 2i + 1 and 2i + 2."""
    depth = max(0, math.ceil(math.log2(max(leaves, 1))))
    dims, ends = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
    parts = {0: sample}
    for node in range(2**depth - 1):
        part = parts.pop(node)
        if len(part):
            c = int(part.std(0).argmax())
            dims[node], ends[node] = c, np.median(part[:, c])
        lower = part[:, dims[node]] <= ends[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[lower], part[~lower]
    return dims, ends


def near_blocks(vectors: DataFrame, extra: str | None = None, by_halves: bool = False, bounded: bool = True) -> Near:
    """Items by the nearest of some pivots, large sets split by a hash, so that blocks are bounded whatever the data.

    The pivots are a sample of the items, as many as there are blocks of full size. Null and NaN entries of a vector
    count as absent: they have no part in its distance to a pivot, and bounds are only for vectors without them.
    ``by_halves`` cuts space at medians of a sample instead, for few dimensions; an absent entry lies at the sample's mean.
    """
    first = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, dim = first["n"], first["dim"] or 1
    size = max(16, min(2048, BLOCK_VALUES // dim))
    wanted = max(1, min(-(-n // size), BLOCK_VALUES // dim))
    taken = min(HALVES_SAMPLE * wanted, BLOCK_VALUES // dim) if by_halves else wanted
    sample = vectors.orderBy(F.xxhash64("item_id")).limit(max(taken, 1)).select("vec").collect()  # at most BLOCK_VALUES numbers
    pivots = np.array([[np.nan if v is None else v for v in r["vec"]] for r in sample], float).reshape(len(sample), -1)
    if by_halves:
        seen = np.isfinite(pivots)
        middle = np.where(seen, pivots, 0).sum(0) / np.maximum(seen.sum(0), 1)
        pivots = (middle, *halves(np.where(seen, pivots, middle), wanted))
    else:
        pivots = np.nan_to_num(pivots)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, dtype=float) for v in pdf["vec"]])
                if by_halves:
                    middle, dims, ends = p
                    x, node = np.where(np.isnan(x), middle, x), np.zeros(len(x), int)
                    while len(dims) and node[0] < len(dims):  # every item is on the same level
                        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > ends[node])
                    yield pdf.assign(pivot=(node - len(dims)).astype("int32"))
                    continue
                have = ~np.isnan(x)
                x0 = np.nan_to_num(x)
                d = (x0 * x0).sum(1)[:, None] - 2 * x0 @ p.T + have.astype(float) @ (p * p).T
                yield pdf.assign(pivot=d.argmin(1).astype("int32"))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    placed = materialize(vectors.mapInPandas(assign, kinds + ", pivot int"))
    # one row per pivot
    counts = sorted(map(tuple, placed.groupBy("pivot").agg(F.count("*")).collect()))
    parts = [max(1, -(-c // size)) for _, c in counts]
    starts = np.concatenate([[0], np.cumsum(parts)]).tolist()
    table = vectors.sparkSession.createDataFrame([(p, s, k) for (p, _), s, k in zip(counts, starts, parts)], "pivot int, _first int, _parts int")
    numbered = placed.join(F.broadcast(table), "pivot").withColumn("block", (F.col("_first") + F.pmod(F.xxhash64("item_id"), F.col("_parts"))).cast("int"))
    fields = ["item_id", "vec"] + ([extra] if extra else [])
    packed = numbered.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("r"))
    cols = [F.col("r.item_id").alias("ids"), F.flatten("r.vec").alias("vecs")] + ([F.col(f"r.{extra}").alias(extra)] if extra else [])
    rows = materialize(packed.select("block", *cols))
    discard(placed)
    total = starts[-1]
    return Near(rows, _bounds(rows) if bounded and total * dim * 3 <= BOUND_VALUES else None, total)


def _bounds(rows: DataFrame) -> Bounds:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for block, ids, vecs in zip(pdf["block"], pdf["ids"], pdf["vecs"]):
                x = matrix(vecs, len(ids))
                c = x.mean(0)
                out.append((block, len(ids), c, float(np.sqrt(((x - c) ** 2).sum(1).max())), x.min(0), x.max(0)))
            yield pd.DataFrame(out, columns=["block", "size", "centre", "radius", "low", "high"])

    found = rows.select("block", "ids", "vecs").mapInPandas(measure, "block int, size int, centre array<double>, radius double, low array<double>, high array<double>")
    pdf = found.toPandas().sort_values("block")  # at most BOUND_VALUES numbers
    stack = lambda c: np.array(pdf[c].tolist(), float).reshape(len(pdf), -1)
    return Bounds(pdf["block"].to_numpy(), pdf["size"].to_numpy(), stack("centre"), pdf["radius"].to_numpy(), stack("low"), stack("high"))


SIDE = 16  # blocks on a side of a cell of listed pairs at most


def listed_pairs(rows: DataFrame, choose: Callable[[dict], np.ndarray]) -> DataFrame:
    """(q_block, d_block): for each stored block of queries the blocks that ``choose`` names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                chosen = np.asarray(choose(row))
                yield pd.DataFrame({"q_block": np.full(len(chosen), row["block"], "int32"), "d_block": chosen.astype("int32")})

    return materialize(rows.mapInPandas(run, "q_block int, d_block int"))


def reduce_listed(pairs: DataFrame, queries: DataFrame, donors: DataFrame, kernel: Callable[[dict], Iterator[pd.DataFrame]], schema: str, listed: int = 0) -> DataFrame:
    """What ``kernel`` makes of each listed pair of blocks (``q_*`` and ``d_*`` fields); blocks that meet in a cell travel there once.

    The more pairs are ``listed`` the larger are the cells, so that fewer copies of blocks are shuffled.
    """
    side = min(SIDE, max(4, math.isqrt(listed // 256)))
    cells = lambda p: pairs.select("*", F.expr(f"q_block div {side}").alias(f"_{p}i"), F.expr(f"d_block div {side}").alias(f"_{p}j"))
    q = cells("q").groupBy("_qi", "_qj", "q_block").agg(F.collect_list("d_block").alias("q_wanted"))  # at most ``side`` each
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    q = q.join(named(queries, "q"), "q_block")
    d = cells("d").select("_di", "_dj", "d_block").distinct().join(named(donors, "d"), "d_block")
    names = [f.split(":")[0].strip().split(" ")[0] for f in schema.split(",")]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = left.to_dict("records"), {r["d_block"]: r for r in right.to_dict("records")}
        found = [part for mine in ours for b in mine["q_wanted"] for part in kernel({**mine, **theirs[b]})]
        return pd.concat(found) if found else pd.DataFrame(columns=names)

    return q.groupBy("_qi", "_qj").cogroup(d.groupBy("_di", "_dj")).applyInPandas(meet, schema)


@dataclass(frozen=True)
class Nearest:
    """``neighbors(item_id, <donor>, distance, rank)``, and how many pairs of blocks there are and were computed."""

    neighbors: DataFrame
    pairs: int
    computed: int


def nearest_pruned(queries: Near, donors: Near, k: int, id_type: str, donor: str = "neighbor", metric: str = "euclidean", masked: bool = False, own: bool = True, least_shared: int = 1) -> Nearest:
    """The exact ``k`` nearest donors of every query, ties by id, from the pairs of blocks that can hold one.

    ``masked`` compares a query in the dimensions that it has (no NaN), at least ``least_shared`` of them.

    First every block of queries meets the blocks that come nearest to it. The k-th distance that a query then has is a bound: a
    block whose items all lie farther is never computed for it. ``own`` leaves out equal ids.
    """
    bounds = donors.bounds
    shared = queries.rows.sparkSession.sparkContext.broadcast(bounds)
    blocks_d = np.arange(donors.n_blocks)

    def least(q: np.ndarray) -> np.ndarray:
        return shared.value.least(np.nan_to_num(q), (~np.isnan(q)).astype(float), metric) if masked else shared.value.least(q)

    def first(row: dict) -> np.ndarray:
        if shared.value is None:
            return blocks_d
        q = matrix(row["vecs"], len(row["ids"]))
        # blocks that may hold a row's nearest, those wanted by most rows first, until they hold k items
        low = least(q)
        centre = np.nan_to_num(np.nanmean(q, axis=0)) if len(q) else np.zeros(q.shape[1])
        order = np.lexsort((((shared.value.centre - centre) ** 2).sum(1), low.mean(0)))
        upto = int(np.searchsorted(np.cumsum(shared.value.size[order]), 2 * k + 1)) + 1
        return shared.value.block[order[: max(2, upto)]]

    def kernel(row: dict) -> Iterator[pd.DataFrame]:
        q_ids, d_ids = np.asarray(row["q_ids"]), np.asarray(row["d_ids"])
        q = matrix(row["q_vecs"], len(q_ids))
        kth = np.full(len(q_ids), np.inf)
        if row.get("q_kth") is not None:
            known = dict(zip(row["q_known"], row["q_kth"]))
            kth = np.array([known.get(i, np.inf) for i in q_ids.tolist()])
            at = np.flatnonzero(shared.value.block == row["d_block"])[0]
            one = Bounds(*(getattr(shared.value, f)[at : at + 1] for f in ("block", "size", "centre", "radius", "low", "high")))
            low = (one.least(np.nan_to_num(q), (~np.isnan(q)).astype(float), metric) if masked else one.least(q))[:, 0]
            near = low <= kth
            q_ids, q, kth = q_ids[near], q[near], kth[near]
        if masked:
            enough = (~np.isnan(q)).sum(1) >= max(least_shared, 1)
            q_ids, q, kth = q_ids[enough], q[enough], kth[enough]
        if len(q_ids):
            i, j, dist = nearest_in(q, matrix(row["d_vecs"], len(d_ids)), d_ids, k, kth, metric, masked, q_ids if own else None)
            yield pd.DataFrame({"item_id": q_ids[i], donor: d_ids[j], "distance": dist})

    schema = f"item_id {id_type}, {donor} {id_type}, distance double"
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("distance", donor))
    best = lambda found: found.withColumn("rank", rank).filter(F.col("rank") <= k)
    begun = listed_pairs(queries.rows, first)
    total, done = queries.n_blocks * donors.n_blocks, begun.count()
    found = materialize(best(reduce_listed(begun, queries.rows, donors.rows, kernel, schema, done)))
    if done == total:
        discard(begun)
        return Nearest(found, total, done)
    kth = found.filter(F.col("rank") == k).select("item_id", "distance")
    members = queries.rows.select("block", F.explode("ids").alias("item_id"))
    known = members.join(kth, "item_id").groupBy("block").agg(F.collect_list("item_id").alias("known"), F.collect_list("distance").alias("kth"))
    listed = begun.groupBy(F.col("q_block").alias("block")).agg(F.collect_list("d_block").alias("begun"))
    bounded = materialize(queries.rows.join(known, "block", "left").join(listed, "block", "left"))

    def needed(row: dict) -> np.ndarray:
        ids = np.asarray(row["ids"])
        have = dict(zip(row["known"], row["kth"])) if row["known"] is not None else {}
        limit = np.array([have.get(i, np.inf) for i in ids.tolist()])
        q = matrix(row["vecs"], len(ids))
        if masked:  # rows that no donor can serve ask for none
            limit[(~np.isnan(q)).sum(1) < max(least_shared, 1)] = -np.inf
        wanted = (least(q) <= limit[:, None]).any(0)
        return np.setdiff1d(shared.value.block[wanted], np.asarray(row["begun"] if row["begun"] is not None else [], int))

    rest = listed_pairs(bounded, needed)
    left = rest.count()
    empty = F.array().cast(f"array<{id_type}>"), F.array().cast("array<double>")
    ready = bounded.select("block", "ids", "vecs", F.coalesce("known", empty[0]).alias("known"), F.coalesce("kth", empty[1]).alias("kth"))
    more = reduce_listed(rest, ready, donors.rows.select("block", "ids", "vecs"), kernel, schema, left)
    out = materialize(best(found.drop("rank").unionByName(more)))
    discard(begun, found, bounded, rest)
    return Nearest(out, total, done + left)


def label_distances(pairs: Pairs, label: str = "label", id_type: str = "bigint", label_type: str = "string") -> DataFrame:
    """Sum of distances from every item to the members of every label: ``item_id, labelling, own, label, total, n``.

    ``label`` is an array with an item's label in each of some labellings; distances are computed once for all of them. The item
    itself is left out.
    """

    def kernel(row: dict) -> Iterator[pd.DataFrame]:
        q_ids, d_ids = np.asarray(row["q_ids"]), np.asarray(row["d_ids"])
        own, labels = (list(zip(*row[f"{side}_{label}"])) for side in "qd")  # one tuple per labelling
        coded = [np.unique(np.asarray(x), return_inverse=True) for x in labels]
        starts = np.cumsum([0] + [len(names) for names, _ in coded])
        member = np.stack([at + which for at, (_, which) in zip(starts, coded)])
        of = np.zeros((len(d_ids), starts[-1]))
        of[np.arange(len(d_ids)), member] = 1
        q, d = matrix(row["q_vecs"], len(q_ids)), matrix(row["d_vecs"], len(d_ids))
        total, n = np.empty((len(q_ids), starts[-1])), np.empty((len(q_ids), starts[-1]))
        step = max(1, TILE_VALUES // 2 // max(1, len(d_ids)))
        for at in range(0, len(q_ids), step):
            dist = euclidean(q[at : at + step], d)
            i, j = np.nonzero(q_ids[at : at + step, None] == d_ids[None, :])
            dist[i, j] = 0
            total[at : at + step], n[at : at + step] = dist @ of, of.sum(0)
            for column in member:
                np.subtract.at(n, (at + i, column[j]), 1)
        for which, (names, _) in enumerate(coded):
            for c, name in enumerate(names):
                at = starts[which] + c
                yield pd.DataFrame({"item_id": q_ids, "labelling": which, "own": np.asarray(own[which]), "label": name, "total": total[:, at], "n": n[:, at].astype("int64")})

    schema = f"item_id {id_type}, labelling int, own {label_type}, label {label_type}, total double, n long"
    parts = pairs.reduce(kernel, schema)
    return parts.groupBy("item_id", "labelling", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouettes(vectors: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Euclidean silhouette of every item in each labelling: ``labelling, item_id, label, a, b, silhouette``, from one pass over the pairs.

    A single member of a label has silhouette 0, as has an item when there is only one label.
    """
    kinds = dict(vectors.dtypes)
    stored = materialize(vectors.select("item_id", F.col("vec").cast("array<double>").alias("vec"), F.array(*labels).alias("label")))
    sums = label_distances(self_pairs(stored, "label"), "label", kinds["item_id"], kinds[labels[0]])
    mean = F.col("total") / F.col("n")
    per = sums.groupBy("labelling", "item_id", F.col("own").alias("label")).agg(
        F.max(F.when((F.col("own") == F.col("label")) & (F.col("n") > 0), mean)).alias("a"),
        F.min(F.when((F.col("own") != F.col("label")) & (F.col("n") > 0), mean)).alias("b"),
    )
    top = F.greatest("a", "b")
    value = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (top > 0), (F.col("b") - F.col("a")) / top)
    return per.withColumn("silhouette", F.coalesce(value, F.lit(0.0)))


def silhouette(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Euclidean silhouette of every item: ``item_id, label, a, b, silhouette``."""
    return silhouettes(vectors, [label]).drop("labelling")


def nearest_outside(near: Near, labels: DataFrame, known: DataFrame | None, id_type: str = "bigint") -> tuple[DataFrame, int]:
    """Ways out of every label: ``label, other, distance, lo, hi``, among them the shortest (ties by ids); and the block pairs computed.

    ``labels(item_id, label)``; ``known`` are ways between items found before, which bound what has to be looked at: a block is computed
    for an item only if it holds another label and can be as near as the shortest way out of the item's label known by then.
    """
    shared = near.rows.sparkSession.sparkContext.broadcast(near.bounds)

    def with_labels(limits: DataFrame | None) -> DataFrame:
        members = near.rows.select("block", F.posexplode("ids").alias("place", "item_id")).join(labels, "item_id")
        if limits is not None:
            members = members.join(limits, "label", "left")
        limit = F.coalesce("limit", F.lit(float("inf"))) if limits is not None else F.lit(float("inf"))
        packed = members.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "label", limit.alias("limit")))).alias("m"))
        return near.rows.join(packed, "block").select("block", "ids", "vecs", F.col("m.label").alias("label"), F.col("m.limit").alias("limit"))

    def kernel(row: dict) -> Iterator[pd.DataFrame]:
        q_ids, d_ids = np.asarray(row["q_ids"]), np.asarray(row["d_ids"])
        own, others = np.asarray(row["q_label"]), np.asarray(row["d_label"])
        q, limit = matrix(row["q_vecs"], len(q_ids)), np.asarray(row["q_limit"], float)
        use = np.ones(len(q_ids), bool)
        if shared.value is not None and np.isfinite(limit).any():
            at = np.flatnonzero(shared.value.block == row["d_block"])[0]
            one = Bounds(*(getattr(shared.value, f)[at : at + 1] for f in ("block", "size", "centre", "radius", "low", "high")))
            use = one.least(q)[:, 0] <= limit
        if len(set(others.tolist())) == 1:
            use &= own != others[0]
        q_ids, own, q, limit = q_ids[use], own[use], q[use], limit[use]
        if not len(q_ids):
            return
        dist = euclidean(q, matrix(row["d_vecs"], len(d_ids)), tiled=False)
        dist[(own[:, None] == others[None, :]) | (dist > limit[:, None])] = np.inf
        low = dist.min(axis=1, keepdims=True)
        i, j = np.nonzero((dist == low) & np.isfinite(dist))
        out = pd.DataFrame({"label": own[i], "other": others[j], "distance": dist[i, j], "lo": np.minimum(q_ids[i], d_ids[j]), "hi": np.maximum(q_ids[i], d_ids[j])})
        yield out.sort_values(["label", "distance", "lo", "hi"]).groupby("label", sort=False).head(1)

    schema = f"label {id_type}, other {id_type}, distance double, lo {id_type}, hi {id_type}"

    def shortest(found: DataFrame) -> DataFrame:
        return found.groupBy("label").agg(F.min(F.struct("distance", "lo", "hi", "other")).alias("e")).select("label", "e.*")

    def limits_of(found: DataFrame) -> DataFrame:
        return found.groupBy("label").agg(F.min("distance").alias("limit"))

    ways = None
    if known is not None:
        a, b = (labels.select(F.col("item_id").alias(c), F.col("label").alias(f"l_{c}")) for c in ("lo", "hi"))
        both = known.select("lo", "hi", "distance").distinct().join(a, "lo").join(b, "hi").filter("l_lo <> l_hi")
        sides = F.array(*[F.struct(F.col(f"l_{x}").alias("label"), F.col(f"l_{y}").alias("other"), "distance", "lo", "hi") for x, y in (("lo", "hi"), ("hi", "lo"))])
        ways = materialize(both.select(F.explode(sides).alias("e")).select("e.*"))
    start = materialize(with_labels(None if ways is None else limits_of(ways)))
    mixed = start.filter(F.size(F.array_distinct("label")) > 1)
    inside = materialize(reduce_listed(mixed.select(F.col("block").alias("q_block"), F.col("block").alias("d_block")), start, start, kernel, schema))
    met = mixed.count()
    both_ways = inside if ways is None else ways.unionByName(inside)
    ready = materialize(with_labels(limits_of(both_ways)))
    discard(start)
    everywhere = np.arange(near.n_blocks)
    single = {r["block"]: r["label"] for r in ready.filter(F.size(F.array_distinct("label")) == 1).select("block", F.col("label")[0].alias("label")).toLocalIterator()}

    def needed(row: dict) -> np.ndarray:
        others = everywhere[everywhere != row["block"]]
        own, limit = np.asarray(row["label"]), np.asarray(row["limit"], float)
        if shared.value is None:
            return others
        can = least_of(row) <= limit[:, None]
        for n, b in enumerate(shared.value.block.tolist()):
            if b in single:
                can[:, n] &= own != single[b]
        return np.setdiff1d(shared.value.block[can.any(0)], [row["block"]])

    def least_of(row: dict) -> np.ndarray:
        return shared.value.least(matrix(row["vecs"], len(row["ids"])))

    rest = listed_pairs(ready, needed)
    left = rest.count()
    found = materialize(reduce_listed(rest, ready, ready, kernel, schema, left))
    discard(ready, rest)
    out = materialize(shortest(both_ways.unionByName(found)))
    discard(ways, inside, found)
    return out, met + left
