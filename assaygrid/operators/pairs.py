"""Sums over all pairs of samples (or items) without emitting a row per pair and feature.

Each feature is one row holding its observed (index, value) entries. A task turns a batch of
such rows into a dense block and adds up matrix products; only the summed blocks are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.operators.ranking import PART
from assaygrid.runtime import materialize

BLOCK = 512  # samples per block; a block pair needs a few BLOCK x BLOCK matrices in a task
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
EXTRA = ["sabs", "smin"]


def index_samples(samples: DataFrame, by: str = "sample_id") -> DataFrame:
    """Samples numbered from 0 in id order, from one scalar array; ``idx`` is the position."""
    ids = samples.agg(F.sort_array(F.collect_set(by)).alias("ids"))
    return ids.select(F.posexplode("ids").alias("idx", by))


def _accumulate(extra: bool, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple[int, int], list[np.ndarray]] = {}
        for pdf in batches:
            for (bi, bj), part in pdf.groupby(["bi", "bj"], sort=False):
                if (bi, bj) not in acc:
                    yield from _flush(acc, extra)  # rows come sorted by block pair
                    acc = {(bi, bj): [np.zeros((width, width)) for _ in range(8 if extra else 6)]}
                x, wx = _dense(part["xi"], part["xv"], width)
                y, wy = (x, wx) if bi == bj else _dense(part["yi"], part["yv"], width)
                sums = acc[(bi, bj)]
                sums[0] += wx.T @ wy
                sums[1] += x.T @ wy
                sums[2] += wx.T @ y
                sums[3] += (x * x).T @ wy
                sums[4] += wx.T @ (y * y)
                sums[5] += x.T @ y
                if extra:
                    for a in np.flatnonzero(wx.any(axis=0)):
                        both = wx[:, a : a + 1] * wy
                        sums[6][a] += (np.abs(x[:, a : a + 1] - y) * both).sum(axis=0)
                        sums[7][a] += (np.minimum(x[:, a : a + 1], y) * both).sum(axis=0)
        yield from _flush(acc, extra)

    return run


def _dense(idx: pd.Series, val: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = idx.map(len).to_numpy()
    rows = np.repeat(np.arange(len(idx)), lengths)
    cols = np.concatenate([np.asarray(i, dtype=int) for i in idx]) if len(idx) else np.zeros(0, int)
    vals = np.concatenate([np.asarray(v, dtype=float) for v in val]) if len(val) else np.zeros(0)
    x = np.zeros((len(idx), width))
    w = np.zeros((len(idx), width))
    x[rows, cols % BLOCK] = vals
    w[rows, cols % BLOCK] = 1.0
    return x, w


def _flush(acc: dict, extra: bool) -> Iterator[pd.DataFrame]:
    for (bi, bj), sums in acc.items():
        i, j = np.nonzero(sums[0])
        keep = (i <= j) if bi == bj else slice(None)
        i, j = i[keep], j[keep]
        names = SUMS + (EXTRA if extra else [])
        out = {"i": i + bi * BLOCK, "j": j + bj * BLOCK}
        out.update({name: s[i, j] for name, s in zip(names, sums)})
        yield pd.DataFrame(out)


def pair_sums(entries: DataFrame, key: str, n_items: int, extra: bool = False) -> DataFrame:
    """Sums over shared keys for every index pair i <= j.

    ``entries(key, idx, value)`` holds at most one value per (key, idx), with idx < ``n_items``. Result: ``i, j, n`` and the
    sums of x, y, x2, y2, xy over keys seen in both; with ``extra`` also of abs(x-y) and min(x, y).
    """
    entries = entries.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = entries.groupBy(key, F.expr(f"idx div {BLOCK}").cast("int").alias("blk")).agg(
        F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "value")).alias("e")
    )
    rows = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("blk", "e"))).alias("blocks"))
    left = rows.select("blocks", F.explode("blocks").alias("p"))
    later = F.filter("blocks", lambda b: b["blk"] >= F.col("p.blk"))
    pairs = left.select("p", F.explode(later).alias("q")).select(
        F.col("p.blk").alias("bi"),
        F.col("q.blk").alias("bj"),
        F.col("p.e.idx").alias("xi"),
        F.col("p.e.value").alias("xv"),
        F.col("q.e.idx").alias("yi"),
        F.col("q.e.value").alias("yv"),
    )
    names = SUMS + (EXTRA if extra else [])
    schema = "i int, j int, " + ", ".join(f"{n} double" for n in names)
    partial = pairs.sortWithinPartitions("bi", "bj").mapInPandas(_accumulate(extra, min(BLOCK, n_items)), schema)
    return partial.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums, null below two shared rows or without spread, held in [-1, 1]."""
    cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
    flat = (vx <= 1e-12 * F.abs(sxx)) | (vy <= 1e-12 * F.abs(syy))
    r = cov / F.sqrt(vx * vy)
    return F.when((n >= 2) & ~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def named(pairs: DataFrame, index: DataFrame, left: str, right: str, by: str = "sample_id") -> DataFrame:
    """Replace positions i, j by ids; ``index`` is the table of ``index_samples``."""
    a = index.select(F.col("idx").alias("i"), F.col(by).alias(left))
    b = index.select(F.col("idx").alias("j"), F.col(by).alias(right))
    return pairs.join(a, "i").join(b, "j").drop("i", "j")


# ---- ranks within every pair's shared keys -----------------------------------------


SECTION = 4_000_000  # numbers in the rank table of one laid-out part: its rows times the items
WORD = 64  # items per column of presence bits


def _presence(table: pa.Table | pa.RecordBatch, n_items: int) -> np.ndarray:
    """Rows x items: 1 where the row's key has the item."""
    shift = np.arange(WORD, dtype=np.uint64)
    words = [table.column(f"_m{w}").to_numpy().astype(np.int64).view(np.uint64) for w in range(-(-n_items // WORD))]
    return np.concatenate([((m[:, None] >> shift) & np.uint64(1)).astype(np.uint8) for m in words], axis=1)[:, :n_items]


class _Sections:
    """The values of each item cut where their partitions end; a value that lies in several partitions is a section of its own.

    ``edges``: (partition, item, smallest value, largest value), at most partitions + items rows.
    """

    def __init__(self, edges: list[tuple[int, int, float, float]], parts: int, n_items: int) -> None:
        edges = sorted(edges, key=lambda e: (e[1], e[0]))
        split = {(b[1], b[2]) for a, b in zip(edges, edges[1:]) if a[1] == b[1] and a[3] == b[2]}
        shape = (parts, n_items)
        self.inner, self.first, self.last = (np.full(shape, -1) for _ in range(3))
        self.low, self.high = np.zeros(shape), np.zeros(shape)
        own: dict[tuple[int, float], int] = {}
        self.item: list[int] = []

        def new(item: int) -> int:
            self.item.append(item)
            return len(self.item) - 1

        for part, item, low, high in edges:
            self.low[part, item], self.high[part, item] = low, high
            for value, at in ((low, self.first), (None, self.inner), (high, self.last)):
                if value is None:
                    at[part, item] = new(item)
                elif (item, value) in split:
                    if (item, value) not in own:
                        own[item, value] = new(item)
                    at[part, item] = own[item, value]
        self.whole = np.zeros(len(self.item), bool)
        self.whole[list(own.values())] = True

    def of(self, part: np.ndarray, item: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The section of each row."""
        first, last = self.first[part, item], self.last[part, item]
        found = np.where((first >= 0) & (value == self.low[part, item]), first, self.inner[part, item])
        return np.where((last >= 0) & (value == self.high[part, item]), last, found)

    def below(self, counts: np.ndarray) -> np.ndarray:
        """What the earlier sections of the same item hold."""
        item = np.array(self.item, int)
        before = np.cumsum(counts, axis=0) - counts
        start = np.flatnonzero(np.diff(item, prepend=-1))
        return before - np.repeat(before[start], np.diff(np.append(start, len(item))), axis=0)


def _section_counts(sections: _Sections, n_items: int):
    """For each section, how many of its rows have each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = sections.of(*(batch.column(c).to_numpy() for c in (PART, "idx", "value")))
            order = np.argsort(at, kind="stable")
            start = np.flatnonzero(np.diff(at[order], prepend=-1))
            if not len(start):
                continue
            sums = np.add.reduceat(_presence(batch, n_items)[order], start, axis=0, dtype=np.int64)
            for s, v in zip(at[order][start].tolist(), sums):
                held[s] = held.get(s, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], ["section", "held"])

    return run


def _part_ranks(sections: _Sections, counts: np.ndarray, key: str, n_items: int, width: str):
    """Twice the rank of each value against every item its key has, packed in item order."""
    below = sections.below(counts)

    def run(table: pa.Table) -> pa.Table:
        idx, value = table.column("idx").to_numpy(), table.column("value").to_numpy()
        order = np.lexsort((value, idx))
        table, idx, value = table.take(pa.array(order)), idx[order], value[order]
        bits = _presence(table, n_items)
        start = np.flatnonzero((np.diff(idx, prepend=-1) != 0) | (np.diff(value, prepend=np.nan) != 0))
        equal = np.add.reduceat(bits, start, axis=0, dtype=np.int64)
        before = np.cumsum(equal, axis=0) - equal
        at = sections.of(table.column(PART).to_numpy()[start], idx[start], value[start])
        opening = np.flatnonzero(np.diff(at, prepend=-1))
        before -= np.repeat(before[opening], np.diff(np.append(opening, len(at))), axis=0)
        equal = np.where(sections.whole[at][:, None], counts[at], equal)
        twice = (2 * (below[at] + before) + equal + 1).astype(width)
        packed = np.repeat(twice, np.diff(np.append(start, len(idx))), axis=0)[bits.astype(bool)]
        ends = np.append(0, np.cumsum(bits.sum(axis=1, dtype=np.int64))) * packed.itemsize
        ranks = pa.Array.from_buffers(pa.large_binary(), len(idx), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())
        return pa.table([table.column(key), table.column("idx"), ranks], [key, "idx", "ranks"])

    return run


def _rank_products(key: str, n_items: int, width: str):
    """Sums of rank products and squares over keys; rows (key, idx, ranks) come sorted by key and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cross, square = (np.zeros(n_items * n_items) for _ in range(3))

        def add(table: pa.Table, code: np.ndarray) -> None:
            idx = table.column("idx").to_numpy()
            # an item that a key has several times counts once
            keep = np.flatnonzero((np.diff(code, append=-1) != 0) | (np.diff(idx, append=-1) != 0))
            code, idx = code[keep], idx[keep].astype(np.int64)
            data = table.column("ranks").combine_chunks().cast(pa.large_binary()).take(pa.array(keep))
            flat = np.frombuffer(data.buffers()[2], width).astype(float) / 2
            start = np.flatnonzero(np.diff(code, prepend=-1))
            size = np.diff(np.append(start, len(code)))
            first, size = np.repeat(start, size), np.repeat(size, size)
            at = np.append(0, np.cumsum(size))
            row = np.repeat(np.arange(len(code)), size)
            other = first[row] + np.arange(len(row)) - at[row]
            cell = idx[row] * n_items + idx[other]
            back = flat[at[other] + row - first[row]]
            for sums, weight in ((n, None), (cross, flat * back), (square, flat * flat)):
                sums += np.bincount(cell, weight, n_items * n_items)

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            code = table.column(key).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            cut = int(np.flatnonzero(np.diff(code, prepend=-1))[-1]) if len(code) else 0
            if cut:
                add(table.slice(0, cut), code[:cut])
            held = table.slice(cut)
        if held is not None and held.num_rows:
            add(held, np.zeros(held.num_rows, np.int64))
        n, cross, square = (s.reshape(n_items, n_items) for s in (n, cross, square))
        i, j = np.nonzero(np.triu(n, 1))
        out = {"i": i.astype(np.int32), "j": j.astype(np.int32), "n": n[i, j], "cross": cross[i, j], "square_i": square[i, j], "square_j": square[j, i]}
        yield pa.RecordBatch.from_pydict(out)

    return run


def rank_sums(entries: DataFrame, key: str, n_items: int) -> DataFrame:
    """Spearman ingredients of every pair i < j: ``i, j, n, cross, square_i, square_j``.

    A value's rank against item j is the number of smaller values of the same item on keys that j has,
    plus half of the equal ones: running sums of presence bits along each item's sorted values. Parts of
    the order are bounded, equal values may lie in several, and each adds what earlier ones hold.
    """
    value = F.when(F.col("value") == 0, 0.0).otherwise(F.col("value")).alias("value")
    entries = entries.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(key, F.col("idx").cast("int").alias("idx"), value)
    words = [f"_m{w}" for w in range(-(-n_items // WORD))]
    bit = [F.when(F.expr(f"idx div {WORD}") == w, F.expr(f"shiftleft(1L, idx - {WORD * w})")) for w in range(len(words))]
    spread = materialize(entries.select("*", *[F.coalesce(F.bit_or(b).over(Window.partitionBy(key)), F.lit(0)).cast("bigint").alias(w) for b, w in zip(bit, words)]))
    n_rows = spread.count()
    parts = max(1, -(-n_rows * n_items // SECTION))
    laid = materialize(spread.repartitionByRange(parts, "idx", "value", F.xxhash64(key)).withColumn(PART, F.spark_partition_id()))
    edges = laid.groupBy(PART, "idx").agg(F.min("value").alias("low"), F.max("value").alias("high")).select(PART, "idx", "low", "high")
    sections = _Sections([tuple(r) for r in edges.collect()], parts, n_items)
    counts = np.zeros((len(sections.item), n_items), np.int64)
    for r in laid.select(PART, "idx", "value", *words).mapInArrow(_section_counts(sections, n_items), "section int, held array<bigint>").collect():
        counts[r["section"]] += np.array(r["held"])
    width = "<u4" if 2 * n_rows + 1 < 2**32 else "<u8"
    kind = dict(entries.dtypes)[key]
    ranked = laid.groupBy(PART).applyInArrow(_part_ranks(sections, counts, key, n_items, width), f"`{key}` {kind}, idx int, ranks binary")
    by_key = ranked.repartition(key).sortWithinPartitions(key, "idx")
    sums = by_key.mapInArrow(_rank_products(key, n_items, width), "i int, j int, n double, cross double, square_i double, square_j double")
    return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "cross", "square_i", "square_j")])


def spearman(n: Column, cross: Column, square_i: Column, square_j: Column) -> Column:
    """Correlation of average ranks; their mean is (n + 1) / 2 whatever the ties."""
    centre = n * (n + 1) * (n + 1) / 4
    vi, vj = square_i - centre, square_j - centre
    return F.when((n >= 2) & (vi > 1e-9) & (vj > 1e-9), (cross - centre) / F.sqrt(vi * vj))
