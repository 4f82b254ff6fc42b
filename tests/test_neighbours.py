"""Neighbours, widths and ranks from few pairs, against brute force."""

import numpy as np
import pytest

from assaygrid.operators import blocks, cluster, impute, ordination
from tests.test_models import back, distances, make, points


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_masked_neighbours_are_pruned(spark, monkeypatch, metric):
    """Queries with absent dimensions find their exact neighbours (ties by id) without most of the pairs of blocks."""
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 60)
    rng = np.random.default_rng(51)
    d, q = rng.integers(0, 60, (400, 3)) / 4, rng.uniform(0, 15, (300, 3))
    d[200:230] = d[0]
    q[::5, 1] = np.nan
    q[7] = np.nan
    near = blocks.near_blocks(points(spark, q), by_halves=True, bounded=False), blocks.near_blocks(points(spark, d), by_halves=True)
    found = blocks.nearest_pruned(*near, 4, "bigint", "donor", metric, masked=True, own=False)
    got = {(r["item_id"], r["rank"]): (r["donor"], r["distance"]) for r in found.neighbors.collect()}
    gap = np.abs(q[:, None, :] - d[None, :, :])
    dist = np.nanmean(gap, axis=2) if metric == "manhattan" else np.sqrt(np.nanmean(gap**2, axis=2))
    for i in range(len(q)):
        order = [] if i == 7 else sorted(range(len(d)), key=lambda j: (round(dist[i, j], 12), j))[:4]
        assert [got[i, r + 1][0] for r in range(len(order))] == order
        assert [got[i, r + 1][1] for r in range(len(order))] == pytest.approx([dist[i, j] for j in order])
    assert (7, 1) not in got and found.computed < 0.7 * found.pairs


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_by_blocks(spark, monkeypatch, metric):
    """Imputation from pruned blocks equals imputation from all pairs."""
    rng = np.random.default_rng(52)
    x = rng.uniform(1, 9, (300, 5))
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"s{j}" for j in range(5)]
    whole = back(impute.knn(make(spark, x), metric=metric, mode="complete"), x.shape, names)
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 80)
    monkeypatch.setattr(impute, "FEW_PAIRS", 0)
    pruned = back(impute.knn(make(spark, x), metric=metric, mode="complete"), x.shape, names)
    assert not np.isnan(pruned).any() and pruned == pytest.approx(whole, abs=1e-12)


@pytest.mark.parametrize("metric,weight,mode", [("euclidean", "inverse", "waves"), ("manhattan", "rank", "complete"), ("pearson", "uniform", "complete"), ("cosine", "inverse", "complete")])
def test_few_donors_are_held(spark, monkeypatch, metric, weight, mode):
    """Rows filled beside few donors equal those whose donors are shuffled to them, and only the former shuffle no donors."""
    rng = np.random.default_rng(61)
    x = rng.uniform(1, 9, (200, 5))
    x[20:60] = x[0]
    x[rng.random(x.shape) < 0.2] = np.nan
    names, met = [f"s{j}" for j in range(5)], []
    monkeypatch.setattr(impute, "_neighbours", lambda *a, was=impute._neighbours: met.append(1) or was(*a))
    options = {"metric": metric, "weight": weight, "mode": mode, "k": 3, "min_shared": 2}
    held = back(impute.knn(make(spark, x), **options), x.shape, names)
    assert not met
    monkeypatch.setattr(impute, "FEW_DONORS", 0)
    shuffled = back(impute.knn(make(spark, x), **options), x.shape, names)
    assert met and not np.isnan(held).any() and held == pytest.approx(shuffled, abs=1e-9)


def test_stored_tables_leave_no_shuffles(spark):
    """What was shuffled for a stored table is removed with the job, and a discarded table is gone."""
    import os

    from assaygrid.runtime import discard, materialize

    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses
    before = kept().size()
    stored = materialize(spark.range(1000).groupBy("id").count())
    assert stored.count() == 1000 and kept().size() <= before + 1
    path = stored.stored_at.removeprefix("file:")
    assert os.path.exists(path)
    discard(stored)
    assert not os.path.exists(path)


def test_masked_search_is_lean():
    """Far fewer than all pairs are measured exactly, with and without a bound."""
    rng = np.random.default_rng(53)
    q, d = rng.normal(20, 1, (600, 9)), rng.normal(20, 1, (900, 9))
    q[::3, 2] = np.nan
    i, j, dist = blocks.nearest_in(q, d, np.arange(900), 3, np.full(600, np.inf), masked=True)
    want = np.sqrt(np.nanmean((q[:, None] - d[None]) ** 2, axis=2))
    assert (j.reshape(600, 3) == np.argsort(want, axis=1, kind="stable")[:, :3]).all()
    k, m, again = blocks.nearest_in(q, d, np.arange(900), 3, dist.reshape(600, 3)[:, 2], masked=True)
    assert (k == i).all() and (m == j).all() and (again == dist).all()


@pytest.mark.parametrize("items,perplexity", [(80, 12.0), (9, 30.0), (1, 30.0)])
def test_bandwidths_follow_the_bisection(spark, items, perplexity, monkeypatch):
    """Widths and sums are those of a plain bisection, in few passes over the pairs."""
    rng = np.random.default_rng(54)
    v = rng.normal(size=(items, 4))
    v[: items // 8] = v[0]
    passes = []
    monkeypatch.setattr(ordination.blocks, "self_pairs", lambda *a, was=blocks.self_pairs: passes.append(1) or was(*a))
    got = {r["item_id"]: (r["sigma"], r["total"]) for r in ordination.bandwidths(points(spark, v), perplexity).collect()}
    sq, target = distances(v) ** 2, np.log(min(perplexity, max(items - 1, 1)))
    for i in range(items):
        low, high = 1e-10, 1e4
        for _ in range(50):
            mid = (low + high) / 2
            with np.errstate(over="ignore"):
                w = np.exp(-sq[i] / (2 * mid * mid))
            total = w.sum()
            entropy = ((sq[i] * w).sum() / (2 * mid * mid) + (total - 1) * np.log(total)) / total
            if abs(entropy - target) < 1e-3:
                break
            low, high = (mid, high) if entropy < target else (low, mid)
        assert got[i] == pytest.approx((mid, total), rel=1e-6)
    assert items < 80 or ordination.ASKED * len(passes) < 60


def test_bandwidths_in_few_passes(spark, monkeypatch):
    """One pass over the pairs decides nearly all bisections, whatever the middles on their way."""
    v = np.random.default_rng(58).normal(size=(400, 8))
    asked = []
    monkeypatch.setattr(blocks, "pack", lambda df, *a, was=blocks.pack: asked.append(df.count()) or was(df, *a))
    got = {r["item_id"]: (r["sigma"], r["total"]) for r in ordination.bandwidths(points(spark, v), 20.0).collect()}
    assert asked[:2] == [400, 400] and sum(asked[2:]) < 800, asked
    sq = distances(v) ** 2
    for i in (0, 99, 399):
        w = np.exp(-sq[i] / (2 * got[i][0] ** 2))
        assert got[i][1] == pytest.approx(w.sum(), rel=1e-9)


def test_affinities_meet_pairs_once(spark, monkeypatch):
    """Blocks meet once for the rows of both; each packed row has the sum of its shares."""
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 60)
    v = np.random.default_rng(59).normal(size=(70, 4))
    met, plain = [], {}
    monkeypatch.setattr(blocks.Pairs, "reduce_once", lambda self, kernel, schema, was=blocks.Pairs.reduce_once: met.append(1) or was(self, kernel, schema))
    widths = spark.createDataFrame([(i, [float(x) for x in v[i]], 0.7 + i / 100, 3.0 + i) for i in range(70)], "item_id long, vec array<double>, sigma double, total double")
    for r in ordination.affinities(points(spark, v), widths=widths, packed=True).collect():
        assert r["mass"] == pytest.approx(sum(r["p"]))
        plain.update({(r["item_id"], j): p for j, p in zip(r["neighbors"], r["p"])})
    sq, sigma = distances(v) ** 2, np.array([0.7 + i / 100 for i in range(70)])
    one = np.exp(-sq / (2 * sigma**2)[:, None]) / np.array([3.0 + i for i in range(70)])[:, None]
    np.fill_diagonal(one, 0)
    one[one <= ordination.LEAST_SHARE] = 0
    both = (one + one.T) / 140
    assert met and plain == pytest.approx({(i, j): both[i, j] for i in range(70) for j in range(70) if both[i, j] > 0})


def test_packed_affinities(spark):
    """Packed rows hold the same pairs as plain ones, and the distances from labels are summed without pair rows."""
    v = np.random.default_rng(55).normal(size=(60, 4))
    plain = {(r["item_id"], r["neighbor"]): r["p"] for r in ordination.affinities(points(spark, v), 8.0).collect()}
    rows = ordination.affinities(points(spark, v), 8.0, packed=True).collect()
    packed = {(r["item_id"], j): p for r in rows for j, p in zip(r["neighbors"], r["p"])}
    assert len(plain) > 60 and packed == pytest.approx(plain)


def test_tiled_distances(monkeypatch):
    """Tiles change nothing, equal rows have distance 0 and label sums leave the item itself out."""
    v = np.random.default_rng(56).normal(size=(90, 5))
    v[40:50] = v[3]
    whole = blocks.euclidean(v, v)
    monkeypatch.setattr(blocks, "TILE_VALUES", 500)
    assert (np.abs(blocks.euclidean(v, v) - whole) < 1e-12).all() and whole == pytest.approx(distances(v), abs=1e-9)
    assert (whole[40:50, 3] == 0).all()


def test_sweep_meets_pairs_once(spark, monkeypatch):
    """All labellings share one pass over the pairs of blocks; each has the silhouettes of its own clusters."""
    rng = np.random.default_rng(57)
    v = rng.normal(size=(70, 3)) + rng.integers(0, 3, 70)[:, None] * 4
    labels, passes, d = rng.integers(0, 4, (70, 3)), [], distances(v)
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 60)
    monkeypatch.setattr(blocks, "self_pairs", lambda *a, was=blocks.self_pairs: passes.append(1) or was(*a))
    rows = [(i, [float(x) for x in v[i]], *map(int, labels[i])) for i in range(70)]
    df = spark.createDataFrame(rows, "item_id long, vec array<double>, l0 int, l1 int, l2 int")
    got = {(r["labelling"], r["item_id"]): (r["label"], r["silhouette"]) for r in blocks.silhouettes(df, ["l0", "l1", "l2"]).collect()}
    assert len(passes) == 1 and len(got) == 210
    for c in range(3):
        for i in range(70):
            mean = {x: d[i, (labels[:, c] == x) & (np.arange(70) != i)].mean() for x in range(4)}
            a, b = mean[labels[i, c]], min(m for x, m in mean.items() if x != labels[i, c])
            assert got[c, i] == (labels[i, c], pytest.approx((b - a) / max(a, b)))
    assert [r["k"] for r in cluster.k_sweep(points(spark, v), 2, 4, 1).collect()] == [2, 3, 4] and len(passes) == 2
