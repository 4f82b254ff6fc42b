"""Iterative and randomised operators against brute force on small fixtures."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaygrid import Assay
from assaygrid.operators import batch, blocks, cluster, eigen, enrich, filters, hybrid, impute, ordination, saint, sets


def make(spark, x, names=None, meta=None):
    """Assay of a features x samples array; NaN cells are absent."""
    names = names or [f"s{j}" for j in range(x.shape[1])]
    rows = [(int(i), names[j], float(x[i, j])) for i, j in zip(*np.nonzero(~np.isnan(x)))]
    cells = spark.createDataFrame(rows, "feature_id long, sample_id string, value double")
    cols = sorted(meta or {})
    samples = spark.createDataFrame([(n, *[meta[c][j] for c in cols]) for j, n in enumerate(names)], "sample_id string" + "".join(f", {c} string" for c in cols))
    return Assay(cells, samples)


def back(df, shape, names, value="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[value] is not None:
            out[r["feature_id"], names.index(r["sample_id"])] = r[value]
    return out


def points(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "item_id long, vec array<double>")


def distances(v):
    return np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(-1))


def test_knn_waves(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(10, 2, size=(40, 6)), 3)
    for i in range(15):
        x[i, rng.choice(6, size=1 + i % 3, replace=False)] = np.nan
    names = [f"s{j}" for j in range(6)]
    got = back(impute.knn(make(spark, x), k=3, rule="null"), x.shape, names)
    missing = np.isnan(x).sum(1)
    filled, pool = x.copy(), [i for i in range(40) if missing[i] == 0]
    for count in sorted(set(missing) - {0}):
        wave = [i for i in range(40) if missing[i] == count]
        for i in wave:
            seen = ~np.isnan(x[i])
            d = np.sqrt(((filled[pool][:, seen] - x[i, seen]) ** 2).mean(1))
            best = sorted(range(len(pool)), key=lambda k: (d[k], pool[k]))[:3]
            w = 1 / np.maximum(d[best], 1e-8)
            filled[i, ~seen] = (filled[[pool[k] for k in best]][:, ~seen] * w[:, None]).sum(0) / w.sum()
        pool += wave
    assert got == pytest.approx(filled, abs=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "pearson", "cosine"])
def test_knn_caps_and_metrics(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.random((20, 6)) + 1
    x[0, :4] = np.nan
    x[1, 0] = np.nan
    x[2, [0, 1, 2]] = np.nan
    a = make(spark, x, meta={"g": ["a", "a", "a", "b", "b", "b"]})
    out = impute.knn(a, metric=metric, rule="null", max_missing=0.5, max_missing_group=0.5, by="g", min_shared=2)
    got = back(out, x.shape, [f"s{j}" for j in range(6)])
    assert np.isnan(got[0]).sum() == 4 and np.isnan(got[2]).sum() == 3 and not np.isnan(got[1]).any()


def test_knn_then_minprob_leaves_nothing(spark):
    rng = np.random.default_rng(2)
    x = rng.lognormal(8, 1, size=(30, 5))
    x[rng.random(x.shape) < 0.3] = np.nan
    a = make(spark, x)
    one = impute.knn_then_minprob(a, max_missing=0.3, rule="null").orderBy("feature_id", "sample_id").collect()
    two = impute.knn_then_minprob(a, max_missing=0.3, rule="null").orderBy("feature_id", "sample_id").collect()
    assert all(r["value"] is not None for r in one) and one == two


def test_single_linkage(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(c, 0.3, size=(14, 3)) for c in (0, 4, 9)])
    v[5] = v[6]
    d = distances(v)
    tree = cluster.spanning_tree(points(spark, v)).collect()
    assert len(tree) == len(v) - 1
    # Prim's total weight
    inside, total, low = {0}, 0.0, d[0].copy()
    while len(inside) < len(v):
        nxt = min((j for j in range(len(v)) if j not in inside), key=lambda j: low[j])
        total += low[nxt]
        inside.add(nxt)
        low = np.minimum(low, d[nxt])
    assert sum(r["distance"] for r in tree) == pytest.approx(total)
    labels = {r["item_id"]: r["label"] for r in cluster.threshold_clusters(points(spark, v), 2.0).collect()}
    assert len(set(labels.values())) == 3
    levels = cluster.level_labels(points(spark, v), 5).groupBy("level").agg(F.count_distinct("cluster").alias("k")).orderBy("level").collect()
    counts = [r["k"] for r in levels]
    assert counts[0] >= len(v) - 1 and counts[-1] == 1 and counts == sorted(counts, reverse=True)


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30], "lo long, hi long")
    nodes = spark.range(62).withColumnRenamed("id", "item_id")
    got = {r["item_id"]: r["label"] for r in cluster.components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 30 else 31 if i <= 60 else 61 for i in range(62)}


@pytest.mark.parametrize("size", [500_000, 120])
def test_blocks(spark, size, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", size)
    rng = np.random.default_rng(4)
    v = rng.integers(0, 4, size=(50, 3)).astype(float)  # many equal distances
    d = distances(v)
    got = {(r["item_id"], r["rank"]): r["neighbor"] for r in ordination.knn_graph(points(spark, v), 4).collect()}
    for i in range(50):
        order = sorted((j for j in range(50) if j != i), key=lambda j: (round(d[i, j], 9), j))
        assert [got[i, r] for r in range(1, 5)] == order[:4]
    label = np.arange(50) % 3
    df = points(spark, v).withColumn("label", (F.col("item_id") % 3).cast("string"))
    for r in blocks.silhouette(df).collect():
        i = r["item_id"]
        mean = [d[i, (label == g) & (np.arange(50) != i)].mean() for g in range(3)]
        a, b = mean[label[i]], min(m for g, m in enumerate(mean) if g != label[i])
        assert r["silhouette"] == pytest.approx((b - a) / max(a, b) if max(a, b) else 0.0)


def test_affinities(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 3))
    rows = ordination.affinities(points(spark, v), 10.0).collect()
    p = {(r["item_id"], r["neighbor"]): r["p"] for r in rows}
    assert all(p[i, j] == pytest.approx(p[j, i]) for i, j in p)
    assert all(i != j and x > 0 for (i, j), x in p.items()) and sum(p.values()) <= 1


def test_pca_and_pcoa(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 5)) @ np.diag([4, 2, 1, 0.5, 0.1])
    scores, loadings, variance = ordination.pca(points(spark, v), 2)
    values = np.sort(np.linalg.eigvalsh(np.cov(v.T)))[::-1]
    var = [r for r in variance.orderBy("component").collect()]
    assert [r["eigenvalue"] for r in var] == pytest.approx(list(values[:2]))
    assert var[0]["share_total"] == pytest.approx(values[0] / values.sum()) and sum(r["share_extracted"] for r in var) == pytest.approx(1)
    s = np.array([[r["pc1"], r["pc2"]] for r in scores.orderBy("item_id").collect()])
    assert s.mean(0) == pytest.approx([0, 0], abs=1e-9) and s.var(0, ddof=1) == pytest.approx(values[:2])
    d = distances(v[:12])
    rows = [(f"i{i:02d}", f"i{j:02d}", float(d[i, j])) for i in range(12) for j in range(i + 1, 12)]
    out = ordination.pcoa(spark.createDataFrame(rows, "a string, b string, distance double"), 5)
    c = np.array([[r[f"pc{k}"] for k in range(1, 6)] for r in out.scores.orderBy("sample_id").collect()])
    assert distances(c) == pytest.approx(d, abs=1e-8)


def test_sample_scores_keep_distances(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 6))
    a = make(spark, x)
    out = ordination.sample_scores(a, a.cells)
    c = np.array([list(r)[1:] for r in out.scores.orderBy("sample_id").collect()])
    assert distances(c) == pytest.approx(distances(x.T), abs=1e-8)
    cov = ordination.sample_pca(a, 6).variance.orderBy("component").collect()
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r["eigenvalue"] for r in cov] == pytest.approx(list(want))


def test_kmeans_and_som(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(c, 0.2, size=(20, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    sweep = cluster.k_sweep(points(spark, v), 2, 5, n_init=3)
    assert cluster.choose_k(sweep).first()["k"] == 3
    assert cluster.elbow(sweep).first()["k"] == 3
    clustered, inertia = cluster.kmeans(points(spark, v), 3, 3)
    labels = {r["item_id"]: r["cluster"] for r in clustered.collect()}
    assert [len({labels[i] for i in range(s, s + 20)}) for s in (0, 20, 40)] == [1, 1, 1]
    code = cluster.som(points(spark, v), 4, 4, epochs=15)
    again = cluster.som(points(spark, v).orderBy(F.desc("item_id")), 4, 4, epochs=15)
    assert code == pytest.approx(again)
    m = cluster.som_match(points(spark, v), code)
    q = cluster.som_quality(m, 4, 4).first()
    assert q["quantization_error"] < 0.6 and 0 <= q["topographic_error"] <= 1
    assert cluster.som_units(m, code, 4, 4).agg(F.sum("hits")).first()[0] == 60


def test_lattice():
    steps = cluster.lattice_distance("hex", 3, 3)
    assert (np.isclose(steps, 1).sum(1) == [2, 4, 3, 5, 6, 3, 2, 4, 3]).all()
    assert cluster.lattice_distance("rect", 2, 2)[0, 3] == pytest.approx(math.sqrt(2))


def test_batch_known_truth(spark):
    rng = np.random.default_rng(9)
    names = [f"batch{b}_{g}_{r}" for b in (1, 2) for g in ("ctrl", "trt") for r in range(6)]
    b, g = np.array([n[5] for n in names]), np.array([n.split("_")[1] for n in names])
    base = rng.normal(24, 1.5, size=(150, 1)) + rng.normal(0, 0.25, size=(150, 24))
    base[:20] += np.where(g == "trt", 1.2, 0)
    base = np.where(b == "2", base + 0.7, base)
    x = 2**base
    x[rng.random(x.shape) < 0.03] = np.nan
    a = make(spark, x, names, {"batch": list(b), "grp": list(g)})
    before = batch.batch_r2_summary(batch.batch_r2(a, "batch")).first()["mean"]
    for method in ("median", "mean", "combat"):
        after = a.with_cells(batch.correct(a, "batch", method, covariate="grp"))
        assert batch.batch_r2_summary(batch.batch_r2(after, "batch")).first()["mean"] < 0.1 * before
        logs = np.log2(back(after.cells, x.shape, names))
        effect = np.nanmean(logs[:20][:, g == "trt"], 1) - np.nanmean(logs[:20][:, g == "ctrl"], 1)
        assert effect.mean() == pytest.approx(1.2, abs=0.2)


def test_exact_presence(spark):
    assert hybrid.tail_values(10, 10, 10)[10] == pytest.approx(2 * 0.5**20)
    for n1, n2, c in ((4, 6, 5), (6, 4, 3), (3, 3, 0), (3, 3, 6)):
        p = c / (n1 + n2)
        pa = [math.comb(n1, i) * p**i * (1 - p) ** (n1 - i) for i in range(n1 + 1)]
        pb = [math.comb(n2, i) * p**i * (1 - p) ** (n2 - i) for i in range(n2 + 1)]
        for t in range(max(n1, n2) + 1):
            want = sum(pa[i] * pb[j] for i in range(n1 + 1) for j in range(n2 + 1) if abs(i - j) >= t)
            assert hybrid.tail_values(c, n1, n2)[t] == pytest.approx(want, abs=1e-14)


def test_hybrid(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = 2 ** rng.normal(20, 0.5, size=(120, 12))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:10, :6] = np.nan  # absent in group a
    x[10:30, 6:] *= 8  # higher in group b
    a = make(spark, x, meta={"g": ["a"] * 6 + ["b"] * 6})
    member = spark.createDataFrame([(i, f"p{i}" if i < 60 else f"p{60 + i // 4}") for i in range(120)], "feature_id long, group_id string")
    full, curve = hybrid.hybrid(a, member, "g", "a", "b", n_boot=200)
    rows = {r["group_id"]: r for r in full.collect()}
    assert all(rows[f"p{i}"]["sel_binary"] for i in range(10)) and sum(rows[f"p{i}"]["sel_intensity"] for i in range(10, 30)) >= 18
    assert all(r["sel_hybrid"] == (r["min_p"] <= max(x["min_p"] for x in rows.values() if x["sel_hybrid"])) for r in rows.values())
    assert all(0 <= r["fdr"] <= 1 and r["min_p"] == min(r["p_bin"], 1.0 if r["p_int"] is None else r["p_int"]) for r in rows.values())
    # the list FDR at a cutoff, recomputed group by group
    n_int = sum(r["p_int"] is not None for r in rows.values())
    pi0 = 2 * rows["p0"]["w_hybrid"] - rows["p0"]["w_bin"]
    probe = rows["p12"]["min_p"]

    def null(r):
        if r["pooled"] is None:
            return probe
        return next((t for t in hybrid.tail_values(r["pooled"], 6, 6) if t <= probe + 1e-15), hybrid.tail_values(r["pooled"], 6, 6)[-1])

    num = sum((r["w_bin"] + pi0) / 2 * (probe + (1 - probe) * null(r)) for r in rows.values())
    sel = sum(r["min_p"] <= probe for r in rows.values())
    assert rows["p12"]["fdr"] == pytest.approx(min(1, num / sel)) and n_int > 0
    cp = [r["cp"] for r in curve.orderBy("cp").collect()]
    assert cp[0] == pytest.approx(1e-6) and cp[-1] == 1.0
    # drawing a large group in pieces gives the same sums
    rows_ = hybrid.group_rows(hybrid.presence_counts(a, "g", "a", "b"), member.withColumn("group_id", F.lit("one")))
    whole = hybrid.bootstrap_test(rows_, 6, 6, 100).first()
    monkeypatch.setattr(hybrid, "CHUNK", 7)
    pieces = hybrid.bootstrap_test(rows_, 6, 6, 100).first()
    assert (whole["p"], whole["w"]) == (pieces["p"], pieces["w"]) and whole["statistic"] == pytest.approx(pieces["statistic"])


def test_saint_prior_and_bfdr(spark):
    rng = np.random.default_rng(11)
    lf, lt = rng.random(300) + 0.01, rng.random(300) * 1.5 + 0.01
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lf, lt)] + [(None, 1.0)], "lik_false double, lik_true double")
    beta, old = 0.0, np.log(lf / 2).sum()
    for _ in range(100):
        z = 2**beta * lt > lf
        grid = np.linspace(-2, 2, 400_001)
        like = z.sum() * grid * math.log(2) - 300 * np.log1p(2**grid)
        beta = grid[like.argmax()]
        new = like.max() + np.log(np.where(z, lt, lf)).sum()
        if new >= old and abs(new - old) < 0.01:
            break
        old = new
    fit = saint.fit_prior(df)
    assert fit["beta"] == pytest.approx(beta, abs=1e-4) and fit["cells"] == 300
    scores = spark.createDataFrame([("b", str(i), s) for i, s in enumerate([0.9, 0.9, 0.5, 0.0, 0.7, 0.5])], "bait string, prey string, avg_p double")
    got = {r["prey"]: r["bfdr"] for r in saint.bfdr(scores).collect()}
    assert got["0"] == got["1"] == 0 and got["3"] is None
    assert got["4"] == pytest.approx(0.1) and got["2"] == got["5"] == pytest.approx(1 - 2.5 / 3)


def test_gsea(spark):
    rng = np.random.default_rng(12)
    score = np.sort(rng.normal(size=200))[::-1]
    ranked = spark.createDataFrame([(f"g{i}", float(s)) for i, s in enumerate(score)], "symbol string, score double")
    sets = {"top": list(range(0, 40, 2)), "low": list(range(160, 200, 2)), "mix": list(range(5, 200, 10))}
    df = spark.createDataFrame([(k, f"G{i}") for k, v in sets.items() for i in v] + [("tiny", "g1")], "set_name string, symbol string")

    def es(pos):
        run, best, low = 0.0, 0.0, 0.0
        nr = sum(abs(score[p]) for p in pos)
        for i in range(200):
            run = run + abs(score[i]) / nr if i in set(pos) else run - 1 / (200 - len(pos))
            best, low = max(best, run), min(low, run)
        return best if best >= -low else low

    out = {r["set_name"]: r for r in enrich.gsea(df, ranked, n_perm=150).collect()}
    assert set(out) == set(sets)
    for name, pos in sets.items():
        assert out[name]["es"] == pytest.approx(es(pos))
    null = np.array([es(sorted(enrich._draw(42, 20, p, 200))) for p in range(150)])
    up, down = null[null >= 0].mean(), -null[null < 0].mean()
    norm = np.where(null >= 0, null / up, null / down)
    nes = {k: out[k]["es"] / (up if out[k]["es"] >= 0 else down) for k in sets}
    raw = {}
    for k in sets:
        assert out[k]["nes"] == pytest.approx(nes[k])
        e = out[k]["es"]
        same, more = ((null >= 0).sum(), (null >= e).sum()) if e >= 0 else ((null <= 0).sum(), (null <= e).sum())
        assert out[k]["p"] == pytest.approx((more + 1) / (same + 1))
        side = np.abs(norm[(null >= 0) == (e >= 0)])
        seen = np.array([abs(nes[j]) for j in sets if (nes[j] >= 0) == (e >= 0)])
        rate = ((side >= abs(nes[k]) - 1e-12).mean() + 1 / (450 + 1)) / (seen >= abs(nes[k]) - 1e-12).mean()
        raw[k] = min(1.0, rate)
    worst = 0.0
    for k in sorted(sets, key=lambda k: -abs(nes[k])):
        worst = max(worst, raw[k])
        assert out[k]["fdr"] == pytest.approx(worst)


def test_gsea_null(spark):
    """Any number of permutations, one null per size, seeded by size and number."""
    ranked = spark.createDataFrame([(f"g{i}", float(50 - i)) for i in range(100)], "symbol string, score double")
    placed = enrich.positions(ranked)
    sizes = spark.createDataFrame([(15,), (30,)], "size long")
    few = {(r["size"], r["perm"]): r["es"] for r in enrich.gsea_null(sizes, placed, 20).collect()}
    assert len(few) == 40
    more = {(r["size"], r["perm"]): r["es"] for r in enrich.gsea_null(sizes, placed, 120).collect()}
    assert len(more) == 240 and all(more[k] == pytest.approx(few[k]) for k in few)
    with pytest.raises(ValueError):
        enrich.gsea_null(sizes, placed, 0)


def test_sign_flip(spark):
    ranked = spark.createDataFrame([(f"G{i}", float(i - 60.5)) for i in range(122)], "symbol string, score double")
    sets = spark.createDataFrame([("a", f"g{i}") for i in range(90, 122, 2)], "set_name string, symbol string")
    es = [enrich.gsea_es(enrich.sized_hits(sets, p), p).first()["es"] for p in (enrich.positions(ranked), enrich.positions(ranked.withColumn("score", -F.col("score"))))]
    assert es[0] == pytest.approx(-es[1])


def test_strict_replicates(spark):
    x = np.array([[1.0, 1, 1, 1], [1, np.nan, 1, 1], [1, 1, np.nan, 1]])
    meta = {"b": ["p", "p", "q", "q"], "t": ["T1", "T2", "T1", "T3"]}
    a = make(spark, x, meta=meta)
    plain = back(filters.tech_repro(a, ["b"]).cells, x.shape, [f"s{j}" for j in range(4)])
    strict = back(filters.tech_repro(a, ["b"], strict="t").cells, x.shape, [f"s{j}" for j in range(4)])
    assert plain[1, 0] == 0 and plain[2, 3] == 0
    assert strict[1, 0] == 0 and strict[2, 3] == 1  # T1, T3 is no complete run


def test_leading_eigenpairs():
    """Against a full solution: clustered and negative spectra, low rank, and the zero matrix."""
    rng = np.random.default_rng(21)
    for n, values in ((60, rng.normal(size=60)), (200, np.r_[5, 4.999, 4.9, rng.random(197)]), (40, np.r_[3, 2, np.zeros(38)]), (30, -np.arange(30.0)), (12, np.zeros(12))):
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        a = q @ np.diag(values) @ q.T
        found = eigen.leading(lambda x: a @ x, n, 3)  # noqa: B023
        assert found.values == pytest.approx(np.sort(values)[::-1][:3], abs=1e-8)
        assert np.abs(a @ found.vectors - found.vectors * found.values).max() < 1e-7
        assert found.vectors.T @ found.vectors == pytest.approx(np.eye(3), abs=1e-9)


@pytest.mark.parametrize("size", [eigen.COLUMN_BYTES, 100])
def test_products(spark, monkeypatch, size):
    """Products put together by tasks, whole and column by column."""
    monkeypatch.setattr(eigen, "COLUMN_BYTES", size)
    monkeypatch.setattr(eigen, "PART", 7)
    monkeypatch.setattr(eigen, "DENSE", 50)
    rng = np.random.default_rng(22)
    x = np.where(rng.random((30, 20)) < 0.6, rng.normal(size=(30, 20)), 0)
    rows = spark.createDataFrame([([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r in x], "idx array<int>, x array<double>")
    q = rng.normal(size=(20, 4))
    assert eigen.gram(rows)(q) == pytest.approx(x.T @ x @ q)
    w = rng.random((20, 20))
    w = np.triu(w, 1) + np.triu(w, 1).T
    pairs = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(20) for j in range(i + 1, 20)], "i int, j int, w double")
    assert eigen.symmetric(pairs)(q) == pytest.approx(w @ q)
    j = np.eye(20) - 1 / 20
    assert eigen.centred(eigen.symmetric(pairs), -0.5)(q) == pytest.approx(-0.5 * j @ w @ j @ q)


def test_sample_pca_of_many_samples(spark):
    """30,000 samples: their matrix would hold 900 million numbers. The leading components satisfy A v = e v."""
    n, m = 30_000, 12
    cells = spark.range(n * m).select((F.col("id") % m).alias("feature_id"), F.concat(F.lit("s"), F.lpad((F.col("id") / m).cast("int").cast("string"), 6, "0")).alias("sample_id"), "id")
    u = lambda tag: F.pmod(F.xxhash64(F.lit(tag), "id"), F.lit(10_000)) / 10_000.0
    trend = F.sin(F.col("feature_id") * 1.7) * (F.pmod(F.xxhash64("sample_id"), F.lit(100)) / 20.0)
    cells = cells.withColumn("value", trend + u("a")).filter(u("b") < 0.9).select("feature_id", "sample_id", "value")
    a = Assay(cells, cells.select("sample_id").distinct())
    out = ordination.sample_pca(a, 2)
    pdf = cells.toPandas()
    codes, names = pdf["sample_id"].factorize(sort=True)
    x = np.zeros((m, len(names)))
    x[pdf["feature_id"], codes] = pdf["value"] - pdf.groupby("sample_id")["value"].transform("mean")
    want = np.linalg.svd(x, compute_uv=False) ** 2 / (m - 1)
    got = [r["eigenvalue"] for r in out.variance.orderBy("component").collect()]
    assert got == pytest.approx(want[:2])
    s = out.scores.toPandas().sort_values("sample_id")[["pc1", "pc2"]].to_numpy()
    assert (s * s).sum(0) == pytest.approx(got)
    assert np.abs(x.T @ (x @ s) / (m - 1) - s * got).max() < 1e-7
    assert out.variance.filter("component = 1").first()["share_total"] == pytest.approx(want[0] / want.sum())


def clumps(seed, items=300, dim=3):
    """Tight groups far apart, with copies and equal distances."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 40, size=(12, dim)).astype(float)
    v = centres[rng.integers(0, 12, items)] + rng.integers(0, 4, size=(items, dim)) / 4
    v[items // 2 : items // 2 + 40] = v[0]
    return v


@pytest.mark.parametrize("size", [500_000, 60])
def test_nearest_pruned(spark, monkeypatch, size):
    """Equals brute force with ties and copies; far blocks are not computed."""
    monkeypatch.setattr(blocks, "BLOCK_VALUES", size)
    v = clumps(31)
    d = distances(v)
    found = ordination.knn_search(points(spark, v), 5)
    got = {(r["item_id"], r["rank"]): (r["neighbor"], r["distance"]) for r in found.neighbors.collect()}
    for i in range(len(v)):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (round(d[i, j], 9), j))[:5]
        assert [got[i, r][0] for r in range(1, 6)] == order
        assert [got[i, r][1] for r in range(1, 6)] == pytest.approx([d[i, j] for j in order], abs=1e-9)
    assert found.computed <= found.pairs and (size > 60 or found.computed < 0.5 * found.pairs)
    monkeypatch.setattr(blocks, "BOUND_VALUES", 0)
    again = {(r["item_id"], r["rank"]): (r["neighbor"], r["distance"]) for r in ordination.knn_graph(points(spark, v), 5).collect()}
    assert {k: x[0] for k, x in again.items()} == {k: x[0] for k, x in got.items()}


def test_equal_vectors_are_fast():
    import time

    start = time.time()
    assert blocks.euclidean(np.ones((2000, 30)), np.ones((2000, 30))).max() == 0
    assert time.time() - start < 5


def test_spanning_tree_prunes(spark, monkeypatch):
    """The tree has the weights of a plain one; no round computes more than a part of the pairs of blocks."""
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 60)
    v = clumps(33, 250)
    d = distances(v)
    computed = []
    tree = cluster.spanning_tree(points(spark, v), computed).collect()
    inside, best = {0}, d[0].copy()
    total = []
    while len(inside) < len(v):
        j = min((x for x in range(len(v)) if x not in inside), key=lambda x: best[x])
        total.append(best[j])
        inside.add(j)
        best = np.minimum(best, d[j])
    assert sorted(r["distance"] for r in tree) == pytest.approx(sorted(total), abs=1e-9)
    assert sum(computed) < 0.5 * len(computed) * blocks.near_blocks(points(spark, v)).n_blocks ** 2


@pytest.mark.parametrize("mode", ["waves", "complete"])
def test_phospho_with_imputation(spark, mode):
    """Both matrices are imputed on the log scale, then every site meets its protein in the same sample."""
    from assaygrid.operators import phospho

    rng = np.random.default_rng(41)
    x, y = 2 ** rng.uniform(5, 12, (20, 5)), 2 ** rng.uniform(5, 12, (12, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    y[rng.random(y.shape) < 0.2] = np.nan
    x[:6], y[:5] = np.nan_to_num(x[:6], nan=100.0), np.nan_to_num(y[:5], nan=100.0)
    sites, total = make(spark, x), make(spark, y)
    sites = Assay(sites.cells, sites.samples, spark.createDataFrame([(i, f"p{i % 14};z") for i in range(20)], "feature_id long, proteins string"))
    total = Assay(total.cells, total.samples, spark.createDataFrame([(i, f"p{i}") for i in range(12)], "feature_id long, protein string"))
    names = [f"s{j}" for j in range(5)]
    logs = lambda a, m: make(spark, np.log2(m))
    a, b = (back(impute.knn(logs(n, m), k=3, rule="null", mode=mode), m.shape, names) for n, m in (("x", x), ("y", y)))
    got = back(phospho.normalise_to_total(sites, total, "proteins", "protein", knn=True, k=3, mode=mode), x.shape, names)
    want = np.stack([a[i] - (b[i % 14] if i % 14 < 12 else 0) for i in range(20)])
    assert not np.isnan(got).any() and got == pytest.approx(want)


def test_top_intersections_of_many_sets(spark):
    rng = np.random.default_rng(8)
    held = rng.random((400, 300)) < np.linspace(0.02, 0.4, 300)
    held[:60, 290:] = True
    rows = [(int(f), f"s{int(s):03d}") for f, s in zip(*np.nonzero(held))]
    present = spark.createDataFrame(rows, "feature_id int, sample_id string")
    names = [f"s{n:03d}" for n in range(300)]
    got = [(tuple(r.members), r.n) for r in sets.top_intersections(present, names, max_members=3, limit=500).collect()]
    sizes = [((n,), int(held[:, n].sum())) for n in range(300)]
    x = held.astype(np.int64)
    two = x.T @ x
    sizes += [((a, b), int(two[a, b])) for a, b in combinations(range(300), 2)]
    for a, b in combinations(range(300), 2):
        three = x[held[:, a] & held[:, b], b + 1 :].sum(0)
        sizes += [((a, b, b + 1 + c), int(n)) for c, n in enumerate(three) if n >= 60]
    want = sorted(sizes, key=lambda e: (-e[1], len(e[0]), e[0]))[:500]
    assert want[-1][1] >= 60 and max(len(c) for c, _ in want) == 3
    assert got == [(tuple(names[i] for i in c), n) for c, n in want]


@pytest.mark.parametrize("kernel", ["poisson", "gaussian"])
def test_gene_kernels_by_the_batch(spark, monkeypatch, kernel):
    """Genes of any size side by side have the log odds of their own values, and a batch takes few calls."""
    from assaygrid.functions import special
    from assaygrid.operators import gsva

    rng = np.random.default_rng(8)
    x = np.floor(np.exp(rng.uniform(0, 7, size=(400, 1))) * rng.uniform(0.5, 2, size=(400, 6)))
    x[5, 2] = -3.0
    pdf = pd.DataFrame({"feature_id": np.arange(400), "ids": [np.array(list("abcdef"))] * 400, "values": list(x)})
    calls = []
    monkeypatch.setattr(gsva, "_gamma_q_np", lambda *a: calls.append(1) or special._gamma_q_np(*a))
    monkeypatch.setattr(gsva, "PAIRS", 2000)
    got = pd.concat(gsva._log_odds(kernel)(iter([pdf, pdf.head(0)])))
    assert len(calls) <= 20
    assert set(got["feature_id"]) == set(range(400)) - ({5} if kernel == "poisson" else set())
    got = got.set_index(["feature_id", "sample_id"])["value"]
    for f in (0, 17, 399, int(np.argmax(x.max(axis=1)))):
        v = x[f]
        if kernel == "poisson":
            lt = [np.mean([math.exp(-(r + 0.5)) * sum(math.exp(i * math.log(r + 0.5) - math.lgamma(i + 1)) for i in range(int(k) + 1)) if r < 600 else
                           sum(math.exp(i * math.log(r + 0.5) - math.lgamma(i + 1) - (r + 0.5)) for i in range(int(k) + 1)) for r in v]) for k in v]
        else:
            lt = [np.mean([0.5 * (1 + math.erf((a - b) / (v.std(ddof=1) / 4) / math.sqrt(2))) for b in v]) for a in v]
        want = [-math.log((1 - p) / p) if 0 < p < 1 else math.inf for p in lt]
        assert [got[f, s] for s in "abcdef"] == pytest.approx(want, rel=1e-4, abs=1e-4)
