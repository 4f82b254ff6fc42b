"""Special functions, ranks, quantiles and adjustments against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.functions import special
from assaygrid.operators import multitest, quantiles, ranking
from assaygrid.operators.pairs import pair_sums, rank_sums, spearman


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    return row.asDict()


def lit(x):
    return F.lit(float(x))


def test_distributions(spark):
    got = one(
        spark,
        t1=special.t_two_sided(lit(1), lit(1)), t2=special.t_two_sided(lit(2), lit(2)), tinf=special.t_two_sided(lit(1.5), lit(math.inf)),
        f=special.f_upper(lit(3), lit(2), lit(10)), chi=special.chi2_upper(lit(4), lit(2)), po=special.poisson_cdf(lit(2), lit(3)),
        bi=special.binom_cdf(lit(3), lit(10), lit(0.4)), crit=special.t_critical(0.05, lit(10)), lg=special.lgamma(lit(0.3)),
        tri=special.trigamma(lit(1)), di=special.digamma(lit(1)), ph=special.norm_cdf(lit(-1.2)),
    )
    want = dict(
        t1=0.5, t2=1 - 2 / math.sqrt(6), tinf=math.erfc(1.5 / math.sqrt(2)), f=(1 + 2 * 3 / 10) ** -5, chi=math.exp(-2),
        po=math.exp(-3) * (1 + 3 + 4.5), bi=sum(math.comb(10, k) * 0.4**k * 0.6 ** (10 - k) for k in range(4)), crit=2.2281388519649385,
        lg=math.lgamma(0.3), tri=math.pi**2 / 6, di=-0.5772156649015329, ph=0.5 * math.erfc(1.2 / math.sqrt(2)),
    )
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-10), k


def test_edge_values(spark):
    got = one(
        spark, none=special.t_two_sided(F.lit(None).cast("double"), lit(3)), zero=special.t_two_sided(lit(0), lit(3)),
        p0=special.binom_pmf(lit(0), lit(5), lit(0)), p1=special.binom_pmf(lit(5), lit(5), lit(1)), out=special.binom_pmf(lit(6), lit(5), lit(0.5)),
    )
    assert got == {"none": None, "zero": 1.0, "p0": 1.0, "p1": 1.0, "out": 0.0}


def test_trigamma_inverse():
    for y in (0.2, 1.0, 7.5, 300.0):
        x = special._power_sum(y, 1, math.log)
        assert special.trigamma_inverse(x) == pytest.approx(y, rel=1e-7)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ranks_with_hot_ties(spark, parts):
    rng = np.random.default_rng(0)
    values = np.where(rng.random(600) < 0.4, 5.0, rng.integers(0, 50, 600))
    df = spark.createDataFrame([(int(i), float(v), "a" if i % 5 else "b") for i, v in enumerate(values)], "id long, v double, g string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        avg = {r["id"]: r["rank"] for r in ranking.average_ranks(df, "v", ["g"], 2).collect()}
        rows = ranking.ordered(df, [("v", False), ("id", True)], ["g"], 2).running("s", "sum", F.col("v")).running("lo", "min", F.col("v"), reverse=True).result().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in "ab":
        ids = [i for i in range(600) if ("a" if i % 5 else "b") == g]
        for i in ids:
            less, same = sum(values[j] < values[i] for j in ids), sum(values[j] == values[i] for j in ids)
            assert avg[i] == less + (same + 1) / 2
        order = sorted(ids, key=lambda i: (-values[i], i))
        cum = np.cumsum([values[i] for i in order])
        got = {r["id"]: r for r in rows if r["g"] == g}
        for k, i in enumerate(order):
            assert got[i]["s"] == pytest.approx(cum[k])
            assert got[i]["lo"] == min(values[j] for j in order[k:])


@pytest.mark.parametrize("whole", [20_000, 50])
def test_quantiles(spark, whole, monkeypatch):
    # a low threshold sends every group through the brackets
    monkeypatch.setattr(quantiles, "WHOLE", whole)
    rng = np.random.default_rng(1)
    data = {"a": np.round(rng.normal(size=3000), 2), "b": np.repeat(7.0, 500), "c": rng.random(61)}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None)], "g string, x double")
    rows = quantiles.group_quantiles(df, ["g"], "x", {"q1": 0.25, "m": 0.5, "q9": 0.9}, 3).collect()
    assert {r["g"] for r in rows} == set(data)
    for r in rows:
        assert r["n"] == len(data[r["g"]])
        for name, p in (("q1", 0.25), ("m", 0.5), ("q9", 0.9)):
            assert r[name] == pytest.approx(np.quantile(data[r["g"]], p), abs=1e-12)
    every = np.concatenate(list(data.values()))
    total = quantiles.group_quantiles(df, [], "x", {"m": 0.5}, 1).first()
    assert total["m"] == pytest.approx(np.median(every))


def test_adjustments(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(120) ** 3, np.ones(60)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(999, None)], "id int, p double")
    order = np.argsort(p)
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    got = {r["id"]: r["p_adj"] for r in multitest.benjamini_hochberg(df).collect()}
    assert got[999] is None
    assert [got[i] for i in range(len(p))] == pytest.approx(list(want))
    pi0, curve = multitest.pi0_smoother(df)
    assert 0 <= pi0 <= 1 and len(curve) == 20
    q = {r["id"]: r["q"] for r in multitest.storey(df).collect()}
    assert [q[i] for i in range(len(p))] == pytest.approx(list(np.minimum(1, want * 0 + np.minimum.accumulate((pi0 * raw)[::-1])[::-1][np.argsort(order)])))


def test_smoother_limits():
    x = np.linspace(0, 0.95, 20)
    line = 2 - x
    assert multitest._smooth(x, line, 3.0) == pytest.approx(line, abs=1e-8)
    wave = np.sin(6 * x)
    assert np.abs(multitest._smooth(x, wave, 19.9) - wave).max() < 0.05


@pytest.mark.parametrize("block", [512, 4])
def test_pair_sums(spark, block, monkeypatch):
    from assaygrid.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 11))
    x[rng.random(x.shape) < 0.3] = np.nan
    rows = [(int(f), int(s), float(x[f, s])) for f, s in zip(*np.nonzero(~np.isnan(x)))]
    df = spark.createDataFrame(rows, "f int, idx int, value double")
    got = {(r["i"], r["j"]): r for r in pairs.pair_sums(df, "f", 11, extra=True).collect()}
    assert len(got) == 66
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        want = [both.sum(), a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum(), np.abs(a - b).sum(), np.minimum(a, b).sum()]
        assert [r[c] for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "sabs", "smin")] == pytest.approx(want)


def test_spearman(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, size=(50, 5)).astype(float)
    x[rng.random(x.shape) < 0.25] = np.nan
    rows = [(int(f), int(s), float(x[f, s])) for f, s in zip(*np.nonzero(~np.isnan(x)))]
    df = spark.createDataFrame(rows, "f int, idx int, value double")
    out = rank_sums(df, "f", 5).withColumn("r", spearman(*[F.col(c) for c in ("n", "cross", "square_i", "square_j")])).collect()
    assert len(out) == 10

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    for r in out:
        both = ~np.isnan(x[:, r["i"]]) & ~np.isnan(x[:, r["j"]])
        want = np.corrcoef(ranks(x[both, r["i"]]), ranks(x[both, r["j"]]))[0, 1]
        assert r["r"] == pytest.approx(want)


def test_spearman_in_parts(spark, monkeypatch):
    """Parts of a bounded size, though most values of an item are equal; an item may come twice in a key, and a key may be null."""
    from assaygrid.operators import pairs

    monkeypatch.setattr(pairs, "SECTION", 700)
    rng = np.random.default_rng(5)
    x = np.where(rng.random((300, 70)) < 0.6, 2.0, rng.integers(0, 5, size=(300, 70)).astype(float))
    x[rng.random(x.shape) < 0.8] = np.nan
    at = list(zip(*np.nonzero(~np.isnan(x))))
    rows = [(None if f == 7 else int(f), int(s), float(x[f, s])) for f, s in at]
    df = spark.createDataFrame(rows, "f int, idx int, value double")
    stored, longest = [], pairs.materialize
    monkeypatch.setattr(pairs, "materialize", lambda d: stored.append(longest(d)) or stored[-1])
    got = {(r["i"], r["j"]): r["r"] for r in rank_sums(df, "f", 70).withColumn("r", spearman(*[F.col(c) for c in ("n", "cross", "square_i", "square_j")])).collect()}
    sizes = [r["count"] for r in stored[-1].groupBy(pairs.PART).count().collect()]
    assert len(sizes) > 100 and max(sizes) < 200

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = ranks(x[both, i]), ranks(x[both, j])
        assert (r is None) == (a.std() == 0 or b.std() == 0)
        if r is not None:
            assert r == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert len(got) == sum(1 for i in range(70) for j in range(i) if (~np.isnan(x[:, i]) & ~np.isnan(x[:, j])).any())
    twice = rank_sums(df.filter("idx < 4").unionByName(df.filter("idx < 4")), "f", 4).collect()
    assert {(r["i"], r["j"]): r["n"] for r in twice} == {(i, j): (~np.isnan(x[:, i]) & ~np.isnan(x[:, j])).sum() for i in range(4) for j in range(i + 1, 4)}


@pytest.mark.parametrize("n", [19_999, 20_000, 20_001, 20_050])
def test_quantiles_at_the_border(spark, n):
    """Groups on either side of the bracket's border have the quantiles of the sorted values."""
    from assaygrid.operators.quantiles import WHOLE, group_quantiles

    assert abs(n - WHOLE) <= 50
    rows = spark.range(n).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(50_000)) / 7.0).alias("v"))
    got = group_quantiles(rows, ["g"], "v", {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.999}, 1).first()
    values = np.array([r[0] for r in rows.select("v").collect()])
    assert got["n"] == n
    assert [got[c] for c in "abcd"] == pytest.approx(list(np.quantile(values, [0.001, 0.25, 0.5, 0.999])), abs=1e-12)


@pytest.mark.parametrize("kind", ["spaced", "ties", "skewed"])
def test_quantiles_in_rounds(spark, monkeypatch, kind):
    """Brackets that hold more than a task may order are split again; nothing is lost with ties and skew."""
    monkeypatch.setattr(quantiles, "WHOLE", 50)
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    value = {"spaced": F.col("id") * 1.0, "ties": F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") % 11) * 1.0), "skewed": F.exp((F.col("id") % 9973) / 20.0)}[kind]
    n = 1_000_000 if kind == "spaced" else 60_000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), value.alias("v"))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9137, "e": 1.0}
    got = {r["g"]: r for r in quantiles.group_quantiles(df, ["g"], "v", probs, 2).collect()}
    x = df.toPandas()
    for g in (0, 1):
        want = np.quantile(x["v"][x["g"] == g], list(probs.values()))
        assert [got[g][p] for p in probs] == pytest.approx(list(want)) and got[g]["n"] == (x["g"] == g).sum()
    whole = quantiles.group_quantiles(df, [], "v", {"m": 0.3}, 1).first()
    assert whole["m"] == pytest.approx(np.quantile(x["v"], 0.3)) and whole["n"] == n
    lower = quantiles.group_quantiles(df, [], "v", {"m": 0.3}, 1, interpolate=False).first()
    assert lower["m"] == np.quantile(x["v"], 0.3, method="lower")
