"""Queries over bait-prey scoring and the combined presence and intensity test."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.model import Assay
from assaygrid.operators import enrich, hybrid, saint
from assaygrid.plans.bind import CELLS, DENSE, R, SAMPLES, Catalog, assay, part_features, rnd, samples
from assaygrid.plans.diff import t_tail
from assaygrid.runtime import materialize

catalog = Catalog()
add = catalog.add


def bait_assay(spark, sf):
    """AFRICA holds the controls, every other region is a bait; brand and size name a prey."""
    a = assay(spark, sf)
    s = saint.assign_status(a.samples, col="grp", control="AFRICA", bait="grp")
    prey = F.concat_ws("-", "brand", (F.col("size") % 20).cast("string"))
    return Assay(a.cells, s, part_features(spark, sf).select("feature_id", prey.alias("prey")))


BASE = f"""WITH {CELLS}, {SAMPLES}, {DENSE}, st AS (SELECT sample_id, grp AS bait, CASE WHEN grp = 'AFRICA' THEN 'C' ELSE 'T' END AS status FROM samples),
f AS (SELECT p_partkey AS feature_id, p_brand || '-' || (p_size % 20) AS prey FROM part),
ctl AS (SELECT feature_id, prey, sample_id, value FROM dense JOIN st USING (sample_id) JOIN f USING (feature_id) WHERE status = 'C'),
imp AS (SELECT *, coalesce(value, 0.9 * min(value) OVER (PARTITION BY prey, sample_id), 0.9 * min(value) OVER (PARTITION BY prey), min(value) OVER ()) AS v FROM ctl)"""
STATS = """c0 AS (SELECT feature_id, avg(log2(v)) AS mean, coalesce(stddev_samp(log2(v)), 0) AS sd FROM imp GROUP BY 1),
cs AS (SELECT feature_id, mean, greatest(sd, (SELECT median(sd) FROM c0 WHERE sd > 1e-10)) AS sd FROM c0),
tst AS (SELECT feature_id, sample_id, bait, prey, log2(value) AS x FROM cells JOIN st USING (sample_id) JOIN f USING (feature_id) WHERE status = 'T' AND log2(value) <> 0),
t0 AS (SELECT feature_id, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS sd FROM tst GROUP BY 1),
ts AS (SELECT feature_id, mean, greatest(sd, (SELECT median(sd) FROM t0 WHERE sd > 0)) AS sd FROM t0),
par AS (SELECT tst.*, cs.mean AS mf, cs.sd AS sf, cs.mean + greatest(ts.mean - cs.mean, 2) AS mt, ts.sd AS st FROM tst JOIN cs USING (feature_id) JOIN ts USING (feature_id)),
lik AS (SELECT feature_id, sample_id, bait, prey, 2 ** (-least(((greatest(x, mf) - mf) / sf) ** 2 / 2, 32)) / sf AS lf, 2 ** (-least(((least(x, mt) - mt) / st) ** 2 / 2, 32)) / st AS lt FROM par)"""
SCORES = """rep AS (SELECT bait, prey, sample_id, avg(1.5 * lt / (1.5 * lt + lf)) AS s FROM lik GROUP BY 1, 2, 3), nr AS (SELECT bait, count(*) AS n_rep FROM st WHERE status = 'T' GROUP BY 1),
sc AS (SELECT bait, prey, n_rep, floor(sum(s) / n_rep * 10000 + 0.5) / 10000 AS avg_p FROM rep JOIN nr USING (bait) GROUP BY 1, 2, 3),
bf AS (SELECT *, CASE WHEN avg_p <> 0 THEN greatest(0, coalesce(1 - (SELECT sum(round(b.avg_p * 10000)::BIGINT)::DOUBLE / (count(*) * 10000) FROM sc b WHERE b.avg_p > sc.avg_p), 0)) END AS bfdr FROM sc)"""
BETA = 0.4054651081081644  # log 1.5


@add("saint_status", f"{BASE} SELECT sample_id, status, bait FROM st")
def status(spark, sf):
    return bait_assay(spark, sf).samples.select("sample_id", "status", "bait")


@add("saint_control_scale", f"{BASE} SELECT {R('avg(value) FILTER (WHERE status = ' + chr(39) + 'T' + chr(39) + ') / avg(value) FILTER (WHERE status = ' + chr(39) + 'C' + chr(39) + ')', 9)} AS factor FROM cells JOIN st USING (sample_id)")
def control_scale(spark, sf):
    return saint.control_scale(bait_assay(spark, sf)).withColumn("factor", rnd(F.col("factor"), 9))


@add("saint_impute_controls", f"{BASE} SELECT feature_id, sample_id, {R('v', 4)} AS value FROM imp")
def impute_controls(spark, sf):
    return saint.impute_controls(bait_assay(spark, sf)).select("feature_id", "sample_id", rnd(F.col("value"), 4).alias("value"))


@add("saint_control_stats", f"{BASE}, {STATS} SELECT feature_id, {R('mean')} AS mean, {R('sd')} AS sd FROM cs")
def control_stats(spark, sf):
    out = saint.control_stats(saint.impute_controls(bait_assay(spark, sf)))
    return out.select("feature_id", rnd(F.col("mean")).alias("mean"), rnd(F.col("sd")).alias("sd"))


@add("saint_test_stats", f"{BASE}, {STATS} SELECT feature_id, {R('mean')} AS mean, {R('sd')} AS sd FROM ts")
def test_stats(spark, sf):
    out = saint.test_stats(saint.test_cells(bait_assay(spark, sf)))
    return out.select("feature_id", rnd(F.col("mean")).alias("mean"), rnd(F.col("sd")).alias("sd"))


def _lik(spark, sf):
    a = bait_assay(spark, sf)
    a = a.with_cells(materialize(a.cells))
    tests = materialize(saint.test_cells(a))
    return a, saint.likelihoods(tests, saint.control_stats(saint.impute_controls(a)), saint.test_stats(tests))


@add("saint_likelihoods", f"{BASE}, {STATS} SELECT feature_id, sample_id, {R('lf')} AS lik_false, {R('lt')} AS lik_true FROM lik")
def likelihoods(spark, sf):
    _, lik = _lik(spark, sf)
    return lik.select("feature_id", "sample_id", rnd(F.col("lik_false")).alias("lik_false"), rnd(F.col("lik_true")).alias("lik_true"))


@add("saint_fit_prior")
def fit_prior(spark, sf):
    fit = saint.fit_prior(materialize(_lik(spark, sf)[1]))
    return spark.createDataFrame([(fit["beta"], fit["cells"])], "beta double, cells long")


@add("saint_avg_p", f"{BASE}, {STATS}, {SCORES} SELECT bait, prey, n_rep, avg_p FROM sc")
def avg_p(spark, sf):
    a, lik = _lik(spark, sf)
    return saint.avg_p(lik, a.samples, BETA)


@add("saint_bfdr", f"{BASE}, {STATS}, {SCORES} SELECT bait, prey, avg_p, bfdr, CASE WHEN bfdr <= 0.01 AND avg_p >= 0.8 THEN 'high' WHEN bfdr <= 0.05 AND avg_p >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM bf")
def bfdr(spark, sf):
    a, lik = _lik(spark, sf)
    out = saint.confidence(saint.bfdr(saint.avg_p(lik, a.samples, BETA)))
    return out.select("bait", "prey", "avg_p", "bfdr", "confidence")


@add("saint_full")
def full(spark, sf):
    return saint.saint(bait_assay(spark, sf), normalise=True)


@add(
    "saint_protein_log10",
    f"{BASE}, r AS (SELECT feature_id, sum(log10(value)) AS s FROM cells GROUP BY 1) SELECT prey, {R('sum(s) / (count(*) * (SELECT count(*) FROM samples))')} AS log10_mean FROM r JOIN f USING (feature_id) GROUP BY 1",
)
def protein_log10(spark, sf):
    return saint.protein_log10(bait_assay(spark, sf)).withColumn("log10_mean", rnd(F.col("log10_mean")))


@add(
    "saint_bait_log2fc",
    f"""{BASE}, lg AS (SELECT feature_id, sample_id, coalesce(log2(value), 0) AS x FROM dense),
c AS (SELECT feature_id, list_avg(list_reverse_sort(list(x))[1:3]) AS c FROM lg JOIN st USING (sample_id) WHERE status = 'C' GROUP BY 1),
t AS (SELECT feature_id, bait, avg(x) AS t FROM lg JOIN st USING (sample_id) WHERE status = 'T' GROUP BY 1, 2)
SELECT bait, prey, {R('avg(t - c)')} AS log2fc FROM t JOIN c USING (feature_id) JOIN f USING (feature_id) GROUP BY 1, 2""",
)
def bait_log2fc(spark, sf):
    return saint.bait_log2fc(bait_assay(spark, sf), top=3).withColumn("log2fc", rnd(F.col("log2fc")))


@add(
    "saint_network",
    f"""{BASE}, {STATS}, {SCORES}, e AS (SELECT bait, prey, bfdr FROM bf WHERE bfdr <= 0.5 AND avg_p >= 0.3), x AS (SELECT bait AS id, bfdr, true AS b, false AS p FROM e UNION ALL SELECT prey, bfdr, false, true FROM e),
r AS (SELECT feature_id, sum(log10(value)) AS s FROM cells GROUP BY 1), ex AS (SELECT prey AS id, sum(s) / (count(*) * (SELECT count(*) FROM samples)) AS m FROM r JOIN f USING (feature_id) GROUP BY 1)
SELECT id, min(bfdr) AS min_bfdr, bool_or(b) AS is_bait, bool_or(p) AS is_prey, {R('any_value(m)')} AS expression FROM x LEFT JOIN ex USING (id) GROUP BY 1""",
)
def network(spark, sf):
    a, lik = _lik(spark, sf)
    _, nodes = saint.network(saint.bfdr(saint.avg_p(lik, a.samples, BETA)), saint.protein_log10(a), 0.5, 0.3)
    return nodes.select("id", "min_bfdr", "is_bait", "is_prey", rnd(F.col("expression")).alias("expression"))


# ---- presence and intensity --------------------------------------------------------

A, B = "AFRICA", "EUROPE"


def membership(spark, sf):
    group = F.concat_ws("-", "brand", F.col("size").cast("string"))
    return part_features(spark, sf).select("feature_id", group.alias("group_id"))


HYB = f"""WITH {CELLS}, {SAMPLES}, mem AS (SELECT p_partkey AS feature_id, p_brand || '-' || p_size AS group_id FROM part),
ns AS (SELECT count(*) FILTER (WHERE grp = 'AFRICA') AS n1, count(*) FILTER (WHERE grp = 'EUROPE') AS n2 FROM samples),
y AS (SELECT feature_id, count(*) FILTER (WHERE grp = 'AFRICA') AS y1, count(*) FILTER (WHERE grp = 'EUROPE') AS y2 FROM cells JOIN samples USING (sample_id) WHERE value > 0 GROUP BY 1)"""
PMF = "CASE WHEN {p} <= 0 THEN ({k} = 0)::INT WHEN {p} >= 1 THEN ({k} = {n})::INT ELSE gamma({n} + 1) / (gamma({k} + 1) * gamma({n} - {k} + 1)) * {p} ** {k} * (1 - {p}) ** ({n} - {k}) END"


def pmf(k: str, n: str, p: str) -> str:
    return "(" + PMF.format(k=k, n=n, p=p) + ")"


# distribution of |i - j| under the pooled rate, for every pooled count
EXACT = f"""nulls AS (SELECT c, abs(i - j) AS t, sum({pmf('i', 'n1', '(c / (n1 + n2))')} * {pmf('j', 'n2', '(c / (n1 + n2))')}) AS mass
  FROM ns, range(0, 200) a(c), range(0, 200) b(i), range(0, 200) d(j) WHERE c <= n1 + n2 AND i <= n1 AND j <= n2 GROUP BY 1, 2),
tails AS (SELECT c, t, sum(mass) OVER (PARTITION BY c ORDER BY t DESC) AS tail FROM nulls)"""


@add("hybrid_presence_counts", f"{HYB} SELECT * FROM y")
def presence_counts(spark, sf):
    return hybrid.presence_counts(assay(spark, sf), "grp", A, B)


@add(
    "hybrid_exact_test",
    f"""{HYB}, {EXACT}, e AS (SELECT feature_id, y1, y2, abs(y1 - y2) AS statistic, tail AS p, {pmf('y1', 'n1', '((y1 + y2) / (n1 + n2))')} * {pmf('y2', 'n2', '((y1 + y2) / (n1 + n2))')} AS pmf0,
  {pmf('y1', 'n1', '(y1 / n1)')} * {pmf('y2', 'n2', '(y2 / n2)')} AS pmf1, y1 * n2 = y2 * n1 AS same FROM y, ns JOIN tails ON c = y1 + y2 AND t = abs(y1 - y2))
SELECT feature_id, statistic, {R('p', 10)} AS p, {R('pmf0', 10)} AS pmf0, {R('pmf1', 10)} AS pmf1, CASE WHEN same OR pmf0 >= pmf1 THEN 1 ELSE 0 END AS w FROM e""",
)
def exact_test(spark, sf):
    a = assay(spark, sf)
    n1, n2 = hybrid.group_sizes(a, "grp", A, B)
    out = hybrid.exact_presence_test(hybrid.presence_counts(a, "grp", A, B), n1, n2)
    return out.select("feature_id", "statistic", *[rnd(F.col(c), 10).alias(c) for c in ("p", "pmf0", "pmf1")], "w")


@add(
    "hybrid_largest_tail",
    f"{HYB}, {EXACT} SELECT feature_id, {R('coalesce(max(tail) FILTER (WHERE tail <= 0.2 + 1e-15), min(tail))')} AS f0 FROM y JOIN tails ON c = y1 + y2 GROUP BY 1",
)
def largest_tail(spark, sf):
    a = assay(spark, sf)
    n1, n2 = hybrid.group_sizes(a, "grp", A, B)
    counts = hybrid.presence_counts(a, "grp", A, B).withColumn("pooled", F.col("y1") + F.col("y2"))
    tails = hybrid.exact_tails(spark, n1, n2)
    return counts.join(tails, "pooled").select("feature_id", rnd(hybrid.largest_tail(F.col("tails"), F.lit(0.2))).alias("f0"))


GROUPS = """g AS (SELECT feature_id, group_id, y1, y2, count(*) OVER w AS m, sum(y1 + y2) OVER w AS total FROM y JOIN mem USING (feature_id) WINDOW w AS (PARTITION BY group_id))"""


@add(
    "hybrid_group_statistic",
    f"""{HYB}, {GROUPS} SELECT group_id, count(*) AS m, sum(y1)::BIGINT AS y1, sum(y2)::BIGINT AS y2, {R('sum(CASE WHEN total > 0 THEN (y1 + y2) / total ELSE 1 / m END * (y1 - y2))')} AS statistic FROM g GROUP BY 1""",
)
def group_statistic(spark, sf):
    rows = hybrid.group_rows(hybrid.presence_counts(assay(spark, sf), "grp", A, B), membership(spark, sf))
    return hybrid.group_statistic(rows).withColumn("statistic", rnd(F.col("statistic")))


@add(
    "hybrid_structured_model",
    f"""{HYB}, {GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY y1 + y2 DESC, feature_id) AS rn FROM g),
l AS (SELECT group_id, avg(y1 / n1) AS p1, avg(y2 / n2) AS p2 FROM r, ns WHERE rn <= greatest(1, ceil(0.1 * m)) GROUP BY 1)
SELECT feature_id, {R('p1')} AS p1, {R('p2')} AS p2, {R('0.5 * (CASE WHEN p1 > 0 THEN y1 / n1 / p1 ELSE (y1 > 0)::INT END + CASE WHEN p2 > 0 THEN y2 / n2 / p2 ELSE (y2 > 0)::INT END)')} AS d FROM g JOIN l USING (group_id), ns""",
)
def structured_model(spark, sf):
    a = assay(spark, sf)
    n1, n2 = hybrid.group_sizes(a, "grp", A, B)
    rows = hybrid.group_rows(hybrid.presence_counts(a, "grp", A, B), membership(spark, sf))
    out = hybrid.structured_model(rows, n1, n2)
    return out.select("feature_id", *[rnd(F.col(c)).alias(c) for c in ("p1", "p2", "d")])


@add("hybrid_bootstrap")
def bootstrap(spark, sf):
    a = assay(spark, sf)
    n1, n2 = hybrid.group_sizes(a, "grp", A, B)
    rows = hybrid.group_rows(hybrid.presence_counts(a, "grp", A, B), membership(spark, sf))
    return hybrid.bootstrap_test(rows.filter("m > 1"), n1, n2, 500)


INT = f"""{HYB}, gm AS (SELECT group_id, sample_id, grp, avg(log2(value)) AS x FROM cells JOIN mem USING (feature_id) JOIN samples USING (sample_id) WHERE grp IN ('AFRICA', 'EUROPE') GROUP BY 1, 2, 3),
mo AS (SELECT group_id, count(*) FILTER (WHERE grp = 'AFRICA') AS n1, avg(x) FILTER (WHERE grp = 'AFRICA') AS m1, var_samp(x) FILTER (WHERE grp = 'AFRICA') AS v1,
  count(*) FILTER (WHERE grp = 'EUROPE') AS n2, avg(x) FILTER (WHERE grp = 'EUROPE') AS m2, var_samp(x) FILTER (WHERE grp = 'EUROPE') AS v2 FROM gm GROUP BY 1),
w AS (SELECT group_id, m1 - m2 AS fc, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS df FROM mo WHERE n1 >= 2 AND n2 >= 2)"""


@add("hybrid_intensity_welch", f"{INT} SELECT group_id, {R('fc')} AS log2fc, {R('t', 5)} AS t, {R('df', 5)} AS df, {R(t_tail('t', 'df'))} AS p_int FROM w")
def intensity_welch(spark, sf):
    out = hybrid.intensity_stage(assay(spark, sf), membership(spark, sf), "grp", A, B, test="welch")
    return out.select("group_id", rnd(F.col("log2fc")).alias("log2fc"), rnd(F.col("t"), 5).alias("t"), rnd(F.col("df"), 5).alias("df"), rnd(F.col("p_int")).alias("p_int"))


@add(
    "enrich_rank_from_hybrid",
    f"""{INT}, r AS (SELECT group_id, fc, {t_tail('t', 'df')} AS p FROM w) SELECT group_id AS symbol, {R('-log10(greatest(p, 1e-300)) * sign(fc)', 4)} AS score FROM r WHERE p > 0""",
)
def rank_from_hybrid(spark, sf):
    out = hybrid.intensity_stage(assay(spark, sf), membership(spark, sf), "grp", A, B, test="welch")
    result = out.withColumn("p_bin", F.lit(1.0)).withColumn("statistic", F.lit(0.0)).withColumn("fdr", F.lit(1.0)).withColumn("group_id", F.concat("group_id", F.lit(";other")))
    ranked = enrich.rank_from_hybrid(result.filter("p_int > 0"), "signed_p")
    return ranked.withColumn("score", rnd(F.col("score"), 4))


@add(
    "hybrid_intensity_centred",
    f"""{HYB}, l AS (SELECT feature_id, sample_id, grp, log2(value) AS x FROM cells JOIN samples USING (sample_id) WHERE grp IN ('AFRICA', 'EUROPE')),
sh AS (SELECT feature_id FROM l GROUP BY 1 HAVING count(DISTINCT grp) = 2), ce AS (SELECT sample_id, median(x) AS c FROM l WHERE feature_id IN (FROM sh) GROUP BY 1),
gm AS (SELECT group_id, sample_id, grp, avg(x - c) AS x FROM l JOIN ce USING (sample_id) JOIN mem USING (feature_id) GROUP BY 1, 2, 3)
SELECT group_id, count(*) FILTER (WHERE grp = 'AFRICA') AS n1, {R("avg(x) FILTER (WHERE grp = 'AFRICA')")} AS m1, count(*) FILTER (WHERE grp = 'EUROPE') AS n2, {R("avg(x) FILTER (WHERE grp = 'EUROPE')")} AS m2
FROM gm GROUP BY 1 HAVING n1 >= 2 AND n2 >= 2""",
)
def intensity_centred(spark, sf):
    out = hybrid.intensity_moments(assay(spark, sf), membership(spark, sf), "grp", A, B, centring=True)
    return out.select("group_id", "n1", rnd(F.col("m1")).alias("m1"), "n2", rnd(F.col("m2")).alias("m2"))


@add(
    "hybrid_intensity_imputed",
    f"""{HYB}, {DENSE}, l AS (SELECT feature_id, sample_id, grp, log2(value) AS x FROM dense JOIN samples USING (sample_id) WHERE grp IN ('AFRICA', 'EUROPE')),
lo AS (SELECT feature_id, min(x) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lo FROM l GROUP BY 1 HAVING count(x) > 0),
gm AS (SELECT group_id, sample_id, grp, avg(coalesce(x, lo)) AS x FROM l JOIN lo USING (feature_id) JOIN mem USING (feature_id) GROUP BY 1, 2, 3)
SELECT group_id, {R("avg(x) FILTER (WHERE grp = 'AFRICA')")} AS m1, {R("avg(x) FILTER (WHERE grp = 'EUROPE')")} AS m2, {R("var_samp(x) FILTER (WHERE grp = 'AFRICA')")} AS v1 FROM gm GROUP BY 1""",
)
def intensity_imputed(spark, sf):
    out = hybrid.intensity_moments(assay(spark, sf), membership(spark, sf), "grp", A, B, impute=True)
    return out.select("group_id", *[rnd(F.col(c)).alias(c) for c in ("m1", "m2", "v1")])


@add("hybrid_pi0_grid", f"{INT}, pv AS (SELECT {t_tail('t', 'df')} AS p FROM w), g AS (SELECT DISTINCT l FROM (SELECT i / 100 AS l FROM range(1, 100) t(i) UNION ALL SELECT i / 1000 FROM range(99, 1000, 10) t(i))), c AS (SELECT l, count(*) FILTER (WHERE p > l) / (count(*) * (1 - l)) AS y FROM pv, g GROUP BY l), tl AS (SELECT *, row_number() OVER (ORDER BY l) AS rn FROM c QUALIFY rn > floor(0.75 * count(*) OVER ())), u AS (SELECT l - 1 AS x, y FROM tl), m AS (SELECT count(*) AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x**3) AS s3, sum(x**4) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM u) SELECT round(least(1, greatest(0, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)))), 4) AS pi0 FROM m")
def pi0(spark, sf):
    out = hybrid.intensity_stage(assay(spark, sf), membership(spark, sf), "grp", A, B, test="welch")
    return spark.createDataFrame([(hybrid.pi0_quadratic(out, "p_int"),)], "pi0 double").withColumn("pi0", F.round("pi0", 4))


@add("hybrid_group_sample_mean", f"{HYB} SELECT group_id, sample_id, {R('avg(value)', 4)} AS value FROM cells JOIN mem USING (feature_id) GROUP BY 1, 2")
def group_sample_mean(spark, sf):
    return hybrid.group_sample_mean(assay(spark, sf), membership(spark, sf)).withColumn("value", rnd(F.col("value"), 4))


@add("hybrid_full")
def full(spark, sf):
    return hybrid.hybrid(assay(spark, sf), membership(spark, sf), "grp", A, B, n_boot=300)[0]


@add("hybrid_curves")
def curves(spark, sf):
    return hybrid.hybrid(assay(spark, sf), membership(spark, sf), "grp", A, B, n_boot=300, test="welch")[1]


# a stand-in for a finished result: counts and p-values derived from parts
RESULT = """res AS (SELECT p_partkey AS group_id, (p_size % 6)::BIGINT AS y1, (p_partkey % 5)::BIGINT AS y2, p_retailprice / 2000 AS p_bin, CASE WHEN p_size % 3 > 0 THEN (p_size + 1) / 60 END AS p_int,
  CASE WHEN p_size % 4 > 0 THEN (p_size - 25) / 10 END AS log2fc FROM part)"""


def _result(spark, sf):
    size, key = F.col("size"), F.col("feature_id")
    return part_features(spark, sf).select(
        key.alias("group_id"), (size % 6).cast("bigint").alias("y1"), (key % 5).alias("y2"), (F.col("price") / 2000).alias("p_bin"),
        F.when(size % 3 > 0, (size + 1) / 60).alias("p_int"), F.when(size % 4 > 0, (size - 25) / 10).alias("log2fc"),
    )


@add(
    "hybrid_points",
    f"""WITH {RESULT} SELECT group_id, {R('log2fc')} AS fc, {R('log2((y1 + 1) / (y2 + 1))')} AS presence_ratio, {R('y1 / 6 - y2 / 5')} AS delta_presence, {R('-log10(least(p_bin, coalesce(p_int, 1)))')} AS y FROM res""",
)
def points(spark, sf):
    out = hybrid.hybrid_points(_result(spark, sf), 6, 5)
    return out.select("group_id", *[rnd(F.col(c)).alias(c) for c in ("fc", "presence_ratio", "delta_presence", "y")])


@add(
    "hybrid_one_state",
    f"""WITH {RESULT}, o AS (SELECT CASE WHEN y1 > y2 THEN 1 ELSE -1 END * log2(greatest(y1, y2) + 1) AS x, log2fc AS y FROM res WHERE ((y1 > 0 AND y2 = 0) OR (y1 = 0 AND y2 > 0)) AND log2fc IS NOT NULL),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM o)
SELECT count(*) AS n, {R('corr(x, y)')} AS pearson, {R('corr(rx, ry)')} AS spearman FROM r""",
)
def one_state(spark, sf):
    out = hybrid.one_state(_result(spark, sf))
    return out.select("n", rnd(F.col("pearson")).alias("pearson"), rnd(F.col("spearman")).alias("spearman"))


@add("hybrid_operating_point", "WITH c AS (SELECT p_retailprice AS cp, p_size / 50 AS fdr, p_partkey AS sel FROM part) SELECT max(cp) AS cp, arg_max(fdr, (cp, fdr, sel)) AS fdr, arg_max(sel, (cp, fdr, sel)) AS sel FROM c WHERE fdr <= 0.2")
def operating_point(spark, sf):
    curve = part_features(spark, sf).select(F.col("price").alias("cp"), (F.col("size") / 50).alias("fdr"), F.col("feature_id").alias("sel"))
    return hybrid.operating_point(curve, "fdr", "sel", 0.2)


@add("hybrid_swap_groups", f"WITH {SAMPLES} SELECT sample_id, CASE grp WHEN 'AFRICA' THEN 'EUROPE' WHEN 'EUROPE' THEN 'AFRICA' ELSE grp END AS grp FROM samples")
def swap(spark, sf):
    return hybrid.swap_groups(samples(spark, sf).select("sample_id", "grp"), "grp", A, B)
