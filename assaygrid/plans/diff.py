"""Queries over differential testing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from assaygrid.functions import special
from assaygrid.operators import diff, filters, multitest, qc
from assaygrid.plans.bind import CELLS, R, SAMPLES, Catalog, assay, part_features, rnd, table

catalog = Catalog()
add = catalog.add

MOMENTS = """mom AS (SELECT feature_id, count(*) FILTER (WHERE grp = 'AFRICA') AS n_a, avg(x) FILTER (WHERE grp = 'AFRICA') AS mean_a,
  coalesce(var_samp(x) FILTER (WHERE grp = 'AFRICA'), 0) AS var_a, count(*) FILTER (WHERE grp = 'EUROPE') AS n_b,
  avg(x) FILTER (WHERE grp = 'EUROPE') AS mean_b, coalesce(var_samp(x) FILTER (WHERE grp = 'EUROPE'), 0) AS var_b
  FROM (SELECT feature_id, grp, log2(1 + value) AS x FROM cells JOIN samples USING (sample_id) WHERE value <> 0 AND grp IN ('AFRICA', 'EUROPE'))
  GROUP BY 1 HAVING n_a >= 1 AND n_b >= 1)"""
WELCH = f"""WITH {CELLS}, {SAMPLES}, {MOMENTS},
u AS (SELECT *, var_a / n_a AS ua, var_b / n_b AS ub FROM mom WHERE n_a >= 2 AND n_b >= 2),
tt AS (SELECT *, sqrt(ua + ub) AS se, (mean_b - mean_a) / sqrt(ua + ub) AS t, (ua + ub) ** 2 / (ua * ua / (n_a - 1) + ub * ub / (n_b - 1)) AS df FROM u WHERE ua + ub > 0)"""


def t_tail(t: str, df: str) -> str:
    """Two-sided t probability as an integral of cos^(df - 1), by Simpson's rule on 800 strips.

    The substitution theta = pi/2 - w s^2 keeps the integrand smooth for small df.
    """
    w = f"(pi() / 2 - atan(abs({t}) / sqrt({df})))"
    f = f"sin({w} * (k / 800.0) ** 2) ** ({df} - 1) * 2 * {w} * (k / 800.0)"
    weights = "CASE WHEN k IN (0, 800) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(1, 801), lambda k: {weights} * {f})) / 2400"
    return f"2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {area}"


def _moments(spark, sf):
    return diff.group_moments(assay(spark, sf), "grp", "AFRICA", "EUROPE")


@add(
    "diff_group_moments",
    f"""WITH {CELLS}, {SAMPLES}, {MOMENTS} SELECT feature_id, n_a, {R('mean_a')} AS mean_a, {R('var_a')} AS var_a, n_b, {R('mean_b')} AS mean_b,
{R('var_b')} AS var_b, {R('mean_b - mean_a')} AS log2fc FROM mom""",
)
def group_moments(spark, sf):
    m = diff.log2fc(_moments(spark, sf)).fillna(0.0, ["var_a", "var_b"])
    return m.select("feature_id", "n_a", "n_b", *[rnd(F.col(c)).alias(c) for c in ("mean_a", "var_a", "mean_b", "var_b", "log2fc")])


@add(
    "diff_log2fc_raw",
    f"""WITH {CELLS}, {SAMPLES}, m AS (SELECT feature_id, avg(value) FILTER (WHERE grp = 'AFRICA') AS a, avg(value) FILTER (WHERE grp = 'EUROPE') AS b
FROM cells JOIN samples USING (sample_id) GROUP BY 1) SELECT feature_id, {R('log2((b + 1) / (a + 1))')} AS log2fc FROM m WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def log2fc_raw(spark, sf):
    m = diff.group_moments(assay(spark, sf), "grp", "AFRICA", "EUROPE", log2=False)
    return diff.log2fc(m, log2=False).select("feature_id", rnd(F.col("log2fc")).alias("log2fc"))


@add(
    "diff_welch",
    f"""{WELCH}, done AS (SELECT feature_id, {R('t', 5)} AS t, {R('df', 5)} AS df, {R(t_tail('t', 'df'))} AS p FROM tt)
SELECT mom.feature_id, t, df, CASE WHEN n_a >= 2 AND n_b >= 2 THEN {R('sqrt(var_a / n_a + var_b / n_b)')} END AS se, p FROM mom LEFT JOIN done ON done.feature_id = mom.feature_id""",
)
def welch(spark, sf):
    out = diff.ttest(_moments(spark, sf), "welch")
    return out.select("feature_id", rnd(F.col("t"), 5).alias("t"), rnd(F.col("df"), 5).alias("df"), rnd(F.col("se")).alias("se"), rnd(F.col("p")).alias("p"))


STUDENT = f"""WITH {CELLS}, {SAMPLES}, {MOMENTS}, v AS (SELECT *, n_a + n_b - 2 AS df, ((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2) AS s2 FROM mom WHERE n_a + n_b > 2),
tt AS (SELECT *, (mean_b - mean_a) / sqrt(s2 * (1 / n_a + 1 / n_b)) AS t FROM v WHERE s2 > 0)"""


@add("diff_student", f"""{STUDENT}, done AS (SELECT feature_id, {R('t', 5)} AS t, df::DOUBLE AS df, {R(t_tail('t', 'df'))} AS p FROM tt)
SELECT mom.feature_id, t, df, p FROM mom LEFT JOIN done ON done.feature_id = mom.feature_id""")
def student(spark, sf):
    out = diff.ttest(_moments(spark, sf), "student")
    return out.select("feature_id", rnd(F.col("t"), 5).alias("t"), "df", rnd(F.col("p")).alias("p"))


def trigamma_sql(x: str) -> str:
    z = f"({x} + 10)"
    head = f"list_sum(list_transform(range(0, 10), lambda i: 1 / ({x} + i) ** 2))"
    return f"({head} + 1/{z} + 1/(2*{z}**2) + 1/(6*{z}**3) - 1/(30*{z}**5) + 1/(42*{z}**7) - 1/(30*{z}**9))"


@add(
    "diff_variance_moments",
    f"""{STUDENT}, g AS (SELECT * FROM v WHERE s2 > 0)
SELECT count(*) AS n, {R('avg(ln(s2))')} AS mean_log, {R('var_samp(ln(s2))')} AS var_log, {R(f"avg({trigamma_sql('(df / 2.0)')})")} AS mean_trigamma FROM g""",
)
def variance_moments(spark, sf):
    na, nb = F.col("n_a"), F.col("n_b")
    m = _moments(spark, sf).fillna(0.0, ["var_a", "var_b"]).withColumn("dg", na + nb - 2).filter("dg > 0")
    m = m.withColumn("s2", ((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / F.col("dg")).filter("s2 > 0")
    return m.agg(
        F.count("*").alias("n"), rnd(F.avg(F.log("s2"))).alias("mean_log"), rnd(F.var_samp(F.log("s2"))).alias("var_log"),
        rnd(F.avg(special.trigamma(F.col("dg") / 2))).alias("mean_trigamma"),
    )


def _limma(spark, sf):
    return diff.log2fc(diff.moderated_t(_moments(spark, sf)))


# The prior solves trigamma(d0 / 2) = var(log s2) - mean trigamma: bisection on a fine list.
PRIOR = f"""{STUDENT}, g AS (SELECT * FROM v WHERE s2 > 0),
mm AS (SELECT avg(ln(s2)) AS e, var_samp(ln(s2)) - avg({trigamma_sql('(df / 2.0)')}) AS ev FROM g),
sol AS (SELECT e, ev, list_reduce(range(0, 80), lambda s, i: CASE WHEN {trigamma_sql('((s[1] + s[2]) / 2)')} > ev THEN [(s[1] + s[2]) / 2, s[2]] ELSE [s[1], (s[1] + s[2]) / 2] END, [0.0001::DOUBLE, 10000.0::DOUBLE]) AS s FROM mm),
pr AS (SELECT e, ev, (s[1] + s[2]) / 2 AS h FROM sol),
dg AS (SELECT *, ln(h + 20) - 1/(2*(h+20)) - 1/(12*(h+20)**2) + 1/(120*(h+20)**4) - list_sum(list_transform(range(0, 20), lambda i: 1 / (h + i))) AS psi FROM pr),
prior AS (SELECT CASE WHEN ev > 0 THEN 2 * h ELSE 'inf'::DOUBLE END AS d0, CASE WHEN ev > 0 THEN exp(e + psi - ln(h)) ELSE exp(e) END AS s0 FROM dg),
lim AS (SELECT v.*, d0, CASE WHEN isinf(d0) THEN s0 ELSE (d0 * s0 + df * s2) / (d0 + df) END AS post FROM v, prior)"""


@add(
    "diff_moderated",
    f"""{PRIOR}, done AS (SELECT feature_id, {R('post')} AS s2_post, {R('(mean_b - mean_a) / sqrt(post * (1 / n_a + 1 / n_b))', 5)} AS t FROM lim)
SELECT mom.feature_id, s2_post, t FROM mom LEFT JOIN done ON done.feature_id = mom.feature_id""",
)
def moderated(spark, sf):
    out = _limma(spark, sf)
    return out.select("feature_id", rnd(F.col("s2_post")).alias("s2_post"), rnd(F.col("t"), 5).alias("t"))


@add(
    "diff_effect_ci",
    f"""{PRIOR}, dofs AS (SELECT DISTINCT df + d0 AS dof FROM lim),
crit AS (SELECT dof, list_reduce(range(0, 60), lambda s, i: CASE WHEN {t_tail('((s[1] + s[2]) / 2)', 'dof')} > 0.05 THEN [(s[1] + s[2]) / 2, s[2]] ELSE [s[1], (s[1] + s[2]) / 2] END, [0.0::DOUBLE, 1000.0::DOUBLE]) AS s FROM dofs),
done AS (SELECT feature_id, sqrt(post * (1 / n_a + 1 / n_b)) * (s[1] + s[2]) / 2 AS w FROM lim JOIN crit ON dof = df + d0)
SELECT mom.feature_id, {R('mean_b - mean_a')} AS log2fc, {R('mean_b - mean_a - w')} AS ci_low, {R('mean_b - mean_a + w')} AS ci_high FROM mom LEFT JOIN done ON done.feature_id = mom.feature_id""",
)
def effect_ci(spark, sf):
    out = diff.effect_ci(_limma(spark, sf))
    return out.select("feature_id", *[rnd(F.col(c)).alias(c) for c in ("log2fc", "ci_low", "ci_high")])


@add(
    "diff_bh",
    f"""{WELCH}, pv AS (SELECT feature_id, {t_tail('t', 'df')} AS p FROM tt), r AS (SELECT *, count(*) OVER () * p / rank() OVER (ORDER BY p) AS raw FROM pv)
, done AS (SELECT feature_id, {R('p')} AS p, {R('least(1, min(raw) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))')} AS p_adj FROM r)
SELECT mom.feature_id, p, p_adj FROM mom LEFT JOIN done ON done.feature_id = mom.feature_id""",
)
def bh(spark, sf):
    out = multitest.p_adjust(diff.ttest(_moments(spark, sf), "welch"), "bh")
    return out.select("feature_id", rnd(F.col("p")).alias("p"), rnd(F.col("p_adj")).alias("p_adj"))


# p-values with many ties: price ranks of parts, a third of them 1
TIED = "pv AS (SELECT p_partkey AS feature_id, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE (p_size * p_size + 1) / 5000.0 END::DOUBLE AS p FROM part)"


def _tied(spark, sf):
    size = F.col("size")
    return part_features(spark, sf).select("feature_id", F.when(size % 3 == 0, 1.0).otherwise((size * size + 1) / 5000.0).alias("p"))


@add(
    "diff_bh_ties",
    f"""WITH {TIED}, r AS (SELECT *, count(*) OVER () * p / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM pv)
SELECT feature_id, p, {R('least(1, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))', 8)} AS p_adj FROM r""",
)
def bh_ties(spark, sf):
    return multitest.benjamini_hochberg(_tied(spark, sf)).withColumn("p_adj", rnd(F.col("p_adj"), 8))


@add("diff_bonferroni", f"WITH {TIED} SELECT feature_id, {R('least(1, p * count(*) OVER ())', 8)} AS p_adj FROM pv")
def bonf(spark, sf):
    return multitest.bonferroni(_tied(spark, sf)).select("feature_id", rnd(F.col("p_adj"), 8).alias("p_adj"))


# the smoother is linear in the curve: its last value is a fixed weighting of the 20 shares
SMOOTHER = [float(multitest._smooth(np.array(multitest.LAMBDAS), row, 3.0)[-1]) for row in np.eye(len(multitest.LAMBDAS))]


@add(
    "diff_storey",
    f"""{WELCH}, pv AS (SELECT feature_id, {t_tail('t', 'df')} AS p FROM tt),
cu AS (SELECT l, count(*) FILTER (WHERE p >= round(l / 20, 2)) / count(*) / (1 - l / 20) AS y FROM pv, range(20) r(l) GROUP BY l),
pi AS (SELECT greatest(0, least(1, sum(y * [{', '.join(map(repr, SMOOTHER))}][l + 1]))) AS pi0 FROM cu),
r AS (SELECT *, count(*) OVER () * p / rank() OVER (ORDER BY p) AS raw FROM pv)
, done AS (SELECT feature_id, {R('p')} AS p, {R('least(1, min(pi0 * raw) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))')} AS q FROM r, pi)
SELECT mom.feature_id, p, q FROM mom LEFT JOIN done ON done.feature_id = mom.feature_id""",
)
def storey(spark, sf):
    out = multitest.storey(diff.ttest(_moments(spark, sf), "welch"))
    return out.select("feature_id", rnd(F.col("p")).alias("p"), rnd(F.col("q")).alias("q"))


@add(
    "diff_storey_curve",
    f"""{WELCH}, pv AS (SELECT {t_tail('t', 'df')} AS p FROM tt)
SELECT l / 20 AS lambda, {R('count(*) FILTER (WHERE p >= round(l / 20, 2)) / count(*) / (1 - l / 20)')} AS pi0 FROM pv, range(20) r(l) GROUP BY l""",
)
def storey_curve(spark, sf):
    tests = diff.ttest(_moments(spark, sf), "welch").filter("t IS NOT NULL")
    _, curve = multitest.pi0_smoother(tests)
    return spark.createDataFrame(list(zip(multitest.LAMBDAS, curve)), "lambda double, pi0 double").withColumn("pi0", rnd(F.col("pi0")))


GROUPS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def f_tail(f: str, df1: str, df2: str) -> str:
    """Upper tail of F for up to four numerator degrees of freedom, from the incomplete beta function's recurrence."""
    x = f"({df2} / ({df2} + {df1} * {f}))"
    half = f"({df2} / 2.0)"
    return f"""CASE {df1} WHEN 1 THEN {t_tail(f"sqrt({f})", df2)} WHEN 2 THEN {x} ** {half}
  WHEN 3 THEN {t_tail(f"sqrt(3 * {f})", df2)} + 2 * {x} ** {half} * sqrt(1 - {x}) * exp(lgamma({half} + 0.5) - lgamma({half})) / sqrt(pi())
  WHEN 4 THEN {x} ** {half} * (1 + {half} * (1 - {x})) END"""


@add(
    "diff_anova",
    f"""WITH {CELLS}, {SAMPLES}, g AS (SELECT feature_id, grp, count(*) AS n, avg(log2(1 + value)) AS m, var_samp(log2(1 + value)) AS v
  FROM cells JOIN samples USING (sample_id) WHERE value <> 0 GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT feature_id, count(*) AS k, sum(n)::BIGINT AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum((n - 1) * v) AS ssw,
  arg_max(grp, m) AS max_group, max(m) AS max_mean FROM g GROUP BY 1 HAVING count(*) >= 2)
SELECT feature_id, k, n, {R('(ssb / (k - 1)) / (ssw / (n - k))', 5)} AS f, k - 1 AS df1, n - k AS df2, {R('ssb / (ssb + ssw)')} AS eta2, max_group, {R('max_mean')} AS max_mean FROM t""",
)
def anova(spark, sf):
    out = diff.anova(assay(spark, sf), "grp", GROUPS)
    return out.select("feature_id", "k", "n", rnd(F.col("f"), 5).alias("f"), "df1", "df2", rnd(F.col("eta2")).alias("eta2"), "max_group", rnd(F.col("max_mean")).alias("max_mean"))


@add(
    "diff_anova_p",
    f"""WITH {CELLS}, {SAMPLES}, g AS (SELECT feature_id, grp, count(*) AS n, avg(log2(1 + value)) AS m, var_samp(log2(1 + value)) AS v
  FROM cells JOIN samples USING (sample_id) WHERE value <> 0 GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT feature_id, count(*) AS k, sum(n)::BIGINT AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum((n - 1) * v) AS ssw FROM g GROUP BY 1 HAVING count(*) >= 2),
f AS (SELECT feature_id, k - 1 AS d1, n - k AS d2, greatest(ssb, 0) / (k - 1) / (ssw / (n - k)) AS f FROM t)
SELECT feature_id, {R(f_tail('f', 'd1', 'd2'))} AS p FROM f""",
)
def anova_p(spark, sf):
    out = diff.anova(assay(spark, sf), "grp", GROUPS)
    return out.select("feature_id", rnd(F.col("p")).alias("p"))


@add(
    "diff_kruskal",
    f"""WITH {CELLS}, {SAMPLES}, c AS (SELECT feature_id, grp, floor(log2(1 + value)) AS x, count(*) OVER (PARTITION BY feature_id, grp) AS gs
  FROM cells JOIN samples USING (sample_id) WHERE value <> 0),
r AS (SELECT *, count(*) OVER (PARTITION BY feature_id, x) AS t, rank() OVER (PARTITION BY feature_id ORDER BY x) + (count(*) OVER (PARTITION BY feature_id, x) - 1) / 2 AS rk FROM c WHERE gs >= 2),
g AS (SELECT feature_id, grp, count(*) AS n, sum(rk) AS s, sum(t * t - 1) AS ties FROM r GROUP BY 1, 2),
h AS (SELECT feature_id, count(*) AS k, sum(n)::BIGINT AS n, (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / nullif(1 - sum(ties) / (sum(n) ** 3 - sum(n)), 0) AS h FROM g GROUP BY 1 HAVING count(*) >= 2)
SELECT feature_id, k, n, {R('h', 5)} AS h, {R('CASE k WHEN 3 THEN exp(-h / 2) WHEN 5 THEN exp(-h / 2) * (1 + h / 2) END')} AS p FROM h""",
)
def kruskal(spark, sf):
    a = assay(spark, sf)
    # whole log2 units, so that ties occur
    a = a.with_cells(a.cells.withColumn("value", F.floor(F.log2(1 + F.col("value"))).cast("double")))
    out = diff.kruskal(a, "grp", GROUPS, log2=False)
    # an even number of degrees of freedom has a closed form; h is compared for all
    return out.select("feature_id", "k", "n", rnd(F.col("h"), 5).alias("h"), F.when(F.col("k").isin(3, 5), rnd(F.col("p"))).alias("p"))


@add(
    "diff_classify",
    f"""{WELCH}, pv AS (SELECT feature_id, mean_b - mean_a AS fc, {t_tail('t', 'df')} AS p FROM tt)
SELECT CASE WHEN p <= 0.1 AND abs(fc) >= 0.5 THEN CASE WHEN fc > 0 THEN 'up' ELSE 'down' END ELSE 'ns' END AS sig, count(*) AS n FROM mom LEFT JOIN pv ON pv.feature_id = mom.feature_id GROUP BY 1""",
)
def classify(spark, sf):
    tests = diff.log2fc(diff.ttest(_moments(spark, sf), "welch"))
    return diff.classify(tests, "p", 0.1, 0.5).groupBy("sig").agg(F.count("*").alias("n"))


@add(
    "diff_sam_rule",
    f"""{WELCH}, done AS (SELECT feature_id, {R('se')} AS sam_se, {R('abs(mean_b - mean_a) / (se + 0.05)', 5)} AS sam_t, {t_tail('abs(mean_b - mean_a) / (se + 0.05)', 'df')} <= 0.05 AS sam_pass FROM tt WHERE t <> 0)
SELECT mom.feature_id, sam_se, sam_t, coalesce(sam_pass, false) AS sam_pass FROM mom LEFT JOIN done ON done.feature_id = mom.feature_id""",
)
def sam_rule(spark, sf):
    tests = diff.log2fc(diff.ttest(_moments(spark, sf), "welch"))
    out = diff.sam_rule(tests)
    return out.select("feature_id", rnd(F.col("sam_se")).alias("sam_se"), rnd(F.col("sam_t"), 5).alias("sam_t"), "sam_pass")


@add(
    "diff_volcano",
    f"""{WELCH}, done AS (SELECT feature_id, {R('-log10(' + t_tail('t', 'df') + ')', 5)} AS y FROM tt)
SELECT mom.feature_id, {R('mean_b - mean_a')} AS x, y FROM mom LEFT JOIN done ON done.feature_id = mom.feature_id""",
)
def volcano(spark, sf):
    tests = diff.log2fc(diff.ttest(_moments(spark, sf), "welch"))
    return diff.volcano(tests, "p").select("feature_id", rnd(F.col("x")).alias("x"), rnd(F.col("y"), 5).alias("y"))


@add("diff_ma", f"WITH {CELLS}, {SAMPLES}, {MOMENTS} SELECT feature_id, {R('(mean_a + mean_b) / 2')} AS x, {R('mean_b - mean_a')} AS y FROM mom")
def ma(spark, sf):
    return diff.ma(diff.log2fc(_moments(spark, sf))).select("feature_id", rnd(F.col("x")).alias("x"), rnd(F.col("y")).alias("y"))


@add("diff_p_histogram", f"{WELCH}, pv AS (SELECT {t_tail('t', 'df')} AS p FROM tt) SELECT floor(log10(p))::BIGINT AS decade, count(*) AS n FROM pv GROUP BY 1")
def p_histogram(spark, sf):
    return qc.p_histogram(diff.ttest(_moments(spark, sf), "welch"))


@add(
    "diff_group_heatmap",
    f"""WITH {CELLS}, {SAMPLES}, g AS (SELECT feature_id, grp, count(*) AS n, avg(log2(1 + value)) AS m, var_samp(log2(1 + value)) AS v
  FROM cells JOIN samples USING (sample_id) WHERE value <> 0 GROUP BY 1, 2),
t AS (SELECT feature_id, count(*) - 1 AS d1, sum(n)::BIGINT - count(*) AS d2, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum((n - 1) * v) AS ssw FROM g WHERE n >= 2 GROUP BY 1 HAVING count(*) >= 2),
f AS (SELECT feature_id, d1, d2, greatest(ssb, 0) / d1 / (ssw / d2) AS f FROM t),
top AS (SELECT feature_id FROM f ORDER BY {f_tail('f', 'd1', 'd2')}, feature_id LIMIT 40)
SELECT feature_id, grp AS "group", {R('m')} AS mean, {R('(m - avg(m) OVER w) / stddev_pop(m) OVER w', 5)} AS z FROM g WHERE feature_id IN (FROM top) WINDOW w AS (PARTITION BY feature_id)""",
)
def group_heatmap(spark, sf):
    a, groups = assay(spark, sf), GROUPS
    tests = diff.anova(a, "grp", groups)
    out = diff.group_heatmap(a, tests, "grp", groups)
    return out.select("feature_id", "group", rnd(F.col("mean")).alias("mean"), rnd(F.col("z"), 5).alias("z"))


@add(
    "diff_quant_table",
    f"""WITH {CELLS} SELECT feature_id, {', '.join(f"{R(f'''max(log2(1 + value)) FILTER (WHERE sample_id = 'NATION_{i}')''')} AS NATION_{i}" for i in range(25))} FROM cells WHERE value <> 0 GROUP BY 1""",
)
def quant_table(spark, sf):
    out = diff.quant_table(assay(spark, sf), "grp")
    missing = [F.lit(None).cast("double").alias(f"NATION_{i}") for i in range(25) if f"NATION_{i}" not in out.columns]
    return out.select("feature_id", *[rnd(F.col(c)).alias(c) for c in out.columns if c != "feature_id"], *missing)


@add(
    "diff_group_boxes",
    f"""WITH {CELLS}, {SAMPLES}, l AS (SELECT feature_id, grp, log2(1 + value) AS x FROM cells JOIN samples USING (sample_id) WHERE value <> 0)
SELECT feature_id, grp AS "group", count(*) AS n, {R('min(x)')} AS min, {R('quantile_cont(x, 0.25)')} AS q1, {R('median(x)')} AS median, {R('quantile_cont(x, 0.75)')} AS q3, {R('max(x)')} AS max
FROM l GROUP BY 1, 2""",
)
def group_boxes(spark, sf):
    out = diff.group_boxes(assay(spark, sf), "grp")
    return out.select("feature_id", "group", "n", *[rnd(F.col(c)).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@add(
    "diff_anova_extras",
    f"""WITH {CELLS}, {SAMPLES}, g AS (SELECT feature_id, grp, count(*) AS n, avg(log2(1 + value)) AS m, var_samp(log2(1 + value)) AS v
  FROM cells JOIN samples USING (sample_id) WHERE value <> 0 GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT feature_id, count(*) AS k, sum(n) AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum((n - 1) * v) AS ssw, arg_max(grp, m) AS max_group FROM g GROUP BY 1 HAVING count(*) >= 2)
SELECT feature_id, max_group, {R('ssb / (ssb + ssw)')} AS eta2 FROM t WHERE ssb / (ssb + ssw) >= 0.2 AND (ssb / (k - 1)) / (ssw / (n - k)) >= 1.5""",
)
def anova_extras(spark, sf):
    groups = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    out = diff.anova_filter(diff.anova(assay(spark, sf), "grp", groups), 0.2, 1.5)
    return out.select("feature_id", "max_group", rnd(F.col("eta2")).alias("eta2"))


@add(
    "diff_distributions",
    f"""WITH q AS (SELECT l_orderkey AS o, l_linenumber AS l, l_quantity AS k, l_discount * 40 AS x FROM lineitem)
SELECT o, l, {R(f"exp(-x) * list_sum(list_transform(range(0, (k % 12)::INT + 1), lambda i: x ** i / gamma(i + 1)))")} AS poisson_cdf,
{R("gamma(13) / (gamma(k % 12 + 1) * gamma(13 - k % 12)) * (0.2 + x / 10) ** (k % 12) * (0.8 - x / 10) ** (12 - k % 12)")} AS binom_pmf,
{R("list_sum(list_transform(range(0, (k % 12)::INT + 1), lambda i: gamma(13) / (gamma(i + 1) * gamma(13 - i)) * (0.2 + x / 10) ** i * (0.8 - x / 10) ** (12 - i)))")} AS binom_cdf,
{R("exp(-x / 2) * (1 + x / 2)")} AS chi2_p, {R("lgamma(k + x)")} AS lgamma FROM q""",
)
def distributions(spark, sf):
    k, x = F.col("l_quantity") % 12, F.col("l_discount") * 40
    p = 0.2 + x / 10
    n = F.lit(12.0)
    cols = {
        "poisson_cdf": special.poisson_cdf(k, x), "binom_pmf": special.binom_pmf(k, n, p), "binom_cdf": special.binom_cdf(k, n, p),
        "chi2_p": special.chi2_upper(x, F.lit(4)), "lgamma": special.lgamma(F.col("l_quantity") + x),
    }
    line = table(spark, sf, "lineitem")
    return line.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), *[rnd(c).alias(name) for name, c in cols.items()])


@add(
    "diff_flagship",
    f"""{WELCH.replace('mom AS', 'ok AS (SELECT feature_id FROM cells JOIN samples USING (sample_id) WHERE value > 0 GROUP BY 1 HAVING count(*) FILTER (WHERE grp = ' + "'AFRICA'" + ') >= 2 AND count(*) FILTER (WHERE grp = ' + "'EUROPE'" + ') >= 2), mom AS')},
pv AS (SELECT feature_id, mean_b - mean_a AS fc, t, df, {t_tail('t', 'df')} AS p FROM tt WHERE feature_id IN (FROM ok)),
r AS (SELECT *, count(*) OVER () * p / rank() OVER (ORDER BY p) AS raw FROM pv)
SELECT feature_id, {R('fc')} AS log2fc, {R('t', 5)} AS t, {R('df', 5)} AS df, {R('p')} AS p, {R('least(1, min(raw) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))')} AS p_adj
FROM r ORDER BY r.p, feature_id LIMIT 50""",
)
def flagship(spark, sf):
    a = filters.select_groups(assay(spark, sf), ["grp"], ["AFRICA", "EUROPE"])
    a = filters.keep_rows(a, filters.valid_rows(a, min_n=2, scope="each", by=["grp"]).filter("passed"))
    tests = diff.log2fc(diff.ttest(diff.group_moments(a, "grp", "AFRICA", "EUROPE"), "welch").filter("t IS NOT NULL"))
    top = multitest.benjamini_hochberg(tests).orderBy("p", "feature_id").limit(50)
    return top.select("feature_id", rnd(F.col("log2fc")).alias("log2fc"), rnd(F.col("t"), 5).alias("t"), rnd(F.col("df"), 5).alias("df"), rnd(F.col("p")).alias("p"), rnd(F.col("p_adj")).alias("p_adj"))
