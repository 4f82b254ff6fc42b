"""Queries over imputation and batch effects."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from assaygrid.operators import batch, impute
from assaygrid.plans.bind import CELLS, DENSE, R, REGION_CELLS, SAMPLES, Catalog, assay, region_assay, rnd, spectrum, vectors
from assaygrid.runtime import materialize

catalog = Catalog()
add = catalog.add

BASE = f"WITH {CELLS}, {SAMPLES}, {DENSE}"
FILLS = {
    "median": "SELECT sample_id, median(value) AS fill FROM cells GROUP BY 1",
    "mean": "SELECT sample_id, avg(value) AS fill FROM cells GROUP BY 1",
    "global_min": "SELECT sample_id, (SELECT min(value) FROM cells) AS fill FROM samples",
    "zero": "SELECT sample_id, 0.0 AS fill FROM samples",
}


def _simple(method: str):
    def run(spark, sf):
        return impute.simple(assay(spark, sf), method).withColumn("value", rnd(F.col("value"), 4))

    return run


for _method, _fill in FILLS.items():
    add(
        f"impute_{_method}",
        f"{BASE}, fills AS ({_fill}) SELECT feature_id, sample_id, {R('coalesce(value, fill)', 4)} AS value, value IS NULL AS imputed FROM dense JOIN fills USING (sample_id)",
    )(_simple(_method))


def _uniform(tag: str) -> str:
    return f"((('0x' || substr(md5('{tag}|7|' || feature_id || '|' || sample_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


MINPROB = f"""st AS (SELECT sample_id, avg(log10(1 + value)) AS m, stddev_samp(log10(1 + value)) AS sd FROM cells GROUP BY 1),
mp AS (SELECT feature_id, sample_id, value, greatest(0, 10 ** (m - 1.8 * sd + sqrt(-2 * ln({_uniform('u1')})) * cos(2 * pi() * {_uniform('u2')}) * 0.3 * sd) - 1) AS fill
  FROM dense JOIN st USING (sample_id))"""


@add("impute_min_prob", f"{BASE}, {MINPROB} SELECT feature_id, sample_id, {R('coalesce(value, fill)', 4)} AS value, value IS NULL AS imputed FROM mp")
def min_prob(spark, sf):
    return impute.min_prob(assay(spark, sf), seed=7).withColumn("value", rnd(F.col("value"), 4))


KNN = f"""WITH {REGION_CELLS}, g AS (SELECT feature_id, sample_id, log2(1 + value) AS x FROM rdense),
mc AS (SELECT feature_id, count(*) - count(x) AS miss FROM g GROUP BY 1),
dist AS (SELECT q.feature_id AS q, d.feature_id AS d, {{metric}} AS dist FROM g q JOIN g d ON q.sample_id = d.sample_id
  WHERE q.x IS NOT NULL AND q.feature_id IN (SELECT feature_id FROM mc WHERE miss BETWEEN 1 AND {{cap}}) AND d.feature_id IN (SELECT feature_id FROM mc WHERE miss = 0)
  GROUP BY 1, 2),
nn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, d) AS rn FROM dist QUALIFY rn <= 5),
fb AS (SELECT sample_id, median(x) AS fb FROM g GROUP BY 1),
est AS (SELECT q AS feature_id, sample_id, sum(x * {{weight}}) / sum({{weight}}) AS fill FROM nn JOIN g ON g.feature_id = d GROUP BY 1, 2)
SELECT g.feature_id, g.sample_id, {R('coalesce(x, CASE WHEN miss <= {cap} THEN coalesce(fill, fb) END)')} AS value, x IS NULL AND miss <= {{cap}} AS imputed
FROM g JOIN mc USING (feature_id) JOIN fb USING (sample_id) LEFT JOIN est USING (feature_id, sample_id)"""


def _logged(spark, sf):
    a = region_assay(spark, sf)
    return a.with_cells(a.cells.withColumn("value", F.log2(1 + F.col("value"))))


@add("impute_knn_complete", KNN.format(metric="sqrt(avg((q.x - d.x) ** 2))", weight="(1 / greatest(dist, 1e-8))", cap=99))
def knn_complete(spark, sf):
    return impute.knn(_logged(spark, sf), mode="complete").withColumn("value", rnd(F.col("value")))


@add("impute_knn_manhattan_capped", KNN.format(metric="avg(abs(q.x - d.x))", weight="(1.0 / rn)", cap=2))
def knn_manhattan(spark, sf):
    out = impute.knn(_logged(spark, sf), mode="complete", metric="manhattan", weight="rank", max_missing=0.2)
    return out.withColumn("value", rnd(F.col("value")))


@add("impute_knn_waves")
def knn_waves(spark, sf):
    return impute.knn(_logged(spark, sf)).withColumn("value", rnd(F.col("value")))


@add("impute_knn_then_minprob")
def knn_then_minprob(spark, sf):
    out = impute.knn_then_minprob(_logged(spark, sf), mode="complete", max_missing=0.2, max_missing_group=0.5, by="grp")
    return out.withColumn("value", rnd(F.col("value")))


@add("impute_mask", f"{BASE} SELECT feature_id, sample_id FROM dense WHERE value IS NULL")
def mask(spark, sf):
    return impute.imputed_mask(impute.simple(assay(spark, sf), "zero"))


@add(
    "impute_summary",
    f"""{BASE}, m AS (SELECT sample_id, median(value) AS fill FROM cells GROUP BY 1)
SELECT sample_id, {R('avg((value IS NULL)::INT)')} AS missing_before, {R('avg(log10(1 + value))')} AS mean_measured,
{R('avg(log10(1 + fill)) FILTER (WHERE value IS NULL)')} AS mean_imputed FROM dense JOIN m USING (sample_id) GROUP BY 1""",
)
def summary(spark, sf):
    out = impute.impute_summary(impute.simple(assay(spark, sf), "median"))
    return out.select("sample_id", *[rnd(F.col(c)).alias(c) for c in ("missing_before", "mean_measured", "mean_imputed")])


@add(
    "impute_densities",
    f"""{BASE}, m AS (SELECT sample_id, median(value) AS fill FROM cells GROUP BY 1), d AS (SELECT value, log10(1 + coalesce(value, fill)) AS x FROM dense JOIN m USING (sample_id)),
v AS (SELECT 'before' AS stage, x FROM d WHERE value IS NOT NULL UNION ALL SELECT 'after', x FROM d),
sp AS (SELECT stage, count(*) AS n, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, list_sort(list(x)) AS l FROM v GROUP BY 1),
bw AS (SELECT *, 0.9 * least(sd, (l[floor(0.75 * (n - 1))::INT + 1] - l[floor(0.25 * (n - 1))::INT + 1]) / 1.34) * n ** -0.2 AS h FROM sp),
g AS (SELECT *, p AS point, lo - 2.5 * h + (hi - lo + 5 * h) * p / 15 AS gx FROM bw, range(16) t(p))
SELECT g.stage, point::INT AS point, {R('gx')} AS x, {R('sum(exp(-0.5 * ((gx - x) / h) ** 2)) / (any_value(n) * any_value(h))')} AS density
FROM g JOIN v ON g.stage = v.stage GROUP BY g.stage, point, gx""",
)
def densities(spark, sf):
    out = impute.impute_densities(impute.simple(assay(spark, sf), "median"), 16)
    return out.select("stage", "point", rnd(F.col("x")).alias("x"), rnd(F.col("density")).alias("density"))


BAT = f"""WITH {CELLS.replace('cells AS (', 'cells AS MATERIALIZED (')}, {SAMPLES}, w AS MATERIALIZED (SELECT feature_id, sample_id, batch, grp, log10(value) AS x FROM cells JOIN samples USING (sample_id))"""
R2 = """per AS (SELECT feature_id, batch, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM w GROUP BY 1, 2),
r2 AS (SELECT feature_id, sum(n)::BIGINT AS n, CASE WHEN sum(n) < 2 OR count(*) < 2 OR ssb + sum(n * v) <= 1e-12 THEN 0 ELSE ssb / (ssb + sum(n * v)) END AS r2
  FROM (SELECT *, sum(n * (m - gm) ** 2) OVER (PARTITION BY feature_id) AS ssb FROM (SELECT *, sum(n * m) OVER (PARTITION BY feature_id) / sum(n) OVER (PARTITION BY feature_id) AS gm FROM per))
  GROUP BY feature_id, ssb)"""


@add("batch_r2", f"{BAT}, {R2} SELECT feature_id, n, {R('r2')} AS r2 FROM r2")
def batch_r2(spark, sf):
    return batch.batch_r2(assay(spark, sf), "batch").withColumn("r2", rnd(F.col("r2")))


@add(
    "batch_r2_summary",
    f"""{BAT}, {R2} SELECT count(*) AS n_features, {R('avg(r2)')} AS mean, {R('median(r2)')} AS median, {R('avg((r2 >= 0.3)::INT)')} AS high_share FROM r2""",
)
def batch_r2_summary(spark, sf):
    out = batch.batch_r2_summary(batch.batch_r2(assay(spark, sf), "batch"))
    return out.select("n_features", *[rnd(F.col(c)).alias(c) for c in ("mean", "median", "high_share")])


@add("batch_r2_histogram", f"{BAT}, {R2} SELECT least(floor(r2 * 20), 19)::BIGINT AS bin, count(*) AS n, {R('least(floor(r2 * 20), 19) / 20')} AS bin_start FROM r2 GROUP BY 1, 3")
def batch_r2_histogram(spark, sf):
    return batch.r2_histogram(batch.batch_r2(assay(spark, sf), "batch")).withColumn("bin_start", rnd(F.col("bin_start")))


@add("batch_work_scale", f"WITH {CELLS} SELECT CASE WHEN avg((value > 100)::INT) > 0.5 THEN 'log10' ELSE 'raw' END AS scale FROM cells")
def work_scale(spark, sf):
    return spark.createDataFrame([(batch.work_scale(assay(spark, sf)),)], "scale string")


@add(
    "batch_eta_squared",
    f"""WITH e AS (SELECT label, embedding[1]::DOUBLE AS s FROM embeddings), g AS (SELECT label, count(*) AS n, avg(s) AS m FROM e GROUP BY 1), a AS (SELECT avg(s) AS gm FROM e)
SELECT {R('(SELECT sum(n * (m - gm) ** 2) FROM g, a) / (SELECT sum((s - gm) ** 2) FROM e, a)')} AS eta2""",
)
def eta_squared(spark, sf):
    v = vectors(spark, sf).select("label", F.col("vec")[0].alias("s"))
    return batch.eta_squared(v, "s", "label").withColumn("eta2", rnd(F.col("eta2")))


SIL = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id AS item_id, label, max(total / n) FILTER (WHERE label = other) AS a, min(total / n) FILTER (WHERE label <> other) AS b FROM p GROUP BY 1, 2)"""


@add("batch_silhouette", f"{SIL} SELECT item_id, label, {R('coalesce((b - coalesce(a, 0)) / greatest(coalesce(a, 0), b), 0)')} AS silhouette FROM s")
def batch_silhouette(spark, sf):
    out = batch.batch_silhouette(vectors(spark, sf))
    return out.withColumn("silhouette", rnd(F.col("silhouette")))


@add(
    "batch_stats",
    f"""{BAT}, sz AS (SELECT batch, count(*) AS n_samples FROM samples GROUP BY 1), raw AS (SELECT batch, median(value) AS med, avg(value) AS mean FROM cells JOIN samples USING (sample_id) GROUP BY 1)
SELECT batch, n_samples, count(*) AS n, {R('any_value(mean)', 3)} AS mean, {R('avg(x)')} AS log_mean, {R('stddev_samp(x)')} AS log_sd, {R('any_value(med)', 3)} AS median,
{R('median(x)')} AS log_median, {R('1 - count(*) / ((SELECT count(DISTINCT feature_id) FROM cells) * n_samples)')} AS missing_share
FROM w JOIN sz USING (batch) JOIN raw USING (batch) GROUP BY batch, n_samples""",
)
def batch_stats(spark, sf):
    out = batch.batch_stats(assay(spark, sf), "batch")
    digits = {"mean": 3, "median": 3, "log_mean": 6, "log_sd": 6, "log_median": 6, "missing_share": 6}
    return out.select("batch", "n_samples", "n", *[rnd(F.col(c), d).alias(c) for c, d in digits.items()])


CORRECT = """a AS (SELECT *, count(*) OVER (PARTITION BY feature_id) AS n, {anchor} AS anchor FROM w),
r AS (SELECT *, x - anchor AS r FROM a),
l AS (SELECT *, {loc}(r) OVER (PARTITION BY feature_id, batch) AS loc FROM r)"""
CORRECTED = "SELECT feature_id, sample_id, (round(CASE WHEN n < 2 THEN value ELSE 10 ** (anchor + r - loc) END, 3) + 0) AS value FROM l JOIN cells USING (feature_id, sample_id)"


@add("batch_correct_median", f"{BAT}, {CORRECT.format(anchor='median(x) OVER (PARTITION BY feature_id)', loc='median')} {CORRECTED}")
def correct_median(spark, sf):
    return batch.correct(assay(spark, sf), "batch").withColumn("value", rnd(F.col("value"), 3))


@add("batch_correct_mean_covariate", f"{BAT}, {CORRECT.format(anchor='avg(x) OVER (PARTITION BY feature_id, grp)', loc='avg')} {CORRECTED}")
def correct_mean(spark, sf):
    return batch.correct(assay(spark, sf), "batch", "mean", covariate="grp").withColumn("value", rnd(F.col("value"), 3))


COMBAT = f"""{BAT}, a AS (SELECT *, count(*) OVER (PARTITION BY feature_id) AS nf, avg(x) OVER (PARTITION BY feature_id) AS anchor FROM w),
b AS (SELECT feature_id, batch, count(*) AS n, avg(x - anchor) AS loc, coalesce(stddev_samp(x - anchor), 0) AS sc FROM a GROUP BY 1, 2),
k AS (SELECT count(DISTINCT batch) AS k FROM samples),
f AS (SELECT feature_id, sum(CASE WHEN n > 1 THEN (n - 1) * sc * sc ELSE 0 END) AS ss, sum(n - 1) AS df, sum(loc) AS l1, sum(loc * loc) AS l2, sum(n) AS nf,
  avg(sc * sc / n) FILTER (WHERE sc > 0) AS noise FROM b GROUP BY 1),
g AS (SELECT *, CASE WHEN df > 0 AND ss > 0 THEN sqrt(ss / df) ELSE 1 END AS p, greatest(0, (l2 - l1 * l1 / k) / (k - 1) - coalesce(noise, 0)) AS tau2, greatest(1, nf / k - 1) AS nu FROM f, k),
adj AS (SELECT b.feature_id, batch, p, CASE WHEN sc > 0 AND n * tau2 > 0 THEN loc * n * tau2 / (n * tau2 + sc * sc) ELSE 0 END AS la,
  CASE WHEN n <= 1 THEN p ELSE sqrt(greatest(((n - 1) * sc * sc + nu * p * p) / (n - 1 + nu), 1e-10)) END AS sa FROM b JOIN g USING (feature_id))
SELECT feature_id, sample_id, {R('CASE WHEN nf < 2 THEN c.value ELSE 10 ** (anchor + p * (x - anchor - la) / sa) END', 3)} AS value
FROM a JOIN adj USING (feature_id, batch) JOIN cells c USING (feature_id, sample_id)"""


@add("batch_correct_combat", COMBAT)
def correct_combat(spark, sf):
    return batch.correct(assay(spark, sf), "batch", "combat").withColumn("value", rnd(F.col("value"), 3))


def _stage(tag: str, cells: str) -> str:
    """CTEs with one row ``m<tag>`` of the metrics of batch_compare over ``cells``."""
    named = lambda sql, names: re.sub(rf"\b({names})\b", rf"\1{tag}", sql)
    return named(
        f"""w AS MATERIALIZED (SELECT feature_id, sample_id, batch, value, log10(value) AS x FROM {cells} JOIN samples USING (sample_id)),
{R2},
mean AS (SELECT sample_id, avg(value) AS mu FROM w GROUP BY 1), moved AS MATERIALIZED (SELECT feature_id, sample_id, value - mu AS y FROM w JOIN mean USING (sample_id)),
place AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS i FROM mean),
cov AS MATERIALIZED (SELECT o.i, q.i AS j, sum(l.y * r.y) / (SELECT count(DISTINCT feature_id) - 1 FROM w) AS v
  FROM moved l JOIN moved r USING (feature_id) JOIN place o ON o.sample_id = l.sample_id JOIN place q ON q.sample_id = r.sample_id GROUP BY 1, 2),
{spectrum('cov', '2')},
score AS MATERIALIZED (SELECT sample_id, batch, max(vec[i] * sqrt(value)) FILTER (WHERE c = 1) AS pc1, max(vec[i] * sqrt(value)) FILTER (WHERE c = 2) AS pc2
  FROM found, place JOIN samples USING (sample_id) GROUP BY 1, 2),
away AS (SELECT l.sample_id, l.batch, r.batch AS other, avg(sqrt((l.pc1 - r.pc1) ** 2 + (l.pc2 - r.pc2) ** 2)) AS d FROM score l JOIN score r ON l.sample_id <> r.sample_id GROUP BY 1, 2, 3),
sil AS (SELECT sample_id, coalesce(max(d) FILTER (WHERE batch = other), 0) AS near, min(d) FILTER (WHERE batch <> other) AS far FROM away GROUP BY 1),
eta AS (SELECT sum(n * (b1 - g1) ** 2) / any_value(t1) AS e1, sum(n * (b2 - g2) ** 2) / any_value(t2) AS e2
  FROM (SELECT batch, count(*) AS n, avg(pc1) AS b1, avg(pc2) AS b2 FROM score GROUP BY 1),
    (SELECT avg(pc1) AS g1, avg(pc2) AS g2, var_pop(pc1) * count(*) AS t1, var_pop(pc2) * count(*) AS t2 FROM score)),
m AS (SELECT avg(r2) AS mean, median(r2) AS median, avg((r2 >= 0.3)::INT) AS high_share, (SELECT avg((far - near) / greatest(far, near)) FROM sil) AS silhouette,
  (SELECT e1 FROM eta) AS pc1_eta2, (SELECT e2 FROM eta) AS pc2_eta2 FROM r2)""",
        "w|per|r2|moved|place|cov|mat|eig|signs|found|score|away|sil|eta|m(?= AS \\(SELECT avg)|mean(?= AS \\(SELECT sample)|mean(?= USING)|mean(?=\\),)",
    )


@add(
    "batch_compare",
    f"""{COMBAT.split(chr(10) + 'SELECT feature_id, sample_id')[0].replace('WITH ', 'WITH RECURSIVE ', 1)},
fixed AS MATERIALIZED (SELECT feature_id, sample_id, CASE WHEN nf < 2 THEN c.value ELSE 10 ** (anchor + p * (x - anchor - la) / sa) END AS value FROM a JOIN adj USING (feature_id, batch) JOIN cells c USING (feature_id, sample_id)),
{_stage('_0', 'cells')}, {_stage('_1', 'fixed')},
b_0 AS (SELECT * FROM m_0 UNPIVOT (v FOR metric IN (mean, median, high_share, silhouette, pc1_eta2, pc2_eta2))), b_1 AS (SELECT * FROM m_1 UNPIVOT (v FOR metric IN (mean, median, high_share, silhouette, pc1_eta2, pc2_eta2)))
SELECT metric, {R('b_0.v')} AS before, {R('b_1.v')} AS after, {R('b_1.v - b_0.v')} AS delta FROM b_0 JOIN b_1 USING (metric)""",
)
def compare(spark, sf):
    a = assay(spark, sf)
    a = a.with_cells(materialize(a.cells))
    out = batch.batch_compare(a, a.with_cells(batch.correct(a, "batch", "combat")), "batch")
    return out.select("metric", *[rnd(F.col(c)).alias(c) for c in ("before", "after", "delta")])
