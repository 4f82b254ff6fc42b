"""Queries over sample comparison and presence sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.operators import compare as cmp
from assaygrid.operators import pairs, sets
from assaygrid.plans.bind import CELLS, DENSE, R, SAMPLES, Catalog, assay, rnd

catalog = Catalog()
add = catalog.add

LOGS = "logs AS (SELECT feature_id, sample_id, log10(1 + value) AS x FROM cells WHERE value <> 0)"
PAIRED = "p AS (SELECT a.sample_id AS a, b.sample_id AS b, a.x, b.x AS y FROM logs a JOIN logs b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id)"


@add(
    "compare_pearson_matrix",
    f"WITH {CELLS}, {LOGS}, {PAIRED} SELECT a, b, count(*) AS n, {R('corr(x, y)')} AS r FROM p GROUP BY a, b",
)
def pearson_matrix(spark, sf):
    return cmp.corr_matrix(assay(spark, sf)).withColumn("r", rnd(F.col("r")))


@add(
    "compare_spearman_matrix",
    f"""WITH {CELLS}, {LOGS}, {PAIRED}, k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM p)
SELECT a, b, count(*) AS n, {R('corr(rx, ry)')} AS r FROM k GROUP BY a, b""",
)
def spearman_matrix(spark, sf):
    return cmp.spearman_matrix(assay(spark, sf)).withColumn("r", rnd(F.col("r")))


@add(
    "compare_corr_distances",
    f"""WITH {CELLS}, {LOGS}, {PAIRED}, c AS (SELECT a, b, corr(x, y) AS r FROM p GROUP BY a, b)
SELECT a, b, 'one_minus_r' AS kind, {R('1 - r')} AS distance FROM c UNION ALL SELECT a, b, 'sqrt', {R('sqrt(2 * (1 - r))')} FROM c""",
)
def corr_distances(spark, sf):
    c = cmp.corr_matrix(assay(spark, sf))
    both = None
    for kind in ("one_minus_r", "sqrt"):
        one = cmp.corr_distance(c, kind).select("a", "b", F.lit(kind).alias("kind"), rnd(F.col("distance")).alias("distance"))
        both = one if both is None else both.unionByName(one)
    return both


@add(
    "compare_zscored_distance",
    f"""WITH {CELLS}, {LOGS}, z AS (SELECT feature_id, sample_id, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM logs
  WINDOW w AS (PARTITION BY sample_id)),
p AS (SELECT a.sample_id AS a, b.sample_id AS b, a.x, b.x AS y FROM z a JOIN z b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id)
SELECT a, b, count(*) AS n, {R('sqrt(sum((x - y) ** 2))')} AS distance FROM p GROUP BY a, b""",
)
def zscored_distance(spark, sf):
    return cmp.zscored_distance(assay(spark, sf)).withColumn("distance", rnd(F.col("distance")))


FILLED = f"""WITH {CELLS}, {SAMPLES}, {DENSE}, f AS (SELECT feature_id, sample_id, coalesce(log10(1 + value), 0) AS x FROM dense),
p AS (SELECT a.sample_id AS a, b.sample_id AS b, a.x, b.x AS y FROM f a JOIN f b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id)"""


@add(
    "compare_distances_filled",
    f"""{FILLED}, d AS (SELECT a, b, sqrt(sum((x - y) ** 2)) AS euclidean, sum(abs(x - y)) AS manhattan, 1 - corr(x, y) AS correlation,
  1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cosine, sum(abs(x - y)) / sum(x + y) AS bray_curtis FROM p GROUP BY a, b)
SELECT a, b, metric, {R('distance', 5)} AS distance FROM d UNPIVOT (distance FOR metric IN (euclidean, manhattan, correlation, cosine, bray_curtis))""",
)
def distances_filled(spark, sf):
    a = assay(spark, sf)
    logs = a.with_cells(a.cells.withColumn("value", F.log10(1 + F.col("value"))))
    out = None
    for metric in ("euclidean", "manhattan", "correlation", "cosine", "bray_curtis"):
        one = cmp.pair_distance(logs, metric).select("a", "b", F.lit(metric).alias("metric"), rnd(F.col("distance"), 5).alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out


@add(
    "compare_shared_distances",
    f"""WITH {CELLS}, {LOGS}, {PAIRED}, d AS (SELECT a, b, count(*) AS n, sqrt(sum((x - y) ** 2) / count(*)) AS euclidean, sum(abs(x - y)) / count(*) AS manhattan,
  1 - corr(x, y) AS pearson, 1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cosine FROM p GROUP BY a, b HAVING count(*) >= 10)
SELECT a, b, n, metric, {R('distance')} AS distance FROM d UNPIVOT (distance FOR metric IN (euclidean, manhattan, pearson, cosine))""",
)
def shared_distances(spark, sf):
    a = assay(spark, sf)
    index = pairs.index_samples(a.samples)
    entries = cmp.working_cells(a).join(a.per_sample(index), "sample_id")
    sums = pairs.pair_sums(entries, "feature_id", a.n_samples, extra=True).filter("i < j")
    out = None
    for metric in ("euclidean", "manhattan", "pearson", "cosine"):
        one = pairs.named(cmp.shared_distance(sums, metric, 10), index, "a", "b").withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("distance", rnd(F.col("distance")))


POINTS = """x AS (SELECT feature_id, x FROM logs WHERE sample_id = 'NATION_0'), y AS (SELECT feature_id, x AS y FROM logs WHERE sample_id = 'NATION_3'),
pts AS (SELECT feature_id, x, y FROM x JOIN y USING (feature_id))"""


def _points(spark, sf):
    return cmp.pair_points(assay(spark, sf), "NATION_0", "NATION_3")


@add("compare_pair_points", f"WITH {CELLS}, {LOGS}, {POINTS} SELECT feature_id, {R('x')} AS x, {R('y')} AS y FROM pts")
def pair_points(spark, sf):
    return _points(spark, sf).select("feature_id", rnd(F.col("x")).alias("x"), rnd(F.col("y")).alias("y"))


@add(
    "compare_qq",
    f"""WITH {CELLS}, {LOGS}, {POINTS}, a AS (SELECT row_number() OVER (ORDER BY x, feature_id) AS rank, x FROM pts),
b AS (SELECT row_number() OVER (ORDER BY y, feature_id) AS rank, y FROM pts) SELECT rank, {R('x')} AS x, {R('y')} AS y FROM a JOIN b USING (rank)""",
)
def qq(spark, sf):
    return cmp.qq(_points(spark, sf)).select("rank", rnd(F.col("x")).alias("x"), rnd(F.col("y")).alias("y"))


@add(
    "compare_bland_altman",
    f"""WITH {CELLS}, {LOGS}, {POINTS}, d AS (SELECT y - x AS diff FROM pts)
SELECT count(*) AS n, {R('avg(diff)')} AS bias, {R('stddev_samp(diff)')} AS sd, {R('avg(diff) - 1.96 * stddev_samp(diff)')} AS low,
{R('avg(diff) + 1.96 * stddev_samp(diff)')} AS high FROM d""",
)
def bland_altman(spark, sf):
    out = cmp.agreement(cmp.bland_altman(_points(spark, sf)))
    return out.select("n", *[rnd(F.col(c)).alias(c) for c in ("bias", "sd", "low", "high")])


@add(
    "compare_bland_altman_ratio",
    f"""WITH {CELLS}, logs AS (SELECT feature_id, sample_id, value AS x FROM cells), {POINTS}
SELECT feature_id, {R('sqrt(x * y)', 4)} AS mean, {R('log2(y / x)')} AS diff FROM pts WHERE x > 0 AND y > 0""",
)
def bland_altman_ratio(spark, sf):
    pts = cmp.pair_points(assay(spark, sf), "NATION_0", "NATION_3", transform="none")
    out = cmp.bland_altman(pts, "ratio")
    return out.select("feature_id", rnd(F.col("mean"), 4).alias("mean"), rnd(F.col("diff")).alias("diff"))


@add(
    "compare_corr_to",
    f"""WITH {CELLS}, {LOGS} SELECT b.sample_id, count(*) AS n, {R('corr(a.x, b.x)')} AS r FROM logs a JOIN logs b USING (feature_id)
WHERE a.sample_id = 'NATION_0' AND b.sample_id <> 'NATION_0' GROUP BY 1""",
)
def corr_to(spark, sf):
    return cmp.corr_to(assay(spark, sf), "NATION_0").withColumn("r", rnd(F.col("r")))


METRICS = f"""WITH {CELLS}, {SAMPLES}, {LOGS}, {PAIRED}, c AS (SELECT a, b, corr(x, y) AS r FROM p GROUP BY a, b),
mr AS (SELECT s, avg(r) AS mean_r FROM (SELECT a AS s, r FROM c UNION ALL SELECT b, r FROM c) GROUP BY s),
mo AS (SELECT sample_id, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd FROM logs GROUP BY 1),
sk AS (SELECT sample_id, avg(((x - m) / sd) ** 3) AS skew FROM logs JOIN mo USING (sample_id) GROUP BY 1),
metrics AS (SELECT sample_id, 1 - count(*) / (SELECT count(DISTINCT feature_id) FROM cells) AS missing, median(x) AS median,
  quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, any_value(skew) AS skew, any_value(mean_r) AS mean_r
  FROM logs JOIN sk USING (sample_id) JOIN mr ON s = sample_id GROUP BY 1)"""


@add(
    "compare_outlier_metrics",
    f"""{METRICS} SELECT sample_id, {R('missing')} AS missing, {R('median')} AS median, {R('iqr')} AS iqr, {R('skew')} AS skew,
{R('mean_r')} AS mean_r FROM metrics""",
)
def outlier_metrics(spark, sf):
    out = cmp.outlier_metrics(assay(spark, sf))
    return out.select("sample_id", *[rnd(F.col(c)).alias(c) for c in ("missing", "median", "iqr", "skew", "mean_r")])


def _z(c: str) -> str:
    return (
        f"0.6745 * ({c} - (SELECT median({c}) FROM metrics)) / "
        f"(SELECT median(abs({c} - (SELECT median({c}) FROM metrics))) FROM metrics) AS z_{c}"
    )


@add(
    "compare_outliers",
    f"""{METRICS}, z AS (SELECT sample_id, {', '.join(_z(c) for c in ('missing', 'median', 'iqr', 'skew', 'mean_r'))} FROM metrics)
SELECT sample_id, {', '.join(f"{R('z_' + c, 5)} AS z_{c}" for c in ('missing', 'median', 'iqr', 'skew', 'mean_r'))},
(z_missing > 2.5)::INT + (abs(z_median) > 2.5)::INT + (abs(z_iqr) > 2.5)::INT + (abs(z_skew) > 2.5)::INT + (z_mean_r < -2.5)::INT AS n_flags,
{R('greatest(abs(z_missing), abs(z_median), abs(z_iqr), abs(z_skew), abs(z_mean_r))', 5)} AS score,
(z_missing > 2.5)::INT + (abs(z_median) > 2.5)::INT + (abs(z_iqr) > 2.5)::INT + (abs(z_skew) > 2.5)::INT + (z_mean_r < -2.5)::INT >= 1 AS outlier
FROM z""",
)
def outliers(spark, sf):
    out = cmp.outliers(cmp.outlier_metrics(assay(spark, sf)), threshold=2.5, min_flags=1)
    zs = [rnd(F.col(f"z_{c}"), 5).alias(f"z_{c}") for c in ("missing", "median", "iqr", "skew", "mean_r")]
    return out.select("sample_id", *zs, "n_flags", rnd(F.col("score"), 5).alias("score"), "outlier")


SIGS = f"""WITH {CELLS}, sig AS (SELECT feature_id, list_sort(list(sample_id)) AS members FROM cells WHERE value <> 0 GROUP BY 1),
s AS (SELECT members, count(*) AS n FROM sig GROUP BY 1)"""


@add("sets_signatures", f"{SIGS} SELECT array_to_string(members, ',') AS members, n FROM s")
def signatures(spark, sf):
    sigs = sets.signatures(sets.presence(assay(spark, sf).cells))
    return sigs.select(F.concat_ws(",", "members").alias("members"), "n")


@add("sets_presence_threshold", f"WITH {CELLS} SELECT feature_id, sample_id FROM cells WHERE value > 100000")
def presence_threshold(spark, sf):
    return sets.presence(assay(spark, sf).cells, 100000)


@add(
    "sets_top_intersections",
    f"""WITH {CELLS}, e AS (SELECT feature_id, sample_id AS s FROM cells WHERE value <> 0),
i1 AS (SELECT [s] AS m, count(*) AS n FROM e GROUP BY s),
i2 AS (SELECT [a.s, b.s] AS m, count(*) AS n FROM e a JOIN e b ON a.feature_id = b.feature_id AND a.s < b.s GROUP BY a.s, b.s),
i3 AS (SELECT [a.s, b.s, c.s] AS m, count(*) AS n FROM e a JOIN e b ON a.feature_id = b.feature_id AND a.s < b.s
  JOIN e c ON c.feature_id = a.feature_id AND b.s < c.s GROUP BY a.s, b.s, c.s),
u AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2 UNION ALL SELECT * FROM i3)
SELECT array_to_string(m, ',') AS members, len(m)::INT AS degree, n FROM u ORDER BY n DESC, len(m), m LIMIT 100""",
)
def top_intersections(spark, sf):
    a = assay(spark, sf)
    names = [r[0] for r in a.samples.select("sample_id").collect()]
    out = sets.top_intersections(sets.presence(a.cells), names, max_members=3)
    return out.select(F.concat_ws(",", "members").alias("members"), "degree", "n")


@add(
    "sets_unions",
    f"""WITH {CELLS}, {SAMPLES}, e AS (SELECT feature_id, sample_id AS s FROM cells WHERE value <> 0), c AS (SELECT s, count(*) AS n FROM e GROUP BY s),
p AS (SELECT a.s AS a, b.s AS b, count(*) AS n FROM e a JOIN e b ON a.feature_id = b.feature_id AND a.s < b.s GROUP BY 1, 2),
u AS (SELECT s AS members, 1 AS degree, n FROM c UNION ALL
  SELECT a.s || ',' || b.s, 2, a.n + b.n - coalesce(p.n, 0) FROM c a JOIN c b ON a.s < b.s LEFT JOIN p ON p.a = a.s AND p.b = b.s)
SELECT members, degree::INT AS degree, n FROM u""",
)
def unions(spark, sf):
    a = assay(spark, sf)
    names = [r[0] for r in a.samples.select("sample_id").collect()]
    out = sets.unions(sets.presence(a.cells), names, 1, 2)
    return out.select(F.concat_ws(",", "members").alias("members"), "degree", "n")


@add(
    "sets_display_order",
    f"{SIGS} SELECT array_to_string(members, ',') AS members, len(members)::INT AS degree, n FROM s WHERE len(members) >= 2 ORDER BY n DESC, len(members), members LIMIT 50",
)
def display_order(spark, sf):
    out = sets.display_order(sets.signatures(sets.presence(assay(spark, sf).cells)), 50, min_members=2)
    return out.select(F.concat_ws(",", "members").alias("members"), "degree", "n")


GROUP_SETS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")


@add(
    "sets_regions",
    f"""WITH {CELLS}, {SAMPLES}, g AS (SELECT feature_id, {', '.join(f"bool_or(grp = '{g}') AS {g}" for g in GROUP_SETS)}
  FROM cells JOIN samples USING (sample_id) WHERE value > 60000 AND grp IN {GROUP_SETS} GROUP BY 1),
grid AS (SELECT * FROM {' CROSS JOIN '.join(f"(VALUES (true), (false)) t{g}({g})" for g in GROUP_SETS)})
SELECT grid.*, count(g.feature_id) AS n FROM grid LEFT JOIN g USING ({', '.join(GROUP_SETS)})
WHERE {' OR '.join('grid.' + g for g in GROUP_SETS)} GROUP BY ALL""",
)
def regions(spark, sf):
    a = assay(spark, sf)
    grouped = a.cells.join(a.per_sample(a.samples), "sample_id").select("feature_id", F.col("grp").alias("sample_id"), "value")
    return sets.regions(sets.presence(grouped, 60000), list(GROUP_SETS))


@add(
    "sets_in_all",
    f"""WITH {CELLS}, {SAMPLES} SELECT feature_id, count(DISTINCT grp) AS n_sets FROM cells JOIN samples USING (sample_id)
WHERE value <> 0 GROUP BY 1 HAVING count(DISTINCT grp) = (SELECT count(DISTINCT grp) FROM samples)""",
)
def in_all(spark, sf):
    a = assay(spark, sf)
    grouped = a.cells.join(a.per_sample(a.samples), "sample_id").select("feature_id", F.col("grp").alias("sample_id"), "value")
    n = a.samples.agg(F.count_distinct("grp")).scalar()
    return sets.in_all(sets.presence(grouped), n)
