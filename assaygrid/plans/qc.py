"""Queries over the quality-control operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.operators import qc
from assaygrid.plans.bind import CELLS, FEATURES, R, SAMPLES, Catalog, assay, rnd

catalog = Catalog()
add = catalog.add


@add(
    "qc_sample_stats",
    f"""WITH {CELLS}, {SAMPLES}
SELECT s.sample_id, count(c.value) AS n_quantified,
  {R('quantile_cont(log10(1 + value), 0.25)')} AS q1, {R('median(log10(1 + value))')} AS median,
  {R('quantile_cont(log10(1 + value), 0.75)')} AS q3, {R('min(log10(1 + value))')} AS min,
  {R('max(log10(1 + value))')} AS max, {R('sum(log10(1 + value))', 4)} AS total_log
FROM samples s LEFT JOIN cells c ON c.sample_id = s.sample_id AND c.value > 0 GROUP BY s.sample_id""",
)
def sample_stats(spark, sf):
    df = qc.sample_stats(assay(spark, sf))
    cols = [rnd(F.col(c)).alias(c) for c in ("q1", "median", "q3", "min", "max")]
    return df.select("sample_id", "n_quantified", *cols, rnd(F.col("total_log"), 4).alias("total_log"))


@add(
    "qc_matrix_stats",
    f"""WITH {CELLS}, {SAMPLES}
SELECT count(DISTINCT feature_id) AS n_features, (SELECT count(*) FROM samples) AS n_samples,
  count(DISTINCT feature_id) * (SELECT count(*) FROM samples) AS n_cells,
  count(*) FILTER (WHERE value > 0) AS n_quantified FROM cells""",
)
def matrix_stats(spark, sf):
    return qc.matrix_stats(assay(spark, sf))


@add(
    "qc_column_metrics",
    f"""WITH {CELLS}, {SAMPLES}, m AS (
  SELECT sample_id, count(*) FILTER (WHERE value > 0)::DOUBLE AS n, avg(value) AS raw, avg(log2(1 + value)) AS tf,
    avg((value > 0)::INT) AS rate FROM cells GROUP BY sample_id)
SELECT sample_id, 'count' AS name, {R('n')} AS metric FROM m UNION ALL
SELECT sample_id, 'mean_raw', {R('raw', 4)} FROM m UNION ALL
SELECT sample_id, 'mean_transformed', {R('tf')} FROM m UNION ALL
SELECT sample_id, 'detection_rate', {R('rate')} FROM m""",
)
def column_metrics(spark, sf):
    a = assay(spark, sf)
    out = None
    for name, digits in (("count", 6), ("mean_raw", 4), ("mean_transformed", 6), ("detection_rate", 6)):
        one = qc.column_metric(a, name, "log2p1").select(
            "sample_id", F.lit(name).alias("name"), rnd(F.col("metric"), digits).alias("metric")
        )
        out = one if out is None else out.unionByName(one)
    return out


@add(
    "qc_missing_stats",
    f"""WITH {CELLS}, {SAMPLES}, n AS (SELECT count(DISTINCT feature_id) AS nf, (SELECT count(*) FROM samples) AS ns FROM cells)
SELECT 'total' AS level, 'all' AS id, nf * ns - (SELECT count(*) FROM cells WHERE value <> 0) AS n_missing, nf * ns AS n_total FROM n
UNION ALL SELECT 'sample', s.sample_id, (SELECT nf FROM n) - count(c.value), (SELECT nf FROM n)
FROM samples s LEFT JOIN cells c ON s.sample_id = c.sample_id AND value <> 0 GROUP BY s.sample_id
UNION ALL SELECT 'feature', feature_id::VARCHAR, (SELECT ns FROM n) - count(*) FILTER (WHERE value <> 0), (SELECT ns FROM n)
FROM cells GROUP BY feature_id""",
)
def missing_stats(spark, sf):
    return qc.missing_stats(assay(spark, sf))


@add(
    "qc_top_rows",
    f"""WITH {CELLS} SELECT feature_id, {R('sum(value)', 2)} AS total FROM cells GROUP BY feature_id
ORDER BY sum(value) DESC, feature_id LIMIT 10""",
)
def top_rows(spark, sf):
    return qc.top_rows(assay(spark, sf)).withColumn("total", rnd(F.col("total"), 2))


@add(
    "qc_composition",
    f"""WITH {CELLS}, {FEATURES}, kept AS (
  SELECT c.* FROM cells c JOIN features f USING (feature_id) WHERE kind <> 'ECONOMY')
SELECT feature_id, sample_id, {R('value / sum(value) OVER (PARTITION BY sample_id)', 8)} AS share FROM kept""",
)
def composition(spark, sf):
    a = assay(spark, sf, features=True)
    shares = qc.composition(a, exclude=a.features.filter("kind = 'ECONOMY'"), chosen=a.features)
    return shares.select("feature_id", "sample_id", rnd(F.col("share"), 8).alias("share"))


@add(
    "qc_zscore_rows",
    f"""WITH {CELLS}, s AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n
  FROM cells WINDOW w AS (PARTITION BY feature_id))
SELECT feature_id, sample_id, CASE WHEN n > 1 AND sd > 0 THEN {R('(value - m) / sd')} ELSE 0.0 END AS z FROM s""",
)
def zscore_rows(spark, sf):
    z = qc.zscore_rows(assay(spark, sf).cells)
    return z.select("feature_id", "sample_id", rnd(F.col("z")).alias("z"))


@add(
    "qc_ranked_intensity",
    f"""WITH {CELLS} SELECT feature_id, sample_id, {R('log10(1 + value)')} AS value,
  row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, feature_id) AS rank FROM cells""",
)
def ranked_intensity(spark, sf):
    return qc.ranked_intensity(assay(spark, sf), log=True).withColumn("value", rnd(F.col("value")))


@add(
    "qc_cumulative_pct",
    f"""WITH {CELLS} SELECT feature_id, sample_id, row_number() OVER w AS rank,
  {R('100 * sum(value) OVER w / sum(value) OVER (PARTITION BY sample_id)')} AS cum_pct FROM cells
WINDOW w AS (PARTITION BY sample_id ORDER BY value DESC, feature_id ROWS UNBOUNDED PRECEDING)""",
)
def cumulative_pct(spark, sf):
    return qc.cumulative_pct(assay(spark, sf)).withColumn("cum_pct", rnd(F.col("cum_pct")))


@add(
    "qc_top_with_other",
    f"""WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, feature_id) AS rn FROM cells)
SELECT sample_id, CASE WHEN rn <= 20 THEN feature_id::VARCHAR ELSE 'Other' END AS label, {R('sum(value)', 2)} AS value
FROM r GROUP BY 1, 2""",
)
def top_with_other(spark, sf):
    return qc.top_with_other(assay(spark, sf), 20).withColumn("value", rnd(F.col("value"), 2))


@add(
    "qc_contaminant_share",
    f"""WITH {CELLS}, acc AS (SELECT p_partkey AS feature_id, CASE WHEN p_size <= 5 THEN 'Cont_' WHEN p_size = 6 THEN 'CON__' ELSE 'P' END
  || p_partkey AS accession FROM part)
SELECT sample_id, {R("100 * sum(CASE WHEN accession LIKE 'Cont!_%' ESCAPE '!' OR accession LIKE 'CON!_!_%' ESCAPE '!' THEN value ELSE 0 END) / sum(value)")} AS pct
FROM cells JOIN acc USING (feature_id) GROUP BY sample_id""",
)
def contaminant_share(spark, sf):
    from assaygrid.operators.meta import is_contaminant

    a = assay(spark, sf, features=True)
    prefix = F.when(F.col("size") <= 5, "Cont_").when(F.col("size") == 6, "CON__").otherwise("P")
    with_accession = a.features.withColumn("accession", F.concat(prefix, F.col("feature_id").cast("string")))
    shares = qc.contaminant_share(type(a)(a.cells, a.samples, with_accession), is_contaminant(F.col("accession")))
    return shares.select("sample_id", rnd(F.col("pct")).alias("pct"))


@add(
    "qc_histogram",
    f"""WITH {CELLS} SELECT sample_id, least(floor((log10(1 + value) - 3) / 0.25), 11)::BIGINT AS bin, count(*) AS n,
  3 + least(floor((log10(1 + value) - 3) / 0.25), 11) * 0.25::DOUBLE AS bin_start
FROM cells WHERE log10(1 + value) BETWEEN 3 AND 6 GROUP BY 1, 2, 4""",
)
def histogram(spark, sf):
    logs = assay(spark, sf).observed("positive", F.log10(1 + F.col("value")))
    return qc.histogram(logs, "value", 3.0, 6.0, 0.25, ("sample_id",))


@add(
    "qc_kde",
    f"""WITH {CELLS}, v AS (SELECT sample_id, log10(1 + value) AS x FROM cells),
sp AS (SELECT sample_id, count(*) AS n, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, list_sort(list(x)) AS l FROM v GROUP BY sample_id),
bw AS (SELECT *, 0.9 * least(sd, (l[floor(0.75 * (n - 1))::INT + 1] - l[floor(0.25 * (n - 1))::INT + 1]) / 1.34) * n ** -0.2 AS h FROM sp),
g AS (SELECT *, p AS point, lo - 2.5 * h + (hi - lo + 5 * h) * p / 31 AS gx FROM bw, range(32) t(p))
SELECT g.sample_id, point::INT AS point, {R('gx')} AS x, {R('sum(exp(-0.5 * ((gx - x) / h) ** 2)) / (any_value(n) * any_value(h))')} AS density
FROM g JOIN v ON g.sample_id = v.sample_id GROUP BY g.sample_id, point, gx""",
)
def kde(spark, sf):
    a = assay(spark, sf)
    logs = a.observed("positive", F.log10(1 + F.col("value")))
    out = qc.kde(logs, "value", 32, ["sample_id"], a.n_samples)
    return out.select("sample_id", "point", rnd(F.col("x")).alias("x"), rnd(F.col("density")).alias("density"))


@add(
    "qc_abs_max",
    f"""WITH {CELLS} SELECT 'table' AS level, 'all' AS id, max(abs(value)) AS abs_max FROM cells
UNION ALL SELECT 'sample', sample_id, max(abs(value)) FROM cells GROUP BY sample_id
UNION ALL SELECT 'feature', feature_id::VARCHAR, max(abs(value)) FROM cells GROUP BY feature_id""",
)
def abs_max(spark, sf):
    return qc.abs_max(assay(spark, sf).cells)
