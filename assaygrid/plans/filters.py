"""Queries over the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.operators import filters as flt
from assaygrid.plans.bind import CELLS, FEATURES, R, SAMPLES, Catalog, assay, part_features, rnd, samples

catalog = Catalog()
add = catalog.add

GROUP_COUNTS = f"""WITH {CELLS}, {SAMPLES}, sizes AS (SELECT grp, count(*) AS size FROM samples GROUP BY grp),
part_in AS (SELECT * FROM sizes WHERE size >= 2),
per AS (SELECT feature_id, s.grp, z.size, count(*) FILTER (WHERE value > 0) AS v
  FROM cells c JOIN samples s USING (sample_id) JOIN part_in z ON z.grp = s.grp GROUP BY 1, 2, 3),
per_row AS (SELECT f.feature_id, coalesce(sum(v), 0)::BIGINT AS n_valid, count(*) FILTER (WHERE v >= ceil(size * 60 / 100)) AS n_ok
  FROM (SELECT DISTINCT feature_id FROM cells) f LEFT JOIN per USING (feature_id) GROUP BY 1)"""


@add(
    "filter_valid_total",
    f"""WITH {CELLS}, {SAMPLES}, n AS (SELECT feature_id, count(*) FILTER (WHERE value > 0) AS n_valid FROM cells GROUP BY 1),
v AS (SELECT *, n_valid >= ceil((SELECT count(*) FROM samples) * 70 / 100) AS passed FROM n)
SELECT feature_id, n_valid, passed, CASE WHEN NOT passed THEN 'too few valid values (total)' END AS reason FROM v""",
)
def valid_total(spark, sf):
    return flt.valid_rows(assay(spark, sf), pct=70)


@add(
    "filter_valid_each_group",
    f"""{GROUP_COUNTS}, v AS (SELECT *, n_ok = (SELECT count(*) FROM part_in) AS passed FROM per_row)
SELECT feature_id, n_valid, passed, CASE WHEN NOT passed THEN 'too few valid values (each)' END AS reason FROM v""",
)
def valid_each(spark, sf):
    return flt.valid_rows(assay(spark, sf), pct=60, scope="each", by=["grp"])


@add(
    "filter_valid_any_group",
    f"""{GROUP_COUNTS}, v AS (SELECT *, n_ok >= 1 AS passed FROM per_row)
SELECT feature_id, n_valid, passed, CASE WHEN NOT passed THEN 'too few valid values (any)' END AS reason FROM v""",
)
def valid_any(spark, sf):
    return flt.valid_rows(assay(spark, sf), pct=60, scope="any", by=["grp"])


@add(
    "filter_group_completeness",
    f"""WITH {CELLS}, {SAMPLES}, sizes AS (SELECT grp, count(*) AS size FROM samples GROUP BY grp),
v AS (SELECT c.*, z.size, count(*) OVER (PARTITION BY c.feature_id, s.grp) AS v
  FROM cells c JOIN samples s USING (sample_id) JOIN sizes z ON z.grp = s.grp),
z AS (SELECT feature_id, sample_id, CASE WHEN size >= 2 AND v < ceil(size * 75 / 100) THEN 0 ELSE value END AS value FROM v)
SELECT * FROM z WHERE feature_id IN (SELECT feature_id FROM z GROUP BY 1 HAVING max(value) > 0)""",
)
def group_completeness(spark, sf):
    return flt.group_completeness(assay(spark, sf), ["grp"], pct=75).cells


TECH = f"""WITH {CELLS}, {SAMPLES}, bundles AS (SELECT sample_id, grp || ' | ' || batch AS b FROM samples),
sizes AS (SELECT b, count(*) AS size FROM bundles GROUP BY b),
v AS (SELECT c.*, z.size, count(*) OVER (PARTITION BY c.feature_id, s.b) AS v
  FROM cells c JOIN bundles s USING (sample_id) JOIN sizes z ON z.b = s.b),
z AS (SELECT feature_id, sample_id, CASE WHEN size >= 2 AND v < size THEN 0 ELSE value END AS value FROM v)
SELECT * FROM z WHERE feature_id IN (SELECT feature_id FROM z GROUP BY 1 HAVING max(value) > 0)"""


@add("filter_tech_repro", TECH)
def tech_repro(spark, sf):
    return flt.tech_repro(assay(spark, sf), ["grp", "batch"]).cells


@add("filter_tech_repro_strict", TECH)
def tech_repro_strict(spark, sf):
    from pyspark.sql import Window

    a = assay(spark, sf)
    n = F.row_number().over(Window.partitionBy("grp", "batch").orderBy("sample_id"))
    labelled = a.samples.withColumn("tech", F.concat(F.lit("T"), n.cast("string")))
    return flt.tech_repro(type(a)(a.cells, labelled), ["grp", "batch"], strict="tech").cells


@add(
    "filter_cv",
    f"""WITH {CELLS}, s AS (SELECT feature_id, stddev_samp(value) / avg(value) AS cv FROM cells WHERE value > 0 GROUP BY 1)
SELECT feature_id, {R('cv')} AS cv, coalesce(cv >= 0.2, false) AS passed FROM s""",
)
def cv_filter(spark, sf):
    return flt.cv_filter(assay(spark, sf)).withColumn("cv", rnd(F.col("cv")))


@add(
    "filter_row_id",
    """SELECT p_partkey AS feature_id, p_name AS name FROM part
WHERE lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%ring%'""",
)
def row_id(spark, sf):
    return flt.id_filter(part_features(spark, sf).select("feature_id", "name"), "RED|Ring", col="name")


@add("filter_row_id_regex", "SELECT p_partkey AS feature_id FROM part WHERE regexp_matches(p_partkey::VARCHAR, '^1[0-9]*5$')")
def row_id_regex(spark, sf):
    return flt.id_filter(part_features(spark, sf).select("feature_id"), "^1[0-9]*5$", "regex")


@add(
    "filter_random_rows",
    f"""WITH {CELLS} SELECT feature_id FROM (SELECT DISTINCT feature_id FROM cells)
ORDER BY md5('7|' || feature_id) LIMIT 100""",
)
def random_rows(spark, sf):
    return flt.sample_rows(assay(spark, sf), 100, seed=7)


@add(
    "filter_select_samples",
    f"""WITH {CELLS} SELECT sample_id, count(*) AS n FROM cells
WHERE sample_id = 'NATION_3' OR regexp_matches(sample_id, '_1[0-9]$') GROUP BY 1""",
)
def select_samples(spark, sf):
    kept = flt.select_samples(assay(spark, sf), ["NATION_3"], "_1[0-9]$", "regex")
    return kept.cells.groupBy("sample_id").agg(F.count("*").alias("n"))


@add(
    "filter_select_groups",
    f"""WITH {CELLS}, {SAMPLES} SELECT s.sample_id, grp, batch, count(value) AS n FROM samples s LEFT JOIN cells USING (sample_id)
WHERE (grp = 'ASIA' AND batch = 'B0') OR (grp = 'EUROPE' AND batch = 'B1') GROUP BY 1, 2, 3""",
)
def select_groups(spark, sf):
    kept = flt.select_groups(assay(spark, sf), ["grp", "batch"], ["ASIA | B0", "EUROPE | B1"])
    return (
        kept.samples.join(kept.cells, "sample_id", "left")
        .groupBy("sample_id", "grp", "batch")
        .agg(F.count("value").alias("n"))
    )


@add(
    "filter_valid_columns",
    f"""WITH {CELLS}, {SAMPLES}, n AS (SELECT s.sample_id, count(value) AS n_valid FROM samples s LEFT JOIN cells USING (sample_id) GROUP BY 1)
SELECT sample_id, n_valid, n_valid >= ceil((SELECT count(DISTINCT feature_id) FROM cells) * 65 / 100) AS passed FROM n""",
)
def valid_columns(spark, sf):
    return flt.valid_cols(assay(spark, sf), pct=65)


@add(
    "filter_valid_columns_grouped",
    f"""WITH {CELLS}, {SAMPLES}, {FEATURES}, sizes AS (SELECT kind, count(*) AS size FROM features GROUP BY 1),
p AS (SELECT sample_id, kind, count(*) AS v FROM cells JOIN features USING (feature_id) GROUP BY 1, 2),
o AS (SELECT sample_id, sum(v)::BIGINT AS n_valid, count(*) FILTER (WHERE v >= ceil(size * 60 / 100)) AS n_ok
  FROM p JOIN sizes USING (kind) GROUP BY 1)
SELECT sample_id, coalesce(n_valid, 0) AS n_valid, coalesce(n_ok, 0) = (SELECT count(*) FROM sizes) AS passed
FROM samples LEFT JOIN o USING (sample_id)""",
)
def valid_columns_grouped(spark, sf):
    return flt.valid_cols(assay(spark, sf, features=True), pct=60, feature_group="kind")


@add(
    "filter_annotations",
    """SELECT p_partkey AS feature_id, p_brand AS brand, p_size AS size FROM part
WHERE p_size BETWEEN 10 AND 30 AND regexp_matches(p_brand, '#1[0-5]$')
  AND (lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%')""",
)
def annotations(spark, sf):
    criteria = [
        {"column": "size", "min": 10, "max": 30},
        {"column": "brand", "pattern": "#1[0-5]$", "mode": "regex"},
        {"column": None, "pattern": "ring"},
    ]
    return flt.annotation_filter(part_features(spark, sf), criteria).select("feature_id", "brand", "size")


SITES = """sites AS (SELECT p_partkey AS feature_id, CASE p_size % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'T' ELSE 'Y' END AS residue,
  CASE WHEN p_size % 2 = 0 THEN p_size || ';' || (p_size + 7) ELSE p_size::VARCHAR END AS positions FROM part)"""


@add("filter_class1_sites", f"WITH {SITES} SELECT * FROM sites WHERE positions NOT LIKE '%;%' AND residue = 'T'")
def class1_sites(spark, sf):
    f, size = part_features(spark, sf), F.col("size")
    residue = F.when(size % 3 == 0, "S").when(size % 3 == 1, "T").otherwise("Y")
    both = F.concat_ws(";", size.cast("string"), (size + 7).cast("string"))
    positions = F.when(size % 2 == 0, both).otherwise(size.cast("string"))
    sites = f.select("feature_id", residue.alias("residue"), positions.alias("positions"))
    return flt.site_filter(sites, "positions", "t")


@add(
    "filter_summary",
    f"""WITH {CELLS}, {SAMPLES}, r AS (SELECT feature_id, 1 - count(*) / (SELECT count(*) FROM samples) AS sp,
  stddev_samp(value) / avg(value) AS cv, count(*) AS n FROM cells GROUP BY 1),
b AS (SELECT 'before' AS stage, * FROM r UNION ALL SELECT 'after', * FROM r WHERE n >= ceil((SELECT count(*) FROM samples) * 70 / 100))
SELECT stage, count(*) AS n_rows, {R('avg(sp)')} AS sparsity_mean, {R('median(sp)')} AS sparsity_median, {R('avg(cv)')} AS cv_mean FROM b GROUP BY 1""",
)
def summary(spark, sf):
    a = assay(spark, sf)
    after = flt.keep_rows(a, flt.valid_rows(a, pct=70).filter("passed"))
    out = flt.filter_summary(a, after)
    return out.select("stage", "n_rows", *[rnd(F.col(c)).alias(c) for c in ("sparsity_mean", "sparsity_median", "cv_mean")])


@add(
    "filter_cv_histogram",
    f"""WITH {CELLS}, {SAMPLES}, r AS (SELECT feature_id, least(stddev_samp(value) / avg(value), 2) AS cv, count(*) AS n FROM cells GROUP BY 1),
b AS (SELECT 'before' AS stage, cv FROM r UNION ALL SELECT 'after', cv FROM r WHERE n >= ceil((SELECT count(*) FROM samples) * 70 / 100))
SELECT stage, least(floor(cv / 0.1), 19)::BIGINT AS bin, count(*) AS n, {R('least(floor(cv / 0.1), 19) * 0.1')} AS bin_start FROM b WHERE cv IS NOT NULL GROUP BY 1, 2, 4""",
)
def cv_histogram(spark, sf):
    a = assay(spark, sf)
    after = flt.keep_rows(a, flt.valid_rows(a, pct=70).filter("passed"))
    return flt.cv_histogram(a, after).withColumn("bin_start", rnd(F.col("bin_start")))


@add(
    "filter_column_boxes",
    f"""WITH {CELLS}, {SAMPLES}, k AS (SELECT feature_id FROM cells GROUP BY 1 HAVING count(*) >= ceil((SELECT count(*) FROM samples) * 70 / 100)),
b AS (SELECT 'before' AS stage, * FROM cells UNION ALL SELECT 'after', * FROM cells WHERE feature_id IN (FROM k)), n AS (SELECT stage, count(DISTINCT feature_id) AS rows FROM b GROUP BY 1)
SELECT stage, sample_id, {R('count(*) / any_value(rows)')} AS completeness, {R('min(log10(1 + value))')} AS low, {R('quantile_cont(log10(1 + value), 0.25)')} AS q1,
{R('median(log10(1 + value))')} AS median, {R('quantile_cont(log10(1 + value), 0.75)')} AS q3, {R('max(log10(1 + value))')} AS high FROM b JOIN n USING (stage) GROUP BY 1, 2""",
)
def column_boxes(spark, sf):
    a = assay(spark, sf)
    after = flt.keep_rows(a, flt.valid_rows(a, pct=70).filter("passed"))
    out = flt.column_boxes(a, after)
    return out.select("stage", "sample_id", *[rnd(F.col(c)).alias(c) for c in ("completeness", "low", "q1", "median", "q3", "high")])


@add(
    "filter_search",
    """SELECT p_partkey AS feature_id, p_name AS name, p_retailprice AS price FROM part
WHERE lower(p_name) LIKE '%widget%' OR p_partkey::VARCHAR LIKE '%widget%' ORDER BY price DESC, feature_id LIMIT 25""",
)
def search(spark, sf):
    return flt.search(part_features(spark, sf).select("feature_id", "name", "price"), "Widget", "price", n=25)


@add(
    "filter_exclude_samples",
    f"""WITH {CELLS}, {SAMPLES} SELECT sample_id, count(*) AS n FROM cells WHERE sample_id NOT IN
(SELECT sample_id FROM samples WHERE grp = 'ASIA') GROUP BY 1""",
)
def exclude_samples(spark, sf):
    a = assay(spark, sf)
    kept = flt.exclude_samples(a, a.samples.filter("grp = 'ASIA'"))
    return kept.cells.groupBy("sample_id").agg(F.count("*").alias("n"))
