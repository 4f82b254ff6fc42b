"""Queries over gene-set enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.model import Assay
from assaygrid.operators import diff, enrich, gsva, joins
from assaygrid.plans.bind import CELLS, R, REGION_CELLS, SAMPLES, Catalog, assay, part_features, region_assay, rnd, table
from assaygrid.plans.diff import MOMENTS, WELCH, t_tail

catalog = Catalog()
add = catalog.add


def gene_sets(spark, sf):
    """Parts are genes; brands, sizes and types are the sets."""
    f = part_features(spark, sf)
    symbol = F.concat(F.lit("g"), F.col("feature_id").cast("string"))
    names = F.array("brand", F.concat(F.lit("SIZE_"), F.col("size").cast("string")), "kind")
    return f.select(F.explode(names).alias("set_name"), symbol.alias("symbol"))


SETS = """sets AS (SELECT unnest([p_brand, 'SIZE_' || p_size, p_type]) AS set_name, 'G' || p_partkey AS symbol, p_partkey AS feature_id FROM part)"""


def _named(df):
    return df.withColumn("symbol", F.concat(F.lit("g"), F.col("feature_id").cast("string")))


def _ranked(spark, sf):
    return _named(enrich.rank_from_matrix(assay(spark, sf), "grp", "AFRICA", "EUROPE", "log2fc")).select("symbol", "score")


RANKED = f"""ranked AS (SELECT 'G' || feature_id AS symbol, mean_b - mean_a AS score FROM mom WHERE n_a >= 2 AND n_b >= 2),
pl AS (SELECT *, row_number() OVER (ORDER BY score DESC, symbol) - 1 AS pos FROM ranked)"""
BASE = f"WITH {CELLS}, {SAMPLES}, {MOMENTS}, {RANKED}, {SETS}"
HITS = """hits AS (SELECT set_name, symbol, pos, abs(score) AS w FROM sets JOIN pl USING (symbol) QUALIFY count(*) OVER (PARTITION BY set_name) BETWEEN 15 AND 500)"""
ES = f"""{HITS}, run AS (SELECT *, sum(w) OVER o AS cum, sum(w) OVER (PARTITION BY set_name) AS nr, count(*) OVER (PARTITION BY set_name) AS nh, row_number() OVER o AS h FROM hits
  WINDOW o AS (PARTITION BY set_name ORDER BY pos)),
ev AS (SELECT *, cum / nr - (pos - h + 1) / ((SELECT count(*) FROM pl) - nh) AS aft, (cum - w) / nr - (pos - h + 1) / ((SELECT count(*) FROM pl) - nh) AS bef FROM run),
ex AS (SELECT set_name, max(nh) AS size, greatest(0, max(aft)) AS hi, least(0, min(bef)) AS lo, arg_max(pos, aft) AS top, arg_min(pos - 1, bef) AS bottom FROM ev GROUP BY 1),
es AS (SELECT set_name, size, CASE WHEN hi >= -lo THEN hi ELSE lo END AS es, CASE WHEN hi >= -lo THEN top ELSE bottom END AS peak FROM ex)"""


@add(
    "enrich_rank_from_matrix",
    f"""WITH {CELLS}, {SAMPLES}, {MOMENTS}, m AS (SELECT * FROM mom WHERE n_a >= 2 AND n_b >= 2), s AS (SELECT feature_id, mean_b - mean_a AS log2fc,
  (mean_b - mean_a) / nullif(sqrt(var_a / n_a + var_b / n_b), 0) AS t, (mean_b - mean_a) / nullif(sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)), 0) AS z,
  (mean_b - mean_a) / nullif(sqrt(var_a) + sqrt(var_b), 0) AS s2n FROM m)
SELECT feature_id, metric, {R('score', 5)} AS score FROM s UNPIVOT (score FOR metric IN (log2fc, t, z, s2n))""",
)
def rank_from_matrix(spark, sf):
    out = None
    for metric in ("log2fc", "t", "z", "s2n"):
        one = enrich.rank_from_matrix(assay(spark, sf), "grp", "AFRICA", "EUROPE", metric)
        one = one.select("feature_id", F.lit(metric).alias("metric"), rnd(F.col("score"), 5).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@add(
    "enrich_rank_from_diff",
    f"""{WELCH}, p AS (SELECT feature_id, mean_b - mean_a AS fc, {t_tail('t', 'df')} AS p FROM tt)
SELECT 'g' || feature_id AS symbol, {R('CASE WHEN fc < 0 THEN log10(p) ELSE -log10(p) END', 5)} AS score FROM p""",
)
def rank_from_diff(spark, sf):
    tests = diff.log2fc(diff.ttest(diff.group_moments(assay(spark, sf), "grp", "AFRICA", "EUROPE"), "welch").filter("t IS NOT NULL"))
    return enrich.rank_from_diff(_named(tests), "signed_p").withColumn("score", rnd(F.col("score"), 5))


@add("enrich_collapse", f"WITH {CELLS} SELECT 'G' || (feature_id % 300) AS symbol, arg_max(value - 40000, (abs(value - 40000), value)) AS score FROM cells GROUP BY 1")
def collapse(spark, sf):
    rows = assay(spark, sf).cells.select(F.concat(F.lit(" g"), (F.col("feature_id") % 300).cast("string")).alias("symbol"), (F.col("value") - 40000).alias("score"))
    return enrich.collapse(rows)


def _prepared(spark, sf):
    placed = enrich.positions(enrich.collapse(_ranked(spark, sf)))
    return placed, enrich.sized_hits(gene_sets(spark, sf), placed)


@add("enrich_gsea_es", f"{BASE}, {ES} SELECT set_name, size, {R('es')} AS es, peak FROM es")
def gsea_es(spark, sf):
    placed, hits = _prepared(spark, sf)
    return enrich.gsea_es(hits, placed).select("set_name", "size", rnd(F.col("es")).alias("es"), "peak")


@add("enrich_leading_edge", f"{BASE}, {ES} SELECT set_name, symbol, pos FROM hits JOIN es USING (set_name) WHERE CASE WHEN es >= 0 THEN pos <= peak ELSE pos >= peak END")
def leading_edge(spark, sf):
    placed, hits = _prepared(spark, sf)
    return enrich.leading_edge(hits, enrich.gsea_es(hits, placed))


@add(
    "enrich_gsea_curve",
    f"""{BASE}, {ES}, n AS (SELECT count(*) AS n FROM pl), one AS (SELECT * FROM hits WHERE set_name = 'Brand#1'),
spots AS (SELECT unnest(range(0, n, ceil(n / 100)::BIGINT)) AS pos FROM n UNION SELECT peak FROM es WHERE set_name = 'Brand#1' UNION SELECT n - 1 FROM n)
SELECT a.pos::BIGINT AS pos, {R('coalesce(sum(w), 0) / (SELECT sum(w) FROM one) - (a.pos + 1 - count(w)) / ((SELECT n FROM n) - (SELECT count(*) FROM one))')} AS value
FROM spots a LEFT JOIN one o ON o.pos <= a.pos GROUP BY a.pos""",
)
def gsea_curve(spark, sf):
    placed, hits = _prepared(spark, sf)
    out = enrich.gsea_curve(hits, enrich.gsea_es(hits, placed), placed, "Brand#1", 100)
    return out.withColumn("value", rnd(F.col("value")))


@add("enrich_gsea")
def gsea(spark, sf):
    return enrich.gsea(gene_sets(spark, sf), _ranked(spark, sf), n_perm=200)


@add(
    "enrich_set_report",
    f"""{BASE}, s AS (SELECT set_name, count(pl.symbol) AS size FROM sets LEFT JOIN pl USING (symbol) GROUP BY 1)
SELECT set_name, size, CASE WHEN size < 30 THEN 'size ' || size || ' < min 30' WHEN size > 200 THEN 'size ' || size || ' > max 200' END AS reason FROM s""",
)
def set_report(spark, sf):
    placed = enrich.positions(enrich.collapse(_ranked(spark, sf)))
    sets = gene_sets(spark, sf)
    return enrich.set_report(sets, enrich.set_hits(sets, placed), 30, 200)


def _usable(spark, sf):
    a = region_assay(spark, sf)
    return a.with_cells(a.cells.withColumn("value", F.log2(1 + F.col("value"))))


def _members(spark, sf, a):
    names = _named(part_features(spark, sf).select("feature_id"))
    return gsva.feature_sets(gene_sets(spark, sf), names, gsva.usable_genes(a))


USABLE = f"""WITH {REGION_CELLS}, lc AS (SELECT feature_id, sample_id, log2(1 + value) AS x FROM rcells),
ug AS (SELECT feature_id FROM lc GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM rsamples) AND stddev_samp(x) > 0),
uc AS (SELECT lc.* FROM lc JOIN ug USING (feature_id)), {SETS},
mem AS (SELECT DISTINCT set_name, feature_id FROM sets JOIN ug USING (feature_id) QUALIFY count(*) OVER (PARTITION BY set_name) BETWEEN 10 AND 500)"""


@add("enrich_usable_genes", f"{USABLE} SELECT feature_id FROM ug")
def usable_genes(spark, sf):
    return gsva.usable_genes(_usable(spark, sf))


PHI = """(0.5 * (1 + sign({z}) * (1 - (0.254829592 * {t} - 0.284496736 * {t} ** 2 + 1.421413741 * {t} ** 3 - 1.453152027 * {t} ** 4 + 1.061405429 * {t} ** 5) * exp(-(({z}) * ({z})) / 2))))"""
_Z = "((a.x - b.x) / (sd / 4))"
CDF = f"""sdv AS (SELECT feature_id, stddev_samp(x) AS sd FROM uc GROUP BY 1),
lt AS (SELECT a.feature_id, a.sample_id, avg({PHI.format(z=_Z, t=f'(1 / (1 + 0.3275911 * abs({_Z}) / sqrt(2)))')}) AS lt FROM uc a JOIN uc b USING (feature_id) JOIN sdv USING (feature_id) GROUP BY 1, 2),
z AS (SELECT feature_id, sample_id, round(-ln((1 - lt) / lt), 9) AS z FROM lt)"""


@add("enrich_gene_cdf", f"{USABLE}, {CDF} SELECT feature_id, sample_id, {R('z', 9)} AS value FROM z")
def gene_cdf(spark, sf):
    return gsva.gene_cdf(_usable(spark, sf), "gaussian").withColumn("value", rnd(F.col("value"), 9))


@add("enrich_gene_ecdf", f"{USABLE}, e AS (SELECT feature_id, sample_id, cume_dist() OVER (PARTITION BY feature_id ORDER BY x) AS lt FROM uc) SELECT feature_id, sample_id, CASE WHEN lt < 1 THEN {R('-ln((1 - lt) / lt)')} END AS value FROM e")
def gene_ecdf(spark, sf):
    out = gsva.gene_cdf(_usable(spark, sf), "ecdf")
    return out.withColumn("value", F.when(F.col("value") < float("inf"), rnd(F.col("value"))))


GSVA = f"""{CDF}, rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY z DESC, feature_id) - 1 AS pos, count(*) OVER (PARTITION BY sample_id) AS p FROM z),
gh AS (SELECT set_name, sample_id, pos, p, abs(p / 2 - (p - pos)) AS w FROM rk JOIN mem USING (feature_id)),
gr AS (SELECT *, sum(w) OVER o AS cum, sum(w) OVER (PARTITION BY set_name, sample_id) AS nr, count(*) OVER (PARTITION BY set_name, sample_id) AS nh, row_number() OVER o AS h FROM gh WINDOW o AS (PARTITION BY set_name, sample_id ORDER BY pos)),
ge AS (SELECT set_name, sample_id, greatest(0, max(cum / nr - (pos - h + 1) / (p - nh))) AS hi, least(0, min((cum - w) / nr - (pos - h + 1) / (p - nh))) AS lo FROM gr GROUP BY 1, 2)"""


@add("enrich_gsva", f"{USABLE}, {GSVA} SELECT set_name, sample_id, {R('hi + lo', 5)} AS score FROM ge")
def gsva_scores(spark, sf):
    a = _usable(spark, sf)
    return gsva.gsva(a, _members(spark, sf, a), "gaussian").withColumn("score", rnd(F.col("score"), 5))


@add("enrich_gsva_poisson")
def gsva_poisson(spark, sf):
    a = region_assay(spark, sf)
    counts = a.with_cells(a.cells.withColumn("value", F.floor(F.col("value") / 1000).cast("double")))
    return gsva.gsva(counts, _members(spark, sf, counts), "poisson", max_diff=False)


@add(
    "enrich_ssgsea",
    f"""{USABLE}, rk AS (SELECT *, rank() OVER (PARTITION BY sample_id ORDER BY x) + (count(*) OVER (PARTITION BY sample_id, x) - 1) / 2 AS r, count(*) OVER (PARTITION BY sample_id) AS p FROM uc),
ps AS (SELECT *, p - row_number() OVER (PARTITION BY sample_id ORDER BY r DESC, feature_id) + 1 AS term FROM rk),
e AS (SELECT set_name, sample_id, sum(r ** 0.25 * term) / sum(r ** 0.25) - (any_value(p) * (any_value(p) + 1) / 2 - sum(term)) / (any_value(p) - count(*)) AS es FROM ps JOIN mem USING (feature_id) GROUP BY 1, 2)
SELECT set_name, sample_id, {R('es / ((SELECT max(es) FROM e) - (SELECT min(es) FROM e))')} AS score FROM e""",
)
def ssgsea(spark, sf):
    a = _usable(spark, sf)
    return gsva.ssgsea(a, _members(spark, sf, a)).withColumn("score", rnd(F.col("score")))


@add(
    "enrich_zscore_sets",
    f"""{USABLE}, z AS (SELECT feature_id, sample_id, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM uc WINDOW w AS (PARTITION BY feature_id))
SELECT set_name, sample_id, {R('sum(z) / sqrt(count(*))')} AS score FROM z JOIN mem USING (feature_id) GROUP BY 1, 2""",
)
def zscore_sets(spark, sf):
    a = _usable(spark, sf)
    return gsva.zscore_sets(a, _members(spark, sf, a)).withColumn("score", rnd(F.col("score")))


@add("enrich_plage")
def plage(spark, sf):
    a = _usable(spark, sf)
    return gsva.plage(a, _members(spark, sf, a))


@add(
    "enrich_top_sets",
    f"""{USABLE}, z AS (SELECT feature_id, sample_id, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM uc WINDOW w AS (PARTITION BY feature_id)),
s AS (SELECT set_name, sample_id, sum(z) / sqrt(count(*)) AS score FROM z JOIN mem USING (feature_id) GROUP BY 1, 2)
SELECT set_name, {R('var_samp(score)')} AS variance FROM s GROUP BY 1 ORDER BY var_samp(score) DESC, set_name LIMIT 20""",
)
def top_sets(spark, sf):
    a = _usable(spark, sf)
    return gsva.top_sets(gsva.zscore_sets(a, _members(spark, sf, a)), 20).withColumn("variance", rnd(F.col("variance")))


ORA = f"""{SETS}, l AS (SELECT DISTINCT 'G' || p_partkey AS symbol FROM part WHERE p_name LIKE '%widget%'),
u AS (SELECT count(DISTINCT symbol) AS t FROM sets), n AS (SELECT count(*) AS n FROM l),
c AS (SELECT set_name, count(*) AS m, count(l.symbol) AS k FROM sets LEFT JOIN l USING (symbol) GROUP BY 1 HAVING count(l.symbol) > 0),
h AS (SELECT set_name, m, k, n, t, list_sum(list_transform(range(greatest(k, n + m - t), least(m, n) + 1), lambda i: exp(lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0)
  + CASE WHEN t - m = 0 THEN 0 ELSE lgamma(t - m + 1.0) - lgamma(n - i + 1.0) - lgamma(t - m - n + i + 1.0) END - lgamma(t + 1.0) + lgamma(n + 1.0) + lgamma(t - n + 1.0)))) AS p FROM c, u, n),
r AS (SELECT *, least(1, p) AS pp, count(*) OVER () * least(1, p) / count(*) OVER (ORDER BY round(least(1, p), 12) RANGE UNBOUNDED PRECEDING) AS raw FROM h)"""


def _ora(spark, sf):
    f = part_features(spark, sf).filter(F.col("name").contains("widget"))
    genes = f.select(F.concat(F.lit("G"), F.col("feature_id").cast("string")).alias("gene"))
    return enrich.over_representation(genes, gene_sets(spark, sf))


@add(
    "enrich_over_representation",
    f"""WITH {ORA} SELECT set_name, m AS set_size, k AS overlap, {R('(k * (t - m - n + k))::DOUBLE / nullif((m - k) * (n - k), 0)')} AS odds_ratio, {R('pp')} AS p FROM r""",
)
def over_representation(spark, sf):
    return _ora(spark, sf).select("set_name", "set_size", "overlap", rnd(F.col("odds_ratio")).alias("odds_ratio"), rnd(F.col("p")).alias("p"))


@add("enrich_top_terms", f"""WITH {ORA} SELECT set_name, k AS overlap, {R('pp')} AS p FROM r WHERE k >= 5 AND pp <= 0.5 ORDER BY round(pp, 9), set_name LIMIT 10""")
def top_terms(spark, sf):
    terms = _ora(spark, sf).withColumn("p", F.round("p", 9))
    return enrich.top_terms(terms, 10, by="p", min_overlap=5, max_p=0.5).select("set_name", "overlap", rnd(F.col("p")).alias("p"))


@add(
    "enrich_term_rows",
    """SELECT p_brand AS term, count(DISTINCT upper(p_name))::INT AS overlap FROM part GROUP BY 1""",
)
def term_rows(spark, sf):
    rows = part_features(spark, sf).groupBy(F.col("brand").alias("term")).agg(F.collect_set(F.concat("name", F.lit(" "))).alias("genes"))
    both = rows.withColumn("genes", F.concat("genes", F.transform("genes", lambda g: F.upper(g)), F.array(F.lit(" "))))
    return enrich.term_rows(both).select("term", "overlap")


@add(
    "enrich_term_jaccard",
    f"""WITH {SETS}, z AS (SELECT set_name, count(*) AS n FROM sets GROUP BY 1), p AS (SELECT a.set_name AS a, b.set_name AS b, count(*) AS shared FROM sets a JOIN sets b ON a.symbol = b.symbol AND a.set_name < b.set_name GROUP BY 1, 2)
SELECT a, b, shared, {R('shared / (x.n + y.n - shared)')} AS jaccard FROM p JOIN z x ON x.set_name = a JOIN z y ON y.set_name = b""",
)
def term_jaccard(spark, sf):
    sets = gene_sets(spark, sf)
    n = sets.agg(F.count_distinct("set_name")).first()[0]
    return enrich.term_jaccard(sets, n).withColumn("jaccard", rnd(F.col("jaccard")))


@add("enrich_term_intensity", f"WITH {CELLS}, {SETS} SELECT set_name, sample_id, {R('sum(value)', 2)} AS value, count(*) AS n FROM cells JOIN sets USING (feature_id) GROUP BY 1, 2")
def term_intensity(spark, sf):
    a = assay(spark, sf)
    key = F.concat(F.lit("G"), F.col("feature_id").cast("string"), F.lit("_HUMAN"))
    cells = a.cells.withColumn("feature_id", key)
    features = part_features(spark, sf).select(key.alias("feature_id"))
    return enrich.term_intensity(Assay(cells, a.samples, features), gene_sets(spark, sf)).withColumn("value", rnd(F.col("value"), 2))


@add("enrich_match_sets", f"WITH {CELLS}, {SETS} SELECT set_name, count(*) AS n FROM sets WHERE feature_id IN (SELECT feature_id FROM cells WHERE value > 100000) GROUP BY 1")
def match_sets(spark, sf):
    big = _named(assay(spark, sf).cells.filter("value > 100000").select("feature_id").distinct()).select("symbol")
    return joins.match_sets(gene_sets(spark, sf), big).groupBy("set_name").agg(F.count("*").alias("n"))


@add("enrich_gene_list_from", f"{WELCH}, pv AS (SELECT feature_id, mean_b - mean_a AS fc, {t_tail('t', 'df')} AS p FROM tt) SELECT 'G' || feature_id AS gene FROM pv WHERE p <= 0.1 AND abs(fc) >= 0.5")
def gene_list_from(spark, sf):
    tests = diff.log2fc(diff.ttest(diff.group_moments(assay(spark, sf), "grp", "AFRICA", "EUROPE"), "welch").filter("t IS NOT NULL"))
    marked = diff.classify(tests, "p", 0.1, 0.5).withColumn("symbol", F.concat(F.lit("G"), F.col("feature_id").cast("string")))
    return enrich.gene_list_from(marked, "symbol", significant=True)


@add("enrich_neg_log10", f"SELECT l_orderkey AS o, l_linenumber AS l, {R('CASE WHEN l_discount > 0 AND l_discount <= 1 THEN -log10(l_discount) ELSE 0 END')} AS y FROM lineitem")
def neg_log10(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), rnd(enrich.neg_log10(F.col("l_discount"))).alias("y"))
