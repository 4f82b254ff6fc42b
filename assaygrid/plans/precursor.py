"""Queries over precursor reports, chromatograms, sequence coverage and paired normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.model import Assay
from assaygrid.operators import coverage as cov
from assaygrid.operators import phospho, xic
from assaygrid.operators import precursor as pre
from assaygrid.plans.bind import CELLS, R, Catalog, rnd, samples, table
from assaygrid.runtime import scratch_path

catalog = Catalog()
add = catalog.add


def precursors(spark, sf):
    """Line items as precursor rows: nations are runs, parts are peptides, brand and size a protein group."""
    line = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = line.join(part, "p_partkey").join(supplier, "l_suppkey").join(nation, "n_nationkey")
    pep = F.concat(F.lit("PEP"), (F.col("p_partkey") % 701).cast("string"))
    group = F.when(F.col("p_size") != 7, F.concat_ws("-", "p_brand", F.col("p_size").cast("string")))
    genes = F.when(F.col("p_size") != 9, F.concat_ws("; ", "p_brand", "p_type")).otherwise("")
    return rows.select(
        F.col("n_name").alias("run"),
        F.concat_ws("_", F.lit("PR"), F.col("p_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("precursor_id"),
        pep.alias("stripped_sequence"), F.concat(pep, F.lit("(m)")).alias("modified_sequence"), F.col("l_linenumber").alias("charge"),
        group.alias("protein_group"), F.lit("").alias("protein_ids"), F.col("p_name").alias("protein_names"), genes.alias("genes"),
        (F.col("l_linenumber") % 2).alias("proteotypic"), F.col("l_tax").alias("mz"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double").alias("rt"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("normalised"),
        F.when(F.col("l_returnflag") == "R", F.round(F.col("l_extendedprice") * 2, 2)).otherwise(0.0).alias("maxlfq"),
        F.when(F.col("l_returnflag") != "N", F.col("l_discount") / 10).alias("q_value"), (F.col("l_tax") / 10).alias("global_q_value"),
        (F.col("l_discount") / 5).alias("pg_q_value"),
    )


P = """p AS (SELECT n_name AS run, 'PR_' || l_partkey || '_' || l_linenumber AS precursor_id, 'PEP' || (l_partkey % 701) AS pep, l_linenumber AS charge,
  CASE WHEN p_size <> 7 THEN p_brand || '-' || p_size ELSE 'Unknown' END AS pg, p_name AS protein_names, CASE WHEN p_size <> 9 THEN p_brand || '; ' || p_type ELSE '' END AS genes,
  p_brand, p_type, p_size, l_linenumber % 2 AS proteotypic, l_orderkey * 10 + l_linenumber AS rt, l_extendedprice AS x,
  CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice * 2, 2) ELSE 0 END AS maxlfq, CASE WHEN l_returnflag <> 'N' THEN l_discount / 10 END AS q, l_tax / 10 AS gq, l_discount / 5 AS pgq
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


@add("precursor_filter", f"WITH {P} SELECT run, count(*) AS n, {R('sum(x)', 2)} AS total FROM p WHERE (q IS NULL OR q <= 0.008) AND gq <= 0.006 AND pgq <= 0.018 AND proteotypic = 1 AND lower(genes) LIKE '%brand#1%' GROUP BY 1")
def precursor_filter(spark, sf):
    kept = pre.filter_precursors(precursors(spark, sf), 0.008, 0.006, 0.018, proteotypic=True, gene="Brand#1")
    return kept.groupBy("run").agg(F.count("*").alias("n"), rnd(F.sum("normalised"), 2).alias("total"))


VALUES = {
    "maxlfq": "coalesce(arg_min(maxlfq, (precursor_id, maxlfq)) FILTER (WHERE maxlfq > 0), CASE WHEN sum(x) > 0 THEN sum(x) END)",
    "sum": "CASE WHEN sum(x) > 0 THEN sum(x) END",
    "top3": "list_avg(list_reverse_sort(list(x) FILTER (WHERE x > 0))[1:3])",
}


def _protein(method: str):
    def run(spark, sf):
        out = pre.protein_values(precursors(spark, sf), method)
        return out.withColumn("value", rnd(F.col("value"), 2 if method != "top3" else 4))

    return run


for _m, _v in VALUES.items():
    add(
        f"precursor_protein_{_m}",
        f"WITH {P} SELECT pg AS protein_group, run, {R(_v, 2 if _m != 'top3' else 4)} AS value, count(DISTINCT pep) AS n_peptides FROM p GROUP BY 1, 2",
    )(_protein(_m))


SUMMARY = """n_sequences, n_proteotypic, detected_runs, (round(total, 2) + 0) AS total, (round(mean, 7) + 0) AS mean, (round(mx, 2) + 0) AS max, max_peptides"""


def _matrix_sql(key: str, method: str) -> str:
    return f"""v AS (SELECT {key} AS k, run, {VALUES[method]} AS value, count(DISTINCT pep) AS np FROM src GROUP BY 1, 2),
s AS (SELECT k, count(*) FILTER (WHERE value > 0) AS detected_runs, sum(value) AS total, avg(value) AS mean, max(value) AS mx, max(np) AS max_peptides FROM v GROUP BY 1),
c AS (SELECT {key} AS k, count(DISTINCT pep) AS n_sequences, count(DISTINCT pep) FILTER (WHERE proteotypic = 1) AS n_proteotypic, count(DISTINCT pg) AS npg FROM src GROUP BY 1)"""


def _summary_cols(df):
    money = [rnd(F.col(c), d).alias(c) for c, d in (("total", 2), ("mean", 7), ("max", 2))]
    return ["n_sequences", "n_proteotypic", "detected_runs", *money, "max_peptides"]


@add("precursor_protein_matrix", f"WITH {P}, src AS (FROM p), {_matrix_sql('pg', 'sum')} SELECT k AS protein_group, {SUMMARY} FROM s JOIN c USING (k)")
def protein_matrix(spark, sf):
    out = pre.protein_matrix(precursors(spark, sf), "sum")
    return out.select("protein_group", *_summary_cols(out))


GENES = "src AS (SELECT p.*, unnest(CASE WHEN p_size <> 9 THEN [p_brand, p_type] ELSE ['Unknown'] END) AS gene FROM p)"


@add("precursor_gene_matrix", f"WITH {P}, {GENES}, {_matrix_sql('gene', 'sum')} SELECT k AS gene, {SUMMARY}, npg AS n_protein_groups FROM s JOIN c USING (k)")
def gene_matrix(spark, sf):
    out = pre.gene_matrix(precursors(spark, sf), "sum")
    return out.select("gene", *_summary_cols(out), "n_protein_groups")


@add("precursor_gene_groups", f"WITH {P}, {GENES} SELECT DISTINCT gene, pg AS protein_group FROM src")
def gene_groups(spark, sf):
    return pre.gene_groups(precursors(spark, sf))


@add(
    "precursor_peptide_matrix",
    f"""WITH {P}, v AS (SELECT precursor_id, run, arg_max(x, (rt, x)) AS value FROM p WHERE x > 0 GROUP BY 1, 2),
s AS (SELECT precursor_id, count(*) AS detected_runs, sum(value) AS total, avg(value) AS mean, max(value) AS mx FROM v GROUP BY 1),
l AS (SELECT precursor_id, coalesce(min(q), 1) AS q, min(gq) AS gq, min(pgq) AS pgq, any_value(pep) AS pep, any_value(charge) AS charge,
  CASE WHEN any_value(proteotypic) = 1 THEN 'Yes' ELSE 'No' END AS proteotypic FROM p GROUP BY 1)
SELECT precursor_id, pep AS stripped_sequence, charge, proteotypic, {R('q')} AS q_value, {R('gq')} AS global_q_value, {R('pgq')} AS pg_q_value, detected_runs,
{R('total', 2)} AS total, {R('mean', 7)} AS mean, {R('mx', 2)} AS max FROM l JOIN s USING (precursor_id)""",
)
def peptide_matrix(spark, sf):
    out = pre.peptide_matrix(precursors(spark, sf))
    qs = [rnd(F.col(c)).alias(c) for c in ("q_value", "global_q_value", "pg_q_value")]
    return out.select("precursor_id", "stripped_sequence", "charge", "proteotypic", *qs, "detected_runs", *[rnd(F.col(c), d).alias(c) for c, d in (("total", 2), ("mean", 7), ("max", 2))])


@add("precursor_of_gene", f"WITH {P} SELECT precursor_id, run, {R('arg_max(x, (rt, x))', 2)} AS value FROM p WHERE x > 0 AND p_brand = 'Brand#3' AND p_size <> 9 GROUP BY 1, 2")
def of_gene(spark, sf):
    return pre.peptide_values(pre.of_group(precursors(spark, sf), gene="Brand#3")).withColumn("value", rnd(F.col("value"), 2))


@add("precursor_to_cells", f"WITH {P} SELECT pg AS feature_id, run AS sample_id, {R('sum(x)', 2)} AS value FROM p GROUP BY 1, 2")
def to_cells(spark, sf):
    return pre.to_cells(pre.protein_values(precursors(spark, sf), "sum"), "protein_group").withColumn("value", rnd(F.col("value"), 2))


@add("precursor_protein_profile", f"WITH {P} SELECT run, {R('sum(x)', 2)} AS value, count(DISTINCT pep) AS n_peptides FROM p WHERE pg = 'Brand#5-10' GROUP BY 1")
def protein_profile(spark, sf):
    p = pre.of_group(precursors(spark, sf), group="Brand#5-10")
    return pre.protein_profile(pre.protein_values(p, "sum"), "Brand#5-10").withColumn("value", rnd(F.col("value"), 2))


@add(
    "precursor_run_summary",
    f"""WITH {P} SELECT run, count(*) AS precursors, count(DISTINCT pep) AS peptides, count(DISTINCT nullif(pg, 'Unknown')) AS protein_groups, {R('sum(x)', 2)} AS intensity FROM p GROUP BY 1
UNION ALL SELECT NULL, count(DISTINCT precursor_id), count(DISTINCT pep), count(DISTINCT nullif(pg, 'Unknown')), {R('sum(x)', 2)} FROM p""",
)
def run_summary(spark, sf):
    return pre.run_summary(precursors(spark, sf)).withColumn("intensity", rnd(F.col("intensity"), 2))


@add(
    "precursor_in_all_runs",
    f"""WITH {P}, i AS (SELECT 'precursor' AS kind, precursor_id AS item, run FROM p UNION SELECT 'peptide', pep, run FROM p UNION SELECT 'protein_group', pg, run FROM p WHERE pg <> 'Unknown'),
n AS (SELECT kind, item, count(*) AS n FROM i GROUP BY 1, 2)
SELECT kind, count(*) FILTER (WHERE n = (SELECT count(DISTINCT run) FROM p)) AS in_all, count(*) AS items FROM n GROUP BY 1""",
)
def in_all_runs(spark, sf):
    return pre.in_all_runs(precursors(spark, sf))


@add("precursor_kpis", f"WITH {P}, f AS (SELECT * FROM p WHERE (q IS NULL OR q <= 0.005) AND gq <= 0.01 AND pgq <= 0.01) SELECT count(*) AS filtered, count(DISTINCT pg) AS protein_groups, count(DISTINCT pep) AS peptides, count(DISTINCT run) AS runs, (SELECT count(*) FROM p) AS total FROM f")
def kpis(spark, sf):
    raw = precursors(spark, sf)
    return pre.kpis(raw, pre.filter_precursors(raw, q=0.005))


@add("precursor_run_totals", f"WITH {P} SELECT run, count(*) AS n, {R('sum(x)', 2)} AS intensity FROM p GROUP BY 1")
def run_totals(spark, sf):
    return pre.run_totals(precursors(spark, sf)).withColumn("intensity", rnd(F.col("intensity"), 2))


X = """x AS (SELECT event_type AS run, user_id::VARCHAR AS pr, CASE event_id % 5 WHEN 0 THEN 'ms1' WHEN 1 THEN 'index' WHEN 2 THEN 'y' || (user_id % 9 + 1) || '^1' WHEN 3 THEN 'b' || (user_id % 7 + 1) || '^2' ELSE 'y' || (user_id % 9 + 1) || '^2' END AS feature,
  event_id::DOUBLE AS rt, value FROM events)"""


def chromatograms(spark, sf):
    e, k, u = table(spark, sf, "events"), F.col("event_id") % 5, F.col("user_id")
    y, b = (u % 9 + 1).cast("string"), (u % 7 + 1).cast("string")
    feature = (
        F.when(k == 0, "ms1").when(k == 1, "index").when(k == 2, F.concat(F.lit("y"), y, F.lit("^1")))
        .when(k == 3, F.concat(F.lit("b"), b, F.lit("^2"))).otherwise(F.concat(F.lit("y"), y, F.lit("^2")))
    )
    return e.select(F.col("event_type").alias("run"), u.cast("string").alias("pr"), feature.alias("feature"), F.col("event_id").cast("double").alias("rt"), "value")


@add("xic_traces", f"WITH {X} SELECT * FROM x WHERE pr = '17' AND feature <> 'index'")
def xic_traces(spark, sf):
    path = scratch_path(spark)
    xic.write_sorted(chromatograms(spark, sf), path, 4)
    return xic.traces(spark.read.parquet(path), "17")


@add(
    "xic_decimate",
    f"""WITH {X}, r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY run, pr, feature) AS n FROM x WHERE feature <> 'index' WINDOW w AS (PARTITION BY run, pr, feature ORDER BY rt, value))
SELECT run, pr, feature, rt, value FROM r WHERE n <= 6 OR pos = n - 1 OR pos IN (floor(0 * n / 6), floor(1 * n / 6), floor(2 * n / 6), floor(3 * n / 6), floor(4 * n / 6), floor(5 * n / 6))""",
)
def xic_decimate(spark, sf):
    return xic.decimate(xic.traces(chromatograms(spark, sf)), 6)


@add("xic_index", f"""WITH {X}, c AS (SELECT run, pr, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY run ORDER BY pr) AS u FROM c)
SELECT run, pr, (u - n)::BIGINT AS first, (u - 1)::BIGINT AS last FROM s""")
def xic_index(spark, sf):
    return xic.index(chromatograms(spark, sf))


@add(
    "xic_fragment_max",
    f"""WITH {X}, f AS (SELECT *, feature[1] AS type, regexp_extract(feature, '^[by]([0-9]+)', 1)::INT AS n, regexp_extract(feature, '([0-9]+)$', 1)::INT AS charge FROM x WHERE feature NOT IN ('index', 'ms1'))
SELECT run, pr, type, n, array_to_string(list_sort(list(DISTINCT charge)), ',') AS charges, max(value) AS max, arg_max(rt, (value, -rt)) AS rt FROM f GROUP BY 1, 2, 3, 4""",
)
def xic_fragment_max(spark, sf):
    out = xic.fragment_max(chromatograms(spark, sf))
    return out.withColumn("charges", F.concat_ws(",", F.transform("charges", lambda c: c.cast("string"))))


@add("xic_apex", f"WITH {X} SELECT run, pr, max(value) AS value, arg_max(rt, (value, -rt)) AS rt FROM x WHERE feature <> 'index' GROUP BY 1, 2")
def xic_apex(spark, sf):
    return xic.apex(chromatograms(spark, sf))


SEQ = """s AS (SELECT item_id, 'ACC' || item_id AS accession, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence, text FROM benchmark),
pep AS (SELECT DISTINCT accession, upper(w) AS peptide FROM (SELECT accession, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM s)),
hit AS (SELECT accession, peptide, list_filter(range(1, len(sequence) + 1), lambda i: substr(sequence, i, len(peptide)) = peptide) AS starts FROM pep JOIN s USING (accession))"""


def _sequences(spark, sf):
    b = table(spark, sf, "benchmark")
    acc = F.concat(F.lit("ACC"), F.col("item_id").cast("string"))
    return b.select("item_id", acc.alias("accession"), F.concat(F.lit("sp|"), acc, F.lit("|N"), F.col("item_id").cast("string"), F.lit(" GN=G"), F.col("item_id").cast("string")).alias("header"),
                    F.regexp_replace("text", "[^A-Za-z]", "").alias("sequence"), "text")


def _peptides(spark, sf):
    return _sequences(spark, sf).select("accession", F.explode(F.expr("regexp_extract_all(text, '[A-Za-z]{4,}', 0)")).alias("peptide"))


@add(
    "coverage_find_sequence",
    """WITH q AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'none; ACC' || item_id WHEN 1 THEN 'ACC' || item_id || '-2' WHEN 2 THEN 'acc' || item_id || '.1' ELSE 'zz' || item_id END AS protein_group FROM benchmark)
SELECT protein_group, CASE item_id % 4 WHEN 0 THEN 'ACC' || item_id WHEN 1 THEN 'ACC' || item_id WHEN 2 THEN 'acc' || item_id END AS matched_id, CASE WHEN item_id % 4 < 3 THEN 'ACC' || item_id END AS accession FROM q""",
)
def find_sequence(spark, sf):
    s, k = _sequences(spark, sf), F.col("item_id") % 4
    key = F.col("item_id").cast("string")
    group = (
        F.when(k == 0, F.concat(F.lit("none; ACC"), key)).when(k == 1, F.concat(F.lit("ACC"), key, F.lit("-2")))
        .when(k == 2, F.concat(F.lit("acc"), key, F.lit(".1"))).otherwise(F.concat(F.lit("zz"), key))
    )
    return cov.find_sequence(s.select(group.alias("protein_group")), s).select("protein_group", "matched_id", "accession")


@add(
    "coverage_map_peptides",
    f"""WITH {SEQ} SELECT accession, peptide, array_to_string(starts, ',') AS starts, starts[1]::INT AS start, (starts[1] + len(peptide) - 1)::INT AS "end", len(starts)::INT AS hits FROM hit""",
)
def map_peptides(spark, sf):
    out = cov.map_peptides(_peptides(spark, sf), _sequences(spark, sf))
    return out.withColumn("starts", F.concat_ws(",", F.transform("starts", lambda s: s.cast("string"))))


@add(
    "coverage_pct",
    f"""WITH {SEQ}, spots AS (SELECT DISTINCT accession, unnest(range(st, st + len(peptide))) AS pos FROM (SELECT accession, peptide, unnest(starts) AS st FROM hit)),
c AS (SELECT accession, count(*) AS covered FROM spots GROUP BY 1), n AS (SELECT accession, count(*) AS peptides FROM pep GROUP BY 1)
SELECT accession, len(sequence)::INT AS length, coalesce(peptides, 0) AS peptides, 0::BIGINT AS unmatched, coalesce(covered, 0) AS covered, {R('100 * coalesce(covered, 0) / len(sequence)')} AS pct FROM s LEFT JOIN c USING (accession) LEFT JOIN n USING (accession)""",
)
def coverage_pct(spark, sf):
    return cov.coverage(_peptides(spark, sf), _sequences(spark, sf)).withColumn("pct", rnd(F.col("pct")))


@add(
    "coverage_residue_intensity",
    f"""WITH {SEQ}, cover AS (SELECT DISTINCT accession, peptide, unnest(range(st, st + len(peptide))) AS pos FROM (SELECT accession, peptide, unnest(starts) AS st FROM hit))
SELECT accession, 'run' || r AS run, pos::INT AS pos, sum(len(peptide) * r)::DOUBLE AS intensity FROM cover, range(1, 4) t(r) GROUP BY 1, 2, 3""",
)
def residue_intensity(spark, sf):
    peps = _peptides(spark, sf).select("accession", F.upper("peptide").alias("peptide")).distinct()
    quant = peps.withColumn("r", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    quant = quant.select("accession", F.concat(F.lit("run"), F.col("r").cast("string")).alias("run"), "peptide", (F.length("peptide") * F.col("r")).cast("double").alias("value"))
    return cov.residue_intensity(quant, _sequences(spark, sf))


@add("coverage_subset", "SELECT 'ACC' || item_id AS accession FROM benchmark WHERE len(text) > 230")
def subset(spark, sf):
    s = _sequences(spark, sf)
    groups = s.filter("length(text) > 230").select(F.concat(F.lit("G"), F.col("item_id").cast("string"), F.lit("-1;x")).alias("protein_group"))
    return cov.subset_sequences(s, groups).select("accession")


PHO = """sc AS (SELECT l_partkey || '_' || l_returnflag AS feature_id, l_partkey AS part, n_name AS sample_id, log2(round(sum(l_extendedprice), 2)) AS site
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
tc AS (SELECT feature_id AS part, sample_id, log2(value) AS total FROM cells JOIN part ON p_partkey = feature_id WHERE p_type <> 'ECONOMY')"""


def _sites(spark, sf):
    line, supplier, nation = table(spark, sf, "lineitem"), table(spark, sf, "supplier"), table(spark, sf, "nation")
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = F.col("l_partkey").cast("string")
    site = rows.groupBy(F.concat_ws("_", part, "l_returnflag").alias("feature_id"), F.col("n_name").alias("sample_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    total = rows.groupBy(F.col("l_partkey").alias("feature_id"), F.col("n_name").alias("sample_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    sites = Assay(site, samples(spark, sf), site.select("feature_id").distinct().withColumn("proteins", F.concat(F.regexp_extract("feature_id", r"^\d+", 0), F.lit(";P9"))))
    known = table(spark, sf, "part").filter("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("feature_id"))
    kept = total.join(known, "feature_id", "left_semi")
    return sites, Assay(kept, samples(spark, sf), kept.select("feature_id").distinct().withColumn("protein", F.col("feature_id").cast("string")))


@add(
    "phospho_normalise",
    f"WITH {CELLS}, {PHO} SELECT feature_id, sc.sample_id, {R('coalesce(site - total, site)')} AS value FROM sc LEFT JOIN tc ON sc.part = tc.part AND sc.sample_id = tc.sample_id",
)
def phospho_normalise(spark, sf):
    sites, total = _sites(spark, sf)
    return phospho.normalise_to_total(sites, total, "proteins", "protein").withColumn("value", rnd(F.col("value")))


@add("phospho_normalise_knn")
def phospho_normalise_knn(spark, sf):
    sites, total = _sites(spark, sf)
    return phospho.normalise_to_total(sites, total, "proteins", "protein", knn=True, mode="complete").withColumn("value", rnd(F.col("value")))


@add(
    "phospho_paired_profile",
    f"""WITH {CELLS}, {PHO} SELECT feature_id, sc.sample_id, {R('site')} AS site, {R('total')} AS total, {R('coalesce(site - total, site)')} AS normalised
FROM sc LEFT JOIN tc ON sc.part = tc.part AND sc.sample_id = tc.sample_id""",
)
def paired_profile(spark, sf):
    sites, total = _sites(spark, sf)
    out = phospho.paired_profile(sites, total, phospho.normalise_to_total(sites, total, "proteins", "protein"), "proteins", "protein")
    return out.select("feature_id", "sample_id", *[rnd(F.col(c)).alias(c) for c in ("site", "total", "normalised")])


@add("phospho_log2", f"WITH {CELLS} SELECT feature_id, sample_id, {R('CASE WHEN value > 20000 THEN log2(value - 20000) END')} AS value FROM cells")
def phospho_log2(spark, sf):
    from assaygrid.plans.bind import assay

    shifted = assay(spark, sf).cells.withColumn("value", F.round(F.col("value") - 20000, 2))
    return phospho.log2_positive(shifted).withColumn("value", rnd(F.col("value")))
