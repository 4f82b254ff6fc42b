"""Queries over readers and writers: files are written from the driver tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.functions.missing import na_to_null
from assaygrid.model import Assay
from assaygrid.operators import impute
from assaygrid.plans.bind import CELLS, R, SAMPLES, Catalog, assay, part_features, rnd, samples, table
from assaygrid.plans.enrich import gene_sets
from assaygrid.plans.precursor import VALUES, P, chromatograms, precursors
from assaygrid.runtime import scratch_path
from assaygrid.sources import records, sinks, tables

catalog = Catalog()
add = catalog.add


def _names(spark, sf):
    return [r[0] for r in samples(spark, sf).select("sample_id").orderBy("sample_id").collect()]


def _wide(spark, sf):
    """The matrix with one text column per nation; a missing cell reads NA."""
    names = _names(spark, sf)
    wide = assay(spark, sf).cells.groupBy("feature_id").pivot("sample_id", names).agg(F.first("value"))
    return names, wide.select("feature_id", *[F.coalesce(F.col(n).cast("decimal(18,2)").cast("string"), F.lit("NA")).alias(n) for n in names])


def _save(df, sep="\t"):
    path = scratch_path(df.sparkSession)
    df.write.csv(path, sep=sep, header=True)
    return path


def _text(df):
    path = scratch_path(df.sparkSession)
    df.write.text(path)
    return path


GRID = f"""WITH {CELLS}, {SAMPLES}, g AS (SELECT f.feature_id::VARCHAR AS feature_id, s.sample_id, value FROM (SELECT DISTINCT feature_id FROM cells) f CROSS JOIN samples s LEFT JOIN cells c ON c.feature_id = f.feature_id AND c.sample_id = s.sample_id)"""


@add("read_matrix", f"{GRID} SELECT * FROM g")
def read_matrix(spark, sf):
    return tables.read_matrix(spark, _save(_wide(spark, sf)[1]))


def _annotated(spark, sf):
    names, wide = _wide(spark, sf)
    f = part_features(spark, sf)
    notes = f.select("feature_id", F.concat(F.lit("PG"), F.col("feature_id").cast("string")).alias("Protein.Group"),
                     F.when(F.col("size") % 5 > 0, F.concat(F.lit("N"), F.col("feature_id").cast("string"))).otherwise(" ").alias("Protein.Names"),
                     F.col("brand").alias("Genes"), F.col("name").alias("First.Protein.Description"), F.col("size").alias("N.Sequences"), F.col("size").alias("N.Proteotypic.Sequences"))
    return names, notes.join(wide, "feature_id")


@add("read_diann_pg", f"{GRID} SELECT 'N' || g.feature_id AS feature_id, sample_id, coalesce(value, 0) AS value FROM g JOIN part ON p_partkey = g.feature_id::BIGINT WHERE p_size % 5 > 0")
def read_diann_pg(spark, sf):
    _, df = _annotated(spark, sf)
    return tables.read_diann_pg(spark, _save(df.drop("feature_id"))).cells


@add("read_diann_gg", f"{GRID} SELECT 'G' || feature_id AS feature_id, sample_id, coalesce(value, 0) AS value FROM g")
def read_diann_gg(spark, sf):
    names, df = _annotated(spark, sf)
    gene = F.concat(F.lit("G"), F.col("feature_id").cast("string"))
    return tables.read_diann_gg(spark, _save(df.select(gene.alias("Genes"), tables.quoted("N.Sequences"), tables.quoted("Protein.Group"), *names))).cells


@add(
    "read_diann_sites",
    f"""{GRID}, s AS (SELECT p_partkey, p_brand || '_S' || p_size AS id, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS rn FROM part)
SELECT CASE WHEN rn > 1 THEN id || '_' || rn ELSE id END AS feature_id, sample_id, coalesce(value, 0) AS value FROM g JOIN s ON p_partkey = g.feature_id::BIGINT""",
)
def read_diann_sites(spark, sf):
    names, wide = _wide(spark, sf)
    f = part_features(spark, sf).select(
        "feature_id", F.concat(F.lit("P"), F.col("feature_id").cast("string")).alias("Protein"), F.col("name").alias("Protein.Names"),
        F.col("brand").alias("Gene.Names"), F.lit("S").alias("Residue"), F.col("size").alias("Site"), F.lit("SEQ").alias("Sequence"),
    )
    return tables.read_diann_sites(spark, _save(f.join(wide, "feature_id").orderBy("feature_id").drop("feature_id"))).cells


@add(
    "read_mq_proteins",
    f"""{GRID}, s AS (SELECT p_partkey, coalesce(CASE WHEN p_size % 4 > 0 THEN p_brand || p_size END, 'prot' || p_partkey) AS id, row_number() OVER (PARTITION BY coalesce(CASE WHEN p_size % 4 > 0 THEN p_brand || p_size END, 'prot' || p_partkey) ORDER BY p_partkey) AS rn
  FROM part WHERE p_size % 7 > 0 AND p_partkey % 11 > 0)
SELECT CASE WHEN rn > 1 THEN id || '_' || rn ELSE id END AS feature_id, sample_id, coalesce(value, 0) AS value FROM g JOIN s ON p_partkey = g.feature_id::BIGINT""",
)
def read_mq_proteins(spark, sf):
    names, wide = _wide(spark, sf)
    size, key = F.col("size"), F.col("feature_id")
    f = part_features(spark, sf).select(
        "feature_id", key.alias("id"), F.concat(F.lit("prot"), key.cast("string"), F.lit(";x")).alias("Protein names"),
        F.when(size % 4 > 0, F.concat(F.col("brand"), size.cast("string"), F.lit(";OTHER"))).otherwise("").alias("Gene names"),
        F.when(size % 7 == 0, "+").otherwise("").alias("Reverse"), F.when(key % 11 == 0, "+").otherwise("").alias("Potential contaminant"),
    )
    joined = f.join(wide, "feature_id").orderBy("feature_id").drop("feature_id")
    renamed = joined.select("id", "Protein names", "Gene names", "Reverse", "Potential contaminant", F.lit("9").alias("Intensity"), *[F.col(n).alias(f"LFQ intensity {n}") for n in names], *[F.lit("1").alias(f"Intensity {n}") for n in names])
    return tables.read_mq_proteins(spark, _save(renamed)).cells


@add(
    "read_mq_sites",
    f"""{GRID}, s AS (SELECT p_partkey, p_brand || '_T' || p_size AS id, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS rn FROM part)
SELECT CASE WHEN rn > 1 THEN id || '_' || rn ELSE id END AS feature_id, sample_id, {R('coalesce(value, 0) + 1.5', 2)} AS value FROM g JOIN s ON p_partkey = g.feature_id::BIGINT""",
)
def read_mq_sites(spark, sf):
    names, wide = _wide(spark, sf)
    f = part_features(spark, sf).select(
        "feature_id", F.col("feature_id").alias("id"), F.concat("brand", F.lit(";B")).alias("Gene names"), F.lit("T").alias("Amino acid"),
        F.concat(F.col("size").cast("string"), F.lit(";77")).alias("Positions within proteins"), F.lit("").alias("Reverse"),
    )
    df = f.join(wide, "feature_id").orderBy("feature_id").drop("feature_id")
    parts = [c for n in names for c in (F.lit("5").alias(f"Intensity {n}"), F.col(n).alias(f"Intensity {n}___1"), F.lit("1.5").alias(f"Intensity {n}___2"), F.lit("NaN").alias(f"Intensity {n}___3"))]
    sites = tables.read_mq_sites(spark, _save(df.select("id", "Gene names", "Amino acid", tables.quoted("Positions within proteins"), "Reverse", *parts)))
    return sites.cells.withColumn("value", rnd(F.col("value"), 2))


def _with_headers(spark, headers, wide, names, sep):
    """A text file of header lines and one line per feature in order; missing cells stay NA."""
    body = wide.orderBy("feature_id").select(F.concat_ws(sep, *[F.col("line_id") if "line_id" in wide.columns else F.col("feature_id").cast("string"), *[F.col(n) for n in names]]).alias("value"))
    path = scratch_path(spark)
    # the header lines come first in the order of the file names
    spark.createDataFrame([("\n".join(headers),)], "value string").coalesce(1).write.text(f"{path}/a")
    body.write.text(f"{path}/b")
    joined = scratch_path(spark)
    lines = spark.read.text([f"{path}/a", f"{path}/b"]).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines.orderBy("f", "b", "i").select("value").write.text(joined)
    return joined


def _groups(spark, sf):
    return {r[0]: r[1] for r in samples(spark, sf).select("sample_id", "batch").collect()}


@add("read_wide_grouped", f"{GRID} SELECT feature_id, sample_id, batch AS grp, value FROM g JOIN samples USING (sample_id)")
def read_wide_grouped(spark, sf):
    names, wide = _wide(spark, sf)
    of = _groups(spark, sf)
    path = _with_headers(spark, [",".join(["Feature", *names]), ",".join(["Group", *(of[n] for n in names)])], wide, names, ",")
    a, _ = tables.read_wide_grouped(spark, path)
    return a.cells.join(a.samples, "sample_id").select("feature_id", "sample_id", "grp", "value")


@add("read_bait_matrix", f"{GRID} SELECT feature_id AS prey, sample_id, CASE batch WHEN 'B0' THEN 'C' ELSE 'T' END AS status, batch AS bait, value FROM g JOIN samples USING (sample_id)")
def read_bait_matrix(spark, sf):
    names, wide = _wide(spark, sf)
    of = _groups(spark, sf)
    headers = ["\t".join(["", *("C" if of[n] == "B0" else "T" for n in names)]), "\t".join(["", *(of[n] for n in names)]), "\t".join(["Protein", *names])]
    a = tables.read_bait_matrix(spark, _with_headers(spark, headers, wide, names, "\t"), "Protein")
    return a.cells.join(a.samples, "sample_id").join(a.features, "feature_id").select("prey", "sample_id", "status", "bait", "value")


@add("read_category_matrix", f"{GRID} SELECT 'F' || feature_id AS feature_id, sample_id, batch, p_brand AS brand, value FROM g JOIN samples USING (sample_id) JOIN part ON p_partkey = feature_id::BIGINT")
def read_category_matrix(spark, sf):
    names, wide = _wide(spark, sf)
    of = _groups(spark, sf)
    marked = wide.join(part_features(spark, sf).select("feature_id", "brand"), "feature_id")
    line = F.concat(F.lit("('F"), F.col("feature_id").cast("string"), F.lit("', 'cat-0: "), F.col("brand"), F.lit("')"))
    headers = ["\t".join(["", *names]), "\t".join(["cat-0: Batch", *(of[n] for n in names)])]
    a = tables.read_category_matrix(spark, _with_headers(spark, headers, marked.withColumn("line_id", line), names, "\t"))
    brands = a.features.select("feature_id", F.col("categories")[0]["value"].alias("brand"))
    return a.cells.join(a.samples, "sample_id").join(brands, "feature_id").select("feature_id", "sample_id", F.col("Batch").alias("batch"), "brand", "value")


# a matrix whose ids repeat: the brand names several parts
REPEATED = f"""{GRID}, ids AS (SELECT p_partkey::VARCHAR AS feature_id, p_brand || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END AS id FROM part WHERE p_partkey IN (SELECT feature_id FROM cells) WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
d AS (SELECT id AS feature_id, sample_id, value FROM g JOIN ids USING (feature_id))"""


def _repeated(spark, sf):
    names, wide = _wide(spark, sf)
    marked = wide.join(part_features(spark, sf).select("feature_id", "brand"), "feature_id").orderBy("feature_id")
    return Assay(tables.read_matrix(spark, _save(marked.select(F.col("brand").alias("id"), *names))), samples(spark, sf))


@add("read_then_impute_median", f"{REPEATED}, m AS (SELECT sample_id, median(value) AS fill FROM d GROUP BY 1) SELECT feature_id, sample_id, {R('coalesce(value, fill)', 4)} AS value FROM d JOIN m USING (sample_id)")
def read_then_impute_median(spark, sf):
    return impute.simple(_repeated(spark, sf), "median").select("feature_id", "sample_id", rnd(F.col("value"), 4).alias("value"))


def _uniform(tag):
    return f"((('0x' || substr(md5('{tag}|7|' || feature_id || '|' || sample_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@add(
    "read_then_min_prob",
    f"""{REPEATED}, st AS (SELECT sample_id, avg(log10(1 + value)) AS m, stddev_samp(log10(1 + value)) AS sd FROM d WHERE value IS NOT NULL GROUP BY 1)
SELECT feature_id, sample_id, {R(f"coalesce(value, greatest(0, 10 ** (m - 1.8 * sd + sqrt(-2 * ln({_uniform('u1')})) * cos(2 * pi() * {_uniform('u2')}) * 0.3 * sd) - 1))", 4)} AS value FROM d JOIN st USING (sample_id)""",
)
def read_then_min_prob(spark, sf):
    return impute.min_prob(_repeated(spark, sf), seed=7).select("feature_id", "sample_id", rnd(F.col("value"), 4).alias("value"))


@add("read_precursors", f"WITH {P} SELECT run, count(*) AS n, {R('sum(x)', 2)} AS total, count(DISTINCT pg) AS groups, any_value(typeof(1.0::DOUBLE)) AS charge_type FROM p WHERE pg <> 'Unknown' GROUP BY 1")
def read_precursors(spark, sf):
    ours = {v: k for k, v in records.REPORT_COLUMNS.items()}
    raw = precursors(spark, sf)
    path = scratch_path(spark)
    raw.select(*[F.col(c).alias(ours[c]) for c in raw.columns], F.lit(1).alias("Unused.Column")).write.parquet(path)
    p = records.read_precursors(spark, path)
    kept = p.filter("protein_group IS NOT NULL").groupBy("run")
    return kept.agg(F.count("*").alias("n"), rnd(F.sum("normalised"), 2).alias("total"), F.count_distinct("protein_group").alias("groups"), F.upper(F.any_value(F.typeof("charge"))).alias("charge_type"))


@add("read_xic", "SELECT event_type AS run, count(*) AS n, sum(event_id)::DOUBLE AS rt FROM events WHERE event_id % 5 <> 1 GROUP BY 1")
def read_xic(spark, sf):
    base = scratch_path(spark)
    x = chromatograms(spark, sf)
    x.withColumnRenamed("run", "file").write.partitionBy("file").parquet(base)
    rows = records.read_xic(spark, base, r"file=([^/]+)/")
    return rows.groupBy("run").agg(F.count("*").alias("n"), F.sum("rt").alias("rt"))


LONG = f"""WITH {CELLS}, {SAMPLES}, l AS (SELECT feature_id::VARCHAR AS feature_id, sample_id, value FROM cells JOIN samples USING (sample_id) WHERE grp IN ('ASIA', 'EUROPE'))"""


@add("read_long", f"{LONG} SELECT l.feature_id, sample_id, grp, value, p_brand AS group_id FROM l JOIN samples USING (sample_id) JOIN part ON p_partkey = l.feature_id::BIGINT")
def read_long(spark, sf):
    a = assay(spark, sf, features=True)
    rows = a.cells.join(a.samples.filter("grp IN ('ASIA', 'EUROPE')"), "sample_id").join(a.features, "feature_id")
    named = rows.select(F.col("feature_id").alias("Peptide"), F.col("brand").alias("Protein"), F.col("sample_id").alias("Run"), F.col("grp").alias("Condition"), F.col("value").cast("decimal(18,2)").alias("Abundance"))
    long, member = tables.read_long(spark, _save(named, ","))
    return long.cells.join(long.samples, "sample_id").join(member, "feature_id")


@add("read_na_tokens", "SELECT p_partkey AS key, CASE WHEN p_size % 4 IN (0, 1) THEN NULL ELSE p_name END AS value FROM part")
def read_na_tokens(spark, sf):
    size = F.col("size")
    text = F.when(size % 4 == 0, " N/A ").when(size % 4 == 1, "Missing").otherwise(F.concat(F.lit(" "), "name"))
    return part_features(spark, sf).select(F.col("feature_id").alias("key"), na_to_null(text).alias("value"))


@add("read_gmt", "SELECT DISTINCT 'custom' AS leaf, set_name, symbol FROM (SELECT unnest([p_brand, 'SIZE_' || p_size, p_type]) AS set_name, 'g' || p_partkey AS symbol FROM part)")
def read_gmt(spark, sf):
    sets = gene_sets(spark, sf).groupBy("set_name").agg(F.sort_array(F.collect_list("symbol")).alias("g"))
    lines = sets.select(F.concat_ws("\t", "set_name", F.lit("about"), F.array_join("g", "\t")).alias("value"))
    noise = spark.createDataFrame([("# comment",), ("",)], "value string")
    return records.read_gmt(spark, _text(lines.unionByName(noise)))


@add(
    "read_collection",
    "WITH s AS (SELECT p_type AS leaf, p_brand AS set_name, 'g' || p_partkey AS symbol FROM part), f AS (SELECT set_name, min(CASE leaf WHEN 'LARGE' THEN 1 ELSE 2 END) AS r FROM s WHERE leaf IN ('LARGE', 'ECONOMY') GROUP BY 1) SELECT leaf, set_name, symbol FROM s JOIN f USING (set_name) WHERE leaf IN ('LARGE', 'ECONOMY') AND r = CASE leaf WHEN 'LARGE' THEN 1 ELSE 2 END",
)
def read_collection(spark, sf):
    f = part_features(spark, sf)
    sets = f.select(F.col("kind").alias("leaf"), F.col("brand").alias("set_name"), F.concat(F.lit("g"), F.col("feature_id").cast("string")).alias("symbol"))
    return records.collection(sets, ["LARGE", "ECONOMY"])


@add("read_ranked", "SELECT 'g' || p_partkey AS symbol, p_size::DOUBLE AS score FROM part WHERE p_size % 4 < 3")
def read_ranked(spark, sf):
    f = part_features(spark, sf)
    gene, size = F.concat(F.lit("g"), F.col("feature_id").cast("string")), F.col("size")
    sep = F.when(size % 4 == 0, "\t").when(size % 4 == 1, " ; ").otherwise("   ")
    line = F.when(size % 4 == 3, F.concat(gene, F.lit("\tno number"))).otherwise(F.concat(gene, sep, size.cast("string")))
    return records.read_ranked(spark, _text(f.select(line.alias("value"))))


SEQ = "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '\\s', '', 'g')"


@add("read_sequences", f"SELECT 'ACC' || item_id AS accession, 'sp|ACC' || item_id || '|N GN=g' AS header, {SEQ} AS sequence FROM benchmark")
def read_sequences(spark, sf):
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    wrapped = F.regexp_replace(letters, "(.{60})", "$1\n")
    entry = F.concat(F.lit(">sp|ACC"), F.col("item_id").cast("string"), F.lit("|N GN=g\n"), wrapped)
    return records.read_sequences(spark, _text(table(spark, sf, "benchmark").select(entry.alias("value"))))


@add("read_protein_desc", f"SELECT 'ACC' || item_id AS accession, 'ACC' || item_id || ' n' || item_id || ' GN=g' AS header, {SEQ} AS sequence FROM benchmark")
def read_protein_desc(spark, sf):
    b = table(spark, sf, "benchmark")
    key = F.col("item_id").cast("string")
    rows = b.select(F.concat(F.lit("ACC"), key).alias("Accession"), F.concat(F.lit("n"), key).alias("Name"), F.lit("g").alias("Gene"), F.regexp_replace("text", "[^A-Za-z ]", "").alias("Sequence"))
    return records.read_protein_desc(spark, _save(rows))


@add("read_samples", f"WITH {SAMPLES} SELECT sample_id, grp, batch FROM samples")
def read_samples(spark, sf):
    return tables.read_samples(spark, _save(samples(spark, sf).withColumnRenamed("sample_id", "Sample_ID")))


def _melted(df, key, names):
    return tables.melt(df, [tables.quoted(key).alias("key")], names).filter("value IS NOT NULL").select("key", F.col("sample_id").alias("run"), rnd(F.col("value"), 2).alias("value"))


@add("write_protein_matrix", f"WITH {P} SELECT pg AS key, run, {R(VALUES['sum'], 2)} AS value FROM p GROUP BY 1, 2")
def write_protein_matrix(spark, sf):
    path, names = scratch_path(spark), _names(spark, sf)
    sinks.write_pg_matrix(precursors(spark, sf), path, names, "sum")
    return _melted(tables.read_text_table(spark, path), "Protein.Group", names)


@add("write_gene_matrix", f"WITH {P}, src AS (SELECT p.*, unnest(CASE WHEN p_size <> 9 THEN [p_brand, p_type] ELSE ['Unknown'] END) AS gene FROM p) SELECT gene AS key, run, {R(VALUES['sum'], 2)} AS value FROM src GROUP BY 1, 2")
def write_gene_matrix(spark, sf):
    path, names = scratch_path(spark), _names(spark, sf)
    sinks.write_gene_matrix(precursors(spark, sf), path, names, "sum")
    return _melted(tables.read_text_table(spark, path), "Genes", names)


@add("write_peptide_matrix", f"WITH {P} SELECT precursor_id AS key, run, {R('arg_max(x, (rt, x))', 2)} AS value FROM p WHERE x > 0 GROUP BY 1, 2")
def write_peptide_matrix(spark, sf):
    path, names = scratch_path(spark), _names(spark, sf)
    sinks.write_peptide_matrix(precursors(spark, sf), path, names)
    return _melted(tables.read_text_table(spark, path), "Precursor.Id", names)


@add("write_result", "SELECT p_brand AS brand, string_agg(p_partkey::VARCHAR, ';' ORDER BY p_partkey) AS parts FROM part GROUP BY 1")
def write_result(spark, sf):
    path = scratch_path(spark)
    df = part_features(spark, sf).groupBy("brand").agg(F.sort_array(F.collect_list("feature_id")).alias("parts"))
    sinks.write_result(df, path)
    return tables.read_text_table(spark, path, ",")


@add("save_analysis", f"WITH {CELLS} SELECT feature_id, sample_id, value, '0.05' AS alpha FROM cells")
def save_analysis(spark, sf):
    path, a = scratch_path(spark), assay(spark, sf)
    sinks.save_analysis(path, {"cells": a.cells, "samples": a.samples}, {"alpha": "0.05"})
    saved, params = sinks.load_analysis(spark, path)
    return saved["cells"].withColumn("alpha", F.lit(params["alpha"]))
