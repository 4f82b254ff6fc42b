"""Queries over metadata operators and join shapes. Runs and row ids are derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.model import Assay
from assaygrid.operators import joins, meta
from assaygrid.plans.bind import CELLS, R, SAMPLES, Catalog, assay, part_features, rnd, samples, table

catalog = Catalog()
add = catalog.add


def _runs(spark, sf, fmt: str):
    """Suppliers as runs; ``fmt`` is a SQL expression over region, key."""
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.expr(fmt).alias("sample_id"))


RUNS = "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@add("meta_simplify_names", f"SELECT 'E:/searches/set_1\\20240101_' || r_name || '_' || s_suppkey || '.raw' AS sample_id, r_name || '_' || s_suppkey AS name {RUNS}")
def simplify_names(spark, sf):
    runs = _runs(spark, sf, r"concat('E:/searches/set_1\\20240101_', r_name, '_', s_suppkey, '.raw')")
    return meta.simplify_names(runs).select("sample_id", "name")


@add("meta_simplify_digits", f"SELECT 'D:/x/' || s_suppkey || '_T1.raw' AS sample_id, 'S' || s_suppkey || '_T1' AS name {RUNS}")
def simplify_digits(spark, sf):
    return meta.simplify_names(_runs(spark, sf, "concat('D:/x/', s_suppkey, '_T1.raw')")).select("sample_id", "name")


@add("meta_shorten_names", f"SELECT '/data/plate_' || r_name || '_' || s_suppkey || '_DIA.raw' AS sample_id, r_name || '_' || s_suppkey AS short {RUNS}")
def shorten_names(spark, sf):
    # the cut goes back to the separator on both sides
    out = meta.shorten_names(_runs(spark, sf, "concat('/data/plate_', r_name, '_', s_suppkey, '_DIA.raw')"))
    return out.select("sample_id", F.regexp_replace("short", "^_|_$", "").alias("short"))


REP = "concat_ws('_', replace(r_name, ' ', ''), concat('R', lpad(cast(s_suppkey % 5 + 1 as string), 2, '0')), concat('T', cast(s_suppkey % 2 + 1 as string)), concat('K', cast(s_suppkey as string)), case when s_suppkey % 3 = 0 then 'NS' else concat(cast(s_suppkey % 3 * 5 as string), 'min') end)"


@add(
    "meta_parse_replicates",
    f"""WITH r AS (SELECT replace(r_name, ' ', '') AS g, 'R' || lpad((s_suppkey % 5 + 1)::VARCHAR, 2, '0') AS r, 'T' || (s_suppkey % 2 + 1) AS t, 'K' || s_suppkey AS k,
  CASE WHEN s_suppkey % 3 = 0 THEN 'NS' ELSE (s_suppkey % 3 * 5) || 'min' END AS tm {RUNS})
SELECT concat_ws('_', g, r, t, k, tm) AS sample_id, tm AS Time, NULL::VARCHAR AS Sample, r AS Biological_Replicate, t AS Technical_Replicate, g || '_' || k AS "Group" FROM r""",
)
def parse_replicates(spark, sf):
    return meta.parse_replicates(_runs(spark, sf, REP))


@add("meta_infer_groups", f"SELECT left(r_name, 6) || '_' || s_suppkey AS sample_id, left(r_name, 6) AS \"Group\" {RUNS}")
def infer_groups(spark, sf):
    return meta.infer_groups(_runs(spark, sf, "concat(left(r_name, 6), '_', s_suppkey)"))


@add(
    "meta_keyword_columns",
    f"""WITH r AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'Ctrl' WHEN 1 THEN 'treated' ELSE 'x' END || '_batch' || (s_suppkey % 4) || '_' || s_suppkey AS sample_id, s_suppkey {RUNS})
SELECT sample_id, CASE s_suppkey % 3 WHEN 0 THEN 'Control' WHEN 1 THEN 'Treatment' END AS Treatment, 'batch' || (s_suppkey % 4) AS Batch FROM r""",
)
def keyword_columns(spark, sf):
    fmt = "concat(case s_suppkey % 3 when 0 then 'Ctrl' when 1 then 'treated' else 'x' end, '_batch', s_suppkey % 4, '_', s_suppkey)"
    return meta.keyword_cols(_runs(spark, sf, fmt))


@add(
    "meta_backfill_replicates",
    f"""SELECT 'g_R' || s_suppkey || '_T' || (s_suppkey % 3) AS sample_id, CASE s_suppkey % 2 WHEN 0 THEN 'R' || s_suppkey ELSE 'R7' END AS Biological_Replicate,
'T' || (s_suppkey % 3) AS Technical_Replicate {RUNS}""",
)
def backfill_replicates(spark, sf):
    runs = _runs(spark, sf, "concat('g_R', s_suppkey, '_T', s_suppkey % 3)")
    key = F.regexp_extract("sample_id", r"R(\d+)", 1).cast("int")
    given = runs.withColumn("Biological_Replicate", F.when(key % 2 == 0, "N.D.").otherwise("R7")).withColumn("Technical_Replicate", F.lit(" - "))
    return meta.backfill_replicates(given)


@add(
    "meta_attach",
    f"""WITH {CELLS}, {SAMPLES}, m AS (SELECT sample_id, CASE WHEN grp = 'ASIA' THEN NULL ELSE grp END AS grp FROM samples WHERE batch = 'B0')
SELECT coalesce(grp, '(unassigned)') AS grp, count(*) AS n, {R('sum(value)', 2)} AS total FROM cells LEFT JOIN m USING (sample_id) GROUP BY 1""",
)
def attach(spark, sf):
    a = assay(spark, sf)
    known = a.samples.filter("batch = 'B0'").withColumn("grp", F.when(F.col("grp") == "ASIA", " ").otherwise(F.col("grp")))
    out = meta.attach_meta(Assay(a.cells, known), "grp").groupBy("grp")
    return out.agg(F.count("*").alias("n"), rnd(F.sum("value"), 2).alias("total"))


@add(
    "meta_site_ids",
    """WITH s AS (SELECT p_partkey AS k, 'G' || (p_size % 7) AS g1, substr('STY', p_size % 3 + 1, 1) AS res, p_size AS pos FROM part),
i AS (SELECT k, CASE WHEN pos % 11 = 0 THEN 'row_' || k ELSE g1 || '_' || res || pos END AS id FROM s),
n AS (SELECT k, id, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM i)
SELECT k, CASE WHEN rn > 1 THEN id || '_' || rn ELSE id END AS site_id FROM n""",
)
def site_ids(spark, sf):
    size = F.col("size")
    gene = F.concat(F.lit("G"), (size % 7).cast("string"), F.when(size % 2 == 0, ";GX").otherwise(""))
    named = size % 11 != 0  # the others have no name at all
    rows = part_features(spark, sf).select(
        F.col("feature_id").alias("k"), F.when(named, gene).alias("gene"), F.when(named, F.substring(F.lit("STY"), size % 3 + 1, F.lit(1))).alias("res"),
        F.concat(size.cast("string"), F.lit(";9")).alias("pos"), F.when(named, "P").alias("protein"),
    )
    return meta.site_ids(rows, "gene", "res", "pos", ["protein"], "k").select("k", "site_id")


@add("meta_group_counts", f"WITH {SAMPLES} SELECT grp, count(*) AS n FROM samples GROUP BY 1")
def group_counts(spark, sf):
    return meta.group_counts(samples(spark, sf), "grp")


@add(
    "meta_flow_links",
    """WITH c AS (SELECT CASE WHEN p_size % 10 = 3 THEN NULL ELSE p_type END AS kind, p_brand AS brand, p_size::VARCHAR AS size FROM part),
k AS (SELECT * FROM c WHERE kind IS NOT NULL),
tb AS (SELECT brand FROM k GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 9), ts AS (SELECT size FROM k GROUP BY size ORDER BY count(*) DESC, size LIMIT 9),
m AS (SELECT kind, CASE WHEN brand IN (FROM tb) THEN brand ELSE '(other ' || ((SELECT count(DISTINCT brand) FROM k) - 9) || ')' END AS brand,
  CASE WHEN size IN (FROM ts) THEN size ELSE '(other ' || ((SELECT count(DISTINCT size) FROM k) - 9) || ')' END AS size FROM k)
SELECT 0 AS level, kind AS source, brand AS target, count(*) AS n FROM m GROUP BY 2, 3 UNION ALL SELECT 1, brand, size, count(*) FROM m GROUP BY 2, 3""",
)
def flow_links(spark, sf):
    kind = F.when(F.col("size") % 10 != 3, F.col("kind"))
    rows = part_features(spark, sf).select(kind.alias("kind"), "brand", F.col("size").cast("string").alias("size"))
    return meta.flow_links(rows, ["kind", "brand", "size"], 10)


@add("meta_flow_skipped", "SELECT count(*) AS n_skipped FROM part WHERE p_size % 10 = 3")
def flow_skipped(spark, sf):
    rows = part_features(spark, sf).select(F.when(F.col("size") % 10 != 3, F.col("kind")).alias("kind"), "brand")
    return meta.skipped_rows(rows, ["kind", "brand"])


ACC = "CASE p_size % 4 WHEN 0 THEN 'P' || lpad((p_partkey % 100000)::VARCHAR, 5, '1') WHEN 1 THEN 'A0A' || lpad((p_partkey % 10)::VARCHAR, 1, '0') || 'BC' || 'D12' || (p_size % 10) WHEN 2 THEN 'GENE' || p_partkey ELSE 'Q9' || 'Z' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') END"
ACC_SPARK = "case size % 4 when 0 then concat('P', lpad(cast(feature_id % 100000 as string), 5, '1')) when 1 then concat('A0A', lpad(cast(feature_id % 10 as string), 1, '0'), 'BC', 'D12', size % 10) when 2 then concat('GENE', feature_id) else concat('Q9', 'Z', lpad(cast(feature_id % 1000 as string), 3, '0')) end"


def _accessions(spark, sf):
    return part_features(spark, sf).select(F.col("feature_id").alias("key"), F.expr(ACC_SPARK).alias("feature_id"))


@add(
    "meta_is_accession",
    f"""WITH a AS (SELECT p_partkey AS key, {ACC} AS feature_id FROM part)
SELECT key, feature_id, len(feature_id) BETWEEN 6 AND 13 AND regexp_matches(feature_id, '{meta.ACCESSION}') AS is_acc FROM a""",
)
def is_accession(spark, sf):
    return _accessions(spark, sf).withColumn("is_acc", meta.is_accession(F.col("feature_id")))


@add(
    "meta_map_names",
    f"""WITH a AS (SELECT p_partkey AS key, {ACC} AS q FROM part),
l AS (SELECT 'GENE' || p_partkey AS sym, p_name AS pn, 'P' || lpad((p_partkey % 100000)::VARCHAR, 5, '1') AS ac FROM part WHERE p_type <> 'ECONOMY'),
h AS (SELECT ac AS k, count(*) AS n, min((sym, pn, ac)) AS hit FROM l GROUP BY 1 UNION ALL SELECT sym, 1, (sym, pn, ac) FROM l)
SELECT q || ';other x' AS feature_id, q AS query_id, coalesce(hit[1], '') AS gene_symbol, coalesce(hit[2], '') AS protein_name, coalesce(hit[3], '') AS uniprotkb_ac,
'9606' AS species_taxid, CASE WHEN hit IS NULL THEN 'no hit' WHEN n > 1 THEN 'multiple: ' || n ELSE '' END AS mapping_note FROM a LEFT JOIN h ON k = q""",
)
def map_names(spark, sf):
    f = part_features(spark, sf)
    ids = f.select(F.concat(F.expr(ACC_SPARK), F.lit(";other x")).alias("feature_id"))
    lookup = f.filter("kind <> 'ECONOMY'").select(
        F.concat(F.lit("GENE"), F.col("feature_id").cast("string")).alias("gene_symbol"), F.col("name").alias("protein_name"),
        F.expr("concat('P', lpad(cast(feature_id % 100000 as string), 5, '1'))").alias("uniprotkb_ac"), F.lit("9606").alias("species_taxid"),
    )
    return meta.map_names(ids, lookup)


@add(
    "meta_resolve_symbol",
    """SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN 'A' || p_size WHEN p_size % 3 = 1 THEN 'M' || p_size ELSE 'P' || p_partkey END AS symbol FROM part""",
)
def resolve_symbol(spark, sf):
    size = F.col("size")
    rows = part_features(spark, sf).select(
        F.col("feature_id").alias("key"),
        F.concat(F.lit("P"), F.col("feature_id").cast("string"), F.lit("_HUMAN|x")).alias("feature_id"),
        F.when(size % 3 == 0, F.concat(F.lit("A"), size.cast("string"), F.lit("_mouse;B"))).alias("genes"),
        F.when(size % 3 == 1, F.concat(F.lit(" M"), size.cast("string"))).otherwise("").alias("mapped"),
    )
    return meta.resolve_symbol(rows, "genes", "mapped").select("key", "symbol")


@add(
    "meta_strip_species",
    """SELECT p_partkey AS key, 'X' || p_partkey || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE '_abc' END AS stem FROM part""",
)
def strip_species(spark, sf):
    size = F.col("size")
    tail = F.when(size % 3 == 0, "_HUMAN").when(size % 3 == 1, "_ecoli").otherwise("_abc")
    rows = part_features(spark, sf).select(F.col("feature_id").alias("key"), F.concat(F.lit("X"), F.col("feature_id").cast("string"), tail).alias("t"))
    return rows.select("key", meta.strip_species(F.col("t")).alias("stem"))


@add(
    "meta_id_profile",
    f"""WITH a AS (SELECT {ACC} AS t FROM part), p AS (SELECT count(*) AS n,
  avg((len(t) BETWEEN 6 AND 13 AND regexp_matches(t, '{meta.ACCESSION}'))::INT) AS accession, 0.0::DOUBLE AS long,
  avg((len(t) <= 20 AND regexp_matches(t, '^[A-Za-z][A-Za-z0-9_-]*$'))::INT) AS symbol FROM a)
SELECT n, {R('accession')} AS accession, long, {R('symbol')} AS symbol, accession > 0.12 OR long > 0.2 OR symbol < 0.38 AS need_mapping FROM p""",
)
def id_profile(spark, sf):
    out = meta.id_profile(_accessions(spark, sf))
    return out.select("n", *[rnd(F.col(c)).alias(c) for c in ("accession", "long", "symbol")], "need_mapping")


@add(
    "meta_guess_species",
    """SELECT CASE WHEN m >= 5 AND m >= 2 * h + 1 THEN 'Mouse' WHEN h >= 5 AND h >= 2 * m + 1 THEN 'Human' END AS species, 'high' AS confidence,
2 + least(16, 2 * h) AS human, 2 + least(16, 2 * m) AS mouse FROM (SELECT count(*) FILTER (WHERE p_size % 5 < 4) AS h, count(*) FILTER (WHERE p_size % 5 = 4) AS m FROM part)""",
)
def guess_species(spark, sf):
    mark = F.when(F.col("size") % 5 < 4, "_HUMAN").otherwise("_MOUSE")
    rows = part_features(spark, sf).select(F.concat(F.lit("P"), F.col("feature_id").cast("string"), mark).alias("name"))
    return meta.guess_species(rows, "name", rows)


@add(
    "meta_symbol_index",
    """WITH p AS (SELECT p_partkey AS k, upper(p_name) AS nm FROM part), u AS (
  SELECT 'P' || k AS symbol, k FROM p UNION SELECT unnest(string_split(nm, ' ')), k FROM p)
SELECT symbol, 'P' || k || '_RAT;zz' AS feature_id FROM u""",
)
def symbol_index(spark, sf):
    key = F.concat(F.lit("P"), F.col("feature_id").cast("string"), F.lit("_RAT;zz"))
    return meta.symbol_index(part_features(spark, sf).select(key.alias("feature_id"), "name"), genes="name")


@add(
    "meta_gene_list",
    """SELECT DISTINCT 'G' || unnest([p_partkey % 997, p_size]) AS gene FROM part WHERE p_size % 2 = 0""",
)
def gene_list(spark, sf):
    packed = F.concat_ws("; ", F.concat(F.lit("G"), (F.col("feature_id") % 997).cast("string"), F.lit("_PIG")), F.concat(F.lit("G"), F.col("size").cast("string")))
    rows = part_features(spark, sf).select("feature_id", F.when(F.col("size") % 2 == 0, packed).alias("genes"))
    return meta.gene_list(rows, "genes")


@add("meta_label", "SELECT p_partkey AS feature_id, CASE WHEN p_size > 25 THEN p_name ELSE p_partkey::VARCHAR END AS label FROM part")
def label(spark, sf):
    rows = part_features(spark, sf).withColumn("shown", F.when(F.col("size") > 25, F.col("name")).otherwise("  "))
    return rows.select("feature_id", meta.label("shown").alias("label"))


@add(
    "meta_edit",
    f"""WITH {SAMPLES} SELECT sample_id, grp AS region, CASE WHEN sample_id IN ('NATION_1', 'NATION_2') THEN 'x' ELSE '' END AS note FROM samples""",
)
def edit(spark, sf):
    edits = [("add", "note"), ("rename", "grp", "region"), ("drop", "batch"), ("set", "note", ["NATION_1", "NATION_2"], "x")]
    return meta.edit_meta(samples(spark, sf), edits)


@add(
    "join_lookup_first",
    """SELECT s_suppkey AS key, arg_min(p_name, p_partkey) AS name FROM supplier LEFT JOIN part ON p_size = s_suppkey % 60 GROUP BY 1""",
)
def lookup_first(spark, sf):
    left = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 60).alias("size"))
    right = part_features(spark, sf).select(F.col("size").cast("bigint").alias("size"), "name", "feature_id")
    return joins.lookup_first(left, right, "size", F.col("feature_id")).select("key", "name")


@add(
    "join_fallback",
    """WITH ids AS (SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 'Acc' || p_partkey WHEN 1 THEN 'Acc' || p_partkey || '-2' WHEN 2 THEN 'ACC' || p_partkey ELSE 'none' || p_partkey END AS acc, p_size, p_name FROM part)
SELECT k, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS matched_by, CASE WHEN p_size % 4 < 3 THEN p_name END AS name FROM ids""",
)
def fallback(spark, sf):
    f, size, key = part_features(spark, sf), F.col("size"), F.col("feature_id").cast("string")
    acc = (
        F.when(size % 4 == 0, F.concat(F.lit("Acc"), key)).when(size % 4 == 1, F.concat(F.lit("Acc"), key, F.lit("-2")))
        .when(size % 4 == 2, F.concat(F.lit("ACC"), key)).otherwise(F.concat(F.lit("none"), key))
    )
    right = f.select(F.concat(F.lit("Acc"), key).alias("accession"), "name")
    return joins.fallback_join(f.select(F.col("feature_id").alias("k"), acc.alias("acc")), right, "acc", "accession").select("k", "matched_by", "name")


@add("join_match_runs", "SELECT '/x/' || n_name || '.xic.parquet' AS path, 'C:\\r\\' || lower(n_name) || '.raw' AS run FROM nation")
def match_runs(spark, sf):
    n = table(spark, sf, "nation")
    files = n.select(F.concat(F.lit("/x/"), "n_name", F.lit(".xic.parquet")).alias("path"))
    runs = n.select(F.concat(F.lit("C:\\r\\"), F.lower("n_name"), F.lit(".raw")).alias("run"))
    return joins.match_runs(files, runs)
