"""Readers for reports, chromatograms, gene sets, ranked lists and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.operators.joins import clean_file_name
from assaygrid.sources.tables import find_column, quoted, read_text_table

# Report columns that are read, and our names for them.
REPORT_COLUMNS = {
    "Run": "run", "Precursor.Id": "precursor_id", "Modified.Sequence": "modified_sequence", "Stripped.Sequence": "stripped_sequence",
    "Precursor.Charge": "charge", "Protein.Ids": "protein_ids", "Protein.Group": "protein_group", "Protein.Names": "protein_names",
    "Genes": "genes", "Proteotypic": "proteotypic", "Precursor.Mz": "mz", "RT": "rt", "Precursor.Quantity": "quantity",
    "Precursor.Normalised": "normalised", "PG.MaxLFQ": "maxlfq", "Q.Value": "q_value", "Global.Q.Value": "global_q_value",
    "PG.Q.Value": "pg_q_value", "First.Protein.Description": "description",
}
# Tree of gene-set collections.
COLLECTIONS = {
    "H": ["h.all"], "C1": ["c1.all"],
    "C2": ["c2.cgp", "c2.cp.biocarta", "c2.cp.kegg_legacy", "c2.cp.kegg_medicus", "c2.cp.pid", "c2.cp.reactome", "c2.cp.wikipathways"],
    "C3": ["c3.mir.mirdb", "c3.mir.mir_legacy", "c3.tft.gtrd", "c3.tft.tft_legacy"], "C4": ["c4.3ca", "c4.cgn", "c4.cm"],
    "C5": ["c5.go.bp", "c5.go.cc", "c5.go.mf", "c5.hpo"], "C6": ["c6.all"], "C7": ["c7.immunesigdb", "c7.vax"], "C8": ["c8.all"], "C9": ["c9.all"],
}


def read_precursors(spark: SparkSession, path: str) -> DataFrame:
    """Report parquet: the needed columns when at least five exist (all otherwise), numbers as doubles.

    Only the selected columns are read from the files.
    """
    raw = spark.read.parquet(path)
    present = [c for c in REPORT_COLUMNS if c in raw.columns]
    if len(present) < 5:
        return raw
    out = []
    for c in present:
        kind = raw.schema[c].dataType
        col = quoted(c).cast("double") if isinstance(kind, T.NumericType) else quoted(c)
        out.append(col.alias(REPORT_COLUMNS[c]))
    return raw.select(*out)


def read_xic(spark: SparkSession, path: str, run_pattern: str | None = None) -> DataFrame:
    """Chromatogram parquet files: ``run, pr, feature, rt, value`` without the index channel.

    The run is the file name without its suffix, or the group of ``run_pattern`` in the path.
    """
    raw = spark.read.parquet(path)
    file = F.input_file_name()
    run = clean_file_name(file) if run_pattern is None else F.regexp_extract(file, run_pattern, 1)
    rows = raw.select(run.alias("run"), "pr", "feature", F.col("rt").cast("double").alias("rt"), F.col("value").cast("double").alias("value"))
    return rows.filter(F.col("feature") != "index")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines without comments, with their place in the input."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("line"), place.alias("place"))
    return lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_gmt(spark: SparkSession, path: str, leaf: str | None = None) -> DataFrame:
    """Gene sets: name, description and genes separated by tabs; the first definition of a name wins."""
    parts = _lines(spark, path).select(F.split("line", "\t").alias("p"), "place")
    named = parts.select(F.trim(F.col("p")[0]).alias("set_name"), F.slice("p", 3, F.size("p")).alias("genes"), "place").filter("set_name <> ''")
    first = named.groupBy("set_name").agg(F.min_by("genes", "place").alias("genes"))
    genes = first.select(F.lit(leaf or "custom").alias("leaf"), "set_name", F.explode("genes").alias("symbol"))
    return genes.withColumn("symbol", F.trim("symbol")).filter("symbol <> ''").distinct()


def collection(sets: DataFrame, leaves: Sequence[str]) -> DataFrame:
    """Sets of the chosen leaves; a name in several leaves keeps the members of the first leaf given.

    A branch of the tree, such as ``C2``, stands for all its leaves.
    """
    leaves = list(dict.fromkeys(x for leaf in leaves for x in COLLECTIONS.get(leaf, [leaf])))
    rank = F.array_position(F.array(*[F.lit(x) for x in leaves]), F.col("leaf"))
    kept = sets.filter(F.col("leaf").isin(list(leaves))).withColumn("_r", rank)
    first = kept.groupBy("set_name").agg(F.min("_r").alias("_r"))
    return kept.join(first, ["set_name", "_r"]).select("leaf", "set_name", "symbol").distinct()


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """Gene and score per line, separated by tab, comma or semicolon, else by blanks; other lines are skipped."""
    line = F.col("line")
    packed = F.split(line, r"[\t,;]+")
    parts = F.when(F.size(packed) >= 2, packed).otherwise(F.split(line, r"\s+"))
    rows = _lines(spark, path).withColumn("p", parts).filter(F.size("p") >= 2)
    score = F.trim(F.col("p")[1]).try_cast("double")
    return rows.select(F.trim(F.col("p")[0]).alias("symbol"), score.alias("score")).filter("symbol <> '' AND score IS NOT NULL AND NOT isnan(score)")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Sequence entries starting with ``>``: ``accession, header, sequence``.

    The separator is the line break before ``>``, so an entry is one record however long it is.
    """
    entries = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>|\r", "").alias("e"))
    header = F.trim(F.element_at(F.split("e", "\n", 2), 1))
    body = F.element_at(F.split("e", "\n", 2), 2)
    sequence = F.upper(F.regexp_replace(body, r"\s+", ""))
    first = F.element_at(F.split(header, r"\s+"), 1)
    parts = F.split(first, r"\|")
    second = F.get(parts, F.lit(1))
    accession = F.when(F.size(parts) >= 3, second).when(F.size(parts) == 2, F.coalesce(F.nullif(second, F.lit("")), parts[0])).otherwise(first)
    rows = entries.filter(F.size(F.split("e", "\n", 2)) == 2)
    return rows.select(accession.alias("accession"), header.alias("header"), sequence.alias("sequence")).filter("sequence <> ''")


# Accepted headers of the description table.
DESCRIPTION_ALIASES = {
    "accession": ["protein.id", "id", "accession", "protein"],
    "sequence": ["sequence", "seq", "protein.sequence"],
    "name": ["protein.name", "name"],
    "gene": ["gene", "genes", "genename"],
    "description": ["description", "desc", "protein.description"],
}


def read_protein_desc(spark: SparkSession, path: str) -> DataFrame:
    """Protein descriptions as sequences: id, letters of the sequence, and a header built from the other columns.

    Without a sequence header the first and last columns are taken.
    """
    df = read_text_table(spark, path)
    cols = {k: find_column(df.columns, names) for k, names in DESCRIPTION_ALIASES.items()}
    if cols["sequence"] is None:
        df = read_text_table(spark, path, header=False)
        cols = {"accession": df.columns[0], "sequence": df.columns[-1], "name": None, "gene": None, "description": None}
    if cols["accession"] is None:
        raise ValueError("no protein id column")

    def text(k: str):
        return F.nullif(F.trim(quoted(cols[k])), F.lit("")) if cols[k] else F.lit(None).cast("string")

    sequence = F.upper(F.regexp_replace(quoted(cols["sequence"]), "[^A-Za-z]", ""))
    header = F.concat_ws(" ", text("accession"), text("name"), F.concat(F.lit("GN="), text("gene")), text("description"))
    return df.select(text("accession").alias("accession"), header.alias("header"), sequence.alias("sequence")).filter("accession IS NOT NULL AND sequence <> ''")
