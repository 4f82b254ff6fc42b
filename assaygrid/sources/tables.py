"""Readers for matrices and metadata. Everything is read as text; formats cast what they need."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.functions.missing import na_to_null
from assaygrid.model import Assay
from assaygrid.operators.meta import number_duplicates, site_ids
from assaygrid.operators.ranking import row_numbers


def quoted(name: str) -> Column:
    """A column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(c: Column) -> Column:
    """The number in a text cell; null when missing or unparseable."""
    return na_to_null(c).try_cast("double")


def read_text_table(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=header, inferSchema=False, mode="PERMISSIVE")


def placed(df: DataFrame) -> DataFrame:
    """A frame just read from text files with ``_place``: file, block and row, which order the lines of the input."""
    return df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("_place"))


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """First of ``names`` that occurs, ignoring case."""
    by_lower = {c.strip().lower(): c for c in reversed(columns)}
    return next((by_lower[n.lower()] for n in names if n.lower() in by_lower), None)


def melt(df: DataFrame, ids: Sequence[Column], values: Sequence[str], fill: float | None = None) -> DataFrame:
    """Long cells of the ``values`` columns: the id columns, ``sample_id`` and a numeric ``value``."""
    entries = [F.struct(F.lit(v).alias("sample_id"), number(quoted(v)).alias("value")) for v in values]
    long = df.select(*ids, F.inline(F.array(*entries)))
    return long.fillna(fill, ["value"]) if fill is not None else long


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Plain matrix: header row, ids in the first column, unparseable cells missing; later duplicates of an id get a number."""
    df = read_text_table(spark, path, sep)
    named = number_duplicates(placed(df).withColumn("_id", quoted(df.columns[0])), "_id", "_place")
    return melt(named, [F.col("_id").alias("feature_id")], df.columns[1:])


def read_samples(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Sample table: the first column is the sample id, all columns are text."""
    df = read_text_table(spark, path, sep)
    return df.withColumnRenamed(df.columns[0], "sample_id")


# ---- precursor software matrices -----------------------------------------------


# Id columns of the report, by preference.
PG_IDS = ["Protein.Names", "Genes", "First.Protein.Description", "Protein.Group"]


def read_diann_pg(spark: SparkSession, path: str, id_col: str = "Protein.Names", sep: str = "\t") -> Assay:
    """Protein-group matrix: six annotation columns, then intensities; non-numeric cells become 0.

    Without the wanted id column the next of names, genes, description, group is taken. Rows with a blank
    id are dropped unless the id is the group; later duplicates of an id get a number.
    """
    df = read_text_table(spark, path, sep)
    if len(df.columns) < 7:
        raise ValueError("expected at least 7 columns")
    chosen = find_column(df.columns, [id_col, *PG_IDS]) or df.columns[0]
    key = F.trim(F.coalesce(quoted(chosen), F.lit("")))
    return _annotated(df, key, chosen.lower() != "protein.group", df.columns[:6], df.columns[6:])


def read_diann_gg(spark: SparkSession, path: str, sep: str = "\t") -> Assay:
    """Gene-group matrix: ids in the first column, intensities from the fourth; later duplicates of an id get a number."""
    df = read_text_table(spark, path, sep)
    key = F.trim(F.coalesce(quoted(df.columns[0]), F.lit("")))
    return _annotated(df, key, True, df.columns[:3], df.columns[3:])


def _annotated(df: DataFrame, key: Column, drop_blank: bool, notes: Sequence[str], values: Sequence[str]) -> Assay:
    keyed = placed(df).withColumn("_id", key)
    named = number_duplicates(keyed.filter("_id <> ''") if drop_blank else keyed, "_id", "_place")
    cells = melt(named, [F.col("_id").alias("feature_id")], values, 0.0)
    features = named.select(F.col("_id").alias("feature_id"), *[quoted(c).alias(_plain(c)) for c in notes])
    samples = df.sparkSession.createDataFrame([(v,) for v in values], "sample_id string")
    return Assay(cells, samples, features)


def _plain(name: str) -> str:
    return re.sub(r"\W+", "_", name.strip()).strip("_").lower()


# Annotation columns of the site report.
SITE_NOTES = ["Protein", "Protein.Names", "Gene.Names", "Residue", "Site", "Sequence"]


def read_diann_sites(spark: SparkSession, path: str, sep: str = "\t") -> Assay:
    """Site matrix: six annotation columns, then intensities; ids like ``AKT1_S473``."""
    df = read_text_table(spark, path, sep)
    notes = [find_column(df.columns, [c]) for c in SITE_NOTES]
    if None in notes:
        raise ValueError(f"expected the columns {SITE_NOTES}")
    renamed = placed(df).select(*[quoted(c).alias(_plain(n)) for n, c in zip(SITE_NOTES, notes)], *[quoted(c) for c in df.columns if c not in notes], "_place")
    # lines in the order of the input, numbered from 1
    ordered_lines = row_numbers(renamed, [("_place", True)], out="_line").drop("_place")
    named = site_ids(ordered_lines, "gene_names", "residue", "site", ["protein_names", "protein"], "_line")
    values = [c for c in df.columns if c not in notes]
    cells = melt(named, [F.col("site_id").alias("feature_id")], values, 0.0)
    features = named.select(F.col("site_id").alias("feature_id"), *[_plain(n) for n in SITE_NOTES])
    return Assay(cells, spark.createDataFrame([(v,) for v in values], "sample_id string"), features)


# ---- quantification tables with per-experiment columns ------------------------------


# Columns whose + marks a row to drop, and id columns by preference.
FLAGS = ["Reverse", "Potential contaminant", "Only identified by site"]
PROTEIN_IDS = ["Gene names", "Protein names", "Majority protein IDs", "Protein IDs", "id"]


def _experiments(columns: Sequence[str], prefix: str) -> dict[str, str]:
    found = {c[len(prefix) + 1 :]: c for c in columns if c.startswith(prefix + " ") and "___" not in c}
    return {k: v for k, v in found.items() if k.strip()}


def _without_flags(df: DataFrame) -> DataFrame:
    for flag in FLAGS:
        col = find_column(df.columns, [flag])
        if col:
            df = df.filter(F.coalesce(F.trim(quoted(col)), F.lit("")) != "+")
    return df


def _first_entry(col: str) -> Column:
    return F.nullif(F.trim(F.element_at(F.split(quoted(col), ";"), 1)), F.lit(""))


def _unique(df: DataFrame) -> DataFrame:
    return number_duplicates(df, "feature_id", "_place")


def read_mq_proteins(
    spark: SparkSession, path: str, quant: str = "LFQ intensity", id_col: str = "Gene names", remove_contaminants: bool = True, sep: str = "\t"
) -> Assay:
    """Protein table: LFQ columns if present, else raw intensity; first id entry; missing becomes 0.

    Rows marked ``+`` as reverse, contaminant or site-only are dropped; later duplicates of an id get a number.
    """
    df = read_text_table(spark, path, sep)
    experiments = _experiments(df.columns, quant) or _experiments(df.columns, "Intensity")
    columns, df = df.columns, placed(df)
    if remove_contaminants:
        df = _without_flags(df)
    options = [find_column(df.columns, [c]) for c in [id_col, *PROTEIN_IDS]]
    key = F.coalesce(*[_first_entry(c) for c in options if c])
    named = _unique(df.withColumn("feature_id", key).filter("feature_id IS NOT NULL"))
    entries = [F.struct(F.lit(k).alias("sample_id"), F.coalesce(number(quoted(c)), F.lit(0.0)).alias("value")) for k, c in experiments.items()]
    cells = named.select("feature_id", F.inline(F.array(*entries)))
    notes = [c for c in columns if not any(c.endswith(" " + k) for k in experiments)]
    features = named.select("feature_id", *[quoted(c).alias(_plain(c)) for c in notes if _plain(c) != "feature_id"])
    return Assay(cells, spark.createDataFrame([(k,) for k in experiments], "sample_id string"), features)


def read_mq_sites(spark: SparkSession, path: str, id_mode: str = "gene", remove_contaminants: bool = True, sep: str = "\t") -> Assay:
    """Site table: per-experiment intensities, the ``___1..3`` multiplicities summed where there are any.

    ``id_mode``: ``gene``, ``protein`` (names with residue and position), ``leading`` (protein and position) or ``id``.
    """
    df = read_text_table(spark, path, sep)
    columns, df = df.columns, placed(df)
    if remove_contaminants:
        df = _without_flags(df)
    parts: dict[str, list[str]] = {}
    for c in df.columns:
        m = re.match(r"^Intensity (.+?)(___\d+)?$", c)
        if m:
            parts.setdefault(m.group(1), []).append(c)
    entries = []
    for name, cols in parts.items():
        expanded = [c for c in cols if "___" in c] or cols
        total = sum((F.coalesce(number(quoted(c)), F.lit(0.0)) for c in expanded[1:]), F.coalesce(number(quoted(expanded[0])), F.lit(0.0)))
        entries.append(F.struct(F.lit(name).alias("sample_id"), total.alias("value")))

    def entry(names: list[str]) -> Column:
        col = find_column(df.columns, names)
        return _first_entry(col) if col else F.lit(None).cast("string")

    position = F.trim(F.element_at(F.split(F.coalesce(entry(["Position"]), entry(["Positions within proteins"])), "[;,]"), 1))
    residue = entry(["Amino acid"])
    gene, protein = entry(["Gene names"]), entry(["Protein names", "Proteins", "Protein"])
    leading, own = entry(["Leading proteins", "Proteins"]), entry(["id"])
    key = {
        "gene": F.concat(F.coalesce(gene, protein, leading), F.lit("_"), residue, position),
        "protein": F.concat(F.coalesce(protein, leading), F.lit("_"), residue, position),
        "leading": F.concat(leading, F.lit("_"), position),
        "id": own,
    }[id_mode]
    named = _unique(df.withColumn("feature_id", F.coalesce(key, own)).filter("feature_id IS NOT NULL"))
    cells = named.select("feature_id", F.inline(F.array(*entries)))
    notes = [c for c in columns if not c.startswith("Intensity ")]
    features = named.select("feature_id", *[quoted(c).alias(_plain(c)) for c in notes if _plain(c) != "feature_id"])
    return Assay(cells, spark.createDataFrame([(k,) for k in parts], "sample_id string"), features)


# ---- grouped tables ------------------------------------------------------------


# Accepted headers of the long form.
LONG_ALIASES = {
    "feature_id": ["feature", "feature_id", "peptide", "precursor", "id"],
    "group_id": ["feature group", "feature_group", "protein", "protein group"],
    "sample_id": ["sample", "sample_id", "run"],
    "grp": ["group", "condition"],
    "value": ["intensity", "value", "abundance"],
}


def read_long(spark: SparkSession, path: str, sep: str = ",") -> tuple[Assay, DataFrame]:
    """Long table ``feature[, feature group], sample, group, intensity`` with exactly two groups: assay and membership."""
    df = read_text_table(spark, path, sep)
    cols = {name: find_column(df.columns, names) for name, names in LONG_ALIASES.items()}
    lacking = [n for n in ("feature_id", "sample_id", "grp", "value") if cols[n] is None]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    group = quoted(cols["group_id"]) if cols["group_id"] else quoted(cols["feature_id"])
    rows = df.select(
        *[F.trim(quoted(cols[n])).alias(n) for n in ("feature_id", "sample_id", "grp")], F.trim(group).alias("group_id"), number(quoted(cols["value"])).alias("value")
    )
    n = rows.agg(F.count_distinct("grp")).first()[0]
    if n != 2:
        raise ValueError(f"expected exactly two groups, found {n}")
    cells = rows.select("feature_id", "sample_id", "value")
    samples = rows.groupBy("sample_id").agg(F.min("grp").alias("grp"))
    return Assay(cells, samples), rows.select("feature_id", "group_id").distinct()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one file that are not blank, with their place."""
    return placed(spark.read.text(path)).filter(F.trim("value") != "")


def _head(spark: SparkSession, path: str, n: int, sep: str) -> list[tuple]:
    """The first ``n`` lines: place and cells. A folder is read in the order of its file names."""
    first = _lines(spark, path).orderBy("_place").limit(n).collect()
    return [(r["_place"], r["value"].rstrip("\r").split(sep)) for r in first]


def _body(spark: SparkSession, path: str, last, width: int, sep: str) -> DataFrame:
    """The lines after the place ``last`` as text columns ``c0..``, with their place."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    # the place is compared as a whole, so a line equal to a header line stays
    limit = F.struct(F.lit(last["file_path"]).alias("file_path"), F.lit(last["file_block_start"]).alias("file_block_start"), F.lit(last["row"]).alias("row"))
    lines = _lines(spark, path).filter(F.col("_place") > limit)
    return lines.select(F.from_csv("value", schema, {"sep": sep}).alias("r"), "_place").select("r.*", "_place")


def read_wide_grouped(spark: SparkSession, path: str, sep: str = ",") -> tuple[Assay, DataFrame]:
    """Wide table ``Feature[, Feature group], sample...`` with an optional second row of groups.

    Without that row the group is the last token of the sample name; exactly two groups are needed. Later
    duplicates of a feature get a number.
    """
    head = _head(spark, path, 2, sep)
    split = [cells for _, cells in head]
    header = [h.strip() for h in split[0]]
    with_group_col = len(header) > 1 and header[1].lower() in LONG_ALIASES["group_id"]
    first = 2 if with_group_col else 1
    names = header[first:]
    marked = len(split) > 1 and split[1][0].strip().lower() in ("group", "groups", "condition")
    if marked:
        groups = [g.strip() for g in split[1][first:]]
    else:
        groups = [re.split(r"[_\-. ]", n)[-1] for n in names]
    if len(set(groups)) != 2:
        raise ValueError("expected exactly two groups")
    body = _body(spark, path, head[1 if marked else 0][0], len(header), sep)
    entries = [F.struct(F.lit(n).alias("sample_id"), number(F.col(f"c{first + i}")).alias("value")) for i, n in enumerate(names)]
    named = number_duplicates(body.withColumn("_id", F.trim("c0")), "_id", "_place")
    cells = named.select(F.col("_id").alias("feature_id"), F.inline(F.array(*entries)))
    member = named.select(F.col("_id").alias("feature_id"), F.trim("c1" if with_group_col else "c0").alias("group_id")).distinct()
    samples = spark.createDataFrame(list(zip(names, groups)), "sample_id string, grp string")
    return Assay(cells, samples), member


def read_bait_matrix(spark: SparkSession, path: str, prey: str | None = None, sep: str = "\t") -> Assay:
    """Matrix under three header rows (status, bait, name); data start at the first column with a status."""
    head = _head(spark, path, 3, sep)
    status, bait, names = (cells for _, cells in head)
    start = next(i for i, s in enumerate(status) if s.strip())
    body = _body(spark, path, head[-1][0], len(names), sep)
    at = names.index(prey) if prey else 0
    keyed = row_numbers(body, [("_place", True)], out="_line").withColumn("feature_id", F.col("_line").cast("string"))
    entries = [F.struct(F.lit(names[i]).alias("sample_id"), number(F.col(f"c{i}")).alias("value")) for i in range(start, len(names))]
    samples = [(names[i], status[i].strip().upper(), bait[i] if i < len(bait) else "") for i in range(start, len(names))]
    return Assay(
        keyed.select("feature_id", F.inline(F.array(*entries))),
        spark.createDataFrame(samples, "sample_id string, status string, bait string"),
        keyed.select("feature_id", F.col(f"c{at}").alias("prey"), *[F.col(f"c{i}").alias(_plain(names[i]) or f"c{i}") for i in range(start) if i != at]),
    )


def read_category_matrix(spark: SparkSession, path: str, sep: str = "\t") -> Assay:
    """Matrix with sample categories in rows between the names and the first data row, such as ``cat-0: Subtype`` followed
    by one value per sample, and feature categories in row names such as ``(GENE, cat-0: kinase)``.

    A row is one of categories if its first cell says ``cat-N:``, or if neither its first cell nor its second is a number.
    Any number of category rows and of categories per feature is read; later duplicates of a name get a number.
    """
    is_number = lambda c: c.try_cast("double").isNotNull()
    cells = F.split(F.regexp_replace("value", "\r$", ""), sep if sep != "|" else r"\|")
    lines = _lines(spark, path).withColumn("_c", cells)
    (top, names_row), *_ = _head(spark, path, 1, sep)
    names = [n.strip() for n in names_row[1:]]
    first, second = F.trim(F.col("_c")[0]), na_to_null(F.get("_c", F.lit(1)))
    category = first.rlike(r"(?i)^cat-\d+:") | ((first != "") & ~is_number(first) & second.isNotNull() & ~is_number(second))
    at = lambda place: F.struct(*[F.lit(place[k]).alias(k) for k in ("file_path", "file_block_start", "row")])
    after = lines.filter(F.col("_place") > at(top))
    data = after.filter(~category).agg(F.min("_place")).first()[0]
    header = after if data is None else after.filter(F.col("_place") < at(data))
    extra = [(r["_c"][0].strip(), [v.strip() for v in r["_c"][1:]]) for r in header.orderBy("_place").collect()]
    titles = []
    for title, _ in extra:
        name = re.sub(r"(?i)^cat-\d+:\s*", "", title) or title
        while name.lower() in ("sample_id", *(t.lower() for t in titles)):
            name += "_"
        titles.append(name)
    last = top if not extra else header.agg(F.max("_place")).first()[0]
    body = _body(spark, path, last, len(names) + 1, sep)
    pieces = F.transform(F.split(F.regexp_replace(F.trim("c0"), r"^\(|\)$|'", ""), ","), lambda p: F.trim(p))
    named = number_duplicates(body.withColumn("_p", pieces).withColumn("feature_id", F.element_at("_p", 1)), "feature_id", "_place")
    entries = [F.struct(F.lit(n).alias("sample_id"), number(F.col(f"c{i + 1}")).alias("value")) for i, n in enumerate(names)]
    notes = F.transform(F.slice("_p", 2, F.size("_p")), lambda p: F.struct(
        F.trim(F.element_at(F.split(p, ":"), 1)).alias("title"), F.trim(F.element_at(F.split(p, ":"), -1)).alias("value")
    ))
    samples = [(n, *[v[i] if i < len(v) else "" for _, v in extra]) for i, n in enumerate(names)]
    return Assay(
        named.select("feature_id", F.inline(F.array(*entries))),
        spark.createDataFrame(samples, "sample_id string" + "".join(f", `{t}` string" for t in titles)),
        named.select("feature_id", notes.alias("categories")),
    )
