"""Precursor reports: filtering, roll-up to proteins, genes and peptides, run summaries.

Precursor frames use the columns ``run, precursor_id, stripped_sequence, modified_sequence, charge,
protein_group, protein_ids, protein_names, genes, proteotypic, mz, rt, quantity, normalised, maxlfq,
q_value, global_q_value, pg_q_value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.runtime import materialize, shuffle_partitions

ROWS = 250_000  # rows of a peptide table that one task sorts


def blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def group_key() -> Column:
    return F.coalesce(blank_to_null("protein_group"), blank_to_null("protein_ids"), F.lit("Unknown"))


def sequence_key() -> Column:
    return F.coalesce(blank_to_null("stripped_sequence"), blank_to_null("modified_sequence"))


def filter_precursors(
    p: DataFrame, q: float = 0.01, global_q: float = 0.01, pg_q: float = 0.01, proteotypic: bool = False,
    name: str = "", gene: str = "", group: str = "",
) -> DataFrame:
    """Rows under every cutoff (a missing q passes), optionally proteotypic and matching text, ignoring case."""
    keep = F.lit(True)
    for col, cut in (("q_value", q), ("global_q_value", global_q), ("pg_q_value", pg_q)):
        if col in p.columns and cut is not None:
            keep = keep & (F.col(col).isNull() | (F.col(col) <= cut))
    if proteotypic:
        keep = keep & (F.col("proteotypic") == 1)
    for text, cols in ((name, ["protein_names"]), (gene, ["genes"]), (group, ["protein_group", "protein_ids"])):
        needle = text.strip().lower()
        if needle:
            hit = F.lit(False)
            for c in cols:
                hit = hit | F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
            keep = keep & hit
    return p.filter(keep)


def _run_values(rows: DataFrame, method: str, intensity: str) -> DataFrame:
    """Value and distinct peptides per (key, run).

    Rows of the same peptide are merged first, so a group that holds much of the data is spread over
    its peptides; sums and firsts combine map-side.
    """
    x = F.coalesce(F.col(intensity), F.lit(0.0))
    pep = rows.groupBy("key", "run", "pep").agg(
        F.sum(x).alias("s"),
        F.min(F.when(F.col("maxlfq") > 0, F.struct("precursor_id", "maxlfq"))).alias("m"),
    )
    total = F.sum("s")
    by_sum = F.when(total > 0, total)
    value = F.coalesce(F.min("m")["maxlfq"], by_sum) if method == "maxlfq" else by_sum
    out = pep.groupBy("key", "run").agg(F.count("pep").alias("n_peptides"), value.alias("value"))
    if method == "top3":
        # the rank limit prunes to three rows per group before the shuffle
        w = Window.partitionBy("key", "run").orderBy(F.desc(intensity))
        top = rows.filter(F.col(intensity) > 0).withColumn("_rn", F.row_number().over(w)).filter("_rn <= 3")
        means = top.groupBy("key", "run").agg(F.avg(intensity).alias("value"))
        out = out.drop("value").join(means, ["key", "run"], "left")
    return out


def _summary(values: DataFrame, rows: DataFrame) -> DataFrame:
    """Per key: distinct and proteotypic peptides, detected runs, total, mean and maximum."""
    peps = rows.groupBy("key", "pep").agg(F.max((F.col("proteotypic") == 1).cast("int")).alias("pt"))
    counts = peps.groupBy("key").agg(F.count("pep").alias("n_sequences"), F.count_if((F.col("pt") == 1) & F.col("pep").isNotNull()).alias("n_proteotypic"))
    v = F.when(F.col("value") > 0, F.col("value"))
    quant = values.groupBy("key").agg(
        F.count(v).alias("detected_runs"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
        F.max("n_peptides").alias("max_peptides"),
    )
    return counts.join(quant, "key")


def _keyed(p: DataFrame, key: Column) -> DataFrame:
    return p.withColumn("key", key).withColumn("pep", sequence_key())


def protein_values(p: DataFrame, method: str = "maxlfq", intensity: str = "normalised") -> DataFrame:
    """Long protein matrix: ``protein_group, run, value, n_peptides``.

    ``maxlfq``: first positive reported value in precursor order, else the sum; ``top3``: mean of the
    three largest; ``sum``.
    """
    return _run_values(_keyed(p, group_key()), method, intensity).withColumnRenamed("key", "protein_group")


def protein_matrix(p: DataFrame, method: str = "maxlfq", intensity: str = "normalised") -> DataFrame:
    """One row per protein group with labels and summary, largest total first."""
    rows = _keyed(p, group_key())
    summary = _summary(_run_values(rows, method, intensity), rows)
    labels = rows.groupBy("key").agg(F.min_by(F.struct("protein_names", "genes"), "precursor_id").alias("l"))
    out = summary.join(labels, "key").select(
        F.col("key").alias("protein_group"), "l.protein_names", "l.genes", *[c for c in summary.columns if c != "key"]
    )
    return out.orderBy(F.desc("total"), "protein_group")


def _by_gene(p: DataFrame) -> DataFrame:
    genes = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col("genes"), F.lit("")), ";"), lambda g: F.trim(g)), lambda g: g != ""))
    some = F.when(F.size(genes) > 0, genes).otherwise(F.array(F.lit("Unknown")))
    return p.withColumn("key", F.explode(some))


def _gene_rows(p: DataFrame) -> DataFrame:
    return _by_gene(p.withColumn("group_", group_key()).withColumn("pep", sequence_key()))


def _gene_parts(p: DataFrame, method: str, intensity: str) -> DataFrame:
    """Rows for every column of the gene matrix, stored once and not yet dealt to their genes; ``label`` holds the
    precursor and its protein names.

    Rows that agree in genes, protein group, run and peptide are merged.
    """
    named = p.withColumn("group_", group_key()).withColumn("pep", sequence_key())
    keys = ["genes", "group_", "run", "pep"]
    label = F.when(F.col("precursor_id").isNotNull(), F.struct("precursor_id", "protein_names"))
    if method == "top3":
        return materialize(named.select(*keys, intensity, "precursor_id", "maxlfq", "proteotypic", label.alias("label")))
    first = F.min(F.when(F.col("maxlfq") > 0, F.struct("precursor_id", "maxlfq"))) if method == "maxlfq" else F.lit(None).cast("struct<precursor_id: string, maxlfq: double>")
    merged = named.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col(intensity), F.lit(0.0))).alias(intensity), first.alias("m"),
        F.max((F.col("proteotypic") == 1).cast("int")).alias("proteotypic"), F.min(label).alias("label"),
    )
    return materialize(merged.select(*keys, intensity, *[F.col("m")[c].alias(c) for c in ("precursor_id", "maxlfq")], "proteotypic", "label"))


def gene_values(p: DataFrame, method: str = "maxlfq", intensity: str = "normalised") -> DataFrame:
    """Long gene matrix: shared peptides count to each of their genes."""
    return _run_values(_gene_rows(p), method, intensity).withColumnRenamed("key", "gene")


def gene_groups(p: DataFrame) -> DataFrame:
    """Distinct protein groups of every gene, one row each."""
    return _gene_rows(p).select(F.col("key").alias("gene"), F.col("group_").alias("protein_group")).distinct()


def gene_tables(p: DataFrame, method: str = "maxlfq", intensity: str = "normalised") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``gene_matrix`` (in no order), ``gene_values`` and ``gene_groups`` give, from one reading of ``p``."""
    rows = _gene_parts(p, method, intensity)
    values = materialize(_run_values(_by_gene(rows), method, intensity))
    # what a gene needs is merged by the genes as they are listed before it is dealt to each of them
    groups = materialize(_by_gene(rows.select("genes", "group_").distinct()).select("key", "group_").distinct())
    counts = groups.groupBy("key").agg(F.count("*").alias("n_protein_groups"))
    labels = _by_gene(rows.groupBy("genes").agg(F.min("label").alias("label"))).groupBy("key").agg(F.min("label")["protein_names"].alias("protein_names"))
    peps = rows.groupBy("genes", "pep").agg(F.max((F.col("proteotypic") == 1).cast("int")).alias("proteotypic"))
    matrix = _summary(values, _by_gene(peps)).join(counts, "key").join(labels, "key").withColumnRenamed("key", "gene")
    groups = groups.select(F.col("key").alias("gene"), F.col("group_").alias("protein_group"))
    return matrix, values.withColumnRenamed("key", "gene"), groups


def gene_matrix(p: DataFrame, method: str = "maxlfq", intensity: str = "normalised") -> DataFrame:
    """One row per gene with its summary and the number of protein groups, largest total first."""
    return gene_tables(p, method, intensity)[0].orderBy(F.desc("total"), "gene")


def precursor_key() -> Column:
    seq = F.coalesce(blank_to_null("modified_sequence"), blank_to_null("stripped_sequence"))
    return F.coalesce(blank_to_null("precursor_id"), F.concat_ws("_", seq, F.col("charge").cast("string")))


def peptide_values(p: DataFrame, intensity: str = "normalised", order: str = "rt") -> DataFrame:
    """Last positive intensity of every precursor and run in ``order``: ``precursor_id, run, value``."""
    rows = p.withColumn("precursor_id", precursor_key()).filter(F.col(intensity) > 0)
    return rows.groupBy("precursor_id", "run").agg(F.max(F.struct(order, intensity))[intensity].alias("value"))


def of_group(p: DataFrame, group: str | None = None, gene: str | None = None) -> DataFrame:
    """Rows of one protein group or gene."""
    if group is not None:
        return p.filter((F.col("protein_group") == group) | (F.col("protein_ids") == group))
    if gene is not None:
        return p.filter(F.array_contains(F.transform(F.split("genes", ";"), lambda g: F.trim(g)), gene))
    return p


def peptide_table(p: DataFrame, run_names: Sequence[str] = (), intensity: str = "normalised", order: str = "rt") -> DataFrame:
    """``peptide_matrix`` in no order, with a column of ``peptide_values`` for each named run.

    One shuffle by precursor into as many partitions as the rows need, so a task's sort stays bounded; rows of a
    precursor are merged per run first.
    """
    label_cols = ["stripped_sequence", "modified_sequence", "charge", "protein_group", "protein_names", "genes", "proteotypic", "mz", "rt"]
    q_cols = ["q_value", "global_q_value", "pg_q_value"]
    parts = max(shuffle_partitions(p.sparkSession), -(-p.count() // ROWS))
    rows = p.withColumn("precursor_id", precursor_key())
    rows = rows.select(*dict.fromkeys(["precursor_id", "run", *label_cols, *q_cols, intensity, order])).repartition(parts, "precursor_id")
    place, x = F.struct(order, "run"), F.col(intensity)
    per_run = rows.groupBy("precursor_id", "run").agg(
        F.max(F.when(x > 0, F.struct(order, intensity)))[intensity].alias("_v"), F.min(place).alias("_o"), F.min_by(F.struct(*label_cols), place).alias("l"), *[F.min(c).alias(c) for c in q_cols]
    )
    v = F.col("_v")
    summary = {"detected_runs": F.count(v), "total": F.sum(v), "mean": F.avg(v), "max": F.max(v)}
    per = per_run.groupBy("precursor_id").agg(
        F.min_by("l", "_o").alias("l"),
        *[F.coalesce(F.min(c), F.lit(1.0)).alias(c) for c in q_cols],
        *[F.coalesce(f, F.lit(0)).alias(c) for c, f in summary.items()],
        *[F.max(F.when(F.col("run") == r, v)).alias(r) for r in run_names],
    )
    yes = F.when(F.col("l.proteotypic") == 1, "Yes").otherwise("No")
    runs_ = ["`" + r.replace("`", "``") + "`" for r in run_names]
    return per.select("precursor_id", *[F.col(f"l.{c}").alias(c) for c in label_cols if c != "proteotypic"], yes.alias("proteotypic"), *q_cols, *summary, *runs_)


def peptide_matrix(p: DataFrame, intensity: str = "normalised", order: str = "rt") -> DataFrame:
    """One row per precursor: labels, smallest q-values (1 when none), quantification summary."""
    return peptide_table(p, (), intensity, order).orderBy(F.desc("total"), "precursor_id")


def to_cells(values: DataFrame, key: str) -> DataFrame:
    """Hand-off: a long protein, gene or peptide matrix as cells (missing values become 0 only on export)."""
    return values.filter(F.col("value").isNotNull()).select(
        F.col(key).alias("feature_id"), F.col("run").alias("sample_id"), "value"
    )


def protein_profile(values: DataFrame, group: str) -> DataFrame:
    """One protein group across runs."""
    return values.filter(F.col("protein_group") == group).select("run", "value", "n_peptides")


def run_summary(p: DataFrame, intensity: str = "normalised") -> DataFrame:
    """Per run and, with run null, in total: precursors, peptides, protein groups and intensity.

    In a run precursors are rows; in the total they are distinct.
    """
    rows = p.select(
        "run", precursor_key().alias("prec"), sequence_key().alias("pep"),
        F.coalesce(blank_to_null("protein_group"), blank_to_null("protein_ids")).alias("pg"), F.col(intensity).alias("x"),
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("item")) for k in ("prec", "pep", "pg")])
    # each item once per run; counts per run and over all runs then come from the same rows
    seen = rows.select("run", F.inline(kinds)).filter("item IS NOT NULL").distinct()
    held = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("prec", "prec_"), ("pep", "peptides"), ("pg", "protein_groups"))]
    sums = rows.groupBy("run").agg(F.count("*").alias("precursors"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("intensity"))
    per_run = sums.alias("s").join(seen.groupBy("run").agg(*held).alias("i"), F.col("s.run").eqNullSafe(F.col("i.run")), "left")
    per_run = per_run.select("s.run", "precursors", F.coalesce("peptides", F.lit(0)).alias("peptides"), F.coalesce("protein_groups", F.lit(0)).alias("protein_groups"), "intensity")
    total = seen.select("kind", "item").distinct().agg(*held)
    intensity_ = rows.agg(F.coalesce(F.sum("x"), F.lit(0.0))).scalar()
    total = total.select(F.lit(None).cast(rows.schema["run"].dataType).alias("run"), F.col("prec_").alias("precursors"), "peptides", "protein_groups", intensity_.alias("intensity"))
    return per_run.unionByName(total)


def in_all_runs(p: DataFrame) -> DataFrame:
    """How many precursors, peptides and protein groups occur in every run."""
    n_runs = p.agg(F.count_distinct("run")).scalar()
    items = F.array(
        F.struct(F.lit("precursor").alias("kind"), precursor_key().alias("item")),
        F.struct(F.lit("peptide").alias("kind"), sequence_key().alias("item")),
        F.struct(F.lit("protein_group").alias("kind"), F.coalesce(blank_to_null("protein_group"), blank_to_null("protein_ids")).alias("item")),
    )
    seen = p.select("run", F.inline(items)).filter("item IS NOT NULL").distinct()
    per = seen.groupBy("kind", "item").agg(F.count("*").alias("n"))
    return per.groupBy("kind").agg(F.count_if(F.col("n") == n_runs).alias("in_all"), F.count("*").alias("items"))


def kpis(raw: DataFrame, filtered: DataFrame) -> DataFrame:
    """Headline counts of a report."""
    return filtered.agg(
        F.count("*").alias("filtered"), F.count_distinct(group_key()).alias("protein_groups"),
        F.count_distinct(sequence_key()).alias("peptides"), F.count_distinct("run").alias("runs"),
    ).withColumn("total", raw.agg(F.count("*")).scalar())


def run_totals(p: DataFrame, intensity: str = "normalised") -> DataFrame:
    return p.groupBy("run").agg(F.count("*").alias("n"), F.sum(intensity).alias("intensity"))


def runs(p: DataFrame) -> DataFrame:
    return p.select("run").distinct().orderBy("run")


def wide(values: DataFrame, key: str, run_names: Sequence[str]) -> DataFrame:
    """One column per run."""
    return values.groupBy(key).pivot("run", list(run_names)).agg(F.first("value"))
