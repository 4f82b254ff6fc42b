"""Writers: wide matrices, result tables and whole analyses."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.operators import precursor


def _write(df: DataFrame, path: str, sep: str) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="", emptyValue="")


def write_pg_matrix(p: DataFrame, path: str, runs: Sequence[str], method: str = "maxlfq", intensity: str = "normalised") -> None:
    """Protein matrix: six label columns, then one column per run, blank where missing."""
    values = precursor.wide(precursor.protein_values(p, method, intensity), "protein_group", runs)
    labels = precursor.protein_matrix(p, method, intensity)
    out = labels.join(values, "protein_group").select(
        F.col("protein_group").alias("Protein.Group"), F.col("protein_names").alias("Protein.Names"), F.col("genes").alias("Genes"),
        F.col("protein_names").alias("First.Protein.Description"), F.col("n_sequences").alias("N.Sequences"),
        F.col("n_proteotypic").alias("N.Proteotypic.Sequences"), *runs,
    )
    _write(out, path, "\t")


def write_gene_matrix(p: DataFrame, path: str, runs: Sequence[str], method: str = "maxlfq", intensity: str = "normalised") -> None:
    """Gene matrix with counts and the list of protein groups."""
    labels, long, members = precursor.gene_tables(p, method, intensity)
    values = precursor.wide(long, "gene", runs)
    groups = members.groupBy("gene").agg(F.array_join(F.sort_array(F.collect_list("protein_group")), "; ").alias("groups"))
    out = labels.join(groups, "gene").join(values, "gene").select(
        F.col("gene").alias("Genes"), F.col("protein_names").alias("Protein.Names"), F.col("n_sequences").alias("N.Sequences"),
        F.col("n_proteotypic").alias("N.Proteotypic.Sequences"), F.col("n_protein_groups").alias("N.Protein.Groups"),
        F.col("groups").alias("Protein.Groups"), *runs,
    )
    _write(out, path, "\t")


def write_peptide_matrix(p: DataFrame, path: str, runs: Sequence[str], intensity: str = "normalised") -> None:
    """Peptide matrix: eleven label columns, then one column per run."""
    names = {
        "precursor_id": "Precursor.Id", "stripped_sequence": "Stripped.Sequence", "modified_sequence": "Modified.Sequence", "charge": "Precursor.Charge",
        "protein_group": "Protein.Group", "protein_names": "Protein.Names", "genes": "Genes", "proteotypic": "Proteotypic", "q_value": "Q.Value",
        "global_q_value": "Global.Q.Value", "pg_q_value": "PG.Q.Value",
    }
    out = precursor.peptide_table(p, runs, intensity)
    _write(out.select(*[F.col(a).alias(b) for a, b in names.items()], *runs), path, "\t")


def write_result(df: DataFrame, path: str) -> None:
    """A result table as CSV; arrays are joined with ``;``."""
    cols = [
        F.concat_ws(";", F.transform(F.col(f.name), lambda x: x.cast("string"))).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        for f in df.schema.fields
    ]
    _write(df.select(*cols), path, ",")


def save_analysis(path: str, tables: dict[str, DataFrame], params: dict | None = None) -> None:
    """One parquet table per name and a one-row table of parameters."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = json.dumps({"tables": sorted(tables), "params": params or {}})
    spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").parquet(f"{path}/analysis_meta")


def load_analysis(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and parameters of a saved analysis."""
    meta = json.loads(spark.read.parquet(f"{path}/analysis_meta").first()["meta"])
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}, meta["params"]
