"""Join shapes the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rows(right: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: the first by ``order``. Partial aggregation keeps a hot key in map tasks."""
    rest = [c for c in right.columns if c != key]
    return right.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def lookup_first(left: DataFrame, right: DataFrame, key: str, order: Column) -> DataFrame:
    """Left join where the first of duplicate right rows wins."""
    return left.join(first_rows(right, key, order), key, "left")


def cell_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``value`` of ``a`` minus that of ``b`` on both keys; ``a`` is kept where ``b`` has no value."""
    other = b.select(*keys, F.col("value").alias("_other"))
    joined = a.join(other, list(keys), "left")
    return joined.withColumn("value", F.coalesce(F.col("value") - F.col("_other"), F.col("value"))).drop("_other")


def match_sets(sets: DataFrame, symbols: DataFrame) -> DataFrame:
    """Set memberships whose symbol occurs in ``symbols``, ignoring case."""
    members = sets.select("set_name", F.upper(F.trim("symbol")).alias("symbol")).distinct()
    return members.join(symbols.withColumn("symbol", F.upper(F.trim("symbol"))), "symbol")


def fallback_join(left: DataFrame, right: DataFrame, id_col: str, key: str) -> DataFrame:
    """Left rows with the right row found by exact id, else without a ``-n`` suffix, else ignoring case.

    Every left id turns into its candidate keys with a priority; one equi join serves all of them.
    """
    base = F.regexp_replace(F.col(id_col), r"-\d+$", "")
    tries = F.array(
        F.struct(F.lit(1).alias("prio"), F.concat(F.lit("="), F.col(id_col)).alias("k")),
        F.struct(F.lit(2).alias("prio"), F.concat(F.lit("="), base).alias("k")),
        F.struct(F.lit(3).alias("prio"), F.concat(F.lit("~"), F.lower(base)).alias("k")),
    )
    wanted = left.select(id_col).distinct().select(id_col, F.inline(tries))
    rest = [c for c in right.columns if c != key]
    row = F.struct(F.col(key), *rest)
    keyed = right.select(
        row.alias("row"), F.explode(F.array(F.concat(F.lit("="), F.col(key)), F.concat(F.lit("~"), F.lower(key)))).alias("k")
    )
    keyed = keyed.groupBy("k").agg(F.min("row").alias("row"))
    best = wanted.join(keyed, "k").groupBy(id_col).agg(F.min_by("row", "prio").alias("row"), F.min("prio").alias("matched_by"))
    return left.join(best.select(id_col, "matched_by", "row.*"), id_col, "left")


def contains_join(peptides: DataFrame, sequences: DataFrame, key: str) -> DataFrame:
    """Pairs sharing ``key`` where the peptide occurs in the sequence."""
    joined = peptides.join(sequences, key)
    return joined.filter(F.col("sequence").contains(F.col("peptide")))


def clean_file_name(c: Column, suffixes: str = r"raw|d|mzml|dia|parquet") -> Column:
    """File name without folders and known extensions (also chained, as in ``a.xic.parquet``)."""
    name = F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)
    return F.regexp_replace(name, rf"(?i)(\.xic)?\.({suffixes})$", "")


def match_runs(files: DataFrame, runs: DataFrame, file_col: str = "path", run_col: str = "run") -> DataFrame:
    """Files and runs whose cleaned names agree."""
    a = files.withColumn("_k", F.lower(clean_file_name(F.col(file_col))))
    b = runs.withColumn("_k", F.lower(clean_file_name(F.col(run_col))))
    return a.join(b, "_k").drop("_k")
