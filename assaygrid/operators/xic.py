"""Chromatogram traces: ``run, pr, feature, rt, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.operators.ranking import ordered, row_numbers


def traces(x: DataFrame, pr: str | None = None) -> DataFrame:
    """Fragment points of one precursor (or of all); the ``index`` channel is no fragment.

    The precursor filter reaches the scan, where files sorted by precursor skip their row groups.
    """
    kept = x.filter(F.col("feature") != "index")
    return kept if pr is None else kept.filter(F.col("pr") == pr)


def decimate(points: DataFrame, n: int = 250, n_traces: int = 1_000_000) -> DataFrame:
    """Long traces thinned to points floor(i len / n) and the last point; shorter ones stay whole."""
    trace = ["run", "pr", "feature"]
    placed = row_numbers(points, [("rt", True), ("value", True)], trace, n_traces, out="_r")
    sizes = points.groupBy(*trace).agg(F.count("*").alias("_n"))
    pos, total = F.col("_r") - 1, F.col("_n")
    i = F.ceil(pos * n / total)
    picked = (i < n) & (F.floor(i * total / n) == pos)
    kept = placed.join(sizes, trace).filter((total <= n) | picked | (F.col("_r") == total))
    return kept.drop("_r", "_n")


def write_sorted(x: DataFrame, path: str, files: int) -> None:
    """Store chromatograms in precursor order, so that row-group statistics find a precursor's rows."""
    laid = x.repartitionByRange(files, "run", "pr", "feature", "rt").sortWithinPartitions("run", "pr", "feature", "rt")
    laid.write.mode("overwrite").parquet(path)


def index(x: DataFrame, n_runs: int | None = None) -> DataFrame:
    """First and last row (from 0) of every precursor in a run's precursor-sorted rows.

    ``n_runs`` is an upper bound for the number of runs; they are counted unless it is given.
    """
    counts = x.groupBy("run", "pr").agg(F.count("*").alias("n"))
    if n_runs is None:
        n_runs = counts.select("run").distinct().count()
    run = ordered(counts, [("pr", True)], ["run"], n_runs).running("upto", "sum", F.col("n")).result()
    return run.select("run", "pr", (F.col("upto") - F.col("n")).alias("first"), (F.col("upto") - 1).alias("last"))


PATTERN = r"^([by])(\d+)\^(\d+)$"


def parse_fragment(c: Column) -> Column:
    """``y6^1`` as type, number and charge; null for other channels."""
    parts = F.struct(
        F.regexp_extract(c, PATTERN, 1).alias("type"), F.regexp_extract(c, PATTERN, 2).try_cast("int").alias("n"),
        F.regexp_extract(c, PATTERN, 3).try_cast("int").alias("charge"),
    )
    return F.when(c.rlike(PATTERN), parts)


def fragment_max(x: DataFrame) -> DataFrame:
    """Highest point of every cleavage: ``run, pr, type, n, charges, max, rt``."""
    f = traces(x).withColumn("f", parse_fragment(F.col("feature"))).filter("f IS NOT NULL")
    return f.groupBy("run", "pr", "f.type", "f.n").agg(
        F.sort_array(F.collect_set("f.charge")).alias("charges"), F.max("value").alias("max"),
        F.max(F.struct(F.col("value"), (-F.col("rt")).alias("t")))["t"].alias("t"),
    ).withColumn("rt", -F.col("t")).drop("t")


def apex(x: DataFrame) -> DataFrame:
    """Highest point of a precursor in each run, earliest on ties."""
    top = F.max(F.struct(F.col("value"), (-F.col("rt")).alias("t"), "feature"))
    best = traces(x).groupBy("run", "pr").agg(top.alias("b"))
    return best.select("run", "pr", F.col("b.value").alias("value"), (-F.col("b.t")).alias("rt"))
