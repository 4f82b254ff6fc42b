"""Modification sites against the total amount of their protein."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.model import Assay
from assaygrid.operators import impute
from assaygrid.operators.joins import cell_join, first_rows


def log2_positive(cells: DataFrame) -> DataFrame:
    v = F.col("value")
    return cells.withColumn("value", F.when(~F.isnan(v) & (v > 0), F.log2(v)))


def site_protein(sites: DataFrame, col: str) -> DataFrame:
    """``feature_id, protein``: first ``;`` entry of the matching column."""
    return sites.select("feature_id", F.trim(F.element_at(F.split(F.col(col), ";"), 1)).alias("protein"))


def normalise_to_total(
    sites: Assay, total: Assay, site_col: str, total_col: str, knn: bool = False, k: int = 5, **options
) -> DataFrame:
    """log2 site minus log2 protein in the same sample; a site without its protein there stays as it is.

    Of several rows for one protein the first (smallest feature id) counts. With ``knn`` both
    matrices are imputed on the log scale first; ``options`` go to ``impute.knn``.
    """
    a, b = (x.with_cells(log2_positive(x.cells)) for x in (sites, total))
    if knn:
        a = a.with_cells(impute.knn(a, k=k, rule="null", **options).drop("imputed"))
        b = b.with_cells(impute.knn(b, k=k, rule="null", **options).drop("imputed"))
    proteins = total.features.select("feature_id", F.trim(F.col(total_col)).alias("protein")).filter("protein <> ''")
    chosen = first_rows(proteins, "protein", F.col("feature_id"))
    cells = a.cells.join(site_protein(sites.features, site_col), "feature_id")
    amounts = b.cells.filter("value IS NOT NULL").join(chosen, "feature_id").select("protein", "sample_id", "value")
    return cell_join(cells, amounts, ["protein", "sample_id"]).select("feature_id", "sample_id", "value").filter("value IS NOT NULL")


def paired_profile(sites: Assay, total: Assay, normalised: DataFrame, site_col: str, total_col: str) -> DataFrame:
    """Site, protein and normalised value per sample."""
    proteins = total.features.select("feature_id", F.trim(F.col(total_col)).alias("protein")).filter("protein <> ''")
    chosen = first_rows(proteins, "protein", F.col("feature_id"))
    amounts = log2_positive(total.cells).join(chosen, "feature_id").select("protein", "sample_id", F.col("value").alias("total"))
    own = log2_positive(sites.cells).filter("value IS NOT NULL").withColumnRenamed("value", "site")
    own = own.join(site_protein(sites.features, site_col), "feature_id").join(amounts, ["protein", "sample_id"], "left")
    return own.join(normalised.withColumnRenamed("value", "normalised"), ["feature_id", "sample_id"], "left")
