"""The assay: a long cell table, its sample table and, optionally, feature annotations."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_missing
from assaygrid.runtime import broadcast_if


@dataclass(frozen=True)
class Assay:
    """``cells(feature_id, sample_id, value)``, ``samples(sample_id, ...)``, ``features(feature_id, ...)``.

    A cell that is not measured is an absent row or a null; which other values count as missing is
    a parameter of each operator. There is at most one cell per (feature, sample).
    """

    cells: DataFrame
    samples: DataFrame
    features: DataFrame | None = None

    @cached_property
    def n_samples(self) -> int:
        """Rows of the sample table; bounds every per-sample frame."""
        return self.samples.count()

    def per_sample(self, df: DataFrame) -> DataFrame:
        """``df`` has at most one row per sample: broadcast it if the sample table is small enough."""
        return broadcast_if(df, self.n_samples)

    def with_cells(self, cells: DataFrame) -> Assay:
        return replace(self, cells=cells)

    def observed(self, rule: str = "positive", value: Column | None = None) -> DataFrame:
        """Cells that count as measured under ``rule``."""
        v = F.col("value")
        kept = self.cells.filter(~is_missing(v, rule))
        return kept if value is None else kept.withColumn("value", value)

    def sample_ids(self) -> Column:
        """All sample ids in order, as a scalar array column."""
        return self.samples.agg(F.sort_array(F.collect_set("sample_id"))).scalar()

    def dense(self) -> DataFrame:
        """One row per (feature, sample) of the grid, null where no cell exists.

        One shuffle on the feature; a group holds at most one entry per sample.
        """
        kind = self.cells.schema["value"].dataType
        obs = F.collect_list(F.struct("sample_id", "value"))
        per_feature = self.cells.groupBy("feature_id").agg(obs.alias("obs")).withColumn("ids", self.sample_ids())
        absent = F.transform(
            F.array_except("ids", F.col("obs.sample_id")),
            lambda s: F.struct(s.alias("sample_id"), F.lit(None).cast(kind).alias("value")),
        )
        return per_feature.select("feature_id", F.inline(F.concat("obs", absent)))
