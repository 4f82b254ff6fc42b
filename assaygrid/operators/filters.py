"""Row and column filters. Each takes an assay and returns a smaller one, or verdicts with a reason.

A filter looks only at the assay it is given, so filtering from the loaded matrix (never stacking)
is a matter of passing the loaded matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_missing
from assaygrid.model import Assay
from assaygrid.operators.qc import histogram
from assaygrid.operators.quantiles import group_quantiles


def keep_rows(assay: Assay, passed: DataFrame) -> Assay:
    """Cells (and annotations) of the features listed in ``passed``."""
    ids = passed.select("feature_id")
    features = assay.features.join(ids, "feature_id", "left_semi") if assay.features is not None else None
    return replace(assay, cells=assay.cells.join(ids, "feature_id", "left_semi"), features=features)


def keep_samples(assay: Assay, samples: DataFrame) -> Assay:
    """The samples listed, and their cells. The list is a part of the sample table."""
    ids = assay.per_sample(samples.select("sample_id"))
    return Assay(
        assay.cells.join(ids, "sample_id", "left_semi"),
        assay.samples.join(ids, "sample_id", "left_semi"),
        assay.features,
    )


def grouped_samples(assay: Assay, by: Sequence[str], ignore_small: bool = True) -> DataFrame:
    """Samples with their group key, the group's size and whether the group takes part."""
    key = F.concat_ws(" | ", *[F.col(c) for c in by])
    keyed = assay.samples.select("sample_id", key.alias("group"))
    size = F.count("*").over(Window.partitionBy("group"))
    return keyed.withColumn("size", size).withColumn("takes_part", F.col("size") >= (2 if ignore_small else 1))


def _required(size: Column, min_n: int | None, pct: float | None) -> Column:
    if pct is not None:
        return F.ceil(size * F.lit(pct) / 100)
    return F.lit(1 if min_n is None else min_n).cast("bigint")


def valid_rows(
    assay: Assay,
    min_n: int | None = None,
    pct: float | None = None,
    scope: str = "total",
    by: Sequence[str] = (),
    ignore_small: bool = True,
) -> DataFrame:
    """Verdict per feature on its count of valid (finite, > 0) values: ``feature_id, n_valid, passed, reason``.

    ``scope``: ``total`` over all samples, ``each`` group or ``any`` group of the ``by`` columns.
    """
    valid = F.count_if(~is_missing(F.col("value")))
    if scope == "total":
        per_row = assay.cells.groupBy("feature_id").agg(valid.alias("n_valid"))
        passed = F.col("n_valid") >= _required(F.lit(assay.n_samples), min_n, pct)
    else:
        groups = grouped_samples(assay, by, ignore_small).filter("takes_part")
        n_groups = groups.agg(F.count_distinct("group")).scalar()
        per_group = (
            assay.cells.join(assay.per_sample(groups), "sample_id")
            .groupBy("feature_id", "group", "size")
            .agg(valid.alias("v"))
            .withColumn("ok", F.col("v") >= _required(F.col("size"), min_n, pct))
        )
        per_row = per_group.groupBy("feature_id").agg(F.sum("v").alias("n_valid"), F.count_if("ok").alias("n_ok"))
        all_rows = assay.cells.select("feature_id").distinct()
        per_row = all_rows.join(per_row, "feature_id", "left").fillna(0, ["n_valid", "n_ok"])
        passed = F.col("n_ok") == n_groups if scope == "each" else F.col("n_ok") >= 1
    reason = F.when(~F.col("passed"), F.lit(f"too few valid values ({scope})"))
    return per_row.withColumn("passed", passed).select("feature_id", "n_valid", "passed", reason.alias("reason"))


def _zero_failing(assay: Assay, groups: DataFrame, required: Column) -> Assay:
    """Set a feature's cells of every failing group to 0, then drop rows without a positive cell.

    One shuffle: both windows lie inside a feature, which has at most one cell per sample.
    """
    cells = assay.cells.join(assay.per_sample(groups), "sample_id").repartition("feature_id")
    valid = F.count_if(~is_missing(F.col("value"))).over(Window.partitionBy("feature_id", "group"))
    fails = F.col("takes_part") & (valid < required)
    zeroed = cells.withColumn("value", F.when(fails, F.lit(0.0)).otherwise(F.col("value")))
    best = F.max("value").over(Window.partitionBy("feature_id"))
    kept = zeroed.withColumn("best", best).filter(F.col("best") > 0)
    return assay.with_cells(kept.select("feature_id", "sample_id", "value"))


def group_completeness(
    assay: Assay, by: Sequence[str], min_n: int | None = None, pct: float | None = None, ignore_small: bool = True
) -> Assay:
    """Zero the cells of groups below the threshold; remove rows that end up without a positive value."""
    groups = grouped_samples(assay, by, ignore_small)
    if groups.filter("takes_part").isEmpty():
        raise ValueError("No groups match the chosen columns and minimum group size")
    return _zero_failing(assay, groups, _required(F.col("size"), min_n, pct))


def tech_repro(assay: Assay, bundle: Sequence[str], strict: str | None = None) -> Assay:
    """Any invalid replicate zeroes its bundle for that feature; all-zero rows are dropped.

    ``strict`` names the technical-replicate column (labels T1..TN); then only bundles whose labels
    form a complete run from T1 take part.
    """
    groups = grouped_samples(assay, bundle)
    if strict is not None:
        number = F.regexp_extract(F.col(strict), r"(\d+)$", 1).try_cast("int")
        labels = assay.samples.select("sample_id", number.alias("t"))
        w = Window.partitionBy("group")
        run = (F.min("t").over(w) == 1) & (F.max("t").over(w) == F.size(F.collect_set("t").over(w)))
        complete = run & (F.count("t").over(w) == F.col("size"))
        groups = groups.join(labels, "sample_id").withColumn("takes_part", F.col("takes_part") & complete).drop("t")
    return _zero_failing(assay, groups, F.col("size"))


def cv_filter(assay: Assay, threshold: float = 0.2) -> DataFrame:
    """Verdict per feature: sd / mean over values > 0; rows below the threshold fail."""
    stats = assay.observed("positive").groupBy("feature_id").agg(
        F.stddev_samp("value").alias("sd"), F.avg("value").alias("mean")
    )
    cv = F.col("sd") / F.col("mean")
    return stats.select("feature_id", cv.alias("cv"), F.coalesce(cv >= threshold, F.lit(False)).alias("passed"))


def text_match(c: Column, pattern: str, mode: str = "contains") -> Column:
    """``contains`` (any of the ``|``-separated words, ignoring case) or ``regex``."""
    if mode == "regex":
        return F.coalesce(c.rlike(pattern), F.lit(False))
    words = [w.strip().lower() for w in pattern.split("|") if w.strip()]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(c).contains(w)
    return F.coalesce(hit, F.lit(False))


def id_filter(ids: DataFrame, pattern: str, mode: str = "contains", col: str = "feature_id") -> DataFrame:
    """Rows whose id matches."""
    return ids.filter(text_match(F.col(col).cast("string"), pattern, mode))


def sample_rows(assay: Assay, n: int, seed: int = 1) -> DataFrame:
    """Exactly ``n`` features, chosen by the order of a seeded hash."""
    ids = assay.cells.select("feature_id").distinct()
    return ids.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("feature_id").cast("string")))).limit(n)


def select_samples(assay: Assay, names: Sequence[str] = (), pattern: str | None = None, mode: str = "contains") -> Assay:
    """Keep samples by name or by pattern."""
    chosen = F.col("sample_id").isin(list(names))
    if pattern is not None:
        chosen = chosen | text_match(F.col("sample_id"), pattern, mode)
    return keep_samples(assay, assay.samples.filter(chosen))


def select_groups(assay: Assay, by: Sequence[str], groups: Sequence[str]) -> Assay:
    """Keep whole groups; with two columns a group reads ``a | b``."""
    key = F.concat_ws(" | ", *[F.col(c) for c in by])
    return keep_samples(assay, assay.samples.filter(key.isin(list(groups))))


def exclude_samples(assay: Assay, ids: DataFrame) -> Assay:
    """Drop samples, e.g. outliers."""
    return keep_samples(assay, assay.samples.join(ids.select("sample_id"), "sample_id", "left_anti"))


def valid_cols(
    assay: Assay, min_n: int | None = None, pct: float | None = None, feature_group: str | None = None
) -> DataFrame:
    """Verdict per sample on its valid values: over all features, or in every group of features."""
    cells = assay.cells.withColumn("ok", ~is_missing(F.col("value")))
    if feature_group is None:
        n = cells.agg(F.count_distinct("feature_id")).scalar()
        per = cells.groupBy("sample_id").agg(F.count_if("ok").alias("n_valid"))
        per = assay.samples.select("sample_id").join(assay.per_sample(per), "sample_id", "left").fillna(0, ["n_valid"])
        return per.withColumn("passed", F.col("n_valid") >= _required(n, min_n, pct))
    groups = assay.features.select("feature_id", F.col(feature_group).alias("g"))
    sizes = groups.groupBy("g").agg(F.count("*").alias("size"))
    per = cells.join(groups, "feature_id").groupBy("sample_id", "g").agg(F.count_if("ok").alias("v"))
    per = per.join(sizes, "g").withColumn("ok", F.col("v") >= _required(F.col("size"), min_n, pct))
    per = per.groupBy("sample_id").agg(F.sum("v").alias("n_valid"), F.count_if("ok").alias("n_ok"))
    per = assay.samples.select("sample_id").join(assay.per_sample(per), "sample_id", "left").fillna(0, ["n_valid", "n_ok"])
    n_groups = sizes.agg(F.count("*")).scalar()
    return per.select("sample_id", "n_valid", (F.col("n_ok") == n_groups).alias("passed"))


def annotation_filter(features: DataFrame, criteria: Sequence[dict]) -> DataFrame:
    """Rows that meet every criterion.

    ``{"column": c, "min": x, "max": y}`` bounds a number; ``{"column": c, "pattern": p, "mode": m}``
    matches text, in any column when ``column`` is None.
    """
    keep = F.lit(True)
    for crit in criteria:
        if "pattern" in crit:
            cols = [crit["column"]] if crit.get("column") else [c for c in features.columns if c != "feature_id"]
            hit = F.lit(False)
            for c in cols:
                hit = hit | text_match(F.col(c).cast("string"), crit["pattern"], crit.get("mode", "contains"))
            keep = keep & hit
        else:
            number = F.col(crit["column"]).cast("string").try_cast("double")
            if crit.get("min") is not None:
                keep = keep & F.coalesce(number >= crit["min"], F.lit(False))
            if crit.get("max") is not None:
                keep = keep & F.coalesce(number <= crit["max"], F.lit(False))
    return features.filter(keep)


def site_filter(
    features: DataFrame, positions: str | None = None, residue: str | None = None, residue_col: str = "residue"
) -> DataFrame:
    """Class I sites (exactly one candidate position) and, if given, one residue."""
    keep = F.lit(True)
    if positions is not None:
        entries = F.filter(F.split(F.col(positions), ";"), lambda p: F.trim(p) != "")
        keep = keep & (F.size(entries) == 1)
    if residue is not None:
        keep = keep & (F.upper(F.trim(F.col(residue_col))) == residue.upper())
    return features.filter(keep)


def filter_summary(before: Assay, after: Assay) -> DataFrame:
    """Rows, sparsity mean and median, and mean CV of both matrices."""
    out = None
    for label, assay in (("before", before), ("after", after)):
        v = F.when(~is_missing(F.col("value")), F.col("value"))
        per_row = assay.cells.groupBy("feature_id").agg(
            (1 - F.count(v) / assay.n_samples).alias("sparsity"), (F.stddev_samp(v) / F.avg(v)).alias("cv")
        )
        one = per_row.agg(
            F.lit(label).alias("stage"),
            F.count("*").alias("n_rows"),
            F.avg("sparsity").alias("sparsity_mean"),
            F.median("sparsity").alias("sparsity_median"),
            F.avg("cv").alias("cv_mean"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def cv_histogram(before: Assay, after: Assay, width: float = 0.1, high: float = 2.0) -> DataFrame:
    """``stage, bin, n, bin_start``: rows by their coefficient of variation, before and after; larger ones in the last bin."""
    out = None
    for label, assay in (("before", before), ("after", after)):
        v = F.when(~is_missing(F.col("value")), F.col("value"))
        cv = assay.cells.groupBy("feature_id").agg((F.stddev_samp(v) / F.avg(v)).alias("cv"))
        capped = cv.select(F.lit(label).alias("stage"), F.least("cv", F.lit(high)).alias("cv"))
        one = histogram(capped, "cv", 0.0, high, width, ("stage",))
        out = one if out is None else out.unionByName(one)
    return out


def column_boxes(before: Assay, after: Assay) -> DataFrame:
    """Per stage and sample: completeness, and quartiles and extremes of log10(1 + value)."""
    out = None
    for label, assay in (("before", before), ("after", after)):
        logs = assay.observed("positive", F.log10(1 + F.col("value")))
        boxes = group_quantiles(logs, ["sample_id"], "value", {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}, assay.n_samples)
        rows = assay.cells.agg(F.count_distinct("feature_id")).scalar()
        one = boxes.withColumn("completeness", F.col("n") / rows).withColumn("stage", F.lit(label)).drop("n")
        out = one if out is None else out.unionByName(one)
    return out


def search(df: DataFrame, text: str, sort: str, descending: bool = True, n: int = 100, offset: int = 0) -> DataFrame:
    """Rows with ``text`` in any column, sorted with missing values last, one page of them."""
    needle = text.lower()
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False))
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    rest = [F.asc(c) for c in df.columns if c != sort]
    return df.filter(hit).orderBy(order, *rest).offset(offset).limit(n)
