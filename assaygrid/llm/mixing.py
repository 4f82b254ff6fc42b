"""Mixing sources to target weights.

Sizes are summed per source and each source gets a target; a document is then emitted floor(rate) times and
once more with probability rate - floor(rate), where rate is target over size of its source. The draw is a
hash of the document, so reruns and other partitionings agree.

Defined results: a null source is a source of its own, ordered last; a null or empty text has size 0 and is
emitted like its neighbours, taking nothing; a source of total size 0 has target 0 and is not emitted; equal
rows share one draw; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import broadcast_small, fresh, n_words, whole
from assaygrid.operators.ranking import row_numbers
from assaygrid.plans.bind import Catalog, table
from assaygrid.runtime import materialize

catalog = Catalog()
WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights: Sequence[int], ceiling: int) -> DataFrame:
    """Add ``target`` to one row per source (``key`` null-free, ``source``, ``source_size``).

    The weights repeat over the sources in code-point order, null last. A target stops at ``ceiling`` times
    the size; what is cut goes to the others by weight until none is above. Each round sends three numbers to
    the driver.
    """
    ranked = row_numbers(
        sizes.withColumn("_last", F.col("source").isNull().cast("int")), [("_last", True), ("source", True)], out="_n"
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("_weight", weight.cast("bigint")).withColumn("_cap", F.col("source_size") * ceiling))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while True:
        full = F.col("_weight") * F.lit(level) >= F.col("_cap") if stopped >= 0 else F.lit(False)
        n, cut, open_weight = ranked.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0))
        ).first()
        if n == stopped or not open_weight:
            break
        level, stopped = (total - cut) / open_weight, n
    target = F.least(F.col("_weight") * F.lit(level), F.col("_cap").cast("double"))
    return ranked.withColumn("target", target).drop("_last", "_n", "_weight", "_cap")


def uniform(doc_id: Column, text: Column) -> Column:
    """In [0, 1): the first 13 hex digits of an md5 over the id, or over the text where the id is null."""
    name = F.coalesce(doc_id.cast("string"), F.md5(whole(text)))
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), name)), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, renamed if the input has such columns.

    The names in use come last, in that order.
    """
    key, size, total, target, n = fresh(docs.columns, "mix_key", "size", "source_size", "target", "copies")
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias(key)
    sizes = docs.select(named, "source", n_words(whole()).alias("source_size")).groupBy(key).agg(F.first("source").alias("source"), F.sum("source_size").alias("source_size"))
    aims = targets(sizes, weights, ceiling).select(key, F.col("source_size").alias(total), F.col("target").alias(target))
    aims = broadcast_small(aims, F.octet_length(key) + 32)
    rate = F.when(F.col(total) > 0, F.col(target) / F.col(total)).otherwise(0.0)
    extra = (uniform(F.col("doc_id"), F.col("text")) < rate - F.floor(rate)).cast("bigint")
    out = docs.withColumns({key: named, size: n_words(whole())}).join(aims, key)
    return out.withColumn(n, F.floor(rate) + extra).drop(key).select(*docs.columns, size, total, target, n)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Each document as often as the mix takes it, in the columns of ``docs``."""
    counted = copies(docs, weights, ceiling)
    n, each = counted.columns[-1], fresh(counted.columns, "mix_copy")[0]
    return counted.filter(F.col(n) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)


@catalog.add(
    "op3_mix_sources",
    rf"""
WITH sized AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM per_source
), steps AS (
  SELECT *, row_number() OVER o AS n, sum(cap) OVER o - cap AS cut, sum(w) OVER () - (sum(w) OVER o - w) AS open_w, sum(source_size) OVER () AS total
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT arg_min((total - cut)::DOUBLE / open_w::DOUBLE, n) AS l FROM steps WHERE (total - cut)::DOUBLE / open_w::DOUBLE <= cap / w
), aims AS (
  SELECT source, source_size, least(w * l, cap::DOUBLE) AS target FROM weighed, level
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
""",
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
