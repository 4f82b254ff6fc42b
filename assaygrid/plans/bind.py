"""The driver tables seen as assay data, in Spark and, with the same names, as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assaygrid.model import Assay

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name, each with the SQL it must agree with (or none)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is already registered")
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file once."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def R(expr: str, digits: int = 6) -> str:
    """The SQL counterpart of ``rnd``; adding 0 turns -0 into 0."""
    return f"(round({expr}, {digits}) + 0)"


def assay(spark: SparkSession, sf: str, features: bool = False) -> Assay:
    """Features are parts, samples are nations that have suppliers, values are summed prices."""
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation")
    cells = (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .groupBy("l_partkey", "s_nationkey")
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("l_partkey").alias("feature_id"), F.col("n_name").alias("sample_id"), "value")
    )
    return Assay(cells, samples(spark, sf), part_features(spark, sf) if features else None)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    used = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return (
        nation.join(used, "n_nationkey", "left_semi")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("sample_id"),
            F.col("r_name").alias("grp"),
            F.concat(F.lit("B"), (F.col("n_nationkey") % 2).cast("string")).alias("batch"),
        )
    )


def part_features(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("feature_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


CELLS = """cells AS (
  SELECT l_partkey AS feature_id, n_name AS sample_id, round(sum(l_extendedprice), 2) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY l_partkey, n_name)"""

SAMPLES = """samples AS (
  SELECT n_name AS sample_id, r_name AS grp, 'B' || (n_nationkey % 2) AS batch
  FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))"""

FEATURES = """features AS (
  SELECT p_partkey AS feature_id, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size,
         p_retailprice AS price FROM part)"""

# every (feature, sample) pair of the grid, null where the cell is absent
DENSE = """dense AS (
  SELECT f.feature_id, s.sample_id, c.value
  FROM (SELECT DISTINCT feature_id FROM cells) f CROSS JOIN samples s
  LEFT JOIN cells c ON c.feature_id = f.feature_id AND c.sample_id = s.sample_id)"""


def region_assay(spark: SparkSession, sf: str) -> Assay:
    """As ``assay`` with a coarser sample: region and nation parity. Most features have every sample."""
    fine = assay(spark, sf)
    label = F.concat_ws("_", "grp", "batch")
    cells = fine.cells.join(fine.per_sample(fine.samples), "sample_id").groupBy("feature_id", label.alias("sample_id"))
    coarse = fine.samples.select(label.alias("sample_id"), "grp", "batch").distinct()
    return Assay(cells.agg(F.round(F.sum("value"), 2).alias("value")), coarse)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


REGION_CELLS = f"""{CELLS}, {SAMPLES}, rcells AS (SELECT feature_id, grp || '_' || batch AS sample_id, round(sum(value), 2) AS value
  FROM cells JOIN samples USING (sample_id) GROUP BY 1, 2),
rsamples AS (SELECT DISTINCT grp || '_' || batch AS sample_id, grp, batch FROM samples),
rdense AS (SELECT f.feature_id, s.sample_id, c.value FROM (SELECT DISTINCT feature_id FROM rcells) f CROSS JOIN rsamples s
  LEFT JOIN rcells c ON c.feature_id = f.feature_id AND c.sample_id = s.sample_id)"""


def spectrum(source: str, k: str, squarings: int = 40) -> str:
    """CTEs ``mat`` and ``eig``: eigenpairs of the symmetric matrix ``source(i, j, v)``, i and j from 1, the ``k`` largest by size.

    The matrix is squared until its largest row is the leading eigenvector, which is then taken out; ``found`` has
    c, value, and vec with the sign that makes its largest entry positive. Needs WITH RECURSIVE.
    """
    row = "{0}[({1}) * n + 1 : ({1}) * n + n]"
    return f"""mat AS MATERIALIZED (SELECT list(v ORDER BY i, j) AS m, max(i)::INT AS n FROM {source}),
eig AS (SELECT 0 AS c, 0 AS step, n, m, m AS p, NULL::DOUBLE AS value, NULL::DOUBLE[] AS vec FROM mat
  UNION ALL SELECT CASE WHEN step < {squarings} THEN c ELSE c + 1 END, CASE WHEN step < {squarings} THEN step + 1 ELSE 0 END, n,
    CASE WHEN step < {squarings} THEN m ELSE list_transform(range(n * n), lambda q: m[q + 1] - lam * u[q // n + 1] * u[q % n + 1]) END,
    CASE WHEN step < {squarings} THEN list_transform(s, lambda x: x / top) ELSE list_transform(range(n * n), lambda q: m[q + 1] - lam * u[q // n + 1] * u[q % n + 1]) END,
    CASE WHEN step = {squarings} THEN lam END, CASE WHEN step = {squarings} THEN u END
  FROM (SELECT *, list_dot_product(u, list_transform(range(n), lambda a: list_dot_product({row.format("m", "a")}, u))) AS lam, list_max(list_transform(s, lambda x: abs(x))) AS top
    FROM (SELECT *, list_transform(r, lambda x: x / sqrt(rr)) AS u
      FROM (SELECT *, list_dot_product(r, r) AS rr
        FROM (SELECT *, {row.format("p", "d - 1")} AS r, CASE WHEN step < {squarings} THEN list_transform(range(n * n), lambda q: list_dot_product({row.format("p", "q // n")}, {row.format("p", "q % n")})) END AS s
          FROM (SELECT *, list_position(g, list_max(g)) AS d
            FROM (SELECT *, list_transform(range(n), lambda a: p[a * n + a + 1]) AS g FROM eig WHERE c < {k}))))))),
signs AS (SELECT c, value, vec, list_transform(vec, lambda x: abs(round(x, 9))) AS size FROM eig WHERE vec IS NOT NULL),
found AS MATERIALIZED (SELECT c, value, list_transform(vec, lambda x: x * sign(vec[list_position(size, list_max(size))])) AS vec FROM signs)"""
