"""Ranks and running aggregates over an order that no single task has to hold.

Rows are range-partitioned on (groups, order) and written once, so that partition numbers are
fixed. Windows then run inside a partition, and what earlier (or later) partitions contribute is
added from a table with one row per (partition, group).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.runtime import broadcast_if, materialize, shuffle_partitions

PART = "_part"


@dataclass(frozen=True)
class Ordered:
    """A frame laid out in a total order; ``running`` adds prefix or suffix aggregates."""

    df: DataFrame
    order: tuple[Column, ...]
    reverse_order: tuple[Column, ...]
    groups: tuple[str, ...]
    n_groups: int

    def running(self, out: str, fn: str, col: Column, reverse: bool = False, exclusive: bool = False) -> Ordered:
        """Add ``out``: ``fn`` (sum, min or max) of ``col`` over this row and all before it in its group.

        ``reverse`` runs from the end instead; ``exclusive`` leaves the row itself out.
        """
        agg = {"sum": F.sum, "min": F.min, "max": F.max}[fn]
        order = self.reverse_order if reverse else self.order
        last = -1 if exclusive else 0
        inside = (
            Window.partitionBy(PART, *self.groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        )
        by_part = F.col(PART).desc() if reverse else F.col(PART).asc()
        others = (
            Window.partitionBy(*(self.groups or [F.lit(0)]))
            .orderBy(by_part)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        keys = [PART, *self.groups]
        # one row per (partition, group): at most partitions + groups rows
        carried = (
            self.df.groupBy(*keys)
            .agg(agg(col).alias("_t"))
            .select(*keys, agg("_t").over(others).alias("_carry"))
        )
        bound = shuffle_partitions(self.df.sparkSession) + self.n_groups
        local = self.df.withColumn("_local", agg(col).over(inside))
        # a null group is a group like the others
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        joined = local.alias("l").join(broadcast_if(carried, bound).alias("c"), reduce(lambda x, y: x & y, same), "left").select("l.*", "c._carry")
        a, b = F.col("_local"), F.col("_carry")
        if fn == "sum":
            total = F.coalesce(a, a * 0, F.lit(0)) + F.coalesce(b, F.lit(0))
        else:
            total = F.least(a, b) if fn == "min" else F.greatest(a, b)
        return replace(self, df=joined.withColumn(out, total).drop("_local", "_carry"))

    def on(self, df: DataFrame) -> Ordered:
        """The same layout over ``df``, which was derived row by row from this frame."""
        return replace(self, df=df)

    def result(self) -> DataFrame:
        return self.df.drop(PART)


def ordered(
    df: DataFrame, order: Sequence[tuple[str, bool]], groups: Sequence[str] = (), n_groups: int = 1
) -> Ordered:
    """Lay ``df`` out by ``order``, a list of (column, ascending) that is unique within a group.

    ``n_groups`` is an upper bound for the number of groups (it decides about one broadcast).
    """
    cols = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    back = [F.col(c).desc() if up else F.col(c).asc() for c, up in order]
    # without a fixed number of partitions, adaptive execution merges neighbouring small ranges
    laid = df.repartitionByRange(*[F.col(g) for g in groups], *cols).withColumn(PART, F.spark_partition_id())
    return Ordered(materialize(laid), tuple(cols), tuple(back), tuple(groups), n_groups)


def row_numbers(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    groups: Sequence[str] = (),
    n_groups: int = 1,
    out: str = "rank",
) -> DataFrame:
    """Position from 1 within each group under a total order."""
    return ordered(df, order, groups, n_groups).running(out, "sum", F.lit(1).cast("bigint")).result()


def average_ranks(
    df: DataFrame, value: str, groups: Sequence[str] = (), n_groups: int = 1, out: str = "rank", ascending: bool = True
) -> DataFrame:
    """Rank with ties averaged. Equal values are counted first, so a hot value is one row in the order."""
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    ranks = (
        ordered(counts, [(value, ascending)], groups, n_groups)
        .running("_upto", "sum", F.col("_n"))
        .result()
        .select(*groups, value, "_n", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    )
    return join_counted(df, ranks, [*groups, value], "_n").drop("_n")


def join_counted(df: DataFrame, lookup: DataFrame, keys: Sequence[str], count: str, share: int = 1000) -> DataFrame:
    """Join each row of ``df`` to its one row in ``lookup``, whose ``count`` says how many rows of ``df`` it serves.

    Keys that serve more than a 1/``share`` part of all rows number at most ``share``: those are
    broadcast, so a hot key never gathers in one task. The others join by shuffle.
    """
    total = lookup.agg(F.sum(count)).scalar()
    lookup = lookup.withColumn("_hot", F.col(count) > total / share)
    hot = F.broadcast(lookup.filter("_hot").drop("_hot"))
    cold = lookup.filter(~F.col("_hot")).drop("_hot")
    is_hot = F.broadcast(lookup.filter("_hot").select(*keys))
    return df.join(hot, list(keys)).unionByName(df.join(is_hot, list(keys), "left_anti").join(cold, list(keys)))
