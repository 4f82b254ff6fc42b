"""Presence sets: which features occur in which samples, and how those sets overlap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_missing
from assaygrid.runtime import materialize

CHUNK = 4096  # combinations counted together
BLOCK = 100_000  # signatures in a block


def presence(cells: DataFrame, threshold: float | None = None) -> DataFrame:
    """Distinct (feature, sample) that are present: finite and non-zero, or above ``threshold``."""
    v = F.col("value")
    rule = ~is_missing(v, "zero") if threshold is None else ~is_missing(v, "null") & (v > threshold)
    return cells.filter(rule).select("feature_id", "sample_id").distinct()


def signatures(present: DataFrame) -> DataFrame:
    """Exclusive intersections: features counted by their exact set of samples: ``members, n``.

    A feature's set holds at most one entry per sample; only (signature, count) is shuffled twice.
    """
    per_feature = present.groupBy("feature_id").agg(F.sort_array(F.collect_set("sample_id")).alias("members"))
    return per_feature.groupBy("members").agg(F.count("*").alias("n"))


def _packed(n_sets: int):
    """Signature rows into blocks: one bit per set and signature, and the counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                member = np.zeros((len(part), n_sets), dtype=bool)
                sizes = part["idx"].map(len)
                member[np.repeat(np.arange(len(part)), sizes), np.concatenate([np.zeros(0, int), *part["idx"]]).astype(int)] = True
                yield pd.DataFrame({"bits": [np.packbits(member, axis=1).tobytes()], "weights": [part["n"].to_numpy(np.int64).tobytes()]})

    return run


def _totals(bits: bytes, weights: bytes, combos: list[tuple[int, ...]], mode: str, n_sets: int) -> pd.DataFrame:
    """How many features of a block each combination holds (all its sets, or any)."""
    weight = np.frombuffer(weights, np.int64)
    member = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(weight), -1), axis=1)[:, :n_sets].T.astype(bool)
    over = np.logical_and if mode == "intersection" else np.logical_or
    totals = [int(weight[over.reduce(member[list(c)])].sum()) for c in combos]
    return pd.DataFrame({"combo": [list(c) for c in combos], "n": totals}).query("n > 0")


def _intersection_sizes(sigs: DataFrame, combos: DataFrame, n_sets: int) -> DataFrame:
    """``combo, n`` of every combination in the table ``combos``: each block of signatures meets each part of the table."""
    parts = max(1, -(-combos.count() // CHUNK))
    lists = combos.groupBy(F.pmod(F.xxhash64("combo"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list("combo").alias("combos"))
    blocks = sigs.mapInPandas(_packed(n_sets), "bits binary, weights binary")
    met = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(lists, "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bits, weights, asked in zip(pdf["bits"], pdf["weights"], pdf["combos"]):
                yield _totals(bits, weights, asked, "intersection", n_sets)

    return met.mapInPandas(run, "combo array<int>, n long").groupBy("combo").agg(F.sum("n").alias("n"))


def _longer(alive: DataFrame, degree: int) -> DataFrame:
    """Combinations of ``degree`` + 1 sets all of whose parts of ``degree`` sets are in ``alive`` (combo)."""
    side = lambda c, last: alive.select(F.slice("combo", 1, degree - 1).alias("start"), F.col("combo").alias(c), F.element_at("combo", -1).alias(last))
    grown = side("a", "x").join(side("b", "y"), "start").filter("x < y").select(F.concat("a", F.array("y")).alias("combo"))
    if degree == 1:
        return grown
    places = F.sequence(F.lit(0), F.lit(degree))
    part = F.filter("combo", lambda x, k: k != F.col("place"))
    parts = grown.withColumn("place", F.explode(places)).select("combo", part.alias("part"))
    whole = parts.join(alive.select(F.col("combo").alias("part")), "part").groupBy("combo").agg(F.count("*").alias("k"))
    return whole.filter(F.col("k") == degree + 1).select("combo")


def _indexed(sigs: DataFrame, names: Sequence[str]) -> DataFrame:
    lookup = F.array(*[F.lit(n) for n in names])
    positions = F.transform("members", lambda m: (F.array_position(lookup, m) - 1).cast("int"))
    return sigs.select(F.filter(positions, lambda p: p >= 0).alias("idx"), "n")


def _named(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    lookup = F.array(*[F.lit(n) for n in names])
    members = F.transform("combo", lambda i: F.element_at(lookup, i + 1))
    return counts.select(members.alias("members"), F.size("combo").alias("degree"), "n")


def top_intersections(present: DataFrame, names: Sequence[str], max_members: int = 5, limit: int = 100) -> DataFrame:
    """The ``limit`` largest inclusive intersections of 1..``max_members`` sets, in display order.

    Exact without listing every combination: a combination never holds more than its parts, so a
    level is built only from combinations that can still beat the current last place. On ties the
    smaller degree wins, so deeper levels must be strictly larger than it. Candidates are a table, grown by a
    join on their common start and counted in parts; the driver sees the last place only.
    """
    names = sorted(names)
    sigs = materialize(_indexed(signatures(present), names))
    level = sigs.sparkSession.range(len(names)).select(F.array(F.col("id").cast("int")).alias("combo"))
    found = None
    for degree in range(1, max_members + 1):
        counts = materialize(_intersection_sizes(sigs, level, len(names)))
        both = counts if found is None else found.unionByName(counts)
        found = materialize(both.orderBy(F.desc("n"), F.size("combo"), "combo").limit(limit))
        kept, least = found.agg(F.count("*"), F.min("n")).first()
        level = materialize(_longer(counts.filter(F.col("n") > (least if kept == limit else 0)).select("combo"), degree))
        if level.isEmpty():
            break
    return _named(found.orderBy(F.desc("n"), F.size("combo"), "combo"), names)


def unions(present: DataFrame, names: Sequence[str], min_members: int = 1, max_members: int = 5) -> DataFrame:
    """Union size of every combination of ``min_members``..``max_members`` sets."""
    names = sorted(names)
    n_sets = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bits, weights in zip(pdf["bits"], pdf["weights"]):
                source = (c for degree in range(min_members, max_members + 1) for c in combinations(range(n_sets), degree))
                while chunk := list(islice(source, CHUNK)):
                    yield _totals(bits, weights, chunk, "union", n_sets)

    blocks = _indexed(signatures(present), names).mapInPandas(_packed(n_sets), "bits binary, weights binary")
    return _named(blocks.mapInPandas(run, "combo array<int>, n long").groupBy("combo").agg(F.sum("n").alias("n")), names)


def display_order(combos: DataFrame, limit: int = 100, min_members: int = 1, max_members: int | None = None) -> DataFrame:
    """Largest first, ties by degree then name; ``limit`` rows."""
    sized = combos.withColumn("degree", F.size("members")).filter(F.col("degree") >= min_members)
    if max_members is not None:
        sized = sized.filter(F.col("degree") <= max_members)
    return sized.orderBy(F.desc("n"), "degree", "members").limit(limit)


def regions(present: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Venn / K-map regions of 2-6 chosen sets: one boolean per set and the count, empty regions included."""
    if not 2 <= len(sets) <= 6:
        raise ValueError("choose 2 to 6 sets")
    flags = [F.coalesce(F.bool_or(F.col("sample_id") == s), F.lit(False)).alias(s) for s in sets]
    chosen = present.filter(F.col("sample_id").isin(list(sets)))
    counted = chosen.groupBy("feature_id").agg(*flags).groupBy(*sets).agg(F.count("*").alias("n"))
    spark = present.sparkSession
    grid = [tuple(bool(k >> i & 1) for i in range(len(sets))) for k in range(1, 2 ** len(sets))]
    schema = ", ".join(f"`{s}` boolean" for s in sets)
    return spark.createDataFrame(grid, schema).join(F.broadcast(counted), list(sets), "left").fillna(0, ["n"])


def in_all(present: DataFrame, n_sets: int, item: str = "feature_id", member: str = "sample_id") -> DataFrame:
    """Items present in every set."""
    per = present.groupBy(item).agg(F.count_distinct(member).alias("n_sets"))
    return per.filter(F.col("n_sets") == n_sets)
