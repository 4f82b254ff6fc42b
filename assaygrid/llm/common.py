"""What the operators share: words, whole texts, the learning split, names that clash with nothing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.runtime import materialize

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# A lookup is broadcast only when its measured size is at most this; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 16 * 1024 * 1024


def whole(text: Column | str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text that is not null: runs of anything but space and the controls 9 to 13."""
    return F.array_remove(F.split(text, SPACE), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id, which therefore never teaches a model."""
    return F.crc32(F.col(doc_id).cast("string")) % mod


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    return F.coalesce(remainder(doc_id, mod) == rest, F.lit(False))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each lengthened until it meets none of those taken, in any case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: str, text: str) -> Column:
    """A key of equal rows; copies of a text under other ids get other keys, so that none is hot."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(text))


def broadcast_small(df: DataFrame, size: Column) -> DataFrame:
    """Hint a broadcast when the sum of ``size`` (bytes per row) is measured to be small."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def text_key(text: Column | str = "text") -> list[Column]:
    """``a`` and ``b``, 128 bits that stand for a text."""
    return [F.xxhash64(whole(text)).alias("a"), F.xxhash64(F.lit("b"), whole(text)).alias("b")]


def draw(rows: DataFrame, label: str, bound: int) -> DataFrame:
    """(label, a, b, weight): at most ``bound`` different texts of ``rows`` (label, a, b) for each label.

    Priority sampling: of texts that n rows have, those with the least u / n are drawn, u by hash, and weigh n, or the
    inverse of the first value not drawn if that is more. A large group of copies is thus drawn once, with its own
    number of rows, and a label's weights add up to its rows as expected; if all texts are drawn, exactly.
    """
    u = (F.pmod(F.xxhash64(F.lit("draw"), "a", "b"), F.lit(2**52)) + 1) / F.lit(float(2**52))
    texts = rows.groupBy(label, "a", "b").agg(F.count("*").alias("n")).withColumn("p", u / F.col("n"))
    order = Window.partitionBy(label).orderBy("p", "a", "b")
    first = materialize(texts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= bound + 1))
    ends = first.filter(F.col("r") > bound).select(label, (1 / F.col("p")).alias("least"))
    drawn = first.filter(F.col("r") <= bound).join(ends, label, "left")
    return drawn.select(label, "a", "b", F.greatest(F.col("n").cast("double"), F.col("least")).alias("weight"))


def drawn_rows(rows: DataFrame, label: str, bound: int, *values: str) -> DataFrame:
    """(label, weight, values): ``draw`` with the values of one row of each text."""
    drawn = F.broadcast(draw(rows.select(label, "a", "b"), label, bound))
    one = rows.join(drawn, [label, "a", "b"]).groupBy(label, "a", "b", "weight").agg(*[F.any_value(v).alias(v) for v in values])
    return one.select(label, "weight", *values)
