"""Quality by Bradley-Terry ranking.

A document has a score w.x over its features; of a good and a bad document the good one is preferred with the
logistic of the difference of their scores. The weights minimise that loss over pairs of labelled documents, each
good one drawn against several bad ones, on the differences of their features. Only the weights are learned from a
sample. The threshold is an exact quantile of the scores of all rows that may teach, at the share of bad labels; the
published score is a logistic curve in the distance from the threshold, with 0.3 there, and as wide as those scores.

Defined results: a null text counts as empty, whose features are all 0 but one that marks it; without labels of both
kinds every score is 0; a null id or label teaches nothing; equal texts get equal scores; texts of any length
are read whole; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import broadcast_small, drawn_rows, fresh, held_out, remainder, text_key, whole
from assaygrid.operators.quantiles import group_quantiles
from assaygrid.plans.bind import Catalog, table
from assaygrid.runtime import materialize

catalog = Catalog()
SAMPLE = 4000  # different labelled texts per class at most
RIVALS = 8  # bad documents that a good one is compared with
THRESHOLD = 0.3
KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "symbol", "high", "other")


def _kinds() -> np.ndarray:
    """The kind of each byte."""
    kind = np.full(256, KINDS.index("other"))
    groups = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "newline": b"\n", "stop": b".,;:?", "symbol": b"#*$%&|<>!_=+/\\~^@{}[]"}
    for name, members in groups.items():
        kind[list(members)] = KINDS.index(name)
    kind[128:] = KINDS.index("high")
    return kind


KIND = _kinds()


def features(text: str) -> list[float]:
    """Numbers between 0 and about 10: shares of byte kinds, shape of words and lines, repetition."""
    raw = text.encode()
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(KINDS) + 15) + [1.0]
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(KIND, byte, minlength=len(KINDS)) / len(raw)
    p = byte[byte > 0] / len(raw)
    seen = Counter(words)
    top = [c for _, c in seen.most_common(2)]
    number = dict(zip(seen, range(len(seen))))
    code = np.fromiter(map(number.__getitem__, words), np.int64, n)
    two = code[:-1] * len(seen) + code[1:]
    _, two_code = np.unique(two, return_inverse=True)
    pairs = int(two_code.max()) + 1 if n > 1 else 0
    triples = len(np.unique(two_code[:-1] * len(seen) + code[2:])) if n > 2 else 0
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        *share.tolist(),
        float(-(p * np.log2(p)).sum()),
        float(np.log1p(n)),
        float(np.log1p(len(raw)) / 2),
        len(raw) / n / 10,
        len(seen) / n,
        float(np.log(len(seen)) / np.log(n + 1)),
        top[0] / n,
        sum(top) / n,
        1 - pairs / (n - 1) if n > 1 else 0.0,
        1 - triples / (n - 2) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(w.isupper() for w in words) / n,
        float((code[1:] == code[:-1]).sum()) / n,
        sum(len(w) > 15 for w in words) / n,
        0.0,
    ]


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float = 0.0
    spread: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.centre, self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.log(THRESHOLD / (1 - THRESHOLD)) + (self.raw(x) - self.threshold) / self.spread
        return 1 / (1 + np.exp(-np.clip(at, -50, 50)))


def expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, kept within bounds, and their squares: a feature may be bad at both ends."""
    z = np.clip((x - centre) / scale, -6, 6)
    return np.concatenate([z, z * z / 6], -1)


def bradley_terry(good: np.ndarray, bad: np.ndarray, good_weight: np.ndarray, bad_weight: np.ndarray, rounds: int = 400, rate: float = 0.05, pull: float = 1e-4, seed: int = 5) -> Model:
    """Weights from pairs (good, bad), by gradient descent with momentum on the logistic loss of the differences.

    A row counts by its weight: in the pairs of its class, which are as many for either class, and in the scales.
    """
    both = np.concatenate([good, bad])
    part = [w / w.sum() for w in (good_weight, bad_weight)]
    share = np.concatenate([part[0] * len(good), part[1] * len(bad)]) / len(both)
    centre = share @ both
    model = Model(centre, np.sqrt(share @ (both - centre) ** 2) + 1e-6, np.zeros(2 * both.shape[1]))
    rng = np.random.default_rng(seed)
    first, second = (rng.choice(len(p), RIVALS * max(len(good), len(bad)), p=p) for p in part)
    a, b = expand(good, model.centre, model.scale), expand(bad, model.centre, model.scale)
    move = np.zeros_like(model.weight)
    for part in np.array_split(rng.permutation(len(first)), 16) * (rounds // 16):
        gap = a[first[part]] - b[second[part]]
        lost = 1 / (1 + np.exp(np.clip(gap @ model.weight, -50, 50)))
        move = 0.9 * move + gap.T @ lost / len(part) - pull * model.weight
        model.weight = model.weight + rate * move
    return model


def feature_rows(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return run(whole(text))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Weights from a sample of the different texts of ``labelled`` (text, quality 0 or 1), threshold and spread from all of it.

    None without both classes.
    """
    size = {r[0]: r[1] for r in labelled.groupBy("quality").count().collect()}
    if not size.get(0) or not size.get(1):
        return None
    known = materialize(labelled.select("quality", *text_key(), feature_rows(F.col("text")).alias("x")))
    rows = sorted(map(tuple, drawn_rows(known, "quality", sample, "x").collect()), key=lambda r: (r[2], r[1]))
    good, bad = (np.array([r[2] for r in rows if r[0] == c]) for c in (1, 0))
    model = bradley_terry(good, bad, *(np.array([r[1] for r in rows if r[0] == c]) for c in (1, 0)))
    # of n scores in order, the one at the place of the last bad label
    n = size[0] + size[1]
    probs = {"low": 0.1, "at": (size[0] - 0.5) / (n - 1), "high": 0.9}
    found = group_quantiles(known.select(raw_scores(F.col("x"), model, known.sparkSession).alias("s")), [], "s", probs, 1, interpolate=False).first()
    model.threshold, model.spread = found["at"], (found["high"] - found["low"]) / 8 or 1.0
    return model


def raw_scores(x: Column, model: Model, spark: SparkSession) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        flat = rows.flatten().to_numpy()
        return pa.array(shared.value.raw(flat.reshape(len(rows), -1)) if len(rows) else flat, pa.float64())

    return run(x)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, renamed if the input has such columns; they come last."""
    prob, predicted = fresh(docs.columns, "score", "predicted")
    if model is None:
        return docs.withColumns({prob: F.lit(0.0), predicted: F.lit(0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t.as_py()) for t in texts]).reshape(len(texts), -1)
            yield pa.array(shared.value.score(x).round(6) if len(x) else np.zeros(0), pa.float64())

    return docs.withColumn(prob, run(whole())).withColumn(predicted, (F.col(prob) >= THRESHOLD).cast("int"))


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, quality) of the labelled rows that may teach."""
    known = labels.filter(F.col("quality").isin(0, 1) & (remainder("doc_id", 5) != 0)).select("doc_id", "quality")
    return docs.select("doc_id", "text").join(broadcast_small(known, F.lit(16)), "doc_id").select("text", "quality")


@catalog.add("op5_quality_ranking")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = score(docs, fit(learnable(docs, table(spark, sf, "labels"))))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
