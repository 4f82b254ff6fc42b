"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

A document's two log-likelihoods are divided by its length; their difference is turned into a probability by a
logistic curve fitted on documents that the counts left out. Bigrams back off to the words of their class, and
those to shared backoff counts: how many different words a word follows, in both classes together. A rare
expression is thus about as likely under either model and decides nothing.

Counts are of documents with the expression, so that a repeated line counts once; every word and pair is counted,
by Spark and as strings. Where the split of an expression over the classes is within chance (below ``TRUST``
standard deviations), the classes share its counts: such an expression weighs nothing. All others are kept, however
many, in a written table of weights that add up over a text: of a word, of a context, and what a pair adds to those
of its parts. Weights are whole multiples of 1 / ``UNIT``, so that sums are the same in every order. The most
frequent ones, as far as they are measured to fit ``BROADCAST_BYTES``, are summed where a text is read; what may be
among the others (by a filter of ``BITS`` bits) is joined with them by shuffle.

Defined results: a null text counts as empty; a text without a word has difference 0; without labels of both
classes every score is 0; a null id or label teaches nothing; equal texts get equal scores; texts of any length are read
whole; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import BROADCAST_BYTES, broadcast_small, drawn_rows, fresh, held_out, remainder, text_key, whole
from assaygrid.plans.bind import Catalog, table
from assaygrid.runtime import materialize

catalog = Catalog()
DISCOUNT = 0.75
TRUST = 4.0
FOLDS = 4  # one part of the texts fits the curve, the others are counted
CALIBRATION = 4000  # different texts per class for the logistic curve at most
BETWEEN = r"[^\p{L}\p{N}]+"
THRESHOLD = 0.3
UNIT = 2**30
BITS = 2**27


def words_of(text: str, between=regex.compile(BETWEEN)) -> list[str]:
    return [w for w in between.split(text.lower()) if w]


@dataclass
class Model:
    """Log ratios of toxic to ordinary: ``unigram`` by word, ``backoff`` by context, ``bigram`` by pair of ids."""

    ids: dict[str, int]
    unigram: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    bigram: np.ndarray

    def difference(self, text: str) -> float:
        """The difference of the two log-likelihoods per word."""
        found = words_of(text)
        if not found:
            return 0.0
        w = np.fromiter(map(self.ids.get, found, [0] * len(found)), np.int64, len(found))
        v = np.concatenate([[0], w[:-1]])
        key = v * len(self.unigram) + w
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        rest = self.backoff[v] + self.unigram[w]
        if len(self.pairs):
            rest = np.where(self.pairs[at] == key, self.bigram[at], rest)
        return float(rest.mean())


class Near:
    """The weights that every task holds, and the filter of the others.

    An expression is a word ``w``, a context ``v `` or a pair ``v w``; the context of the first word is empty.
    """

    def __init__(self, expressions: list[str], weights: np.ndarray, bits: np.ndarray | None) -> None:
        cut = [e.partition(" ") for e in expressions]
        self.ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(x for v, blank, w in cut for x in ((v, w) if w else (v,))))}
        size = len(self.ids) + 1
        self.word, self.context = np.zeros(size, np.int64), np.zeros(size, np.int64)
        pairs = {}
        for (v, blank, w), x in zip(cut, weights.tolist()):
            if not blank:
                self.word[self.ids[v]] = x
            elif not w:
                self.context[self.ids[v]] = x
            else:
                pairs[self.ids[v] * size + self.ids[w]] = x
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.bits = bits

    def read(self, text: str) -> tuple[int, int, list[dict]]:
        """Sum of the weights held here, number of words, and how often each expression occurs that may have another."""
        found = words_of(text)
        if not found:
            return 0, 0, []
        before = ["", *found[:-1]]
        w = np.fromiter(map(self.ids.get, found, [0] * len(found)), np.int64, len(found))
        v = np.concatenate([[self.ids.get("", 0)], w[:-1]])
        total = int(self.word[w].sum() + self.context[v].sum())
        if len(self.pairs):
            key = v * len(self.word) + w
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            total += int(self.pair[at[self.pairs[at] == key]].sum())
        if self.bits is None:
            return total, len(found), []
        times = Counter(found)
        times.update(x + " " for x in before)
        times.update(f"{a} {b}" for a, b in zip(before, found))
        place = np.fromiter((zlib.crc32(e.encode()) % BITS for e in times), np.int64, len(times))
        maybe = (self.bits[place // 8] >> (place % 8).astype(np.uint8)) & 1
        return total, len(found), [{"e": e, "k": k} for (e, k), m in zip(times.items(), maybe.tolist()) if m]


@dataclass
class Weights:
    """``near`` is in every task; ``far`` (expression, weight) is joined, None if ``near`` holds all."""

    near: Near
    far: DataFrame | None
    slope: float = 0.0
    shift: float = 0.0


def trusted(ordinary: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Whether the toxic part of the counts is further from its expected share than chance explains."""
    n = ordinary + toxic
    return np.abs(toxic - n * share) >= TRUST * np.sqrt(np.maximum(n, 1) * share * (1 - share))


def kneser_ney(words: list[str], pairs: np.ndarray, context: np.ndarray, follows: np.ndarray, share: float) -> Model:
    """The model from counts in memory, as ``weights`` makes it from tables; ``share`` is that of toxic documents.

    ``pairs``: rows (context id, word id, ordinary, toxic). ``context``: (ordinary, toxic) counts per id as a
    context, all pairs included. ``follows``: (ordinary, toxic, different words before) per id. Id 0 is the unknown word.
    """
    size = len(words) + 1
    backoff = (follows[:, 2] + 0.5) / (follows[:, 2] + 0.5).sum()
    uni = np.empty((size, 2))
    own = trusted(follows[:, 0], follows[:, 1], share)
    pooled = follows[:, :2].sum(1) / max(follows[:, :2].sum(), 1)
    for c in (0, 1):
        n = follows[:, c].astype(float)
        kept = np.maximum(n - DISCOUNT, 0) / max(n.sum(), 1)
        uni[:, c] = np.where(own, kept + (1 - kept.sum()) * backoff, np.maximum(pooled, 1e-12))
    pairs = pairs[trusted(pairs[:, 2], pairs[:, 3], share)]
    key = pairs[:, 0] * size + pairs[:, 1]
    pairs = pairs[np.argsort(key)]
    seen = np.maximum(pairs[:, 2:4] - DISCOUNT, 0) / np.maximum(context[pairs[:, 0]], 1)
    left = np.ones((size, 2))
    for c in (0, 1):
        left[:, c] -= np.bincount(pairs[:, 0], seen[:, c], minlength=size)
    left = np.maximum(left, 1e-9)
    bigram = np.log(seen + left[pairs[:, 0]] * uni[pairs[:, 1]])
    ratio = lambda a: (a[:, 1] - a[:, 0]).astype(np.float32)
    ids = {w: i + 1 for i, w in enumerate(words)}
    return Model(ids, ratio(np.log(uni)), ratio(np.log(left)), np.sort(key), ratio(bigram))


def counts(labelled: DataFrame) -> tuple[DataFrame, float] | None:
    """(v, w, n0, n1) for every pair of neighbours in ``labelled`` (text, toxic 0 or 1), and the share of toxic rows.

    None without both classes or without a word.
    """
    size = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return None
    w = F.col("w")
    tokens = labelled.select("toxic", F.concat(F.array(F.lit("")), F.array_remove(F.split(F.lower(whole()), BETWEEN), "")).alias("w"))
    # as strings, since only flat values are made distinct by hashing; words hold no blank
    beside = F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    ones = [F.sum(F.when(F.col("toxic") == c, 1).otherwise(0)).alias(n) for c, n in ((0, "n0"), (1, "n1"))]
    told = tokens.select("toxic", F.explode(beside).alias("p")).groupBy("p").agg(*ones)
    pairs = materialize(told.select(F.substring_index("p", " ", 1).alias("v"), F.substring_index("p", " ", -1).alias("w"), "n0", "n1"))
    return None if pairs.isEmpty() else (pairs, size[1] / (size[0] + size[1]))


def weights(pairs: DataFrame, share: float) -> DataFrame:
    """(expression, n, weight): all that do not weigh nothing, with the number of documents they are in."""

    def trust(a: str, b: str) -> Column:
        n = F.col(a) + F.col(b)
        return F.abs(F.col(b) - n * share) >= TRUST * F.sqrt(n * share * (1 - share))

    def ratio(a: str, b: str) -> Column:
        return F.log(b) - F.log(a)

    def discounted(c: str) -> Column:
        return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))

    follows = materialize(pairs.groupBy("w").agg(F.sum("n0").alias("f0"), F.sum("n1").alias("f1"), F.count("*").alias("f2")))
    t = follows.agg(*[F.sum(c).alias(c) for c in ("f0", "f1", "f2")], *[F.sum(discounted(c)).alias("k" + c) for c in ("f0", "f1")], F.count("*").alias("size")).first()
    backoff = (F.col("f2") + 0.5) / (t.f2 + 0.5 * (t.size + 1))  # with a word never seen
    own = {c: discounted(c) / max(t[c], 1) + (1 - t["k" + c] / max(t[c], 1)) * backoff for c in ("f0", "f1")}
    pooled = (F.col("f0") + F.col("f1")) / (t.f0 + t.f1)
    words = follows.select("w", (F.col("f0") + F.col("f1")).alias("n"), *[F.when(trust("f0", "f1"), own[c]).otherwise(pooled).alias(u) for c, u in (("f0", "u0"), ("f1", "u1"))])
    contexts = pairs.groupBy("v").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    seen = [(discounted(n) / F.greatest(F.col(c), F.lit(1))).alias(s) for n, c, s in (("n0", "c0", "s0"), ("n1", "c1", "s1"))]
    told = materialize(pairs.filter(trust("n0", "n1")).join(contexts, "v").select("v", "w", (F.col("n0") + F.col("n1")).alias("n"), F.col("c0") + F.col("c1"), *seen).toDF("v", "w", "n", "c", "s0", "s1"))
    left = materialize(told.groupBy("v").agg(F.max("c").alias("c"), *[F.greatest(1 - F.sum(s), F.lit(1e-9)).alias(x) for s, x in (("s0", "l0"), ("s1", "l1"))]))
    both = told.join(left.drop("c"), "v").join(words.drop("n"), "w")
    bigram = F.log(F.col("s1") + F.col("l1") * F.col("u1")) - F.log(F.col("s0") + F.col("l0") * F.col("u0"))
    found = [
        words.select("w", "n", ratio("u0", "u1")),
        left.select(F.concat("v", F.lit(" ")), "c", ratio("l0", "l1")),
        both.select(F.concat("v", F.lit(" "), "w"), "n", bigram - ratio("l0", "l1") - ratio("u0", "u1")),
    ]
    whole_units = lambda x: F.round(x * UNIT).cast("bigint")
    every = [f.toDF("e", "n", "x").select("e", "n", whole_units(F.col("x")).alias("x")) for f in found]
    return every[0].unionByName(every[1]).unionByName(every[2]).filter("x <> 0")


def placed(table: DataFrame) -> Weights:
    """The written table, its most frequent expressions as far as they fit near, the others far."""
    table = materialize(table.withColumn("level", F.floor(F.log2("n"))))
    size = {r[0]: r[1] for r in table.groupBy("level").agg(F.sum(F.octet_length("e") + 32)).collect()}
    used, cut = 0, None
    for level in sorted(size, reverse=True):
        used += size[level]
        if used > BROADCAST_BYTES:
            break
        cut = level
    near = table.filter(F.col("level") >= cut if cut is not None else F.lit(False)).toArrow()
    far = bits = None
    if used > BROADCAST_BYTES:
        far = table.filter(F.col("level") < cut) if cut is not None else table
        place = F.crc32(F.col("e").cast("binary")) % BITS
        marks = far.select(F.floor(place / 8).cast("int").alias("at"), F.pmod(place, F.lit(8)).cast("int").alias("bit"))
        marks = marks.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("byte")).toArrow()
        bits = np.zeros(BITS // 8, np.uint8)
        bits[marks["at"].to_numpy()] = marks["byte"].to_numpy()
        far = far.select("e", "x")
    return Weights(Near(near["e"].to_pylist(), near["x"].to_numpy(), bits), far)


def differences(docs: DataFrame, model: Weights, name: str) -> DataFrame:
    """``docs`` with the difference of a text's two log-likelihoods per word."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.near)
    kind = "struct<total:bigint,n:int,rest:array<struct<e:string,k:int>>>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        types = [pa.int64(), pa.int32(), pa.list_(pa.struct([("e", pa.string()), ("k", pa.int32())]))]
        for texts in batches:
            columns = list(zip(*[shared.value.read(t.as_py()) for t in texts])) or [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["total", "n", "rest"])

    def mean(total: Column, n: Column) -> Column:
        return F.coalesce(F.try_divide(total, n * F.lit(float(UNIT))), F.lit(0.0))

    (part,) = fresh(docs.columns, "part")
    if model.far is None:
        return docs.withColumn(part, run(whole())).withColumn(name, mean(F.col(part).total, F.col(part).n)).drop(part)
    # equal texts are read once: a key of 128 bits stands for the text, so that no group of copies is hot
    key, far = fresh([*docs.columns, part], "key", "far")
    keyed = F.struct(F.xxhash64(whole()).alias("a"), F.xxhash64(F.lit("b"), whole()).alias("b"))
    texts = docs.select(keyed.alias("key"), whole().alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    read = materialize(texts.select("key", run(F.col("text")).alias("part")).select("key", "part.*"))
    maybe = read.select("key", F.explode("rest").alias("r")).select("key", "r.*")
    extra = maybe.join(model.far, "e").groupBy("key").agg(F.sum(F.col("k") * F.col("x")).alias("extra"))
    told = read.join(extra, "key", "left").select(F.col("key").alias(key), mean(F.col("total") + F.coalesce("extra", F.lit(0)), F.col("n")).alias(far))
    return docs.withColumn(key, keyed).join(told, key, "left").withColumn(name, F.col(far)).drop(key, far)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton steps on weighted points, with a light pull of the slope towards zero."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        w -= np.linalg.solve(hess, z.T @ (weight * (p - y)) + np.array([1e-2, 1e-6]) * w)
    return float(w[0] / scale), float(w[1])


def fit(labelled: DataFrame) -> Weights | None:
    """Counts from all but one of ``FOLDS`` parts of the texts, by hash; the curve from a sample of that one."""
    fold = F.pmod(F.xxhash64(whole()), F.lit(FOLDS))
    counted = counts(labelled.filter(fold > 0))
    if counted is None:
        return None
    model = placed(weights(*counted))
    apart = labelled.filter(fold == 0)
    chosen = drawn_rows(apart.select("toxic", *text_key(), "text"), "toxic", CALIBRATION, "text")
    rows = differences(chosen, model, "x").select("x", "toxic", "weight").toPandas().sort_values(["x", "toxic", "weight"])
    if rows["toxic"].nunique() == 2:
        model.slope, model.shift = logistic(rows["x"].to_numpy(float), rows["toxic"].to_numpy(float), rows["weight"].to_numpy(float))
    else:
        model.slope = 30.0
    return model


def score(docs: DataFrame, model: Weights | None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, renamed if the input has such columns; they come last."""
    diff, prob, predicted = fresh(docs.columns, "difference", "score", "predicted")
    if model is None:
        return docs.withColumns({prob: F.lit(0.0), predicted: F.lit(0)})
    out = differences(docs, model, diff)
    curve = 1 / (1 + F.exp(-(F.col(diff) * model.slope + model.shift)))
    return out.withColumn(prob, F.round(curve, 6)).withColumn(predicted, (F.col(prob) >= THRESHOLD).cast("int")).drop(diff)


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows that may teach."""
    known = labels.filter(F.col("toxic").isin(0, 1) & (remainder("doc_id", 4) != 2)).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(broadcast_small(known, F.lit(16)), "doc_id").select("text", "toxic")


@catalog.add("op2_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = fit(materialize(learnable(docs, table(spark, sf, "labels"))))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
