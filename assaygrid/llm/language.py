"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes, from both ends at once. At every position the states of the two
directions give a distribution over languages; a document's probabilities are the means over all its positions.
The network is trained in numpy by backpropagation through time on windows of labelled documents: a bounded
sample of different texts, as many per language, from everywhere in them; a text counts by its number of rows, and each
language as much as another.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text when there is
nothing to learn from; a null language teaches nothing and a null id is never learned from; repeated rows get the
same answer; texts of any length are read whole; an empty table gives an empty result; other columns pass
through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import drawn_rows, fresh, held_out, remainder, text_key, whole
from assaygrid.plans.bind import Catalog, table

catalog = Catalog()
WINDOW = 64
PAD = 256
HIDDEN = 8
SAMPLE = 1500  # training windows per language at most
PER_DOC = 3  # windows drawn from one text
EPOCHS = 4
STEPS = 400  # training steps at least, however few the windows
BATCH = 64
MIN_CONFIDENCE = 0.3
LETTER = r"\p{L}"


class Network:
    """Two gated recurrent layers, one per direction, under a shared softmax.

    ``emb`` has a column per direction and byte: the input's part of update gate, reset gate and candidate. The
    columns of the padding byte hold the update gate open, so that the state stays what it was. A gate is
    (1 + tanh) / 2. Arrays run (direction, unit, window), so that every part of a step is one block of memory.
    """

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(langs)
        self.langs = langs
        self.w = {
            "emb": rng.normal(0, 0.3, (2, 3 * h, PAD + 1)),
            "rec": rng.normal(0, 1 / np.sqrt(h), (2, 3 * h, h)),
            "out": rng.normal(0, 0.3, (2, k, h)),
            "bias": np.zeros(k),
        }
        self.w = {n: a.astype(np.float32) for n, a in self.w.items()}
        self._pin()

    def _pin(self) -> None:
        self.w["emb"][:, :, PAD] = 0
        self.w["emb"][:, :HIDDEN, PAD] = 30

    def states(self, x: np.ndarray, keep: bool = False):
        """The log weights (position, language, window) of windows ``x``; with ``keep`` also what training needs."""
        n, steps = x.shape
        h, k = HIDDEN, len(self.langs)
        w = self.w
        kind = w["emb"].dtype
        rows = np.ascontiguousarray(np.stack([x.T, x.T[::-1]], 1))  # (step, direction, window)
        state = np.zeros((2, h, n), kind)
        logits = np.empty((steps, k, n), kind)
        logits[:] = w["bias"][:, None]
        inner = np.empty((2, 3 * h, n), kind)
        kept = []
        for s in range(steps):
            for d in (0, 1):
                np.take(w["emb"][d], rows[s, d], axis=1, out=inner[d], mode="clip")
            hidden = w["rec"] @ state
            gates = inner[:, : 2 * h] + hidden[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= kind.type(0.5)
            update, reset = gates[:, :h], gates[:, h:]
            new = reset * hidden[:, 2 * h :]
            new += inner[:, 2 * h :]
            np.tanh(new, out=new)
            before = state
            state = before - new
            state *= update
            state += new
            votes = w["out"] @ state
            logits[s] += votes[0]
            logits[steps - 1 - s] += votes[1]
            if keep:
                kept.append((before, hidden, gates, new, state))
        return (logits, rows, kept) if keep else logits

    @staticmethod
    def softmax(logits: np.ndarray) -> np.ndarray:
        """Over the languages, in place."""
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions that are not padding, by backpropagation through time."""
        steps, h, w = x.shape[1], HIDDEN, self.w
        logits, rows, kept = self.states(x, keep=True)
        delta = self.softmax(logits)
        delta[:, y, np.arange(len(y))] -= 1
        real = (x.T != PAD)[:, None] * (np.ones(len(y)) if weight is None else weight).astype(delta.dtype)
        delta *= real / delta.dtype.type(max(real.sum(), 1e-6))
        grad = {n: np.zeros_like(a) for n, a in w.items()}
        grad["bias"] = delta.sum((0, 2))
        back = np.zeros_like(kept[0][0])
        flip = lambda a: a.transpose(0, 2, 1)
        by_byte = np.zeros((2, PAD + 1, 3 * h), delta.dtype)
        for s in reversed(range(steps)):
            before, hidden, gates, new, state = kept[s]
            update, reset = gates[:, :h], gates[:, h:]
            votes = np.stack([delta[s], delta[steps - 1 - s]])
            grad["out"] += votes @ flip(state)
            back = back + flip(w["out"]) @ votes
            d_new = back * (1 - update) * (1 - new * new)
            d_update = back * (before - new) * update * (1 - update) * 2
            d_reset = d_new * hidden[:, 2 * h :] * reset * (1 - reset) * 2
            d_inner = flip(np.concatenate([d_update, d_reset, d_new], 1))
            for d in (0, 1):
                np.add.at(by_byte[d], rows[s, d], d_inner[d])
            d_hidden = np.concatenate([d_update, d_reset, d_new * reset], 1)
            grad["rec"] += d_hidden @ flip(before)
            back = back * update + flip(w["rec"]) @ d_hidden
        grad["emb"] = flip(by_byte)
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> Network:
        """Adam over shuffled batches, with a rate that falls to zero."""
        rng = np.random.default_rng(seed)
        first = {n: np.zeros_like(a) for n, a in self.w.items()}
        second = {n: np.zeros_like(a) for n, a in self.w.items()}
        epochs = max(epochs, -(-STEPS * BATCH // max(len(x), 1)))
        batches = [b for _ in range(epochs) for b in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH))]
        for t, b in enumerate(batches):
            pace = rate * (1 - t / len(batches))
            for n, g in self.gradients(x[b], y[b], None if weight is None else weight[b]).items():
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                step = first[n] / (1 - 0.9 ** (t + 1)) / (np.sqrt(second[n] / (1 - 0.99 ** (t + 1))) + 1e-6)
                self.w[n] -= (pace * step).astype(np.float32)
            self._pin()
        return self

    def document_probabilities(self, texts: list[bytes], rows: int = 1024) -> np.ndarray:
        """Mean probabilities over all positions of each text (zeros for an empty one)."""
        size = np.array([len(t) for t in texts], np.int64)
        n_windows = -(-size // WINDOW)
        flat = np.full(int(n_windows.sum()) * WINDOW, PAD, np.int16)
        starts = np.concatenate([[0], np.cumsum(n_windows)])
        for t, at in zip(texts, starts):
            flat[at * WINDOW : at * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
        windows = flat.reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(texts)), n_windows)
        total = np.zeros((len(texts), len(self.langs)))
        for at in range(0, len(windows), rows):
            x = windows[at : at + rows].astype(np.int64)
            p = self.softmax(self.states(x))
            p *= (x.T != PAD)[:, None]
            np.add.at(total, owner[at : at + rows], p.sum(0).T)
        return total / np.maximum(size, 1)[:, None]


def as_windows(pieces: list[str]) -> np.ndarray:
    out = np.full((len(pieces), WINDOW), PAD, np.int64)
    for row, piece in zip(out, pieces):
        raw = piece.encode()[:WINDOW]
        row[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def training_windows(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, weight, piece): windows from hashed places of different texts, at most ``sample`` per language."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    chance = lambda n: F.pmod(F.xxhash64("text", F.lit(n)), F.lit(2**30)) / F.lit(float(2**30))
    start = lambda n: F.floor(chance(n) * F.greatest(F.char_length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    pieces = F.array(*[F.substring("text", start(n), F.lit(WINDOW)) for n in range(PER_DOC)])
    drawn = drawn_rows(known.select("lang", *text_key(), pieces.alias("pieces")), "lang", -(-sample // PER_DOC), "pieces")
    return drawn.select("lang", "weight", F.explode("pieces").alias("piece"))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train on ``labelled`` (text, lang); None if no row can teach."""
    rows = sorted(map(tuple, training_windows(labelled, sample).collect()))
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    y = np.array([langs.index(r[0]) for r in rows])
    weight = np.array([r[1] for r in rows])
    weight /= (np.bincount(y, weight) / np.bincount(y))[y]
    return Network(langs).train(as_windows([r[2] for r in rows]), y, weight)


def predict(text: Column, model: Network | None, spark: SparkSession) -> Column:
    """struct<lang_pred, score>: the most probable language and its probability."""
    unknown = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        for texts in batches:
            chosen, score, chunk, held = [], [], [], 0

            def flush() -> None:
                p = net.document_probabilities(chunk)
                best = p.argmax(1)
                chosen.extend(net.langs[b] for b in best)
                score.extend(np.minimum(p[np.arange(len(p)), best], 1).round(4))

            for t in texts:
                chunk.append(t.as_py().encode())
                held += len(chunk[-1])
                if held > 4_000_000:
                    flush()
                    chunk, held = [], 0
            if chunk:
                flush()
            yield pa.StructArray.from_arrays([pa.array(chosen, pa.string()), pa.array(np.array(score, float), pa.float64())], ["lang_pred", "score"])

    return F.when(F.coalesce(text.rlike(LETTER), F.lit(False)), run(F.coalesce(text, F.lit("")))).otherwise(unknown)


def identify(docs: DataFrame, model: Network | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, renamed if the input has such columns; they come last."""
    both, lang, score = fresh(docs.columns, "lang_struct", "lang_pred", "score")
    out = docs.withColumn(both, predict(F.col("text"), model, docs.sparkSession))
    return out.select(*docs.columns, F.col(f"{both}.lang_pred").alias(lang), F.col(f"{both}.score").alias(score))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may teach: their id's remainder is known and not 2."""
    return docs.select("text", "lang", remainder("doc_id", 4).alias("rest")).filter("rest <> 2").select("text", "lang")


@catalog.add("op1_language_id")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = identify(docs.select("doc_id", "text"), fit(learnable(docs)))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
