"""Byte-level BPE by backtracking over longest matches.

Each pretoken's bytes are read as Latin-1, so that an Aho-Corasick automaton over characters finds the longest
token at every place. The encoder takes the longest token, and goes back to the next shorter one when the
token does not fit the one before it: two tokens fit if merging their text would leave the border between them.
Whether a pair fits is memoised, places from which no encoding exists are marked, so work is linear in the
length of a pretoken. The result is that of applying the merges in order of rank.

Defined results: a null text counts as empty and gives no ids; bytes of any text are covered, since every single
byte is a token; texts of any length are encoded whole; an empty table gives an empty result; other columns pass
through untouched.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import fresh, whole
from assaygrid.plans.bind import Catalog, table

catalog = Catalog()
ROWS = 100  # texts decoded at once
MEMO = 250_000  # pretokens and pairs remembered by a worker; then the memory starts afresh


def ascii_form(pattern: str) -> str:
    """The pattern with letters, numbers and white space spelled out, for texts of ASCII only and the faster engine."""
    spelled = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}
    out, inside, at = [], False, 0
    while at < len(pattern):
        part = next((k for k in (*spelled, r"\S") if pattern.startswith(k, at)), pattern[at])
        at += len(part)
        if part in "[]" and not (out and out[-1] == "\\"):
            inside = part == "["
        if part == r"\S" and not inside:
            out.append(f"[^{spelled[chr(92) + 's']}]")
        else:
            known = spelled.get(part)
            out.append(part if known is None else known if inside else f"[{known}]")
    return "".join(out)


class Encoder:
    """Vocabulary, splits and (on first use in a process) the automaton; broadcast once per application."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.pattern = pattern
        lines = (line.split() for line in ranks.splitlines() if line.strip())
        by_id = sorted((int(n), base64.b64decode(token)) for token, n in lines)
        if [n for n, _ in by_id] != list(range(len(by_id))):
            raise ValueError("ranks must number the tokens from 0 without gaps")
        self.tokens = [t for _, t in by_id]
        self._derive()

    def _derive(self) -> None:
        ids = {t: n for n, t in enumerate(self.tokens)}
        self.shorter = []  # the longest proper prefix that is a token, -1 for single bytes
        for t in self.tokens:
            end = len(t) - 1
            while end and t[:end] not in ids:
                end -= 1
            self.shorter.append(ids[t[:end]] if end else -1)
        self.left, self.right = list(range(len(ids))), list(range(len(ids)))
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for n, t in enumerate(self.tokens):
            head = self.shorter[n]
            while head >= 0:
                tail = ids.get(t[len(self.tokens[head]) :], n)
                if head < n and tail < n and self._fit(head, tail):
                    self.left[n], self.right[n], self.merged[head, tail] = head, tail, n
                    break
                head = self.shorter[head]
        self.fits.clear()

    def _fit(self, a: int, b: int) -> bool:
        """Undo merges at the border, the latest first; a pair there that merges earlier than that would cross it."""
        limit = len(self.tokens)
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a != limit:
                    continue
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 != limit:
                    continue
                limit, a = a, self.right[a]
                if a == limit:
                    return True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "memo", "find", "find_ascii", "sizes")}

    def ready(self) -> Encoder:
        if not hasattr(self, "automaton"):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for n, t in enumerate(self.tokens):
                automaton.add_word(t.decode("latin-1"), n)
            automaton.make_automaton()
            self.automaton, self.memo, self.find = automaton, {}, regex.compile(self.pattern).findall
            self.find_ascii = re.compile(ascii_form(self.pattern)).findall
            self.sizes = list(map(len, self.tokens))
        return self

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one pretoken."""
        raw = text.encode().decode("latin-1")
        # mostly the longest match after the longest match fits all the way
        out = [n for _, n in self.automaton.iter_long(raw)]
        fits = self.fits
        for pair in zip(out, out[1:]):
            if not (fits[pair] if pair in fits else self._pair(*pair)):
                return self._backtrack(raw)
        return tuple(out)

    def _backtrack(self, raw: str) -> tuple[int, ...]:
        sizes, shorter, fits, size = self.sizes, self.shorter, self.fits, len(raw)
        longest = [-1] * size
        for end, n in self.automaton.iter(raw):
            longest[end + 1 - sizes[n]] = n  # ends come in order, so the last match from a place is its longest
        out: list[int] = []
        dead = set()
        at, token = 0, longest[0]
        while True:
            end = at + sizes[token]
            if end not in dead:
                if out:
                    pair = (out[-1], token)
                    good = fits[pair] if pair in fits else self._pair(*pair)
                else:
                    good = True
                if good:
                    out.append(token)
                    if end == size:
                        return tuple(out)
                    at, token = end, longest[end]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]

    def _pair(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[a, b] = self._fit(a, b)
        return known

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        words = (self.find_ascii if text.isascii() else self.find)(text)
        memo = self.memo
        out = list(map(memo.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    word = words[i]
                    out[i] = ids = memo.get(word) or array("i", self.piece(word)).tobytes()
                    if len(word) <= 64:
                        memo[word] = ids
            if len(memo) >= MEMO:
                memo.clear()
        return b"".join(out)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of each list of ``ids``; list n goes from ``ends[n]`` to ``ends[n + 1]``."""
        # a few texts at a time: ids as Python numbers take much more room than in an array
        cuts = ends[[*range(0, len(ends) - 1, ROWS), len(ends) - 1]].tolist()
        data = b"".join(b"".join(map(self.tokens.__getitem__, ids[a:b].tolist())) for a, b in zip(cuts, cuts[1:]))
        offsets = np.append(0, np.cumsum(np.array(self.sizes)[ids]))[ends].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encoder(spark: SparkSession, path: str, pattern: str):
    """A broadcast encoder; its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(Encoder(file.read(), pattern))


def coded(text: Column, shared) -> Column:
    """struct: the ids of each whole text, and the bytes that these ids stand for."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # a few texts at a time leave the worker before the next are read
        for texts in chain.from_iterable((b.slice(at, ROWS) for at in range(0, max(1, len(b)), ROWS)) for b in batches):
            model = shared.value.ready()
            raw = [model.encode(t.as_py() or "") for t in texts]
            ids, ends = np.frombuffer(b"".join(raw), np.int32), np.cumsum([0, *map(len, raw)]) // 4
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.StructArray.from_arrays([lists, model.decode(ids, ends)], ["ids", "decoded"])

    return run(text)


def decode(ids: Column, shared) -> Column:
    """binary: the bytes that the ids stand for."""

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
        return shared.value.ready().decode(lists.flatten().to_numpy(), ends)

    return run(ids)


def tokenize(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, renamed if the input has such columns; they come last."""
    shared = encoder(docs.sparkSession, path, pattern)
    found, ids, decoded = fresh(docs.columns, "coded", "ids", "decoded")
    out = docs.withColumn(found, coded(whole(), shared))
    return out.select(*docs.columns, F.col(found)["ids"].alias(ids), F.col(found)["decoded"].alias(decoded))


def digests(tokenized: DataFrame) -> list[Column]:
    """n_tokens and the two checksums, from the last two columns of ``tokenize``."""
    ids, decoded = tokenized.columns[-2:]
    return [
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]


@catalog.add("op6_byte_bpe")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", *digests(out))
