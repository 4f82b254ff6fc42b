"""Cross-tokenizer alignment by diagonal run skipping.

Both tokenizers read the same bytes, a space and the text; the byte offsets at which their tokens end are two rising arrays. From a pair of
places the arrays are compared at the present shift between their indices, in slices that double while they are equal and halve
once they differ: a stretch in which tokens match one to one is jumped, however long, in a logarithm of slices. Where the ends
differ, the two are walked to the next end they share; that irregular group changes the shift. Tokens whose bytes
overlap are linked: a one-to-one pair once, and inside a group each step of the walk links the two tokens it stands on.

Neither tokenizer lets a token cross a space between visible characters, nor go on from a letter to a mark like a comma, so a worker asks the
libraries once for every different word between such places; a text with a piece that is not reproduced goes to them whole.

Counts of linked id pairs are added up over the corpus by Spark and stored. Pairs whose counts exceed a cut, as many as
fit ``TABLE`` entries, are looked up in Arrow batches; the links of all rarer pairs are joined to their counts by shuffle.

Defined results: a text that is null or empty, or whose joined tokens of either side differ from space and text, has no tokens, zeros
and an empty digest; equal rows count each time; texts of any length are aligned whole; ties of the highest count all are
best; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import fresh, whole
from assaygrid.plans.bind import Catalog, table
from assaygrid.runtime import materialize

catalog = Catalog()
TABLE = 1_000_000  # pairs a task may hold, 17 bytes each
PROBE = 4  # tokens compared first
CHUNK = 500_000  # characters of texts whose new words are asked for at once
MEMO = 400_000  # pieces between spaces, and words in them, remembered by a worker; then the memory starts afresh
Pair = tuple[bytes, bytes]
# A space between visible characters: both tokenizers begin a token there, and at marks that follow a letter or digit.
CUT = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")
PLAIN = re.compile(r"[ -~\nÀ-ÖØ-öø-ÿ]*").fullmatch
MARKS = re.compile(r"(.*[A-Za-z0-9À-ÖØ-öø-ÿ])([.,;:!?]+)", re.DOTALL).fullmatch
CROSSED = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ][.,;:!?]").search
TOKENS = "struct<ids_a:array<int>,ids_b:array<int>,ends_a:array<int>,ends_b:array<int>>"
COUNTS = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,pairs:array<bigint>,times:array<int>>"


# --- two token sequences -----------------------------------------------------------------------------------


def align(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rising ends that finish alike: the last tokens of each group on both sides, and the linked tokens."""
    i = j = 0
    a, b = [*a, -1], [*b, -2]  # marks that differ end the last stretch
    runs: list[tuple[int, int, int]] = []
    last_a: list[int] = []
    last_b: list[int] = []
    link_a: list[int] = []
    link_b: list[int] = []
    size = len(a) - 1
    while i < size:
        if a[i] == b[j]:
            # slices double while both sides agree at this shift, then halve towards the first difference
            first, shift, step = i, j - i, PROBE
            while a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
                step += step
            while step > 1:
                step >>= 1
                if a[i : i + step] == b[i + shift : i + shift + step]:
                    i += step
            runs.append((first, j, i - first))
            j = i + shift
            if i == size:
                break
        u, v = a[i], b[j]
        link_a.append(i)
        link_b.append(j)
        while u != v:
            if u < v:
                i += 1
                u = a[i]
            else:
                j += 1
                v = b[j]
            link_a.append(i)
            link_b.append(j)
        last_a.append(i)
        last_b.append(j)
        i += 1
        j += 1
    starts = np.array(runs, np.int64).reshape(-1, 3)
    n = starts[:, 2]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    run_a, run_b = np.repeat(starts[:, 0], n) + inside, np.repeat(starts[:, 1], n) + inside
    groups_a, groups_b = np.concatenate([run_a, np.array(last_a, np.int64)]), np.concatenate([run_b, np.array(last_b, np.int64)])
    groups_a.sort()
    groups_b.sort()
    return groups_a, groups_b, np.concatenate([run_a, np.array(link_a, np.int64)]), np.concatenate([run_b, np.array(link_b, np.int64)])


# --- vocabularies ------------------------------------------------------------------------------------------


def byte_level() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as printable characters: themselves if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Models:
    """Both tokenizers, the bytes of their tokens, and the pieces of the groups' notation; broadcast as two definitions."""

    def __init__(self, definition_a: str, proto_b: bytes) -> None:
        self.definition_a, self.proto_b = definition_a, proto_b

    def __getstate__(self) -> dict:
        return {"definition_a": self.definition_a, "proto_b": self.proto_b}

    def ready(self) -> Models:
        if hasattr(self, "b"):
            return self
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(self.definition_a), SentencePieceProcessor(model_proto=self.proto_b)
        self.a.encode_special_tokens = True
        entries, level = self.a.get_vocab(), byte_level()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, n in entries.items():
            self.bytes_a[n] = bytes(level[c] for c in entry) if all(c in level for c in entry) else entry.encode()
        self.bytes_b = []
        for n in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(n)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode())
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        numbers = [str(n) for n in range(max(len(self.bytes_a), len(self.bytes_b)))]
        # if no piece of the second vocabulary goes on behind a space, or from a letter to a mark, its tokens, as those of the first, cross neither
        whole_pieces = [self.b.id_to_piece(n) for n in range(len(self.bytes_b))]
        self.cuts = not any("▁" in p.lstrip("▁") or CROSSED(p) for p in whole_pieces) and len(self.b.encode("a")) == 1
        self.memo: dict[str, Pair | None] = {}
        self.words: dict[str, Pair | None] = {}
        self.marks: dict[str, Pair] = {}
        self.inner, self.bar, self.close = (np.array([n + mark for n in numbers], object) for mark in (",", "|", ";"))
        return self

    def _whole(self, texts: list[str]) -> Iterator[Pair | None]:
        """Ids as bytes of space and each text by both libraries, None where they are not reproduced."""
        found_a = self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        for text, a, b in zip(texts, found_a, self.b.encode(texts, num_threads=1)):
            a, raw = a.ids, f" {text}".encode()
            same = b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            yield (array("i", a).tobytes(), array("i", b).tobytes()) if same else None

    def _mark(self, marks: str) -> Pair:
        """Marks behind a letter: the first vocabulary begins a token there, the second is asked behind a letter of one token."""
        if marks not in self.marks:
            self.marks[marks] = array("i", self.a.encode(marks, add_special_tokens=False).ids).tobytes(), array("i", self.b.encode(f"a{marks}")[1:]).tobytes()
        return self.marks[marks]

    def _pairs(self, texts: list[str]) -> Iterator[Pair | None]:
        """As ``_whole``, verified together: all bytes in a row, and each text's number of bytes."""
        spaced = [f" {t}" for t in texts]
        ids_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        raw = [t.encode() for t in spaced]
        sizes, joined, out = list(map(len, raw)), b"".join(raw), []
        for ids, parts, widths in ((ids_a, self.bytes_a, self.sizes_a), (ids_b, self.bytes_b, self.sizes_b)):
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            ends = np.cumsum(list(map(len, ids)))
            told = np.diff(np.append(0, np.cumsum(widths[flat]))[ends], prepend=0)
            if told.tolist() != sizes or b"".join(map(parts.__getitem__, chain.from_iterable(ids))) != joined:
                return self._whole(texts)
            held, cuts = flat.tobytes(), (4 * ends).tolist()
            out.append([held[x:y] for x, y in zip([0, *cuts], cuts)])
        return zip(*out)

    def _learn(self, pieces: list[str]) -> None:
        cut = [(p, *m.groups()) if m else (p, p, "") for p, m in zip(pieces, map(MARKS, pieces))]
        new = list({word for _, word, _ in cut if word not in self.words})
        if new:
            self.words.update(zip(new, self._pairs(new)))
        for piece, word, marks in cut:
            pair = self.words[word]
            if pair and marks:
                more = self._mark(marks)
                pair = pair[0] + more[0], pair[1] + more[1]
            self.memo[piece] = pair

    def pieces(self, text: str) -> list[str]:
        """Cut at spaces between visible characters; each piece follows a space, the first the one that both sides add."""
        if not self.cuts:
            return [text]
        if PLAIN(text) and not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " "):
            return text.split(" ")
        first, *others = CUT.split(text)
        return [first, *(p[1:] for p in others)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides of each text, or None for a text without tokens."""
        memo = self.memo
        if len(memo) > MEMO or len(self.words) > MEMO:
            memo.clear()
            self.words.clear()
        cut = [self.pieces(t) if t else [] for t in texts]
        found = [list(map(memo.get, pieces)) for pieces in cut]
        new = list({p for pieces, pairs in zip(cut, found) if None in pairs for p, pair in zip(pieces, pairs) if pair is None})
        if new:
            self._learn(new)
        for text, pieces, pairs in zip(texts, cut, found):
            if None in pairs:
                pairs = [memo[p] if pair is None else pair for p, pair in zip(pieces, pairs)]
                if None in pairs:  # a piece is not reproduced; the whole text may be
                    pairs = [next(self._whole([text]))]
            yield tuple(np.frombuffer(b"".join(ids), np.int32) for ids in zip(*pairs)) if pairs and pairs != [None] else None
        for p in new:
            if len(p) > 64:
                del memo[p]
                self.words.pop(p, None)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return align(np.cumsum(self.sizes_a[a]).tolist(), np.cumsum(self.sizes_b[b]).tolist())

    def notation(self, a: np.ndarray, b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: every token's number and mark goes to its place among both sides' tokens."""
        out = np.empty(len(a) + len(b), object)
        marks_a, marks_b = self.inner[a], self.inner[b]
        marks_a[groups_a], marks_b[groups_b] = self.bar[a[groups_a]], self.close[b[groups_b]]
        before = np.concatenate([[0], groups_b[:-1] + 1])  # tokens of b in earlier groups
        out[np.arange(len(a)) + np.repeat(before, np.diff(groups_a, prepend=-1))] = marks_a
        out[np.arange(len(b)) + np.repeat(groups_a + 1, np.diff(groups_b, prepend=-1))] = marks_b
        return "".join(out.tolist())[:-1]


def models(spark: SparkSession, path_a: str, path_b: str):
    """Broadcast models; their size is that of the vocabularies."""
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return spark.sparkContext.broadcast(Models(a.read(), b.read()))


def _encoded(texts: pa.Array, model: Models) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """The ids of each text; texts whose lengths add up to ``CHUNK`` share their calls of the libraries."""
    chunk, held = [], 0
    for t in texts:
        chunk.append(t.as_py() or "")
        held += len(chunk[-1])
        if held > CHUNK:
            yield from model.encode(chunk)
            chunk, held = [], 0
    yield from model.encode(chunk)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), kind))


def tokens(text: Column, shared) -> Column:
    """struct: the ids of both sides, and for each group how many tokens of either side lie before its end."""

    @F.arrow_udf(TOKENS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        none = (np.zeros(0, np.int64),) * 4
        for texts in batches:
            model, rows = shared.value.ready(), []
            for pair in _encoded(texts, model):
                rows.append(none if pair is None else (*pair, *(x + 1 for x in model.align(*pair)[:2])))
            yield pa.StructArray.from_arrays([_lists([r[k] for r in rows], pa.int32()) for k in range(4)], ["ids_a", "ids_b", "ends_a", "ends_b"])

    return run(text)


def counted(text: Column, shared) -> Column:
    """struct: numbers of tokens, groups and links, the digest of the groups, and how often each id pair is linked."""

    @F.arrow_udf(COUNTS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            model, rows, pairs, times = shared.value.ready(), [], [], []
            width = len(model.bytes_b)
            for pair in _encoded(texts, model):
                if pair is None:
                    rows.append((0, 0, 0, 0, ""))
                    found = n = np.zeros(0, np.int64)
                else:
                    a, b = pair
                    groups_a, groups_b, link_a, link_b = model.align(a, b)
                    digest = hashlib.sha256(model.notation(a, b, groups_a, groups_b).encode()).hexdigest()
                    rows.append((len(a), len(b), len(groups_a), len(link_a), digest))
                    found, n = np.unique(a[link_a].astype(np.int64) * width + b[link_b], return_counts=True)
                pairs.append(found)
                times.append(n)
            kinds = [pa.int64()] * 4 + [pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.StructArray.from_arrays([*columns, _lists(pairs, pa.int64()), _lists(times, pa.int32())], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run(text)


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` with ``ids_a, ids_b`` and ``ends_a, ends_b`` (tokens up to each group's end), renamed if such columns exist."""
    shared = models(docs.sparkSession, path_a, path_b)
    found, *names = fresh(docs.columns, "alignment", "ids_a", "ids_b", "ends_a", "ends_b")
    out = docs.withColumn(found, tokens(whole(), shared))
    return out.select(*docs.columns, *[F.col(found)[k].alias(n) for k, n in zip(("ids_a", "ids_b", "ends_a", "ends_b"), names)])


# --- counts over the corpus --------------------------------------------------------------------------------


def pair_counts(stored: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): links of each pair of ids (a * width + b) over all rows; best if none of its b has more."""
    rows = stored.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = materialize(rows.groupBy("pair").agg(F.sum("times").alias("n")))
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("highest"))
    # at most one row per id of b
    joined = counts.join(F.broadcast(highest), F.col("pair") % width == F.col("b"))
    return materialize(joined.select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))


def frequent_cut(counts: DataFrame, limit: int) -> int:
    """The least power of two such that at most ``limit`` pairs have that count or more; 64 numbers reach the driver."""
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    held = {r.power: r.rows for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("rows")).collect()}
    total, cut = 0, max(held, default=0) + 1
    while cut > 0 and total + held.get(cut - 1, 0) <= limit:
        cut -= 1
        total += held.get(cut, 0)
    return 1 << cut


def looked_up(pairs: Column, times: Column, held) -> Column:
    """struct: the sums over the pairs that tasks hold, and the other pairs with their times."""

    @F.arrow_udf("struct<count_sum:bigint,n_best:bigint,rare:array<struct<pair:bigint,times:int>>>")
    def run(lists: pa.Array, numbers: pa.Array) -> pa.Array:
        keys, n, best = held.value
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat, k = lists.flatten().to_numpy(), numbers.flatten().to_numpy()
        at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
        known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
        at = at[known]

        def sums(values: np.ndarray) -> np.ndarray:
            filled = np.zeros(len(flat) + 1, np.int64)
            filled[1:][known] = values * k[known]
            return np.diff(np.cumsum(filled)[ends])

        rare = pa.StructArray.from_arrays([pa.array(flat[~known]), pa.array(k[~known])], ["pair", "times"])
        left = np.concatenate([[0], np.cumsum(~known)])[ends]
        columns = [pa.array(sums(n[at])), pa.array(sums(best[at])), pa.ListArray.from_arrays(pa.array(left, pa.int32()), rare)]
        return pa.StructArray.from_arrays(columns, ["count_sum", "n_best", "rare"])

    return run(pairs, times)


def link_counts(docs: DataFrame, path_a: str, path_b: str, keep: list[str] | None = None, limit: int = TABLE) -> DataFrame:
    """``docs``, or its columns ``keep``, with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, renamed if such columns exist; they come last."""
    spark = docs.sparkSession
    shared = models(spark, path_a, path_b)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    keep = docs.columns if keep is None else keep
    found, key, *out = fresh(docs.columns, "alignment", "alignment_key", *names)
    stored = docs.select(*keep, counted(whole(), shared).alias(found), F.monotonically_increasing_id().alias(key))
    stored = materialize(stored)
    width = shared.value.ready().b.get_piece_size()
    counts = pair_counts(stored.select(f"{found}.pairs", f"{found}.times"), width)
    cut = frequent_cut(counts, limit)
    # at most ``limit`` rows
    top = counts.filter(F.col("n") >= cut).toArrow().sort_by("pair")
    held = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    told = stored.select("*", looked_up(F.col(f"{found}.pairs"), F.col(f"{found}.times"), held).alias("_told"))
    rare_counts = counts.filter(F.col("n") < cut)
    if rare_counts.isEmpty():
        more_n = more_best = F.lit(0)
    else:
        told = materialize(told.withColumn(found, F.col(found).dropFields("pairs", "times")))
        links = told.select(F.col(key).alias("_row"), F.explode("_told.rare").alias("x")).select("_row", "x.pair", "x.times")
        rest = links.join(rare_counts, "pair").groupBy("_row").agg(F.sum(F.col("n") * F.col("times")).alias("_n"), F.sum(F.when(F.col("best"), F.col("times"))).alias("_best"))
        told = told.join(rest, F.col(key) == F.col("_row"), "left")
        more_n, more_best = F.coalesce("_n", F.lit(0)), F.coalesce("_best", F.lit(0))
    values = {n: F.col(f"{found}.{n}") for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    values |= {"n_best": F.col("_told.n_best") + more_best, "count_sum": F.col("_told.count_sum") + more_n}
    return told.select(*keep, *[values[n].alias(o) for n, o in zip(names, out)])


@catalog.add("op11_token_alignment")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return link_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
