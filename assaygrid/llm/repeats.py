"""Removal of byte strings that occur more than once, by a sparse suffix array sorted deep-shallow.

Every string of ``LENGTH`` bytes has an anchor: among the places of its ``GRAM``-byte grams the one of least hash, the
leftmost of equals. Equal strings have equal anchors, so only suffixes at anchors are sorted, and only those whose
gram occurs at another anchor. The strings of one anchor reach from the first of them to the end of the last; this
context travels to the task that holds all anchors of the gram. There the suffixes are put in order by multikey
quicksort and blind tries, and what two contexts share to both sides of the anchor gives the bytes to remove.

Two shortcuts leave less to sort and change nothing: of equal texts one is looked at, since all of them are
removed; strings that repeat within one block of a text are found by their hashes there, and only the first goes on.
A gram with more contexts than one task should hold is dealt with by the hash of each of its strings instead.

Defined results: a null text counts as empty; a text shorter than ``LENGTH`` keeps all its bytes; equal rows are two
occurrences; matches never cross texts; overlapping and touching removals are one span; texts of any length are
read whole; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import broadcast_small, fresh, row_key, whole
from assaygrid.llm.shingles import STEP, U, mixed
from assaygrid.llm.suffixes import reaches
from assaygrid.plans.bind import Catalog, table
from assaygrid.runtime import materialize

catalog = Catalog()
LENGTH = 200
GRAM = 48
BLOCK = 1 << 20  # bytes whose grams are hashed at once
HOT = 20_000  # contexts of one gram that a task sorts; beyond it strings are matched by hash
ROWS = 40_000  # contexts sorted together
BYTE = mixed((np.arange(256, dtype=np.uint64) + U(7)) * STEP)
BASE = U(0xD6E8FEB86659FD93)


def gram_hashes(flat: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all grams of ``length`` bytes, put together from those of powers of two."""
    parts, h, size, power = [], BYTE[flat], 1, np.array([BASE])
    while True:
        if length & size:
            parts.append((size, h))
        if 2 * size > length:
            break
        h = h[: max(len(h) - size, 0)] * power + h[size:]
        power = power * power
        size *= 2
    out, done = None, 0
    n = max(len(flat) - length + 1, 0)
    for size, h in reversed(parts):
        piece = h[done : done + n]
        scale = np.array([pow(int(BASE), size, 2**64)], np.uint64)
        out = piece.copy() if out is None else out * scale + piece
        done += size
    return out


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys, by doubling."""
    low, size = keys, 1
    while 2 * size <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    n = len(keys) - width + 1
    return np.minimum(low[:n], low[width - size : width - size + n])


def anchors(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of a block of at least ``LENGTH`` bytes: ``gram``, ``at``, ``low`` and ``high`` of their contexts, and
    the spans (``start``, ``end``) of strings that occur in the block twice."""
    width = LENGTH - GRAM + 1
    place = U((1 << 20) * 2 - 1)
    hashes = mixed(gram_hashes(flat, GRAM))
    keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (window_minima(keys, width) & place).astype(np.int64)
    n = len(chosen)
    fresh_ = np.ones(n, bool)
    start = end = np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    if len(np.unique(hashes[chosen[first]])) < len(first):
        # a gram is the anchor twice, so strings may repeat within the block
        strings = gram_hashes(flat, LENGTH)
        _, at, back, count = np.unique(strings, return_index=True, return_inverse=True, return_counts=True)
        fresh_[:] = False
        fresh_[at] = True
        twice = np.flatnonzero(count[back] > 1)
        if len(twice):
            cut = np.flatnonzero(np.diff(twice) > LENGTH)
            start = twice[np.concatenate([[0], cut + 1])]
            end = twice[np.concatenate([cut, [len(twice) - 1]])] + LENGTH
    s = np.flatnonzero(fresh_)
    begins = np.flatnonzero(np.diff(chosen[s], prepend=-1))
    ends = np.append(begins[1:], len(s)) - 1
    at = chosen[s[begins]]
    return {"gram": hashes[at].view(np.int64), "at": at, "low": s[begins], "high": s[ends] + LENGTH, "start": start, "end": end}


def text_anchors(raw: bytes) -> dict[str, np.ndarray]:
    """Anchors of a whole text; a long one goes block by block, every string in one block."""
    flat = np.frombuffer(raw, np.uint8)
    found = []
    for begin in range(0, max(len(flat) - LENGTH + 1, 0), BLOCK):
        part = anchors(flat[begin : begin + BLOCK + LENGTH - 1])
        found.append({k: v if k == "gram" else v + begin for k, v in part.items()})
    return {k: np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in ("gram", "at", "low", "high", "start", "end")}


def anchor_lists(text: Column) -> Column:
    names = ("gram", "at", "low", "high", "start", "end")

    @F.arrow_udf("struct<" + ",".join(f"{n}:array<{'bigint' if n == 'gram' else 'int'}>" for n in names) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [text_anchors(t.as_py().encode()) for t in texts]
            columns = []
            for n in names:
                ends = np.cumsum([0, *(len(r[n]) for r in rows)])
                values = np.concatenate([np.zeros(0, np.int64), *(r[n] for r in rows)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int64 if n == "gram" else np.int32))))
            yield pa.StructArray.from_arrays(columns, list(names))

    return run(text)


def shared_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove, from contexts (gram, key, at, low, context) sorted by gram.

    Whole groups are gathered up to ``ROWS`` contexts, which bounds what a task holds.
    """

    def solve(t: pa.Table) -> pa.RecordBatch:
        at, low = (t[c].to_numpy().astype(np.int64) for c in ("at", "low"))
        context = t["context"].to_pylist()
        left = [c[: a - b][::-1] for c, a, b in zip(context, at, low)]
        right = [c[a - b :] for c, a, b in zip(context, at, low)]
        l, r = reaches(left, right, LENGTH)
        hit = r > 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (t["key"].to_numpy()[hit], (at - l)[hit], (at + r)[hit])], ["key", "start", "end"])

    held: pa.Table | None = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.num_rows >= ROWS:
            grams = held["gram"].to_numpy()
            whole_groups = int(np.searchsorted(grams, grams[-1]))
            if whole_groups:
                yield solve(held.slice(0, whole_groups))
                held = held.slice(whole_groups)
    if held is not None and held.num_rows:
        yield solve(held)


def by_string(contexts: DataFrame) -> DataFrame:
    """The same spans for grams with very many contexts: each string of each context is counted by its hash."""

    @F.arrow_udf("array<struct<string:bigint,start:int>>")
    def strings(low: pa.Array, context: pa.Array) -> pa.Array:
        out = []
        for a, c in zip(low.to_pylist(), context.to_pylist()):
            hashes = gram_hashes(np.frombuffer(c, np.uint8), LENGTH).view(np.int64)
            out.append([{"string": int(h), "start": a + i} for i, h in enumerate(hashes)])
        return pa.array(out, pa.list_(pa.struct([("string", pa.int64()), ("start", pa.int32())])))

    each = contexts.select("gram", "key", F.explode(strings("low", "context")).alias("s")).select("gram", "key", "s.*")
    twice = each.groupBy("gram", "string").count().filter("count > 1").select("gram", "string")
    return each.join(twice, ["gram", "string"], "left_semi").select("key", F.col("start").cast("bigint").alias("start"), (F.col("start") + LENGTH).cast("bigint").alias("end"))


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(gram, id, at, back, ahead, anchors): anchors whose gram is the anchor of several strings; of equal texts only one's."""
    per_text = rows.groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    copies = materialize(rows.select("print", "id").join(per_text, "print").filter("id <> first").select("id"))
    one = rows.select("id", "gram", "at", "low", "high").join(broadcast_small(copies, F.lit(8)), "id", "left_anti")
    flat = one.select("id", F.explode(F.arrays_zip("gram", "at", "low", "high")).alias("a"))
    # small numbers in place of hashes and absolute places: less to shuffle
    flat = flat.select("a.gram", "id", "a.at", (F.col("a.at") - F.col("a.low")).alias("back"), (F.col("a.high") - F.col("a.at")).alias("ahead"))
    counted = flat.groupBy("gram").agg(F.count("*").alias("anchors")).filter("anchors > 1")
    return flat.join(counted, "gram")


def remove(text: Column, spans: Column) -> Column:
    """struct of the bytes that stay, how many were removed, and in how many runs."""

    @F.arrow_udf("struct<kept:binary,n_removed:bigint,n_spans:bigint>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        kept, removed, runs = [], [], []
        for t, found in zip(texts, lists):
            raw = t.as_py().encode()
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in found.as_py() or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            at, parts = 0, []
            for a, b in merged:
                parts.append(raw[at:a])
                at = b
            parts.append(raw[at:])
            kept.append(b"".join(parts))
            removed.append(len(raw) - len(kept[-1]))
            runs.append(len(merged))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["kept", "n_removed", "n_spans"])

    return run(text, spans)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``kept`` (binary), ``n_removed`` and ``n_spans``, renamed if the input has such columns; they come last."""
    key, kept, removed, runs, both, other = fresh(docs.columns, "repeat_key", "kept", "n_removed", "n_spans", "repeat_out", "repeat_other")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    plain = keyed.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    listed = plain.select("key", F.unhex(F.md5("text")).alias("print"), F.octet_length("text").alias("n_bytes"), anchor_lists(F.col("text")).alias("a"))
    rows = materialize(listed.select(F.monotonically_increasing_id().alias("id"), "key", "print", "n_bytes", "a.*"))
    repeated = materialize(repeated_anchors(rows.filter(F.size("gram") > 0)))
    places = repeated.groupBy("id").agg(F.collect_list(F.struct("gram", "at", "back", "ahead", "anchors")).alias("places"))
    places = places.join(rows.select("id", "key"), "id").drop("id")
    # the texts are shuffled once: naming all columns here makes this join and the last one read the same exchange
    unused = F.hash(*[c for c in docs.columns if c != text]) if len(docs.columns) > 1 else F.lit(0)
    cut = keyed.join(places.withColumnRenamed("key", key), key).select(F.col(key).alias("key"), F.col(text).cast("binary").alias("raw"), F.explode("places").alias("p"), unused.alias(other))
    context = F.substring("raw", F.col("p.at") - F.col("p.back") + 1, F.col("p.back") + F.col("p.ahead"))
    contexts = cut.select("p.gram", "key", "p.at", (F.col("p.at") - F.col("p.back")).alias("low"), context.alias("context"), "p.anchors", other)
    sortable = contexts.filter(F.col("anchors") <= HOT).drop("anchors")
    spans = sortable.repartition("gram").sortWithinPartitions("gram").mapInArrow(shared_bytes, "key bigint, start bigint, end bigint")
    if not repeated.filter(F.col("anchors") > HOT).isEmpty():
        spans = spans.unionByName(by_string(contexts.filter(F.col("anchors") > HOT)))
    inside = rows.select("key", F.explode(F.arrays_zip("start", "end")).alias("s")).select("key", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"))
    copies = rows.groupBy("print").agg(F.count("*").alias("copies")).filter("copies > 1")
    all_of = rows.filter(F.col("n_bytes") >= LENGTH).join(copies, "print", "left_semi").select("key", F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").cast("bigint").alias("end"))
    merged = spans.unionByName(inside).unionByName(all_of).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    out = keyed.join(merged.select(F.col("key").alias(key), F.col("spans").alias(both)), key, "left")
    out = out.withColumn(both, remove(whole(F.col(text)), F.col(both)))
    return out.select(*docs.columns, F.col(f"{both}.kept").alias(kept), F.col(f"{both}.n_removed").alias(removed), F.col(f"{both}.n_spans").alias(runs))


@catalog.add("op7_repeated_strings")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    out = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.octet_length(whole()).cast("bigint").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
