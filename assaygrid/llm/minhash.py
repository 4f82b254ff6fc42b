"""Near-duplicates: SuperMinHash signatures, banding, exact verification, union of the links.

Equal shingle sets form a class, and one document stands for it. A class has a SuperMinHash signature: every
shingle takes the registers in a random order of its own, one per level, and leaves level + fraction there; a
register keeps the least. A level can only fill registers that all levels before left empty, so a text is done
when none is empty. ``BANDS`` bands of ``ROWS`` registers give buckets; a pair of similarity 0.8 shares none
with probability (1 - 0.8^6)^48 = 5e-7.

Links are confirmed on full sets. Members of a bucket already in one component need no comparison, so each is first
compared with the first member of its buckets. Where a bucket then still holds several components, sets that can be similar at
all meet in the lists of their rarest shingles: two sets of similarity 0.8 share one of the first few, and few
shingles of a set that differs from all others are shared at all. In rounds, one member of every component in a list is
compared with one of a component drawn there, which merges a group of near copies by as many comparisons as its lists have
entries; when rounds merge little more, the pairs between what is still apart are compared, none twice. No cap and no pair lost.
Components are found by passing on the least label, which stands for the union-find of one machine.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; with fewer words
than a shingle the whole sequence is the one shingle; equal rows are in one class; a null id never is a
component's id unless all ids in it are null; texts of any length are read whole; an empty table gives an empty
result; other columns pass through untouched. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import broadcast_small, fresh, row_key, whole
from assaygrid.llm.shingles import STEP, U, mixed, shingle_sets
from assaygrid.operators.cluster import merge_labels
from assaygrid.operators.ranking import join_counted
from assaygrid.plans.bind import Catalog, table
from assaygrid.runtime import materialize

catalog = Catalog()
BANDS, ROWS = 48, 6
SHARE = 80  # per cent of the union that the intersection must reach
PARITY = 512  # bits that bound from below how many shingles only one of two sets holds
CHUNK = 20_000  # shingles whose orders of registers are held at once
LEVEL = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * STEP


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures, one row of ``m`` registers per set; an empty set's registers stay at the largest value."""
    empty = U(2**64 - 1)
    out = np.full((len(sets), m), empty, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sets):
        end = max(at + 1, int(np.searchsorted(first, first[at] + CHUNK, "right")) - 1)
        if sizes[at:end].sum():
            _fill(np.concatenate(sets[at:end]), np.repeat(np.arange(at, end), sizes[at:end]), out, flat, m)
        at = end
    return out


def _fill(elements: np.ndarray, owner: np.ndarray, out: np.ndarray, flat: np.ndarray, m: int) -> None:
    order = None
    for level in range(m):
        draw = mixed(elements + LEVEL[level])
        swap = (((draw & U(0xFFFFFFFF)) * U(m - level)) >> U(32)).astype(np.int64) + level
        if order is None:
            register = swap
        else:
            row = np.arange(len(elements))
            register = order[row, swap].astype(np.int64)
            order[row, swap] = order[row, level]
        np.minimum.at(flat, owner * m + register, (U(level) << U(32)) | (draw >> U(32)))
        unfinished = (out[owner] == U(2**64 - 1)).any(1) if len(owner) < 64 else _open(out, owner)
        if not unfinished.any():
            return
        if order is None:
            elements, owner, swap = elements[unfinished], owner[unfinished], swap[unfinished]
            order = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
            order[np.arange(len(elements)), swap] = 0
        elif not unfinished.all():
            elements, owner, order = elements[unfinished], owner[unfinished], order[unfinished]


def _open(out: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per element: whether its set still has an empty register."""
    low, high = owner[0], owner[-1] + 1
    return (out[low:high] == U(2**64 - 1)).any(1)[owner - low]


def bands(signatures: np.ndarray) -> np.ndarray:
    """One hash per band, the band's number included."""
    n = len(signatures)
    run = np.broadcast_to(mixed((np.arange(BANDS, dtype=np.uint64) + U(1)) * STEP), (n, BANDS)).copy()
    parts = signatures.reshape(n, BANDS, ROWS)
    for j in range(ROWS):
        run = mixed((run ^ parts[:, :, j]) + STEP)
    return run.view(np.int64)


def _chunks(texts: pa.Array, limit: int = 2_000_000) -> Iterator[list[bytes]]:
    chunk, held = [], 0
    for t in texts:
        chunk.append(t.as_py().encode())
        held += len(chunk[-1])
        if held > limit:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def prints(text: Column, width: int) -> Column:
    """struct of the set's 128-bit print, its size and its bands."""

    @F.arrow_udf("struct<print:binary,n:int,bands:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            digests, sizes, buckets = [], [], [np.zeros((0, BANDS), np.int64)]
            for chunk in _chunks(texts):
                sets = shingle_sets(chunk, width)
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sizes += [len(s) for s in sets]
                buckets.append(bands(superminhash(sets, BANDS * ROWS)))
            values = np.concatenate(buckets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * BANDS, pa.int32()), pa.array(values.reshape(-1)))
            yield pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists], ["print", "n", "bands"])

    return run(text)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``PARITY`` bits per set, in 64-bit words: whether an odd number of its shingles fall on the bit.

    Two rows differ in the parities of what only one of the sets holds, so in at most as many bits as there are such shingles.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (mixed(np.concatenate([np.zeros(0, np.uint64), *sets]) + STEP) % U(PARITY)).astype(np.int64)
    odd = np.zeros((len(sets), PARITY), np.uint8)
    np.bitwise_xor.at(odd.reshape(-1), owner * PARITY + at, 1)
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def full_sets(text: Column, width: int) -> Column:
    """struct of the distinct shingles and their parities."""

    @F.arrow_udf("struct<shingles:array<bigint>,odd:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets, odd = [], [np.zeros((0, PARITY // 64), np.int64)]
            for chunk in _chunks(texts):
                found = shingle_sets(chunk, width)
                sets += found
                odd += [parities(found[at : at + 1000]) for at in range(0, len(found), 1000)]
            ends = np.cumsum([0, *map(len, sets)])
            values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            bits = np.concatenate(odd)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))]
            lists += [pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * bits.shape[1], pa.int32()), pa.array(bits.reshape(-1)))]
            yield pa.StructArray.from_arrays(lists, ["shingles", "odd"])

    return run(text)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (lo, hi), those whose full sets are similar enough."""
    side = lambda c, s: sets.select(F.col("id").alias(c), F.col("shingles").alias(s))
    both = pairs.join(side("hi", "b"), "hi").join(side("lo", "a"), "lo")
    sizes = F.least(F.size("a"), F.size("b")) * 100 >= F.greatest(F.size("a"), F.size("b")) * SHARE
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(sizes).withColumn("common", common).filter((F.size("a") + F.size("b") - F.col("common")) * SHARE <= F.col("common") * 100).select("lo", "hi")


def apart(buckets: DataFrame, state: DataFrame) -> DataFrame:
    """(id, label, minor): members of buckets that hold several components; ``minor`` outside a bucket's largest."""
    labelled = buckets.join(state.withColumnRenamed("item_id", "id"), "id")
    parts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("bucket").agg(F.max_by("label", "n").alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    members = labelled.join(main, "bucket").select("id", "label", (F.col("label") != F.col("main")).alias("minor"))
    return members.groupBy("id").agg(F.first("label").alias("label"), F.max("minor").alias("minor"))


def prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, n, at, shingle): of each member's n shingles in order from rare to frequent, those one of which a similar set must share.

    Two sets of n and m shingles must share o = SHARE (n + m) / (100 + SHARE) of them, hence one among the first n - o + 1 of the
    one and m - o + 1 of the other.
    """
    shingled = sets.join(members.select("id"), "id").select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    seen = shingled.groupBy("shingle").agg(F.count("*").alias("seen"))
    ranked = shingled.join(seen, "shingle").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "shingle"))).alias("s"))
    short = F.slice("s", 1, F.expr(f"n - ({SHARE} * n + 99) div 100 + 1").cast("int"))
    return materialize(ranked.select("id", "n", F.posexplode(short).alias("at", "x")).select("id", "n", "at", "x.shingle"))


def possible(members: DataFrame, firsts: DataFrame, sets: DataFrame) -> DataFrame:
    """(lo, hi): the pairs between components that can reach the similarity, one member minor.

    They share a shingle of their prefixes, and their parities differ in no more bits than the sets may in shingles; so most of
    the pairs of a group that is alike, but below the limit, end inside the join.
    """
    odd = [F.col("odd")[i].alias(f"odd{i}") for i in range(PARITY // 64)]
    listed = firsts.join(members.join(sets.select("id", *odd), "id"), "id")
    a, b = listed.filter("minor").alias("a"), listed.alias("b")
    shared = F.expr(f"({SHARE} * (a.n + b.n) + {99 + SHARE}) div {100 + SHARE}")
    fits = (F.col("a.at") <= F.col("a.n") - shared) & (F.col("b.at") <= F.col("b.n") - shared)
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * SHARE
    differ = sum(F.bit_count(F.col(f"a.odd{i}").bitwiseXOR(F.col(f"b.odd{i}"))) for i in range(PARITY // 64))
    near = differ <= F.col("a.n") + F.col("b.n") - 2 * shared
    met = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.label") != F.col("b.label")) & sizes & fits & near)
    return met.select(F.least("a.id", "b.id").alias("lo"), F.greatest("a.id", "b.id").alias("hi")).distinct()


def met_in_rounds(firsts: DataFrame, sets: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after comparing, round by round, one member of each component in a shingle's list with one of a component drawn there.

    A round's pairs are at most as many as the entries of the lists. Rounds end when one merges less than a tenth of the components
    that it saw. With the state come the pairs (lo, hi) that were compared.
    """
    compared, number = None, 0
    while True:
        at = firsts.select("id", "shingle").join(state.withColumnRenamed("item_id", "id"), "id")
        one = at.groupBy("shingle", "label").agg(F.min_by("id", F.xxhash64("id", F.lit(number))).alias("id"))
        drawn = one.groupBy("shingle").agg(F.min_by(F.struct("id", "label"), F.xxhash64("label", F.lit(number))).alias("d"), F.count("*").alias("parts"))
        met = one.join(drawn.filter("parts > 1"), "shingle").filter(F.col("label") != F.col("d.label"))
        pairs = met.select(F.least("id", "d.id").alias("lo"), F.greatest("id", "d.id").alias("hi"), "label").dropDuplicates(["lo", "hi"])
        pairs = materialize(pairs if compared is None else pairs.join(compared, ["lo", "hi"], "left_anti"))
        links = materialize(confirmed(pairs.select("lo", "hi"), sets))
        before = pairs.agg(F.count_distinct("label")).first()[0]
        compared = pairs.select("lo", "hi") if compared is None else compared.unionByName(pairs.select("lo", "hi"))
        if links.isEmpty():
            return state, compared
        merged = merge_labels(state, links)
        changed = state.join(merged.withColumnRenamed("label", "new"), "item_id").filter("label <> new").agg(F.count_distinct("label")).first()[0]
        state, number = merged, number + 1
        if changed * 10 < before:
            return state, compared


def linked(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """(item_id, label): components of the members of ``buckets`` (bucket, id, lo = its least id)."""
    state = materialize(buckets.select(F.col("id").alias("item_id")).distinct().withColumn("label", F.col("item_id")))
    first = buckets.filter("lo < id").groupBy(F.col("id").alias("hi")).agg(F.min("lo").alias("lo"))
    state = merge_labels(state, materialize(confirmed(first.select("lo", "hi"), sets)))
    label = lambda c: state.select(F.col("item_id").alias(c), F.col("label").alias(f"{c}_label"))
    others = buckets.filter("lo < id").select("lo", F.col("id").alias("hi")).distinct().join(label("lo"), "lo").join(label("hi"), "hi")
    others = others.filter("lo_label <> hi_label").select("lo", "hi").join(first, ["lo", "hi"], "left_anti")
    state = merge_labels(state, materialize(confirmed(others, sets)))
    members = materialize(apart(buckets, state))
    if members.isEmpty():
        return state
    firsts = prefixes(members, sets)
    state, compared = met_in_rounds(firsts, sets, state)
    pairs = materialize(possible(materialize(apart(buckets, state)), firsts, sets).join(compared, ["lo", "hi"], "left_anti"))
    return merge_labels(state, materialize(confirmed(pairs, sets)))


def components(docs: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Per row (``key``, doc_id, n, print), and per print (``component_id``, ``stays``: the key of the row that stays)."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), whole(F.col(text)).alias("text"))
    rows = materialize(plain.withColumn("p", prints(F.col("text"), width)).select("doc_id", "key", "p.*"))
    known = rows.filter("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    per_print = known.groupBy("print").agg(F.min("doc_id").alias("least"), F.min(order).alias("stays"), F.count("*").alias("members"), F.first("bands").alias("bands"))
    classes = materialize(per_print.withColumn("id", F.monotonically_increasing_id()))
    exploded = classes.select("id", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("bucket", "lo")
    buckets = materialize(exploded.join(shared, "bucket"))
    wanted = classes.join(buckets.select("id").distinct(), "id").select("id", F.col("stays.key").alias("key"))
    # a key may be shared by equal rows, whose sets are the same; one of them is enough
    texts = plain.select("key", "text").join(broadcast_small(wanted, F.lit(24)), "key")
    known_sets = texts.select("id", full_sets(F.col("text"), width).alias("s")).groupBy("id").agg(F.first("s").alias("s"))
    sets = materialize(known_sets.select("id", "s.shingles", "s.odd"))
    state = linked(buckets, sets)
    labelled = classes.drop("bands").join(state.withColumnRenamed("item_id", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled = materialize(labelled)
    whole_ = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.min("stays").alias("stays"), F.count("*").alias("classes"))
    per_class = join_counted(labelled.select("print", "members", "label"), whole_, ["label"], "classes")
    return rows.drop("bands"), materialize(per_class.select("print", "members", "component_id", F.col("stays.key").alias("stays")))


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links), kept (its own id is the component's).

    One row per row of ``docs``. Where all ids of a component are null, ``component_id`` is null and all are kept.
    """
    rows, groups = components(docs, width)
    own = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    others = join_counted(rows.filter("n > 0"), groups, ["print"], "members").select("doc_id", "n", "component_id")
    return others.unionByName(own).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component: of the least id, and one of equal rows. Texts without words all stay."""
    key, copy = fresh(docs.columns, "dedup_key", "dedup_copy")
    rows, groups = components(docs, width)
    stays = groups.select(F.col("stays").alias(key)).distinct().unionByName(rows.filter("n = 0").select(F.col("key").alias(key)).distinct())
    repeated = rows.filter("n > 0").groupBy(F.col("key").alias(key)).count().filter("count > 1").select(key)
    left = docs.withColumn(key, row_key("doc_id", "text")).join(broadcast_small(stays, F.lit(24)), key, "left_semi")
    more = broadcast_small(materialize(repeated), F.lit(24))
    once = left.join(more, key, "left_anti")
    return once.unionByName(left.join(more, key, "left_semi").dropDuplicates([key])).drop(key, copy)


@catalog.add("op9_minhash_near_duplicates")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), width=4)
