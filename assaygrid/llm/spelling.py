"""Spelling variants by asymmetric chunks: words one edit apart, and the frequent form each rare one stands for.

Of two words one edit apart, the shorter (or, at equal length, either) contributes two disjoint chunks, its halves; the other contributes
positional grams as long as those chunks. One edit touches one half at most, so the other half is a gram of the longer word, at the chunk's
own place or one further. Grams at other places can meet no chunk, so only those within that shift are sent, and the shift is known
from the lengths: the first half stays at its place, the second moves by the difference of the lengths. Words meet on
(length of the chunk's word, which half, chunk) and are verified.

Where many words share a chunk, their pairs are not compared. What the chunk leaves over differs by one edit again, so both sides
are split once more and meet on the chunk and half of the rest, and so on until few words share all of it: every pair is
still met, no group is cut, and the comparisons of a group are at most ``CROWD`` for each of its words. When one character
is left the words differ in nothing else, so the group is as large as the alphabet at most.

Defined results: a null text has no words; a null id reads as an empty one; equal rows count each time; texts and words of any length are
read whole; ties of the form are decided by code points; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import whole
from assaygrid.operators.ranking import join_counted
from assaygrid.plans.bind import Catalog, table
from assaygrid.runtime import materialize

catalog = Catalog()
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 6  # of a word in code points
LEAST_COUNT = 5
RATIO = 5  # a form is at least so many times as frequent as its word
DAMAGE = 199  # occurrences whose checksum this divides lose a code point
CROWD = 64  # of the words that share a chunk, so many on one side are compared with all of the other


def occurrences(docs: DataFrame, least_length: int = LEAST_LENGTH, damage: int = DAMAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): one row for each run of letters that is long enough after the deletions."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(whole(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length("run") >= least_length).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (h % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    return runs.select(F.when(h % damage == 0, less).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least_length)


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words that occur often enough."""
    return occurrences(docs).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _part(lo: Column, hi: Column) -> Column:
    return F.substring("word", lo + 1, hi - lo)


def _split(rows: DataFrame, key: list[Column]) -> DataFrame:
    """Each row twice: keyed by one half of its stretch (lo, hi) while the other half remains.

    The stretch of a word that is ``longer`` by one than its chunks' word is cut where that word's is, or one further.
    """
    lo, hi, longer = F.col("lo"), F.col("hi"), F.col("longer")
    half = lo + F.floor((hi - lo - longer) / 2).cast("int")
    first = F.struct(F.xxhash64(*key, F.lit(0), _part(lo, half)).alias("key"), half.alias("lo"), hi.alias("hi"))
    second = F.struct(F.xxhash64(*key, F.lit(1), _part(half + longer, hi)).alias("key"), lo.alias("lo"), (half + longer).alias("hi"))
    return rows.select("word", "n", "longer", F.explode(F.array(first, second)).alias("x")).select("word", "n", "longer", "x.*")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, a_n, b, b_n): every pair of the words (word, n; all different) that differ by exactly one edit, once."""
    size = F.char_length("word")
    either = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"), F.lit(0).alias("lo"), size.alias("hi")).filter(size > F.col("longer"))
    # a word's grams among words of its own length are its chunks
    grams = materialize(_split(either, [size - F.col("longer")]))
    found = None
    while True:
        groups = grams.groupBy("key").agg(F.count("*").alias("grams"), F.count_if(F.col("longer") == 0).alias("chunks"), F.max(F.col("hi") - F.col("lo") - F.col("longer")).alias("rest"))
        crowded = materialize(groups.filter((F.least("chunks", "grams") > crowd) & (F.col("rest") > 1)).select("key"))
        none = crowded.isEmpty()
        few = grams if none else grams.join(crowded, "key", "left_anti")
        a = few.filter("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = few.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
        met = a.join(b, "key").filter((F.col("longer") == 1) | (F.col("a") < F.col("b"))).filter(F.levenshtein("a", "b", 1) == 1)
        met = met.select("a", "a_n", "b", "b_n")
        found = met if found is None else found.unionByName(met)
        if none:
            return found.distinct()
        found = materialize(found)
        grams = materialize(_split(grams.join(crowded, "key", "left_semi"), [F.col("key")]))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of the words (word, n; all different)."""
    words = materialize(words.select("word", "n"))
    pairs = near_pairs(words)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    near = pairs.select(F.explode(sides).alias("x")).select("x.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = -F.col("best.less") >= F.col("n") * ratio
    told = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")
    )
    told = materialize(told)
    roots = _roots(told.filter("form is not null").select("word", F.col("form").alias("to")))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, to): each word's last form. Counts grow along the forms, so there is no way round; steps double every round."""
    links = materialize(links)
    while True:
        ends = links.groupBy("to").agg(F.count("*").alias("served"))
        onward = ends.join(links.select(F.col("word").alias("to"), F.col("to").alias("further")), "to", "left")
        stepped = materialize(join_counted(links, materialize(onward), ["to"], "served"))
        if stepped.filter("further is not null").isEmpty():
            return links
        links = materialize(stepped.select("word", F.coalesce("further", "to").alias("to")))


SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda acc, i: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
hexed AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs),
summed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
    lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda acc, b: xor(acc >> 8, t[(1 + (xor(acc, b) & 255))::INT])), 4294967295::BIGINT) AS c FROM hexed, crc),
damaged AS (SELECT k, CASE WHEN c % {DAMAGE} = 0 THEN substr(run, 1, (c % length(run))::INT) || substr(run, (c % length(run))::INT + 2) ELSE run END AS word FROM summed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM damaged WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
near AS (SELECT DISTINCT word, n, near, near_n FROM pairs),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS best FROM near GROUP BY 1),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {RATIO} * n THEN best.near END AS form,
    CASE WHEN -best.less >= {RATIO} * n THEN -best.less END AS form_n FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS here, 0 AS d FROM told UNION ALL SELECT way.word, told.form, d + 1 FROM way JOIN told ON told.word = way.here WHERE told.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN (SELECT word, max_by(here, d) AS root FROM way GROUP BY 1) USING (word)
"""


@catalog.add("op13_spelling_variants", SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf, "documents").select("doc_id", "text")))
