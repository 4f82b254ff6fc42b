"""Quality rules: divergence of a document from language references, besides counts over words and lines.

The histograms of a document over character classes and over common words are compared with those of each
reference language by the Jensen-Shannon distance (base 2, 0 to 1). A document takes the language whose two
distances have the smallest sum, and fails if either of them is above its limit. A histogram with fewer than the
guard's number of entries says too little, so such a document is not judged by it. References are sums over all
documents of a language.

Defined results: a null text counts as empty: all counts 0, ``base_failed`` true, ``kept`` false; rows of a null or
unlisted language are judged but teach no reference; without any reference nothing is rejected by divergence;
repeated rows are judged alike; an empty table gives an empty result. Windows of words are compared by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm.common import WORD, whole, words
from assaygrid.plans.bind import Catalog, table
from assaygrid.runtime import materialize

catalog = Catalog()
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
# Frequent words of the reference languages.
COMMON = {
    "en": "the of and to in is that for with as on be it this at by not or are from".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als in".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur par au avec elle".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
}
VOCABULARY = list(dict.fromkeys(w for ws in COMMON.values() for w in ws))
OTHERS = r"\P{Ll}+"
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:?]", r"[!'\"()-]"]
REST = "*"  # the bin of all other words
GUARD = {"char": 100, "word": 30}
LIMIT = {"char": 0.3, "word": 0.5}


def repeat_words(df: DataFrame, w: str, out: str) -> DataFrame:
    """Add ``out``: how many of the words in array ``w`` lie in a window found twice or more.

    A window's hash is that of its words' hashes. Windows are sorted by hash; each that equals a neighbour is marked,
    and the marked places, in order, cover up to ``WINDOW`` words each. n log n in the length of the text. Steps are columns of their own, so that no
    lambda computes an array again.
    """
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    each = df.withColumn("_v", F.transform(w, lambda x: F.xxhash64(x)))
    hashes = each.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(*[F.get("_v", i + k) for k in range(WINDOW)])))
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = hashes.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed).otherwise(empty))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(none, F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))))
    after = F.concat(F.slice("_s", 2, F.size("_s")), none)
    near = F.arrays_zip(F.col("_s").alias("x"), before.alias("b"), after.alias("a"))
    same = lambda r, side: F.coalesce(r["x"]["h"] == r[side]["h"], F.lit(False))
    marked = F.sort_array(F.transform(F.filter(near, lambda r: r["x"].isNotNull() & (same(r, "b") | same(r, "a"))), lambda r: r["x"]["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(marked, start, lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(acc["end"] - i, F.lit(0))).alias("n")), lambda acc: acc["n"])
    return ordered.withColumn(out, covered).drop("_v", "_h", "_s")


def counts(docs: DataFrame) -> DataFrame:
    """The base counts of each document, and its two histograms, each with the rest last.

    ``_char`` holds a number per class, ``_word`` (bin, n) of the common words that occur.
    """
    docs = docs.withColumn("_t", whole()).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    runs = F.array_remove(F.split(F.lower("_t"), r"\P{L}+"), "")
    docs = repeat_words(docs, "_w", "n_repeat_words").withColumns({"_lines": lines, "_runs": runs})
    docs = docs.withColumn("_common", F.filter("_runs", lambda x: x.isin(VOCABULARY)))
    # most characters are small letters: what is left without the others is counted, not cut into matches
    small = F.char_length(F.regexp_replace("_t", OTHERS, ""))
    per_class = [small, *[F.regexp_count("_t", F.lit(c)) for c in CLASSES[1:]]]
    removed = lambda w: F.size("_common") - F.size(F.array_remove("_common", w))
    found = F.transform(F.array_distinct("_common"), lambda w: F.struct(w.alias("bin"), removed(w).alias("n")))
    rare = F.struct(F.lit(REST).alias("bin"), (F.size("_runs") - F.size("_common")).alias("n"))
    docs = docs.withColumns(
        {
            "n_words": F.size("_w").cast("bigint"),
            "word_chars": F.char_length(F.array_join("_w", "")).cast("bigint"),
            "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_classes": F.array(*per_class),
        }
    )
    rest = F.col("word_chars").cast("int") - F.aggregate("_classes", F.lit(0), lambda a, x: a + x)
    return docs.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.concat("_classes", F.array(rest)).alias("_char"), F.concat(found, F.array(rare)).alias("_word"),
        F.col("word_chars").alias("_char_total"), F.size("_runs").alias("_word_total"),
    )


def references(counted: DataFrame) -> dict[str, dict[str, list[float]]]:
    """Shares per language and histogram over all documents: as many numbers as listed languages and bins."""
    known = counted.filter(F.col("lang").isin(list(COMMON)))
    bins = {"char": (F.posexplode("_char").alias("bin", "n"), range(len(CLASSES) + 1)), "word": (F.inline("_word").alias("bin", "n"), [*VOCABULARY, REST])}
    out: dict[str, dict[str, list[float]]] = {}
    for kind, (entries, names) in bins.items():
        summed: dict[str, dict] = {}
        for lang, name, n in known.select("lang", entries).groupBy("lang", "bin").agg(F.sum("n")).collect():
            summed.setdefault(lang, {})[name] = n
        for lang, n in summed.items():
            total = sum(n.values())
            if total:
                out.setdefault(lang, {})[kind] = [n.get(name, 0) / total for name in names]
    return {lang: found for lang, found in sorted(out.items()) if len(found) == 2}


def half(s: Column, m: Column) -> Column:
    """A share's part of the divergence from the middle ``m`` of two shares."""
    return F.when(s > 0, s * F.log2(s / m)).otherwise(0.0)


def distance(histogram: str, entries: Column | str, start: float, share: Callable[[Column], Column], guard: int) -> Column:
    """Jensen-Shannon distance of a histogram, whose total is a column, from shares; 0 below the guard.

    A bin that the text lacks adds half of its share. ``start`` is that sum over all bins, so that only the bins in ``entries``
    need be visited: each adds what it differs by.
    """
    total = F.col(f"{histogram}_total")

    def term(acc: Column, x: Column) -> Column:
        p, q = x["n"] / total, share(x)
        m = (p + q) / 2
        return acc + (half(p, m) + half(q, m) - q) / 2

    # the total is a column, since a lambda computes what it refers to for every element
    return F.when(total >= guard, F.sqrt(F.greatest(F.aggregate(entries, F.lit(start), term), F.lit(0.0)))).otherwise(0.0)


def judge(counted: DataFrame, refs: dict[str, dict[str, list[float]]]) -> DataFrame:
    """Add the closest language, its distances, ``base_failed`` and ``kept``."""
    langs = list(refs)
    table_of = {b: [refs[lang]["word"][i] for lang in langs] for i, b in enumerate([*VOCABULARY, REST])}
    shares = F.map_from_arrays(F.array(*map(F.lit, table_of)), F.array(*[F.array(*map(F.lit, q)) for q in table_of.values()]))
    known = F.transform("_word", lambda x: F.struct(x["n"].alias("n"), F.element_at(shares, x["bin"]).alias("q")))

    def distances(i: int, lang: str) -> Column:
        q = refs[lang]
        pairs = F.arrays_zip(F.col("_char").alias("n"), F.array(*map(F.lit, q["char"])).alias("q"))
        char = distance("_char", pairs, sum(q["char"]) / 2, lambda x: x["q"], GUARD["char"])
        word = distance("_word", "_known", sum(q["word"]) / 2, lambda x: x["q"][i], GUARD["word"])
        return F.struct(char.alias("char"), word.alias("word"), F.lit(lang).alias("lang"))

    none = F.struct(F.lit(0.0).alias("char"), F.lit(0.0).alias("word"), F.lit(None).cast("string").alias("lang"))
    each = F.array(*[distances(i, lang) for i, lang in enumerate(langs)]) if langs else F.array(none)
    scored = (counted.withColumn("_known", known) if langs else counted).withColumn("_each", each)
    ranked = F.array_min(F.transform("_each", lambda x: F.struct(F.round(x["char"] + x["word"], 9).alias("sum"), x["lang"].alias("lang"), x["char"].alias("char"), x["word"].alias("word"))))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    near = (F.col("_best.char") <= LIMIT["char"]) & (F.col("_best.word") <= LIMIT["word"])
    return scored.withColumn("_best", ranked).withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, verdicts, the closest language and the distances from it.

    The counts are stored, so that texts are read once for the references and the verdicts.
    """
    counted = materialize(counts(docs.select("doc_id", "text", "lang")))
    return judge(counted, references(counted)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("_best.lang").alias("closest"), F.round("_best.char", 6).alias("char_distance"), F.round("_best.word", 6).alias("word_distance"),
    )


def _sql() -> str:
    vocabulary = ", ".join(f"'{w}'" for w in VOCABULARY)
    quote = lambda c: c.replace("'", "''")
    classes = " UNION ALL ".join(f"SELECT d, lang, {i} AS bin, len(regexp_extract_all(t, '{quote(c)}')) AS n FROM docs" for i, c in enumerate(CLASSES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT d, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: struct_pack(i := i, v := w[i:i + {WINDOW - 1}]))) AS x FROM docs WHERE len(w) >= {WINDOW}),
marked AS (SELECT d, x.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY d, x.v) > 1),
repeated AS (SELECT d, count(DISTINCT p) AS n FROM (SELECT d, unnest(range(i, i + {WINDOW})) AS p FROM marked) GROUP BY d),
line AS (SELECT d, unnest(string_split(t, chr(10))) AS l FROM docs),
dups AS (SELECT d, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY d),
base AS (
  SELECT d, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN dups USING (d) LEFT JOIN repeated USING (d)
),
by_class AS ({classes}),
chars AS (SELECT * FROM by_class UNION ALL SELECT d, any_value(lang), {len(CLASSES)}, any_value(word_chars) - sum(n) FROM by_class JOIN (SELECT d, word_chars FROM base) USING (d) GROUP BY d),
run AS (SELECT d, lang, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) AS r FROM docs),
run_n AS (SELECT d, any_value(lang) AS lang, CASE WHEN r IN ({vocabulary}) THEN r ELSE '*' END AS bin, count(*) AS n FROM run GROUP BY d, CASE WHEN r IN ({vocabulary}) THEN r ELSE '*' END),
ids AS (SELECT unnest([{vocabulary}, '*']) AS bin),
bins AS (SELECT 'char' AS kind, d, lang, bin::VARCHAR AS bin, n FROM chars
  UNION ALL SELECT 'word', docs.d, docs.lang, ids.bin, coalesce(run_n.n, 0) FROM docs CROSS JOIN ids LEFT JOIN run_n ON docs.d = run_n.d AND ids.bin = run_n.bin),
ref_n AS (SELECT kind, lang, bin, sum(n) AS n FROM bins WHERE lang IN ('{"', '".join(COMMON)}') GROUP BY ALL),
ref AS (SELECT kind, lang, bin, n / sum(n) OVER (PARTITION BY kind, lang) AS q FROM ref_n QUALIFY sum(n) OVER (PARTITION BY kind, lang) > 0),
share AS (SELECT kind, d, bin, sum(n) OVER (PARTITION BY kind, d) AS total, n / nullif(sum(n) OVER (PARTITION BY kind, d), 0) AS p FROM bins),
js AS (
  SELECT kind, d, ref.lang, any_value(total) AS total, sum(((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2) AS x
  FROM share JOIN ref USING (kind, bin) GROUP BY kind, d, ref.lang
),
dist AS (SELECT kind, d, lang, CASE WHEN total >= CASE kind WHEN 'char' THEN {GUARD["char"]} ELSE {GUARD["word"]} END THEN sqrt(greatest(x, 0)) ELSE 0 END AS x FROM js),
pair AS (SELECT a.d, a.lang, a.x AS c, b.x AS w FROM dist a JOIN dist b USING (d, lang) WHERE a.kind = 'char' AND b.kind = 'word'),
best AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY d ORDER BY round(c + w, 9), lang) = 1),
verdict AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND c <= {LIMIT["char"]} AND w <= {LIMIT["word"]} AS kept,
  best.lang AS closest, round(c, 6) + 0 AS char_distance, round(w, 6) + 0 AS word_distance
FROM verdict JOIN best USING (d)
"""


@catalog.add("op4_quality_rules", _sql())
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"))
