"""Preranked gene-set enrichment, over-representation and term tables.

Gene sets are a long frame ``set_name, symbol``; a ranked list is ``symbol, score``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions import special
from assaygrid.model import Assay
from assaygrid.operators import diff, multitest
from assaygrid.operators.meta import strip_species, symbol_index
from assaygrid.operators.pairs import pair_sums
from assaygrid.operators.ranking import ordered, row_numbers
from assaygrid.runtime import materialize

MIN_GENES = 50
P_FLOOR = 1e-300


# ---- ranked lists ------------------------------------------------------------


def neg_log10(c: Column) -> Column:
    """-log10 p, 0 outside (0, 1]."""
    return F.when((c > 0) & (c <= 1), -F.log10(F.greatest(c, F.lit(P_FLOOR)))).otherwise(0.0)


def _signed(p: Column, fc: Column) -> Column:
    size = -F.log10(F.greatest(p, F.lit(P_FLOOR)))
    return F.when((p > 0) & fc.isNotNull(), F.when(fc < 0, -size).otherwise(size))


def rank_from_diff(tests: DataFrame, metric: str = "log2fc", symbol: str = "symbol") -> DataFrame:
    """Scores from two-group results (``log2fc``, ``t``, ``signed_p``, ``signed_fdr``) or ``anova`` (unsigned)."""
    score = {
        "log2fc": lambda: F.col("log2fc"),
        "t": lambda: F.col("t"),
        "signed_p": lambda: _signed(F.col("p"), F.col("log2fc")),
        "signed_fdr": lambda: _signed(F.col("p_adj"), F.col("log2fc")),
        "anova": lambda: F.when(F.col("p") > 0, -F.log10(F.greatest("p", F.lit(P_FLOOR)))),
    }[metric]()
    return tests.select(F.col(symbol).alias("symbol"), score.alias("score")).filter("score IS NOT NULL")


def rank_from_hybrid(result: DataFrame, metric: str = "log2fc") -> DataFrame:
    """Scores from the combined test: ``statistic``, ``log2fc``, ``signed_p`` (smaller p) or ``signed_fdr``."""
    low = F.least(F.col("p_bin"), F.coalesce("p_int", F.lit(1.0)))
    score = {
        "statistic": F.col("statistic"),
        "log2fc": F.col("log2fc"),
        "signed_p": _signed(low, F.col("log2fc")),
        "signed_fdr": _signed(F.col("fdr"), F.col("log2fc")),
    }[metric]
    symbol = F.trim(F.element_at(F.split(F.col("group_id").cast("string"), r"[\t;|]"), 1))
    return result.select(symbol.alias("symbol"), score.alias("score")).filter("score IS NOT NULL AND symbol <> ''")


def rank_from_matrix(assay: Assay, col: str, a: str, b: str, metric: str = "log2fc") -> DataFrame:
    """Scores per feature of B against A: ``log2fc``, Welch ``t``, pooled ``z`` or ``s2n``; two values per group."""
    m = diff.group_moments(assay, col, a, b, log2=True, zero_missing=True, min_valid=2)
    d = F.col("mean_b") - F.col("mean_a")
    va, vb = F.coalesce("var_a", F.lit(0.0)), F.coalesce("var_b", F.lit(0.0))
    na, nb = F.col("n_a"), F.col("n_b")
    welch = F.sqrt(va / na + vb / nb)
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    spread = F.sqrt(va) + F.sqrt(vb)
    score = {
        "log2fc": d, "t": F.when(welch > 0, d / welch), "z": F.when(pooled > 0, d / pooled), "s2n": F.when(spread > 0, d / spread),
    }[metric]
    return m.select("feature_id", score.alias("score")).filter("score IS NOT NULL")


def collapse(ranked: DataFrame, min_genes: int = MIN_GENES) -> DataFrame:
    """One score per upper-case symbol: the largest in absolute value, the positive one on ties."""
    sym = F.upper(F.trim("symbol"))
    kept = ranked.select(sym.alias("symbol"), "score").filter((F.col("symbol") != "") & F.col("score").isNotNull() & ~F.isnan("score"))
    out = kept.groupBy("symbol").agg(F.max_by("score", F.struct(F.abs("score"), "score")).alias("score"))
    if min_genes and out.limit(min_genes).count() < min_genes:
        raise ValueError(f"fewer than {min_genes} scored genes")
    return out


def positions(ranked: DataFrame) -> DataFrame:
    """``symbol, score, pos``: descending by score, ties by symbol; pos from 0. A stored table."""
    return row_numbers(ranked, [("score", False), ("symbol", True)], out="pos").withColumn("pos", F.col("pos") - 1)


# ---- running-sum statistic -----------------------------------------------------


def walk(hits: DataFrame, groups: Sequence[str], n: Column) -> DataFrame:
    """Weighted running sum over a list of ``n`` positions, from its hits ``(groups, pos, w)`` alone.

    The sum peaks right after a hit and bottoms right before one, so only hits are visited. Per group:
    ``size, es, peak, high, low``; a group has at most the size limit of hits.
    """
    w = Window.partitionBy(*groups).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    run = (
        hits.withColumn("_h", F.row_number().over(Window.partitionBy(*groups).orderBy("pos")))
        .withColumn("_cum", F.sum("w").over(w))
        .withColumn("_nr", F.sum("w").over(whole))
        .withColumn("_nh", F.count("*").over(whole))
        .withColumn("_n", n)
    )
    misses = (F.col("pos") - (F.col("_h") - 1)) / (F.col("_n") - F.col("_nh"))
    run = run.withColumn("_after", F.col("_cum") / F.col("_nr") - misses)
    run = run.withColumn("_before", (F.col("_cum") - F.col("w")) / F.col("_nr") - misses)
    out = run.filter(F.col("_nr") > 0).groupBy(*groups).agg(
        F.max("_nh").alias("size"),
        F.greatest(F.max("_after"), F.lit(0.0)).alias("high"),
        F.least(F.min("_before"), F.lit(0.0)).alias("low"),
        F.max_by("pos", F.struct("_after", -F.col("pos"))).alias("_top"),
        F.min_by(F.col("pos") - 1, F.struct("_before", "pos")).alias("_bottom"),
    )
    up = F.col("high") >= -F.col("low")
    return out.select(
        *groups, "size", F.when(up, F.col("high")).otherwise(F.col("low")).alias("es"),
        F.when(up, F.col("_top")).otherwise(F.col("_bottom")).alias("peak"), "high", "low",
    )


def set_hits(sets: DataFrame, placed: DataFrame, weight: float = 1.0) -> DataFrame:
    """Set members found in the list: ``set_name, symbol, pos, w``."""
    members = sets.select("set_name", F.upper(F.trim("symbol")).alias("symbol")).distinct()
    w = F.pow(F.abs("score"), F.lit(float(weight)))
    return members.join(placed, "symbol").select("set_name", "symbol", "pos", w.alias("w"))


def set_report(sets: DataFrame, hits: DataFrame, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """Size of every set within the list and why it is left out, if it is."""
    sizes = hits.groupBy("set_name").agg(F.count("*").alias("size"), F.sum("w").alias("weight"))
    every = sets.select("set_name").distinct().join(sizes, "set_name", "left").fillna(0, ["size"])
    text = F.col("size").cast("string")
    reason = (
        F.when(F.col("size") < min_size, F.concat(F.lit("size "), text, F.lit(f" < min {min_size}")))
        .when(F.col("size") > max_size, F.concat(F.lit("size "), text, F.lit(f" > max {max_size}")))
        .when(F.col("weight") <= 0, F.lit("zero weight"))
    )
    return every.select("set_name", "size", reason.alias("reason"))


def sized_hits(sets: DataFrame, placed: DataFrame, weight: float = 1.0, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """Hits of the sets inside the size limits."""
    hits = set_hits(sets, placed, weight)
    good = hits.groupBy("set_name").agg(F.count("*").alias("_s")).filter(F.col("_s").between(min_size, max_size))
    return hits.join(good.select("set_name"), "set_name", "left_semi")


def gsea_es(hits: DataFrame, placed: DataFrame) -> DataFrame:
    """Enrichment score and peak of every set."""
    return walk(hits, ["set_name"], placed.agg(F.count("*")).scalar())


def leading_edge(hits: DataFrame, es: DataFrame) -> DataFrame:
    """Members up to the peak (positive sets) or from it on (negative sets): ``set_name, symbol, pos``."""
    joined = hits.join(es.select("set_name", "es", "peak"), "set_name")
    keep = F.when(F.col("es") >= 0, F.col("pos") <= F.col("peak")).otherwise(F.col("pos") >= F.col("peak"))
    return joined.filter(keep).select("set_name", "symbol", "pos")


def gsea_curve(hits: DataFrame, es: DataFrame, placed: DataFrame, name: str, points: int = 400) -> DataFrame:
    """Running sum of one set at about ``points`` positions, its peak and the end included: ``pos, value``."""
    one = hits.filter(F.col("set_name") == name)
    n = placed.agg(F.count("*")).scalar()
    own = one.agg(F.sort_array(F.collect_list(F.struct("pos", "w")))).scalar()  # a size-limited set
    total = one.agg(F.sum("w")).scalar()
    base = es.filter(F.col("set_name") == name).select("peak", "size").withColumn("n", n).withColumn("h", own).withColumn("nr", total)
    step = F.ceil(F.col("n") / points)
    at = F.array_sort(F.array_distinct(F.concat(
        F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, step), F.array(F.col("peak").cast("bigint"), F.col("n") - 1)
    )))
    spots = base.withColumn("pos", F.explode(at))
    seen = F.filter("h", lambda h: h["pos"] <= F.col("pos"))
    gained = F.aggregate(seen, F.lit(0.0), lambda acc, h: acc + h["w"]) / F.col("nr")
    lost = (F.col("pos") + 1 - F.size(seen)) / (F.col("n") - F.col("size"))
    return spots.select("pos", (gained - lost).alias("value"))


# ---- permutation null ------------------------------------------------------------


def _draw(seed: int, size: int, perm: int, n: int) -> np.ndarray:
    rng = np.random.default_rng([seed, size, perm])
    return np.sort(rng.choice(n, size=size, replace=False, shuffle=False))


def gsea_null(es: DataFrame, placed: DataFrame, n_perm: int = 1000, weight: float = 1.0, seed: int = 42, chunk: int = 50) -> DataFrame:
    """Scores of random sets, one null per distinct set size: ``size, perm, es``.

    Work is split by (size, run of permutations); every draw is seeded by its size and number. The drawn
    positions are joined to the list, whatever its length.
    """
    if n_perm < 1:
        raise ValueError("n_perm must be at least 1")
    n = placed.count()
    starts = F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1), F.lit(chunk))).alias("start")
    work = es.select("size").distinct().select(F.col("size").cast("int").alias("size"), starts).repartition("size", "start")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, start in zip(pdf["size"], pdf["start"]):
                for perm in range(start, min(start + chunk, n_perm)):
                    yield pd.DataFrame({"size": size, "perm": perm, "pos": _draw(seed, size, perm, n)})

    drawn = work.mapInPandas(draw, "size int, perm int, pos long")
    hits = drawn.join(placed, "pos").select("size", "perm", "pos", F.pow(F.abs("score"), F.lit(float(weight))).alias("w"))
    return walk(hits.withColumnRenamed("size", "set_size"), ["set_size", "perm"], F.lit(n)).select(
        F.col("set_size").alias("size"), "perm", "es"
    )


def gsea_nes(es: DataFrame, null: DataFrame) -> DataFrame:
    """Add ``nes`` (score over the mean null of its sign) and ``p`` = (more + 1) / (same + 1)."""
    means = null.groupBy("size").agg(
        F.avg(F.when(F.col("es") >= 0, F.col("es"))).alias("mean_pos"), F.avg(F.when(F.col("es") < 0, -F.col("es"))).alias("mean_neg")
    )
    draws = null.select("size", F.col("es").alias("null_es"))
    e, v = F.col("es"), F.col("null_es")
    same = F.when(e >= 0, v >= 0).otherwise(v <= 0)
    more = same & F.when(e >= 0, v >= e).otherwise(v <= e)
    p = es.join(draws, "size").groupBy("set_name").agg(((F.count_if(more) + 1) / (F.count_if(same) + 1)).alias("p"))
    out = es.join(means, "size").join(p, "set_name")
    mean = F.when(e >= 0, F.col("mean_pos")).otherwise(F.col("mean_neg"))
    return out.withColumn("nes", F.when(mean > 0, e / mean).otherwise(e)).drop("mean_pos", "mean_neg")


def gsea_fdr(nes: DataFrame, null: DataFrame, compat: bool = False) -> DataFrame:
    """Add ``fdr``: rate of nulls at least as extreme over the rate of sets, made monotone in |NES|.

    Nulls are normalised like the scores; ``compat`` compares with raw null scores instead. A size's null
    counts once for every set of that size. Tails are running counts over the merged order.
    """
    nes = materialize(nes)
    sizes = nes.groupBy("size").agg(F.count("*").alias("weight"))
    v = F.col("es")
    means = null.groupBy("size").agg(
        F.avg(F.when(v >= 0, v)).alias("mean_pos"), F.avg(F.when(v < 0, -v)).alias("mean_neg")
    )
    mean = F.when(v >= 0, F.col("mean_pos")).otherwise(F.col("mean_neg"))
    x = F.abs(v) if compat else F.when(mean > 0, F.abs(v) / mean).otherwise(F.abs(v))
    nulls = null.join(sizes, "size").join(means, "size").select((v >= 0).alias("up"), x.alias("x"), F.col("weight").alias("w0"), F.lit(0).cast("bigint").alias("w1"))
    seen = nes.select((F.col("nes") >= 0).alias("up"), F.abs("nes").alias("x"), F.lit(0).cast("bigint").alias("w0"), F.lit(1).cast("bigint").alias("w1"))
    points = nulls.unionByName(seen).groupBy("up", "x").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    tails = ordered(points, [("x", False)], ["up"], 2).running("c0", "sum", F.col("w0")).running("c1", "sum", F.col("w1")).result()
    totals = points.groupBy("up").agg(F.sum("w0").alias("t0"), F.sum("w1").alias("t1"))
    lookup = tails.filter("w1 > 0").join(F.broadcast(totals), "up")
    n_draws = nulls.agg(F.sum("w0")).scalar()
    joined = nes.withColumn("up", F.col("nes") >= 0).withColumn("x", F.abs("nes")).join(lookup, ["up", "x"]).withColumn("_d", n_draws)
    rate = F.when(F.col("t0") > 0, F.col("c0") / F.col("t0")).otherwise(1.0)
    raw = (rate + 1 / (F.col("_d") + 1)) / (F.col("c1") / F.col("t1"))
    clamped = joined.withColumn("_raw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    run = ordered(clamped, [("x", False), ("set_name", True)]).running("fdr", "max", F.col("_raw")).result()
    return run.select(*nes.columns, "fdr")


def gsea(sets: DataFrame, ranked: DataFrame, n_perm: int = 1000, weight: float = 1.0, min_size: int = 15, max_size: int = 500, seed: int = 42, compat: bool = False) -> DataFrame:
    """The whole preranked analysis: ``set_name, size, es, peak, nes, p, fdr``."""
    placed = positions(collapse(ranked))
    hits = materialize(sized_hits(sets, placed, weight, min_size, max_size))
    es = materialize(gsea_es(hits, placed).drop("high", "low"))
    null = materialize(gsea_null(es, placed, n_perm, weight, seed))
    return gsea_fdr(gsea_nes(es, null), null, compat)


# ---- over-representation and term tables --------------------------------------------


def hypergeometric_tail(k: Column, members: Column, drawn: Column, total: Column) -> Column:
    """P(X >= k) for ``drawn`` draws from ``total`` with ``members`` marked, terms added in log space."""

    def choose(a: Column, b: Column) -> Column:
        return special.lgamma(a + 1) - special.lgamma(b + 1) - special.lgamma(a - b + 1)

    whole = choose(total, drawn)
    first = F.greatest(k, drawn + members - total, F.lit(0)).cast("int")
    last = F.least(members, drawn).cast("int")
    terms = F.sequence(first, last)
    total_p = F.aggregate(terms, F.lit(0.0), lambda acc, i: acc + F.exp(choose(members, i) + choose(total - members, drawn - i) - whole))
    return F.when(first <= last, F.least(total_p, F.lit(1.0))).otherwise(0.0)


def over_representation(genes: DataFrame, sets: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Overlap of a gene list with every set it meets: ``overlap, set_size, odds_ratio, p, p_adj, combined``.

    The universe is all set members unless given. ``combined`` is -ln p times the odds ratio.
    """

    def upper(df: DataFrame, c: str) -> DataFrame:
        return df.select(F.upper(F.trim(c)).alias("symbol")).filter("symbol <> ''").distinct()

    members = sets.select("set_name", F.upper(F.trim("symbol")).alias("symbol")).distinct()
    base = upper(members if universe is None else universe, "symbol")
    members = members.join(base, "symbol", "left_semi")
    listed = upper(genes, genes.columns[0]).join(base, "symbol", "left_semi").withColumn("_in", F.lit(1))
    counts = members.join(listed, "symbol", "left").groupBy("set_name").agg(
        F.count("*").alias("set_size"), F.coalesce(F.sum("_in"), F.lit(0)).alias("overlap")
    ).filter("overlap > 0")
    counts = counts.withColumn("_n", listed.agg(F.count("*")).scalar()).withColumn("_t", base.agg(F.count("*")).scalar())
    k, m, n, t = F.col("overlap"), F.col("set_size"), F.col("_n"), F.col("_t")
    odds = F.try_divide((k * (t - m - n + k)).cast("double"), ((m - k) * (n - k)).cast("double"))
    tested = counts.withColumn("odds_ratio", odds).withColumn("p", hypergeometric_tail(k, m, n, t))
    out = multitest.benjamini_hochberg(tested.drop("_n", "_t"))
    return out.withColumn("combined", -F.log(F.greatest("p", F.lit(P_FLOOR))) * F.col("odds_ratio"))


def term_rows(rows: DataFrame, genes: str = "genes") -> DataFrame:
    """Term rows with genes de-duplicated ignoring case (first spelling kept) and their number."""
    trimmed = F.filter(F.transform(F.col(genes), lambda g: F.trim(g)), lambda g: g != "")
    upper = F.transform(trimmed, lambda g: F.upper(g))
    kept = F.filter(trimmed, lambda g, i: F.array_position(upper, F.upper(g)) == i + 1)
    return rows.withColumn(genes, kept).withColumn("overlap", F.size(genes))


def top_terms(
    terms: DataFrame, n: int = 20, by: str = "p_adj", min_overlap: int = 0, max_p: float = 1.0, max_padj: float = 1.0,
    min_combined: float | None = None, min_odds: float | None = None,
) -> DataFrame:
    """Terms inside the cutoffs, the best ``n`` by adjusted p, p or combined score."""
    keep = (F.col("overlap") >= min_overlap) & (F.col("p") <= max_p) & (F.col("p_adj") <= max_padj)
    if min_combined is not None:
        keep = keep & (F.col("combined") >= min_combined)
    if min_odds is not None:
        keep = keep & (F.col("odds_ratio") >= min_odds)
    first = F.desc("combined") if by == "combined" else F.asc(by)
    return terms.filter(keep).orderBy(first, "p", "set_name").limit(n)


def term_jaccard(sets: DataFrame, n_sets: int) -> DataFrame:
    """Jaccard similarity of every two sets that share a member: ``a, b, shared, jaccard``.

    Shared members are block-wise inner products over the member index, so a gene in very many sets
    does not emit its pairs.
    """
    members = sets.select("set_name", F.upper(F.trim("symbol")).alias("symbol")).distinct()
    sizes = members.groupBy("set_name").agg(F.count("*").alias("size"))
    index = row_numbers(sizes, [("set_name", True)], out="idx").withColumn("idx", F.col("idx") - 1)
    entries = members.join(index, "set_name").select("symbol", "idx", F.lit(1.0).alias("value"))
    shared = pair_sums(entries, "symbol", n_sets).filter("i < j").select("i", "j", F.col("n").cast("bigint").alias("shared"))
    a = index.select(F.col("idx").alias("i"), F.col("set_name").alias("a"), F.col("size").alias("sa"))
    b = index.select(F.col("idx").alias("j"), F.col("set_name").alias("b"), F.col("size").alias("sb"))
    joined = shared.join(a, "i").join(b, "j")
    return joined.select("a", "b", "shared", (F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).alias("jaccard"))


def term_intensity(assay: Assay, terms: DataFrame, genes: str | None = None) -> DataFrame:
    """Summed intensity of each term's distinct matched rows per sample: ``set_name, sample_id, value, n``."""
    index = symbol_index(assay.features, genes=genes)
    members = terms.select("set_name", F.upper(strip_species(F.col("symbol"))).alias("symbol")).distinct()
    rows = members.join(index, "symbol").select("set_name", "feature_id").distinct()
    return rows.join(assay.observed("positive"), "feature_id").groupBy("set_name", "sample_id").agg(
        F.sum("value").alias("value"), F.count("*").alias("n")
    )


def gene_list_from(result: DataFrame, symbol: str, significant: bool = False) -> DataFrame:
    """Distinct genes of a result table, optionally of its significant rows only."""
    rows = result.filter(F.col("sig") != "ns") if significant else result
    return rows.select(F.trim(F.col(symbol)).alias("gene")).filter("gene <> ''").distinct()


