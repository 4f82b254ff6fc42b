"""Sample and feature metadata: names, groups, identifiers, symbols."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.missing import is_placeholder
from assaygrid.model import Assay
from assaygrid.operators.joins import clean_file_name
from assaygrid.operators.ranking import row_numbers
from assaygrid.runtime import BROADCAST_ROWS, broadcast_if, materialize

SEPARATORS = r"[_\-. ]"
# Fixed value: what reads as a duration.
DURATION = r"(?i)^\d+(\.\d+)?(ns|us|ms|s|sec|secs|min|mins|h|hr|hrs|hour|hours|d|day|days|w|wk|week|weeks|month|months)$"
# Fixed value: accession pattern of the public protein knowledgebase.
ACCESSION = r"^[OPQ][0-9][A-Z0-9]{3}[0-9]$|^[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}$"
# Organism mnemonics that may follow the last underscore of an identifier.
SPECIES = [
    "HUMAN", "MOUSE", "RAT", "BOVIN", "PIG", "RABIT", "CHICK", "XENLA", "DROME", "CAEEL", "YEAST", "SCHPO",
    "DANRE", "CANLF", "MACMU", "PANTR", "PONAB", "MACFA", "GORGO", "CHLAE", "PAPHA", "CALJA", "CANFA", "FELIS",
    "FELCA", "HORSE", "EQUAS", "SHEEP", "GOAT", "MESAU", "CAVPO", "CRIGR", "NORVG", "HAMST", "GERBL", "GUINE",
    "ECHGR", "LOXAF", "ORNAN", "MONDO", "DASNO", "SORAR", "TUPCH", "OTOGA", "MUSPF", "NEOMU", "SUS", "ECOLI",
    "ARATH", "SOYBN", "MAIZE", "BRARE", "ORYZA", "WHEAT", "BARJU", "COTJA", "SOLLC", "TOBAC", "PHYPA", "DICDI",
    "ASPOR", "AJECG", "BACSU", "HELPY", "LACLM", "STRPN", "STAAR", "YERPE", "PSEAE", "METJA", "TRYBR", "PLAF",
    "XENTR", "LASMU", "VICPA", "BISBO", "TAEGU",
]


def _shared_length(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    spots = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    same = F.filter(spots, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(F.length(F.substring(a, F.lit(1), F.lit(1))) == 0, 0).otherwise(F.size(same))


def _cut_to_separator(text: Column, length: Column) -> Column:
    """Longest stretch of the first ``length`` characters that ends in a separator."""
    return F.length(F.regexp_extract(F.substring(text, F.lit(1), length), rf"^(.*{SEPARATORS})?", 0))


def _affixes(samples: DataFrame, name: Column) -> DataFrame:
    """Samples with ``_base`` and the lengths of the common prefix and suffix, cut to separators.

    The extremes of the sorted names share the prefix of all; the same on reversed names for suffixes.
    """
    named = samples.withColumn("_base", name).withColumn("_rev", F.reverse(F.col("_base")))
    one = named.agg(
        F.min("_base").alias("a"), F.max("_base").alias("b"), F.min("_rev").alias("ra"), F.max("_rev").alias("rb"),
        F.min(F.length("_base")).alias("shortest"),
    ).withColumn("pre", _shared_length(F.col("a"), F.col("b")))
    room = F.col("shortest") - F.col("pre")
    one = one.withColumn("suf", F.least(_shared_length(F.col("ra"), F.col("rb")), room))
    cut = one.select(F.struct(
        _cut_to_separator(F.col("a"), F.col("pre")).alias("pre"), _cut_to_separator(F.col("ra"), F.col("suf")).alias("suf")
    ))
    return named.withColumn("_cut", cut.scalar()).drop("_rev")


def _strip(pre: Column, suf: Column) -> Column:
    base = F.col("_base")
    return F.substring(base, pre + 1, F.greatest(F.length(base) - pre - suf, F.lit(0)))


def shorten_names(samples: DataFrame, col: str = "sample_id", out: str = "short") -> DataFrame:
    """Strip the common prefix and suffix; fall back to less until all names are non-empty and unique."""
    zero = F.lit(0)
    cut = _affixes(samples, clean_file_name(F.col(col), "raw"))
    pre, suf = F.col("_cut.pre"), F.col("_cut.suf")
    tried = cut.withColumn("_c", F.array(_strip(pre, suf), _strip(pre, zero), _strip(zero, suf), F.col("_base")))
    usable = [
        (F.count_distinct(F.col("_c")[i]) == F.count("*")) & (F.min(F.length(F.col("_c")[i])) > 0) for i in range(3)
    ]
    pick = tried.agg(
        F.when(F.count("*") < 2, 3).when(usable[0], 0).when(usable[1], 1).when(usable[2], 2).otherwise(3)
    ).scalar()
    return tried.withColumn("_pick", pick).withColumn(out, F.col("_c")[F.col("_pick")]).drop("_base", "_cut", "_c", "_pick")


def number_duplicates(df: DataFrame, col: str, order: str) -> DataFrame:
    """Second and later rows of a name, by ``order``, get _2, _3, ... A name may hold any number of rows.

    Where such a name is already there, the later row gets a number in turn, until all names differ. Null
    names stay null. ``df`` is stored first, as it is read several times.
    """
    df = materialize(df)
    while True:
        repeated = materialize(df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_rn")).filter("_rn > 1").select(col))
        if repeated.isEmpty():
            return df
        ranked = row_numbers(df.join(repeated, col, "left_semi"), [(order, True)], [col], n_groups=BROADCAST_ROWS + 1, out="_rn")
        numbered = F.concat(F.col(col), F.lit("_"), F.col("_rn").cast("string"))
        renamed = ranked.withColumn(col, F.when(F.col("_rn") > 1, numbered).otherwise(F.col(col))).drop("_rn")
        df = df.join(repeated, col, "left_anti").unionByName(renamed)


def simplify_names(samples: DataFrame, col: str = "sample_id", out: str = "name") -> DataFrame:
    """Readable run names: no path or extension, common prefix trimmed at a separator.

    Where trimming would merge names the last token is used; ``S`` goes before names that all start
    with a digit; duplicates get a number.
    """
    cut = _affixes(samples, F.regexp_replace(clean_file_name(F.col(col), "raw"), r"\.[A-Za-z0-9]+$", ""))
    trimmed = cut.withColumn("_t", _strip(F.col("_cut.pre"), F.lit(0)))
    unique = trimmed.agg((F.count_distinct("_t") == F.count("*")) & (F.min(F.length("_t")) > 0)).scalar()
    last = F.element_at(F.split(F.col("_base"), SEPARATORS), -1)
    named = trimmed.withColumn("_u", unique).withColumn(out, F.when(F.col("_u"), F.col("_t")).otherwise(last))
    digits = named.agg(F.bool_and(F.col(out).rlike(r"^\d"))).scalar()
    named = named.withColumn("_d", digits)
    named = named.withColumn(out, F.when(F.col("_d"), F.concat(F.lit("S"), F.col(out))).otherwise(F.col(out)))
    return number_duplicates(named.drop("_cut"), out, col).drop("_base", "_t", "_u", "_d")


def _tokens(col: str) -> Column:
    return F.split(F.col(col), r"[_\-.]")


def _axis_token(col: str, letter: str) -> Column:
    """First token made of ``letter`` and digits."""
    return F.get(F.filter(_tokens(col), lambda t: t.rlike(rf"^{letter}\d+$")), F.lit(0))


def parse_time(samples: DataFrame, col: str = "sample_id") -> DataFrame:
    """Add ``Time`` from the first token position that mostly holds durations in every sample."""
    spread = samples.select(F.col(col).alias("_s"), F.posexplode(_tokens(col)).alias("pos", "tok"))
    n = samples.agg(F.count("*")).scalar()
    per = spread.groupBy("pos").agg(
        F.count("*").alias("n"), F.count_distinct("tok").alias("d"), F.avg(F.col("tok").rlike(DURATION).cast("int")).alias("share")
    ).withColumn("all", n)
    good = per.filter("n = all AND share > 0.5 AND d >= 2 AND d <= all - 1")
    pos = good.agg(F.min("pos")).scalar()
    timed = samples.withColumn("_pos", pos)
    return timed.withColumn("Time", F.get(_tokens(col), F.col("_pos"))).drop("_pos")


AXES = {"S": "Sample", "R": "Biological_Replicate", "T": "Technical_Replicate"}


def parse_replicates(samples: DataFrame, col: str = "sample_id") -> DataFrame:
    """S#/R#/T# tokens of the names as columns, and ``Group`` from what remains.

    An axis is kept when every sample carries it and its numbers run 1..N without a gap.
    """
    timed = parse_time(samples, col)
    df, checks = timed, []
    for letter in AXES:
        df = df.withColumn(f"_{letter}", _axis_token(col, letter))
        number = F.col(f"_{letter}").substr(F.lit(2), F.length(f"_{letter}")).try_cast("decimal(38,0)")
        checks.append(F.coalesce(
            (F.count(number) == F.count("*")) & (F.min(number) == 1) & (F.max(number) == F.count_distinct(number)), F.lit(False)
        ).alias(letter))
    df = df.withColumn("_ok", df.agg(F.struct(*checks)).scalar())
    for letter, name in AXES.items():
        df = df.withColumn(name, F.when(F.col(f"_ok.{letter}"), F.col(f"_{letter}")))
    dropped = F.array_compact(F.array(*[F.col(name) for name in AXES.values()], F.col("Time")))
    rest = F.array_join(F.filter(_tokens(col), lambda t: ~F.array_contains(dropped, t)), "_")
    return df.withColumn("Group", F.nullif(rest, F.lit(""))).drop("_ok", *[f"_{p}" for p in AXES])


def infer_groups(samples: DataFrame, col: str = "sample_id") -> DataFrame:
    """Add ``Group`` for names without S/R/T structure.

    In turn: ``group_replicate`` numbers; the first token position with 2-20 short alphanumeric
    values; runs of 3 (else 2) samples in name order; four blocks in name order.
    """
    numeric = samples.agg(F.bool_and(F.col(col).rlike(r"^\d+_\d+$"))).scalar()
    n = samples.agg(F.count("*")).scalar()
    spread = samples.select(F.posexplode(_tokens(col)).alias("pos", "tok"))
    per = spread.groupBy("pos").agg(
        F.count("*").alias("n"),
        F.count_distinct("tok").alias("d"),
        F.bool_and(F.col("tok").rlike("^[A-Za-z0-9]{1,8}$")).alias("ok"),
    ).withColumn("all", n)
    pos = per.filter("ok AND n = all AND d BETWEEN 2 AND least(20, all - 1)").agg(F.min("pos")).scalar()
    order = samples.agg(F.sort_array(F.collect_list(col))).scalar()
    placed = (
        samples.withColumn("_numeric", numeric)
        .withColumn("_pos", pos)
        .withColumn("_n", n)
        .withColumn("_order", order)
        .withColumn("_i", F.array_position("_order", F.col(col)) - 1)
    )
    per_group = F.when(F.col("_n") % 3 == 0, 3).when(F.col("_n") % 2 == 0, 2)
    block = F.when(per_group.isNotNull(), F.floor(F.col("_i") / per_group)).otherwise(F.floor(4 * F.col("_i") / F.col("_n")))
    group = (
        F.when(F.col("_numeric"), F.get(_tokens(col), F.lit(0)))
        .when(F.col("_pos").isNotNull(), F.get(_tokens(col), F.col("_pos")))
        .otherwise(F.concat(F.lit("Group"), (block + 1).cast("string")))
    )
    return placed.withColumn("Group", group).drop("_numeric", "_pos", "_n", "_order", "_i")


def keyword_cols(samples: DataFrame, col: str = "sample_id") -> DataFrame:
    """``Treatment`` from control / treatment words and ``Batch`` from batch tokens in the name."""
    name = F.lower(F.col(col))
    treatment = F.when(name.rlike("control|ctrl"), "Control").when(name.rlike("treatment|treat"), "Treatment")
    batch = F.nullif(F.regexp_extract(name, r"(batch[_\-. ]?\d*)", 1), F.lit(""))
    return samples.withColumn("Treatment", treatment).withColumn("Batch", batch)


def backfill_replicates(samples: DataFrame, col: str = "sample_id") -> DataFrame:
    """Fill placeholder cells of the replicate columns from the R#/T# tokens of the name."""
    out = samples
    for letter in ("R", "T"):
        name = AXES[letter]
        if name in samples.columns:
            filled = F.when(is_placeholder(F.col(name)), _axis_token(col, letter)).otherwise(F.col(name))
            out = out.withColumn(name, filled)
    return out


def attach_meta(assay: Assay, col: str, default: str = "(unassigned)") -> DataFrame:
    """Cells with a sample column joined on the trimmed id; blank or absent becomes ``default``."""
    lookup = assay.samples.select(F.trim("sample_id").alias("_k"), F.nullif(F.trim(F.col(col)), F.lit("")).alias(col))
    joined = assay.cells.withColumn("_k", F.trim("sample_id")).join(assay.per_sample(lookup), "_k", "left")
    return joined.withColumn(col, F.coalesce(col, F.lit(default))).drop("_k")


def site_ids(features: DataFrame, gene: str, residue: str, position: str, fallback: Sequence[str], order: str) -> DataFrame:
    """Ids like ``AKT1_S473``: gene, residue and first position; other columns in turn; ``row_`` and the order without any; unique suffix."""

    def first(c: str) -> Column:
        return F.nullif(F.trim(F.element_at(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), ";"), 1)), F.lit(""))

    spot = F.nullif(F.trim(F.element_at(F.split(F.col(position).cast("string"), "[;,]"), 1)), F.lit(""))
    suffix = F.concat(F.lit("_"), F.nullif(F.trim(F.col(residue)), F.lit("")), spot)
    stem = F.coalesce(F.when(suffix.isNotNull(), first(gene)), *[first(c) for c in fallback], first(gene))
    own = F.concat(F.lit("row_"), F.col(order).cast("string"))
    named = features.withColumn("site_id", F.coalesce(F.concat(stem, F.coalesce(suffix, F.lit(""))), own))
    return number_duplicates(named, "site_id", order)


def group_counts(samples: DataFrame, col: str) -> DataFrame:
    return samples.groupBy(col).agg(F.count("*").alias("n"))


def flow_links(samples: DataFrame, cols: Sequence[str], max_nodes: int = 30) -> DataFrame:
    """Value-to-value links between neighbouring levels: ``level, source, target, n``.

    Rows with a blank level are skipped. Per level the values beyond the ``max_nodes`` - 1 most
    frequent become one node ``(other N)``.
    """
    limit = max_nodes
    blank = [F.col(c).isNull() | (F.trim(F.col(c)) == "") for c in cols]
    kept = samples.filter(~reduce(lambda a, b: a | b, blank))
    for c in cols:
        per = kept.groupBy(c).agg(F.count("*").alias("_n"))
        top = per.orderBy(F.desc("_n"), c).limit(limit - 1).select(c, F.lit(True).alias("_top"))
        n_values = per.agg(F.count("*")).scalar()
        marked = kept.join(broadcast_if(top, limit), c, "left").withColumn("_d", n_values)
        many = (F.col("_d") > limit) & F.col("_top").isNull()
        other = F.concat(F.lit("(other "), (F.col("_d") - (limit - 1)).cast("string"), F.lit(")"))
        kept = marked.withColumn(c, F.when(many, other).otherwise(F.col(c))).drop("_top", "_d")
    steps = [
        F.struct(F.lit(i).alias("level"), F.col(a).alias("source"), F.col(b).alias("target"))
        for i, (a, b) in enumerate(zip(cols, cols[1:]))
    ]
    return kept.select(F.inline(F.array(*steps))).groupBy("level", "source", "target").agg(F.count("*").alias("n"))


def skipped_rows(samples: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many rows ``flow_links`` leaves out."""
    blank = [F.col(c).isNull() | (F.trim(F.col(c)) == "") for c in cols]
    return samples.agg(F.count_if(reduce(lambda a, b: a | b, blank)).alias("n_skipped"))


def is_accession(c: Column) -> Column:
    t = F.trim(c)
    return F.coalesce(F.length(t).between(6, 13) & t.rlike(ACCESSION), F.lit(False))


def map_names(features: DataFrame, lookup: DataFrame, mode: str = "auto", taxid: str = "9606") -> DataFrame:
    """Feature ids mapped through ``lookup(gene_symbol, protein_name, uniprotkb_ac, species_taxid)``.

    The first ``;`` entry's first word is looked up as accession or symbol. The note says ``empty id``,
    ``no hit``, ``multiple: n`` (accessions) or nothing.
    """
    first = F.trim(F.element_at(F.split(F.trim(F.col("feature_id").cast("string")), ";"), 1))
    token = F.element_at(F.split(first, r"\s+"), 1)
    as_acc = {"uniprot": F.lit(True), "gene": F.lit(False), "auto": is_accession(F.col("query_id"))}[mode]
    asked = features.withColumn("query_id", token).withColumn("_acc", as_acc)
    asked = asked.withColumn("_k", F.concat(F.when(F.col("_acc"), "a:").otherwise("s:"), F.upper("query_id")))
    fields = F.struct("gene_symbol", "protein_name", "uniprotkb_ac", "species_taxid")
    by_acc = lookup.select(F.concat(F.lit("a:"), F.upper("uniprotkb_ac")).alias("_k"), fields.alias("hit"))
    by_sym = lookup.select(F.concat(F.lit("s:"), F.upper("gene_symbol")).alias("_k"), fields.alias("hit"))
    hits = by_acc.unionByName(by_sym).groupBy("_k").agg(F.min("hit").alias("hit"), F.count("*").alias("n_hits"))
    joined = asked.join(hits, "_k", "left")
    note = (
        F.when(F.col("query_id") == "", "empty id")
        .when(F.col("hit").isNull(), "no hit")
        .when(F.col("_acc") & (F.col("n_hits") > 1), F.concat(F.lit("multiple: "), F.col("n_hits").cast("string")))
        .otherwise("")
    )
    blank = F.lit("")
    return joined.select(
        "feature_id",
        "query_id",
        *[F.coalesce(F.col(f"hit.{c}"), blank).alias(c) for c in ("gene_symbol", "protein_name", "uniprotkb_ac")],
        F.coalesce("hit.species_taxid", F.lit(taxid)).alias("species_taxid"),
        note.alias("mapping_note"),
    )


def strip_species(c: Column) -> Column:
    """Remove a trailing ``_MNEMONIC`` that names a known organism."""
    t = F.trim(c)
    stem = F.regexp_extract(t, "^(.+)_([A-Za-z0-9]{3,15})$", 1)
    mark = F.upper(F.regexp_extract(t, "^(.+)_([A-Za-z0-9]{3,15})$", 2))
    return F.when(mark.isin(SPECIES), stem).otherwise(t)


def row_token(c: Column) -> Column:
    """First entry of a row id packed with tab, ``;`` or ``|``."""
    return F.trim(F.element_at(F.split(F.coalesce(c.cast("string"), F.lit("")), r"[\t;|]"), 1))


def resolve_symbol(features: DataFrame, genes: str | None = None, mapped: str | None = None) -> DataFrame:
    """``symbol``: first gene token without species suffix, else the mapped symbol, else the row id."""
    options = []
    if genes is not None:
        first = F.element_at(F.split(F.trim(F.coalesce(F.col(genes), F.lit(""))), r"[,;|\s]+"), 1)
        options.append(F.nullif(strip_species(first), F.lit("")))
    if mapped is not None:
        options.append(F.nullif(F.trim(F.col(mapped)), F.lit("")))
    options.append(strip_species(row_token(F.col("feature_id"))))
    return features.withColumn("symbol", F.coalesce(*options))


def id_profile(features: DataFrame, col: str = "feature_id") -> DataFrame:
    """Fractions of ids that look like accessions, long text and gene symbols, and whether mapping is needed."""
    tok = row_token(F.col(col))
    kept = features.select(tok.alias("t")).filter(F.col("t") != "")
    long = (F.length("t") > 40) | (F.size(F.split("t", r"\s+")) > 2)
    symbol = (F.length("t") <= 20) & F.col("t").rlike("^[A-Za-z][A-Za-z0-9_-]*$")
    share = [F.avg(x.cast("int")) for x in (is_accession(F.col("t")), long, symbol)]
    out = kept.agg(F.count("*").alias("n"), share[0].alias("accession"), share[1].alias("long"), share[2].alias("symbol"))
    need = (F.col("accession") > 0.12) | (F.col("long") > 0.2) | (F.col("symbol") < 0.38)
    return out.withColumn("need_mapping", F.coalesce(need, F.lit(True)))


# Keyword patterns that speak for a species, each worth two points.
HUMAN_WORDS = [r"\bhuman\b|\bhomo sapiens\b|\bhsapiens\b", r"\bhg38\b|\bhg19\b|\bgrch3[78]\b", r"(^|[^a-z0-9])9606([^0-9]|$)", r"_human\b"]
MOUSE_WORDS = [
    r"\bmouse\b|\bmus musculus\b|\bmusculus\b",
    r"\bmm10\b|\bmm39\b|\bgencode.*mouse\b",
    r"\bmmu-|\bmmu_|\bmus\b(?![a-z])",
    r"(^|[^a-z0-9])10090([^0-9]|$)",
    r"_mouse\b",
]


def guess_species(texts: DataFrame, col: str, protein_names: DataFrame | None = None, name_col: str = "name") -> DataFrame:
    """``species, confidence, human, mouse`` from keyword hits in ``texts`` and suffixes in protein names."""
    t = F.lower(F.col(col).cast("string"))
    hits = texts.agg(
        *[F.coalesce(F.bool_or(t.rlike(w)), F.lit(False)).cast("int").alias(f"h{i}") for i, w in enumerate(HUMAN_WORDS)],
        *[F.coalesce(F.bool_or(t.rlike(w)), F.lit(False)).cast("int").alias(f"m{i}") for i, w in enumerate(MOUSE_WORDS)],
    )
    human = 2 * sum((F.col(f"h{i}") for i in range(1, len(HUMAN_WORDS))), F.col("h0"))
    mouse = 2 * sum((F.col(f"m{i}") for i in range(1, len(MOUSE_WORDS))), F.col("m0"))
    counts = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("m"))
    if protein_names is not None:
        p = F.lower(F.col(name_col))
        is_human = p.rlike(r"_human\b|_hsapiens\b")
        counts = protein_names.agg(F.struct(
            F.count_if(is_human).alias("h"), F.count_if(p.rlike(r"_mouse\b") & ~p.rlike(r"_human\b")).alias("m")
        )).scalar()
    scored = hits.select(human.alias("human"), mouse.alias("mouse")).withColumn("s", counts)
    scored = scored.select(
        (F.col("human") + F.least(F.lit(16), 2 * F.col("s.h"))).cast("bigint").alias("human"),
        (F.col("mouse") + F.least(F.lit(16), 2 * F.col("s.m"))).cast("bigint").alias("mouse"),
        F.col("s.h").alias("sh"), F.col("s.m").alias("sm"),
    )
    h, m, sh, sm = F.col("human"), F.col("mouse"), F.col("sh"), F.col("sm")
    by_mouse, by_human = (sm >= 5) & (sm >= 2 * sh + 1), (sh >= 5) & (sh >= 2 * sm + 1)
    species = F.when(by_mouse, "Mouse").when(by_human, "Human").when(h > m + 1, "Human").when(m > h + 1, "Mouse")
    best = F.greatest(h, m)
    confidence = F.when(by_mouse | by_human, "high").when(species.isNotNull(), F.when(best >= 4, "high").otherwise("low"))
    return scored.select(species.alias("species"), confidence.alias("confidence"), "human", "mouse")


def symbol_index(features: DataFrame, genes: str | None = None, mapped: str | None = None) -> DataFrame:
    """Every upper-case symbol form of a row: normalised id, mapped symbol, each gene token."""
    forms = F.array(strip_species(row_token(F.col("feature_id"))))
    if mapped is not None:
        forms = F.concat(forms, F.array(F.trim(F.coalesce(F.col(mapped), F.lit("")))))
    if genes is not None:
        tokens = F.split(F.trim(F.coalesce(F.col(genes), F.lit(""))), r"[,;|\s]+")
        forms = F.concat(forms, F.transform(tokens, strip_species))
    upper = F.array_distinct(F.transform(forms, lambda f: F.upper(F.trim(f))))
    return features.select(F.explode(upper).alias("symbol"), "feature_id").filter(F.col("symbol") != "")


def gene_list(features: DataFrame, col: str) -> DataFrame:
    """Distinct genes of a packed column, or nothing when too few rows or symbols are filled."""
    text = F.trim(F.coalesce(F.col(col), F.lit("")))
    gate = features.agg(F.count("*").alias("n"), F.avg((text != "").cast("int")).alias("filled"))
    pieces = F.transform(F.split(text, r"[;|,]+"), lambda p: strip_species(F.trim(p)))
    genes = features.select(F.explode(pieces).alias("gene")).filter(F.col("gene") != "").distinct()
    rule = gate.select(
        ((F.col("filled") >= 0.22) & (genes.agg(F.count("*")).scalar() >= F.greatest(F.lit(12), F.floor(F.col("n") * 0.12))))
    ).scalar()
    return genes.withColumn("_ok", rule).filter("_ok").drop("_ok")


def is_contaminant(c: Column) -> Column:
    """Accession marked as a contaminant."""
    return c.startswith("Cont_") | c.startswith("CON__")


def label(col: str) -> Column:
    """Chosen annotation, falling back to the row id."""
    return F.coalesce(F.nullif(F.trim(F.col(col).cast("string")), F.lit("")), F.col("feature_id").cast("string"))


def edit_meta(samples: DataFrame, edits: Sequence[tuple]) -> DataFrame:
    """Apply ``("add", c)``, ``("rename", a, b)``, ``("drop", c)``, ``("set", c, ids, value)`` in order."""
    out = samples
    for op, *args in edits:
        if op in ("drop", "set", "rename") and args[0] == "sample_id":
            raise ValueError("sample_id cannot be changed")
        if op in ("add", "rename") and args[-1] in out.columns:
            raise ValueError(f"column {args[-1]} exists")
        if op == "add":
            out = out.withColumn(args[0], F.lit(""))
        elif op == "rename":
            out = out.withColumnRenamed(args[0], args[1])
        elif op == "drop":
            out = out.drop(args[0])
        elif op == "set":
            col, ids, value = args
            out = out.withColumn(col, F.when(F.col("sample_id").isin(list(ids)), F.lit(value)).otherwise(F.col(col)))
        else:
            raise ValueError(f"unknown edit {op!r}")
    return out
