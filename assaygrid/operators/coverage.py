"""Peptides on protein sequences: ``sequences(accession, header, sequence)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.operators.joins import contains_join


def header_tokens(header: Column) -> Column:
    """Searchable tokens of a header: first word, its pipe parts, ``GN=`` gene, every word."""
    text = F.trim(header)
    first = F.element_at(F.split(text, r"\s+"), 1)
    gene = F.regexp_extract(text, r"\bGN=([^\s;]+)", 1)
    words = F.split(text, r"[\s|;,()\[\]]+")
    return F.array_distinct(F.filter(F.concat(F.array(first, gene), F.split(first, r"\|"), words), lambda t: t != ""))


def find_sequence(groups: DataFrame, sequences: DataFrame, col: str = "protein_group") -> DataFrame:
    """The sequence of every protein group, or null.

    Each ``;`` entry is tried as it is and without a ``-2`` or ``.1`` suffix, all exactly before any
    ignoring case. All tries are rows of one equi join; the first that hits wins. Among entries with
    the same token the smallest accession wins.
    """
    ids = F.filter(F.transform(F.split(F.col(col), ";"), lambda s: F.trim(s)), lambda s: s != "")
    tries = F.flatten(F.transform(ids, lambda s: F.array(s, F.regexp_replace(s, r"[-.]\d+$", ""))))
    wanted = groups.select(col).distinct().select(col, F.posexplode(tries).alias("pos", "t"))
    asked = wanted.select(col, F.inline(F.array(
        F.struct(F.col("pos").alias("prio"), F.concat(F.lit("="), "t").alias("k"), F.col("t").alias("matched")),
        F.struct((F.col("pos") + 1_000_000).alias("prio"), F.concat(F.lit("~"), F.lower("t")).alias("k"), F.col("t").alias("matched")),
    )))
    tokens = sequences.select("accession", F.explode(header_tokens(F.col("header"))).alias("t"))
    keyed = tokens.select("accession", F.explode(F.array(F.concat(F.lit("="), "t"), F.concat(F.lit("~"), F.lower("t")))).alias("k"))
    keyed = keyed.groupBy("k").agg(F.min("accession").alias("accession"))
    best = asked.join(keyed, "k").groupBy(col).agg(F.min(F.struct("prio", "matched", "accession")).alias("b"))
    found = best.select(col, F.col("b.matched").alias("matched_id"), F.col("b.accession").alias("accession"))
    return groups.join(found, col, "left").join(sequences.select("accession", "sequence"), "accession", "left")


def starts(sequence: Column, peptide: Column) -> Column:
    """1-based starts of every occurrence, overlapping ones included.

    Splitting before each occurrence yields pieces whose running lengths are the starts, which keeps
    the search in the regex engine. Every piece but the first begins with an occurrence.
    """
    pieces = F.split(sequence, F.concat(F.lit(r"(?=\Q"), peptide, F.lit(r"\E)")), -1)
    first = F.when(F.startswith(sequence, peptide), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    begin = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), first.alias("all"))

    def step(acc: Column, piece: Column) -> Column:
        return F.struct(
            (acc["at"] + F.length(piece)).alias("at"), F.concat(acc["all"], F.array(acc["at"] + 1)).alias("all")
        )

    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), begin, step, lambda acc: acc["all"])


def clean_peptides(peptides: DataFrame, key: str) -> DataFrame:
    """Distinct upper-case peptides per key, letters only."""
    letters = F.regexp_replace(F.upper("peptide"), "[^A-Z]", "")
    return peptides.select(key, letters.alias("peptide")).filter(F.col("peptide") != "").distinct()


def map_peptides(peptides: DataFrame, sequences: DataFrame, key: str = "accession") -> DataFrame:
    """Peptides found in the sequence with the same key: ``key, peptide, starts, start, end, hits``."""
    seqs = sequences.select(key, F.upper("sequence").alias("sequence"))
    found = contains_join(clean_peptides(peptides, key), seqs, key).withColumn("starts", starts(F.col("sequence"), F.col("peptide")))
    first = F.element_at("starts", 1)
    return found.select(
        key, "peptide", "starts", first.alias("start"), (first + F.length("peptide") - 1).alias("end"), F.size("starts").alias("hits")
    )


def coverage(peptides: DataFrame, sequences: DataFrame, key: str = "accession") -> DataFrame:
    """Per sequence: peptides, unmatched ones, covered residues and percentage."""
    mapped = map_peptides(peptides, sequences, key)
    spots = mapped.select(key, F.explode("starts").alias("s"), F.length("peptide").alias("len")).distinct()
    covered = spots.select(key, F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("pos")).distinct()
    n_covered = covered.groupBy(key).agg(F.count("*").alias("covered"))
    n_mapped = mapped.groupBy(key).agg(F.count("*").alias("mapped"))
    n_all = clean_peptides(peptides, key).groupBy(key).agg(F.count("*").alias("peptides"))
    out = sequences.select(key, F.length("sequence").alias("length")).join(n_all, key, "left").join(n_mapped, key, "left").join(n_covered, key, "left")
    out = out.fillna(0, ["peptides", "mapped", "covered"])
    pct = F.when(F.col("length") > 0, 100 * F.col("covered") / F.col("length")).otherwise(0.0)
    return out.select(key, "length", "peptides", (F.col("peptides") - F.col("mapped")).alias("unmatched"), "covered", pct.alias("pct"))


def residue_intensity(quant: DataFrame, sequences: DataFrame, key: str = "accession") -> DataFrame:
    """Summed peptide intensity at each covered residue: ``key, run, pos, intensity``.

    ``quant(key, run, peptide, value)``; intensities are summed per peptide before they are spread.
    """
    letters = F.regexp_replace(F.upper("peptide"), "[^A-Z]", "")
    per = quant.withColumn("peptide", letters).groupBy(key, "run", "peptide").agg(F.sum("value").alias("value"))
    mapped = map_peptides(quant.select(key, "peptide"), sequences, key).select(key, "peptide", "starts")
    # overlapping copies of one peptide cover a residue once
    spans = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.length("peptide") - 1))))
    spread = per.filter("value > 0").join(mapped, [key, "peptide"]).select(key, "run", F.explode(spans).alias("pos"), "value")
    return spread.groupBy(key, "run", "pos").agg(F.sum("value").alias("intensity"))


def subset_sequences(sequences: DataFrame, groups: DataFrame, col: str = "protein_group") -> DataFrame:
    """Sequences that some protein group refers to."""
    used = find_sequence(groups, sequences, col).filter("accession IS NOT NULL").select("accession").distinct()
    return sequences.join(used, "accession", "left_semi")
