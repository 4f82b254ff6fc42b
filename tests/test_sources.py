"""Readers whose files have header rows of their own, and edge cases of the parsers."""

import pytest
from pyspark.sql import functions as F

from assaygrid.operators import impute, joins, meta
from assaygrid.sources import records, tables


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_bait_matrix(spark, tmp_path):
    text = "\tC\tT\tT\n\tGFP\tB1\tB1\nProtein\tc1\tt1\tt2\nP1\t5\t0\t7\nP2\tNA\t3\t4\nP1\t1\t1\t1\n"
    a = tables.read_bait_matrix(spark, write(tmp_path, "b.tsv", text), "Protein")
    assert [tuple(r) for r in a.samples.orderBy("sample_id").collect()] == [("c1", "C", "GFP"), ("t1", "T", "B1"), ("t2", "T", "B1")]
    got = a.cells.join(a.features, "feature_id").groupBy("prey", "sample_id").agg(F.sum("value").alias("v"))
    assert {(r["prey"], r["sample_id"]): r["v"] for r in got.collect()}[("P1", "t2")] == 8
    assert a.features.count() == 3


@pytest.mark.parametrize("row", ["Group,,a,a,b\n", ""])
def test_wide_grouped(spark, tmp_path, row):
    names = "x1,x2,x3" if row else "s1_a,s2_a,s3_b"
    a, member = tables.read_wide_grouped(spark, write(tmp_path, "w.csv", f"Feature,Feature group,{names}\n{row}f1,g1,1,2,3\nf2,g1,,n/a,6\n"))
    assert sorted(r["grp"] for r in a.samples.collect()) == ["a", "a", "b"]
    assert a.cells.filter("value IS NOT NULL").count() == 4 and member.count() == 2
    with pytest.raises(ValueError):
        tables.read_wide_grouped(spark, write(tmp_path, "v.csv", "Feature,s_a,s_b,s_c\nf,1,2,3\n"))


def test_wide_without_group_column_keeps_first_sample(spark, tmp_path):
    a, _ = tables.read_wide_grouped(spark, write(tmp_path, "n.csv", "Feature,s1_a,s2_b\nf1,1,2\n"))
    assert {r["sample_id"]: r["value"] for r in a.cells.collect()} == {"s1_a": 1.0, "s2_b": 2.0}


def test_category_matrix(spark, tmp_path):
    text = "\tS1\tS2\ncat-0: Subtype\tctrl\ttrt\n('AKT1', 'Type: kinase')\t1\t2\nMYC\t3\tNaN\n"
    a = tables.read_category_matrix(spark, write(tmp_path, "c.tsv", text))
    assert {r["sample_id"]: r["Subtype"] for r in a.samples.collect()} == {"S1": "ctrl", "S2": "trt"}
    notes = {r["feature_id"]: [tuple(c) for c in r["categories"]] for r in a.features.collect()}
    assert notes == {"AKT1": [("Type", "kinase")], "MYC": []}


def test_long_needs_two_groups(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_long(spark, write(tmp_path, "l.csv", "feature,sample,group,intensity\nf,s1,a,1\nf,s2,b,2\nf,s3,c,3\n"))


def test_gmt_first_definition(spark, tmp_path):
    sets = records.read_gmt(spark, write(tmp_path, "g.gmt", "# x\n\nA\td\tG1\tG2\nB\td\tG3\nA\td\tG9\n"))
    assert sorted((r["set_name"], r["symbol"]) for r in sets.collect()) == [("A", "G1"), ("A", "G2"), ("B", "G3")]


def test_ranked_and_sequences(spark, tmp_path):
    ranked = records.read_ranked(spark, write(tmp_path, "r.rnk", "gene\tscore\nA\t1.5\nB;-2\nC 3\n#x\t1\n"))
    assert {r["symbol"]: r["score"] for r in ranked.collect()} == {"A": 1.5, "B": -2.0, "C": 3.0}
    seqs = records.read_sequences(spark, write(tmp_path, "s.fasta", ">sp|P1|X GN=a\r\nacd\r\nEF G\r\n>Q2 some\nKL\n>empty\n"))
    assert {r["accession"]: r["sequence"] for r in seqs.collect()} == {"P1": "ACDEFG", "Q2": "KL"}


def test_description_without_header(spark, tmp_path):
    rows = records.read_protein_desc(spark, write(tmp_path, "d.tsv", "P1\tx\tAC-D1\nP2\ty\tEF\n")).collect()
    assert {r["accession"]: r["sequence"] for r in rows} == {"P1": "ACD", "P2": "EF"}


def test_names(spark):
    def frame(names):
        return spark.createDataFrame([(n,) for n in names], "sample_id string")

    out = meta.simplify_names(frame([r"E:/s/2026_Z\2026_Z_BAIT_R1_T1.raw", r"E:/s/2026_Z\2026_Z_CTRL_R1_T1.raw"]))
    assert sorted(r["name"] for r in out.collect()) == ["BAIT_R1_T1", "CTRL_R1_T1"]
    out = meta.parse_replicates(frame(["S01_D292_5min", "S02_D292_15min", "S03_D292_30min", "S04_D292_NS", "S05_D292_5min"]))
    assert {(r["Sample"], r["Group"], r["Time"]) for r in out.collect()} == {
        ("S01", "D292", "5min"), ("S02", "D292", "15min"), ("S03", "D292", "30min"), ("S04", "D292", "NS"), ("S05", "D292", "5min"),
    }
    out = meta.infer_groups(frame(["1_1", "1_2", "2_1"]))
    assert {r["sample_id"]: r["Group"] for r in out.collect()} == {"1_1": "1", "1_2": "1", "2_1": "2"}
    out = meta.infer_groups(frame([f"Sample {i:02d}" for i in range(1, 16)]))
    assert sorted(r["n"] for r in out.groupBy("Group").agg(F.count("*").alias("n")).collect()) == [3] * 5


def test_contains_join(spark):
    pep = spark.createDataFrame([("a", "CD"), ("a", "XX"), ("b", "CD")], "k string, peptide string")
    seq = spark.createDataFrame([("a", "ABCDE"), ("b", "AAAA")], "k string, sequence string")
    assert [(r["k"], r["peptide"]) for r in joins.contains_join(pep, seq, "k").collect()] == [("a", "CD")]


def test_protected_columns(spark):
    df = spark.createDataFrame([("a", "x")], "sample_id string, g string")
    for edit in (("drop", "sample_id"), ("rename", "g", "sample_id"), ("add", "g")):
        with pytest.raises(ValueError):
            meta.edit_meta(df, [edit])


def unique(assay):
    """One cell per (feature, sample), as the model has it."""
    assert assay.cells.groupBy("feature_id", "sample_id").count().filter("count > 1").isEmpty()
    return {r[0] for r in assay.cells.select("feature_id").distinct().collect()}


def test_duplicate_ids(spark, tmp_path):
    """A repeated id gets a number in every matrix reader."""
    matrix = tables.read_matrix(spark, write(tmp_path, "m.tsv", "id\ts1\ts2\nNX\t1\t2\nNX\t3\t4\nNX_2\t5\t6\n"))
    assert {r["feature_id"]: r["value"] for r in matrix.filter("sample_id = 's1'").collect()} == {"NX": 1.0, "NX_2": 3.0, "NX_2_2": 5.0}
    notes = "Protein.Group\tProtein.Names\tGenes\tFirst.Protein.Description\tN1\tN2\ts1\ts2\n"
    pg = tables.read_diann_pg(spark, write(tmp_path, "pg.tsv", notes + "P1\tNX\tG\td\t1\t1\t5\t6\nP2\tNX\tG\td\t1\t1\tNA\t8\n"))
    assert unique(pg) == {"NX", "NX_2"}
    gg = tables.read_diann_gg(spark, write(tmp_path, "gg.tsv", "Genes\ta\tb\ts1\nG\t1\t1\t5\nG\t1\t1\t6\n"))
    assert unique(gg) == {"G", "G_2"}
    sites = "Protein\tProtein.Names\tGene.Names\tResidue\tSite\tSequence\ts1\n"
    ds = tables.read_diann_sites(spark, write(tmp_path, "s.tsv", sites + "P\tN\tG\tS\t4\tAS\t1\nP\tN\tG\tS\t4\tAS\t2\n\t\t\t\t\tX\t3\n\t\t\t\t\tY\t4\n"))
    assert unique(ds) == {"G_S4", "G_S4_2", "row_3", "row_4"}
    mq = tables.read_mq_proteins(spark, write(tmp_path, "p.tsv", "Gene names\tLFQ intensity a\tLFQ intensity b\nG\t1\t2\nG\t3\t4\nH\t5\t6\n"))
    assert unique(mq) == {"G", "G_2", "H"}
    assert {r["feature_id"]: r["value"] for r in mq.cells.filter("sample_id = 'a'").collect()} == {"G": 1.0, "G_2": 3.0, "H": 5.0}
    mqs = tables.read_mq_sites(spark, write(tmp_path, "ps.tsv", "Gene names\tAmino acid\tPosition\tIntensity a\nG\tS\t4\t1\nG\tS\t4\t2\n"))
    assert unique(mqs) == {"G_S4", "G_S4_2"}
    wide, _ = tables.read_wide_grouped(spark, write(tmp_path, "w2.csv", "Feature,s1_a,s2_b\nf,1,2\nf,3,4\nFeature,s1_a,s2_b\n"))
    assert unique(wide) == {"f", "f_2", "Feature"}


def test_category_rows(spark, tmp_path):
    """Any number of category rows and of categories per feature; missing cells stay data."""
    extra = "".join(f"cat-{i}: T{i}\tx{i}\ty{i}\n" for i in range(30))
    kinds = ", ".join(f"cat-{i}: v{i}" for i in range(30))
    a = tables.read_category_matrix(spark, write(tmp_path, "k.tsv", f"\tS1\tS2\n{extra}(AKT1, {kinds})\t1\t2\nMYC\tNA\t4\nMYC\t5\t6\n"))
    assert len(a.samples.columns) == 31 and a.samples.filter("sample_id = 'S2'").first()["T29"] == "y29"
    got = {r["feature_id"]: r["categories"] for r in a.features.collect()}
    assert set(got) == {"AKT1", "MYC", "MYC_2"} and tuple(got["AKT1"][29]) == ("cat-29", "v29")
    assert {r["value"] for r in a.cells.filter("feature_id = 'MYC'").collect()} == {None, 4.0}


def test_read_then_impute(spark, tmp_path):
    """What readers return can be imputed and compared."""
    rows = "".join(f"G{i % 8}\t{i + 1}\t{'NaN' if i % 3 else i + 2}\t{i * 2 + 1}\n" for i in range(12))
    mq = tables.read_mq_proteins(spark, write(tmp_path, "q.tsv", "Gene names\tLFQ intensity a\tLFQ intensity b\tLFQ intensity c\n" + rows))
    for out in (impute.simple(mq, "median"), impute.min_prob(mq), impute.knn(mq, k=2)):
        cells = out.cells if hasattr(out, "cells") else out
        assert cells.count() == 36 and cells.filter("value IS NULL OR value <= 0").isEmpty()


def test_site_names(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, None, None, None), (3, "A", "S", "1"), (4, "A", "S", "1"), (5, "A_S1_2", None, None)], "k int, gene string, res string, pos string")
    got = {r["k"]: r["site_id"] for r in meta.site_ids(rows, "gene", "res", "pos", ["gene"], "k").collect()}
    assert got == {1: "row_1", 2: "row_2", 3: "A_S1", 4: "A_S1_2", 5: "A_S1_2_2"}


def test_long_replicate_numbers(spark):
    names = [(f"run_R{n}",) for n in (1, 2, 12345678901234)]
    got = meta.parse_replicates(spark.createDataFrame(names, "sample_id string"))
    assert got.filter("Biological_Replicate IS NOT NULL").isEmpty()


def test_null_groups_over_partitions(spark):
    """A null group is numbered through, however many partitions it lies in."""
    from assaygrid.operators.ranking import row_numbers

    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"))
    got = row_numbers(rows, [("id", True)], ["g"], n_groups=2)
    assert got.groupBy("g").agg(F.count_distinct("rank").alias("n"), F.max("rank").alias("m")).select("n", "m").distinct().collect() == [(2000, 2000)]
