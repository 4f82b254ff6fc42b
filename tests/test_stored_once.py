"""Steps that several results share read their input once, or in bounded parts."""

import pandas as pd
import pytest

from assaygrid import Assay
from assaygrid.operators import batch, meta, precursor
from assaygrid.sources import sinks, tables


def counted(spark, df):
    """The frame, and an accumulator of the rows that were read from it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return df.mapInPandas(run, df.schema), seen


def report(spark, n=400):
    rows = [
        (f"r{i % 3}", f"p{i % 90}" if i % 11 else None, f"S{i % 40}" if i % 13 else None, f"M{i % 40}", i % 3, [None, "A", "B"][i % 3], "", f"n{i % 90}",
         ["g1;g2", "g2", "", None, "g3; g1"][i % 5], i % 2, 1.0, float(i % 97), float(i % 7 - 1), float(i % 4), 0.1 * (i % 5) if i % 3 else None, 0.2, None)
        for i in range(n)
    ]
    names = "run string, precursor_id string, stripped_sequence string, modified_sequence string, charge int, protein_group string, protein_ids string, protein_names string, genes string, proteotypic int, mz double, rt double, normalised double, maxlfq double, q_value double, global_q_value double, pg_q_value double"
    return spark.createDataFrame(rows, names)


def test_batch_compare_reads_cells_once(spark):
    rows = [(f, f"s{s}", float(10 + (f * 7 + s * 3) % 11 + 2 * (s % 2))) for f in range(30) for s in range(6)]
    cells, seen = counted(spark, spark.createDataFrame(rows, "feature_id int, sample_id string, value double"))
    samples = spark.createDataFrame([(f"s{s}", f"B{s % 2}") for s in range(6)], "sample_id string, batch string")
    a = Assay(cells, samples)
    out = {r["metric"]: r for r in batch.batch_compare(a, a.with_cells(spark.createDataFrame(rows, "feature_id int, sample_id string, value double")), "batch").collect()}
    assert seen.value == len(rows)
    assert out["mean"]["delta"] == pytest.approx(0) and out["mean"]["before"] > 0


def test_number_duplicates_reads_once(spark):
    df, seen = counted(spark, spark.createDataFrame([("a", i) for i in range(5)] + [("b", 5), ("a_2", 6), (None, 7), (None, 8)], "id string, n int"))
    out = meta.number_duplicates(df, "id", "n").collect()
    assert seen.value == 9
    got = [r["id"] for r in out if r["id"] is not None]
    assert len(set(got)) == len(got) == 7 and sum(r["id"] is None for r in out) == 2


@pytest.mark.parametrize("method", ["sum", "maxlfq", "top3"])
def test_gene_tables(spark, tmp_path, method):
    """One reading of the report for all columns of the gene matrix, with what its rows say one by one."""
    p, seen = counted(spark, report(spark))
    sinks.write_gene_matrix(p, str(tmp_path / "g"), ["r0", "r1", "r2"], method)
    assert seen.value == 400
    got = {r["Genes"]: r.asDict() for r in tables.read_text_table(spark, str(tmp_path / "g")).collect()}
    pdf = report(spark).toPandas()
    pdf["gene"] = [[g.strip() for g in (v or "").split(";") if g.strip()] or ["Unknown"] for v in pdf["genes"]]
    pdf["group"] = pdf["protein_group"].fillna("Unknown")
    pdf["pep"] = pdf["stripped_sequence"].fillna(pdf["modified_sequence"])
    pdf = pdf.explode("gene")
    assert set(got) == set(pdf["gene"])
    for gene, part in pdf.groupby("gene"):
        assert got[gene]["Protein.Groups"] == "; ".join(sorted(set(part["group"])))
        assert int(got[gene]["N.Protein.Groups"]) == part["group"].nunique()
        assert int(got[gene]["N.Sequences"]) == part["pep"].nunique()
        assert int(got[gene]["N.Proteotypic.Sequences"]) == part[part["proteotypic"] == 1]["pep"].nunique()
        assert got[gene]["Protein.Names"] == part.loc[part["precursor_id"] == part["precursor_id"].dropna().min(), "protein_names"].iloc[0]
        for run in ("r0", "r1", "r2"):
            mine = part[part["run"] == run]
            if method == "top3":
                want = mine["normalised"][mine["normalised"] > 0].nlargest(3).mean()
            else:
                want = mine["normalised"].sum() if mine["normalised"].sum() > 0 else float("nan")
            if method == "maxlfq" and (mine["maxlfq"] > 0).any():
                continue
            assert (got[gene][run] is None) == pd.isna(want) and (pd.isna(want) or float(got[gene][run]) == pytest.approx(want))


def test_peptide_table_in_bounded_parts(spark, monkeypatch):
    """One shuffle into as many partitions as the rows need, with the values of every run and the labels of the first row."""
    monkeypatch.setattr(precursor, "ROWS", 10)
    p = report(spark)
    out = precursor.peptide_table(p, ["r0", "r1", "r2"])
    plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(precursor_id#" in plan and ", 40)" in plan
    values = {(r["precursor_id"], r["run"]): r["value"] for r in precursor.peptide_values(p).collect()}
    rows = {r["precursor_id"]: r for r in out.collect()}
    pdf = p.toPandas()
    pdf["key"] = pdf["precursor_id"].fillna(pdf["modified_sequence"] + "_" + pdf["charge"].astype(str))
    assert set(rows) == set(pdf["key"])
    for key, part in pdf.groupby("key"):
        r, mine = rows[key], [values[key, run] for run in ("r0", "r1", "r2") if (key, run) in values]
        assert [r[run] for run in ("r0", "r1", "r2")] == [values.get((key, run)) for run in ("r0", "r1", "r2")]
        assert (r["detected_runs"], r["total"], r["max"]) == (len(mine), sum(mine), max(mine, default=0))
        assert r["mean"] == pytest.approx(sum(mine) / len(mine) if mine else 0)
        low = part["q_value"].min()
        assert r["q_value"] == (1.0 if pd.isna(low) else low) and r["pg_q_value"] == 1.0
        assert r["rt"] == part["rt"].min()
