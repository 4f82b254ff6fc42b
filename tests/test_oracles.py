"""A part of the registered queries against their SQL at the smallest scale; check.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, rows_of

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
CHOSEN = [
    "qc_sample_stats", "qc_cumulative_pct", "qc_missing_stats", "filter_valid_each_group", "filter_group_completeness", "compare_pearson_matrix",
    "sets_signatures", "meta_flow_links", "diff_welch", "diff_bh_ties", "impute_min_prob", "batch_correct_combat", "precursor_protein_maxlfq",
    "xic_decimate", "coverage_map_peptides", "enrich_gsea_es", "saint_impute_controls", "hybrid_exact_test", "read_matrix", "write_protein_matrix",
    "read_wide_grouped", "read_bait_matrix", "read_category_matrix", "read_then_impute_median", "read_then_min_prob", "meta_site_ids", "diff_storey", "diff_anova_p",
    "diff_kruskal", "enrich_rank_from_hybrid", "filter_column_boxes", "impute_densities", "impute_knn_complete", "precursor_run_summary", "cluster_silhouette", "saint_avg_p",
]


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 200


@pytest.mark.parametrize("name", CHOSEN)
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
