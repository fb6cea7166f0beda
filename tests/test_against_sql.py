"""Every registered query with a SQL text gives the same rows in DuckDB.

The chained plans take long, so a plain run covers one query per kind; set ALL_QUERIES=1
for all of them (tests/compare.py does the same with timings).
"""

import os

import pytest
from compare import compare, database

from greengrain.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
QUICK = """s01_read_csv s06_sku_day s06_category_day s07_data_quality s08_scenario_supplement v01_table_rules v03_reconcile
v07_monotone p01_activity p03_season_labels p06_winsorize p12_string_helpers j01_dense_calendar j02_span_calendar j03_future_rows
j05_semi_join j08_interval_join a01_monthly_profile a03_peaks a05_zero_inflation a06_distinct_counts a15_box_stats
c06_seasonal_label w02_rolling w03_fill w05_daily_share w06_average_rank w09_weighted_quantiles w16_decompose r01_index_correlation
r02_detrended_spearman r04_active_overlap w11_fdr r12_node_metrics r13_components t03_top_pairs_by_sign t07_set_jaccard
e01_prepared_frame e05_residual_slope e06_slope_bootstrap a07_loss_rate k01_candidates k03_shrinkage_choice z01_residual_pool
q03_minimum_portfolios""".split()
NAMES = [n for n, q in QUERIES.items() if q.sql] if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    problem = compare(spark, con, QUERIES[name].run, QUERIES[name].sql, SF)
    assert problem is None, problem
