"""Plans: scans read only what is needed, filters reach them, and no query multiplies rows."""

import re

import pytest

from tessera.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["panel_lags"](spark, DATA)))
    assert schemas and all({c.split(":")[0] for c in s.split(",")} <= {"l_suppkey", "l_shipdate", "l_quantity"} for s in schemas)


def test_filters_reach_the_scan(spark):
    # cov_ratios, which stood here, reads all rows now
    assert "PushedFilters: [IsNotNull(l_linenumber), LessThanOrEqual(l_linenumber,3)]" in plan(QUERIES["assemble_train_tables"](spark, DATA))


@pytest.mark.parametrize("name", ["panel_rolls_monthly", "cov_lag_delta_roll", "panel_roll_mean_std"])
def test_a_panel_is_shuffled_for_its_sums_and_its_windows_only(spark, name):
    assert len(re.findall(r"\bExchange hashpartitioning", plan(QUERIES[name](spark, DATA)))) == 2


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("cross_expand_groups",)))
def test_no_cross_product_of_two_tables(spark, name):
    """Cross joins are with one aggregate row or a grid of thresholds, which are broadcast."""
    if name in ("gbt_fit_predict", "nested_cv_oof", "ridge_alpha_probe", "adversarial_auc", "recursive_forecast", "family_ablation", "multiclass_forest", "stream_daily_closed", "transform_probe", "strict_cv", "leave_one_out", "search_halving", "oof_boosted_pipeline", "importance_by_model"):
        pytest.skip("fits models or runs a stream")
    assert "CartesianProduct" not in plan(QUERIES[name](spark, DATA))
