import os

import pandas as pd
import pytest

import __spark_entry__ as entry_module
from panelwright.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 150
    assert set(QUERIES) - set(ORACLE) == {
        "h04_split_draws", "k02_random_forest_grid", "k08_estimate_rho", "k09_contrast_invariance", "k10_contrast_bootstrap", "k10_bootstrap_ledger",
        "k11_surface_grid_predict", "k13_sensitivity_suite", "k16_fit_health",
    }


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_entry_and_twin_agree_on_the_smallest_tables(spark):
    import duckdb

    got = entry_module.entry(spark).toPandas()
    con = duckdb.connect()
    for name in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    want = con.execute(ORACLE["g03_grouped_metrics"]).df()
    keys = ["model", "grouping", "level"]
    got, want = (x.sort_values(keys).reset_index(drop=True)[sorted(x.columns)] for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-7)
