import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "s14_json_row_normalize", "p09_p11_clean_trades", "p08_p10_clean_bars", "w03_w04_segments", "p12_w11_w12_g01_model_base", "a04_a08_trade_bars", "a10_a11_id_gaps_and_edges",
    "j01_p28_p29_overlap", "j02_j03_p23_p24_p25_n09_n11_g02_labels", "a18_a19_agreement_sets", "a22_correlations", "f01_f63_features", "j05_p27_g03_join_audit", "g04_g05_w17_splits",
    "a01_column_profile", "m01_m08_metrics", "m12_w16_equal_frequency", "o08_rank_candidates", "g10_o10_calibration_selection", "q05_regional_revenue", "u03_except",
]


def rows(pdf):
    def plain(v):
        if not isinstance(v, str) and pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
