"""A cross-section of the registered queries against their oracles; tools/compare.py runs all of them."""
import sys
from pathlib import Path

import duckdb
import pytest
from conftest import SF

from payproof.plans import bridge, catalogue

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import rows_of  # noqa: E402

NAMES = ["jn_payee", "chk_5_1", "chk_5_2", "chk_5_6", "chk_4_1_cross", "chk_4_1_unknown", "chk_1_2", "chk_1_3", "chk_1_1_late", "chk_4_2", "chk_6_4", "chk_7_2", "chk_8_1", "chk_8_3",
         "gate_reason", "gate_totals", "ev_quote", "agg_unique", "vendor_risk", "score_prf", "au_append", "benford", "src_tidy", "src_typed", "fn_amount", "fn_date"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in bridge.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_its_oracle(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rel = con.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
