"""A spread of registered queries against their SQL on the smallest tables."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check_queries as C

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SPREAD = ["src04_parse_klines", "bar02_resample_idle", "jn01_asof_backward", "feat10_envelope", "feat22_volume_profile", "rank03_decile_bins", "lbl06_direction", "ev07_classification", "reg02_fused", "sig13_deoverlap", "sig20_turnover", "wf03_session_folds", "pf05_risk_summary", "str01_stream_bars"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not here")


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 200


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in C.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = Counter(tuple(C.canon(v) for v in r) for r in df.select(*cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(C.canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 6
