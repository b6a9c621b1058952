import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PICK = ["p1_flag_missing", "w3_innov", "w5_run", "w16_cut_history", "j1_build_neighbours", "j7_exclude_flagged", "s7_write_report", "w10_threshold_runs", "w11_group_runs", "s4_densify", "j12_match_truth", "g3_drift", "g10_random_plan", "f7_signed_text"]


def rows(found):
    return sorted(tuple("-" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows(df.select(*cols).collect()) == rows(want)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
