"""A few registered queries against their SQL on the smallest tables; tools/check_oracle.py runs all."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
NAMES = (
    "grant_decision",
    "wl_similarity_pairs",
    "consequence_outcomes",
    "dedup_turns",
    "protected_literals",
    "locked_spans",
    "judge_job_packing",
    "schema_resolution",
    "pass_rate",
)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
