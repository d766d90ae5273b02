"""Tables where rows share a ``pos`` (and more of what the small tables lack) give what the SQL gives."""

import os

import duckdb
import pytest

import __spark_entry__
from tests.test_queries import SF, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the synthetic tables are not here")
NAMES = ["a_issues", "g_clusters", "g_same_values", "j_lookup", "p_work_plan", "w_percent_rank", "v_counters"]


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet") if t != "lineitem" else con.execute(
            f"copy (select * from '{SF}/lineitem.parquet' union all select * from '{SF}/lineitem.parquet' where l_orderkey % 5 = 0) to '{folder}/lineitem.parquet'"
        )
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, repeated, name):
    folder, con = repeated
    df = __spark_entry__.queries()[name](spark, folder)
    columns = sorted(df.columns)
    result = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    text = lambda rows, at: sorted("|".join(plain(r[at(c)]) for c in columns) for r in rows)
    assert text(df.collect(), lambda c: c) == text(result.fetchall(), names.index)
