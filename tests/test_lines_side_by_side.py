"""One surveyor's records on two lines that follow each other in latitude and lie 4.8 km apart in longitude
are two clusters: the SQL of g_clusters and g_same_values chains them by latitude alone."""

import duckdb
import pytest

import __spark_entry__

#: Suppliers 1 and 2 are one name; parts 999 and 1001 are 22 m apart in latitude.
TABLES = {
    "lineitem": "select 1::bigint as l_orderkey, n::int as l_linenumber, p::bigint as l_partkey, s::bigint as l_suppkey, q::double as l_quantity, 0.05::double as l_tax, timestamp '1995-01-01' as l_shipdate from (values (1, 998, 1, 1), (2, 999, 1, 1), (3, 1001, 2, 2), (4, 1002, 2, 3)) t(n, p, s, q)",
    "orders": "select 1::bigint as o_orderkey, timestamp '1995-01-01' as o_orderdate",
    "part": "select i::bigint as p_partkey, 'part' as p_name, 'type' as p_type from range(1100) t(i)",
    "supplier": "select i::bigint as s_suppkey, 'One' as s_name, 0::int as s_nationkey from range(1, 3) t(i)",
    "nation": "select 0::int as n_nationkey, 'N' as n_name",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("lines")
    for t, sql in TABLES.items():
        duckdb.execute(f"copy ({sql}) to '{made}/{t}.parquet'")
    return str(made)


def test_clusters(spark, folder):
    got = __spark_entry__.queries()["g_clusters"](spark, folder).orderBy("pos").collect()
    assert [(r.cluster_size, r.group_id) for r in got] == [(2, "G-001")] * 2 + [(2, "G-002")] * 2


def test_values(spark, folder):
    got = __spark_entry__.queries()["g_same_values"](spark, folder).orderBy("pos").collect()
    same = "all 2 surveys at this spot have the SAME app entry (2% area / 50% loss) - possible copied entry"
    several = "the 2 surveys at this spot have different app entries (4%/50%; 6%/50%)"
    assert [r.same_location_values for r in got] == [same] * 2 + [several] * 2
