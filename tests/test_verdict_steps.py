"""A query of verdicts makes none of the texts that remarks are made of."""

import os

import pytest

import __spark_entry__
from tests.test_queries import SF


@pytest.mark.skipif(not os.path.isdir(SF), reason="the synthetic tables are not here")
def test_no_texts_for_verdicts(spark):
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = __spark_entry__.queries()["a_overall"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert "Manual QC Required" in plan and "signed form could not be retrieved" not in plan
