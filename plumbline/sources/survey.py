"""The survey view over the synthetic star schema.

One SELECT that Spark and DuckDB read alike, so that every operator on it has
an oracle. ``pos`` is the row's place: a number that grows with the order in
which rows are listed and that no two rows share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {tables} are read as relations of that name.
SURVEY_SQL = """
SELECT CAST(((l.l_orderkey * 8 + l.l_linenumber) * 4194304 + l.l_partkey) * 64 + l.l_quantity AS BIGINT) AS pos,
  CASE WHEN l.l_partkey % 211 = 0 THEN NULL ELSE concat('D', l.l_orderkey, '-', l.l_linenumber) END AS docket_id,
  concat('A', l.l_orderkey) AS application_no,
  CASE WHEN l.l_partkey % 41 = 0 THEN NULL ELSE p.p_name END AS farmer_name,
  CASE WHEN l.l_linenumber % 2 = 0 THEN 'Flood' ELSE 'Hail' END AS calamity_type,
  l.l_quantity * 0.05E0 AS farm_area,
  p.p_type AS crop_name,
  CASE WHEN l.l_partkey % 29 = 0 THEN NULL ELSE concat('K', l.l_partkey % 60) END AS khasra_number,
  concat('', l.l_linenumber % 2) AS division_number,
  'State' AS state, n.n_name AS district,
  concat('T', l.l_suppkey % 7) AS tehsil, concat('B', l.l_suppkey % 3) AS block,
  concat('V', l.l_suppkey % 20) AS village,
  CASE WHEN l.l_suppkey % 19 = 0 THEN NULL ELSE concat('P', l.l_suppkey % 10) END AS patwar_circle,
  CASE WHEN l.l_suppkey % 23 = 0 THEN NULL ELSE s.s_name END AS surveyor_name,
  CASE WHEN l.l_linenumber = 7 THEN '12345' ELSE concat('9', 100000000 + l.l_suppkey) END AS surveyor_mobile,
  l.l_quantity * 2 + (CASE WHEN l.l_partkey % 53 = 0 THEN 20 ELSE 0 END) AS affected_area_pct,
  l.l_tax * 1000 AS crop_loss_pct,
  CASE WHEN l.l_partkey % 31 = 0 THEN NULL WHEN l.l_partkey % 17 = 0 THEN 95.0E0 ELSE l.l_quantity * 2 * l.l_tax * 10 END AS total_damage_pct,
  CASE WHEN l.l_partkey % 43 = 0 THEN NULL ELSE 28.0E0 + (l.l_suppkey % 50) * 0.1E0 + (l.l_partkey % 1000) * 0.0001E0 END AS latitude,
  76.0E0 + (l.l_suppkey % 5) * 0.05E0 AS longitude,
  CASE WHEN l.l_partkey % 37 = 0 THEN NULL ELSE concat('https://example.invalid/pdf/', l.l_orderkey, '.pdf') END AS pdf_url,
  CASE WHEN l.l_partkey % 47 = 0 THEN '' ELSE concat('https://example.invalid/a/', l.l_orderkey, '.jpg https://example.invalid/b/', l.l_partkey, '.jpg') END AS media_urls,
  o.o_orderdate AS survey_start_date, l.l_shipdate AS survey_end_date,
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey
"""
_TABLES = ["lineitem", "orders", "part", "supplier", "nation"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SURVEY_SQL, **{t: table(spark, sf_dir, t) for t in _TABLES})


def survey_oracle() -> str:
    """``survey AS (...)`` for a WITH list."""
    return "survey AS (" + SURVEY_SQL.format(**{t: t for t in _TABLES}) + ")"
