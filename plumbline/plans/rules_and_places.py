"""Queries of the validation rules and of records at the same place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import rules, spatial
from plumbline.operators.numbering import settled
from plumbline.plans.catalogue import NOW, query, survey


def narrow(spark, sf_dir, *columns: str) -> DataFrame:
    """``pos`` and these columns of all survey records, joined once and settled:
    places read them several times."""
    return settled(survey(spark, sf_dir).select("pos", *columns))


_FLAGS = """
med AS (SELECT median(epoch_us(survey_start_date)) AS ms, count(survey_start_date) AS cs, median(epoch_us(survey_end_date)) AS me, count(survey_end_date) AS ce FROM survey),
docks AS (SELECT docket_id AS d, count(*) AS n FROM survey WHERE docket_id IS NOT NULL GROUP BY 1),
fields AS (SELECT khasra_number AS k, division_number AS dv, village AS v, count(DISTINCT docket_id) AS n FROM survey WHERE khasra_number IS NOT NULL AND division_number IS NOT NULL AND village IS NOT NULL GROUP BY ALL),
flagged AS (
  SELECT s.*, list_filter([
    CASE WHEN trim(coalesce(docket_id, '')) = '' THEN 'Missing: docket_id' END,
    CASE WHEN trim(coalesce(farmer_name, '')) = '' THEN 'Missing: farmer_name' END,
    CASE WHEN trim(coalesce(crop_name, '')) = '' THEN 'Missing: crop_name' END,
    CASE WHEN trim(coalesce(khasra_number, '')) = '' THEN 'Missing: khasra_number' END,
    CASE WHEN latitude IS NULL THEN 'Missing: latitude' END,
    CASE WHEN longitude IS NULL THEN 'Missing: longitude' END,
    CASE WHEN affected_area_pct IS NULL THEN 'Missing: affected_area_pct' END,
    CASE WHEN crop_loss_pct IS NULL THEN 'Missing: crop_loss_pct' END,
    CASE WHEN trim(coalesce(pdf_url, '')) = '' THEN 'Missing: signed form link' END,
    CASE WHEN trim(coalesce(media_urls, '')) = '' THEN 'Missing: photo links' END,
    CASE WHEN affected_area_pct < 0 OR affected_area_pct > 100 THEN 'affected_area_pct out of range 0-100' END,
    CASE WHEN crop_loss_pct < 0 OR crop_loss_pct > 100 THEN 'crop_loss_pct out of range 0-100' END,
    CASE WHEN total_damage_pct < 0 OR total_damage_pct > 100 THEN 'total_damage_pct out of range 0-100' END,
    CASE WHEN abs(total_damage_pct - affected_area_pct * crop_loss_pct / 100) > 10 THEN 'Total damage != affected x loss' END,
    CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude BETWEEN 8 AND 37 AND longitude BETWEEN 68 AND 97) THEN 'GPS out of India bounds' END,
    CASE WHEN survey_start_date > survey_end_date THEN 'Start date after end date' END,
    CASE WHEN cs >= 10 AND abs(epoch_us(survey_start_date) - ms) > 400 * 86400000000 THEN 'Survey start date outside season window' END,
    CASE WHEN ce >= 10 AND abs(epoch_us(survey_end_date) - me) > 400 * 86400000000 THEN 'Survey end date outside season window' END,
    CASE WHEN survey_start_date > TIMESTAMP '1998-06-02' THEN 'Survey date in future' END,
    CASE WHEN docks.n > 1 THEN 'Duplicate record' END,
    CASE WHEN fields.n > 1 THEN 'Possible duplicate field' END,
    CASE WHEN trim(coalesce(surveyor_mobile, '')) <> '' AND NOT regexp_full_match(right(regexp_replace(surveyor_mobile, '\\D', '', 'g'), 10), '[6-9]\\d{9}') THEN 'Invalid mobile number' END
  ], lambda x: x IS NOT NULL) AS fl
  FROM survey s CROSS JOIN med LEFT JOIN docks ON docks.d = s.docket_id LEFT JOIN fields ON fields.k = s.khasra_number AND fields.dv = s.division_number AND fields.v = s.village
)
"""


@query("d_rules", _FLAGS + "SELECT pos, array_to_string(fl, ', ') AS data_qc_flags FROM flagged")
def d_rules(spark, sf_dir):
    """Each record's flags in their order."""
    return rules.with_flags(survey(spark, sf_dir), NOW, "data_qc_flags").select("pos", "data_qc_flags")


@query("d_flag_counts", _FLAGS + "SELECT district, flag, count(*) AS records FROM (SELECT district, unnest(fl) AS flag FROM flagged) GROUP BY ALL")
def d_flag_counts(spark, sf_dir):
    """Which rules fail where."""
    return rules.flag_counts(survey(spark, sf_dir), NOW)


_POINTS = """
mean AS (SELECT avg(latitude) AS m FROM survey WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
placed AS (SELECT survey.*, latitude * 111320.0E0 AS y, longitude * 111320.0E0 * cos(radians(m)) AS x,
  CASE WHEN trim(coalesce(surveyor_name, '')) = '' THEN NULL ELSE lower(trim(surveyor_name)) END AS sv FROM survey, mean),
spots AS (SELECT x, y, count(*) AS n, floor(x / 25) AS cx, floor(y / 25) AS cy FROM placed WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x, y),
steps AS (SELECT i.i, j.j FROM (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j)),
any_n AS (SELECT a.x, a.y, sum(b.n) - 1 AS any_count FROM spots a, steps s JOIN spots b ON b.cx = a.cx + s.i AND b.cy = a.cy + s.j
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 25 GROUP BY a.x, a.y),
own AS (SELECT sv, x, y, count(*) AS n, min(pos) AS first, floor(x / 25) AS cx, floor(y / 25) AS cy FROM placed WHERE x IS NOT NULL AND y IS NOT NULL AND sv IS NOT NULL GROUP BY sv, x, y),
same_n AS (SELECT a.sv, a.x, a.y, sum(b.n) - 1 AS same_count FROM own a, steps s JOIN own b ON b.sv = a.sv AND b.cx = a.cx + s.i AND b.cy = a.cy + s.j
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 25 GROUP BY a.sv, a.x, a.y),
near AS (SELECT p.*, coalesce(any_count, 0)::BIGINT AS any_count, coalesce(same_count, 0)::BIGINT AS same_count
  FROM placed p LEFT JOIN any_n a ON a.x = p.x AND a.y = p.y LEFT JOIN same_n s ON s.x = p.x AND s.y = p.y AND s.sv = p.sv),
"""
#: Each surveyor's points lie on one line here, so clusters are runs without a gap over 25 m.
_CLUSTERS = (
    _POINTS
    + """
gaps AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY sv ORDER BY y) <= 25 THEN 0 ELSE 1 END AS st FROM own),
runs AS (SELECT *, sum(st) OVER (PARTITION BY sv ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM gaps),
sized AS (SELECT sv, c, sum(n) AS size, min(first) AS first_pos FROM runs GROUP BY sv, c),
grouped AS (SELECT sv, c, size, first_pos, dense_rank() OVER (ORDER BY first_pos) AS gno FROM sized WHERE size > 1),
located AS (SELECT n.*, coalesce(g.size, 1)::BIGINT AS cluster_size, g.first_pos AS cluster, CASE WHEN g.gno IS NULL THEN '' ELSE 'G-' || CASE WHEN g.gno < 1000 THEN lpad(g.gno::VARCHAR, 3, '0') ELSE g.gno::VARCHAR END END AS group_id,
    CASE WHEN khasra_number IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY coalesce(patwar_circle, village, tehsil, ''), khasra_number) END AS on_field
  FROM near n LEFT JOIN runs r ON r.sv = n.sv AND r.x = n.x AND r.y = n.y LEFT JOIN grouped g ON g.sv = r.sv AND g.c = r.c),
suggested AS (SELECT *, CASE WHEN same_count > 3 AND coalesce(total_damage_pct, crop_loss_pct) > 15 THEN 'Same Location - QC Required' WHEN same_count > 3 THEN 'Same Location - Low Damage' WHEN on_field > 3 THEN 'Review - Multiple Records' ELSE 'OK' END AS remark FROM located),
"""
)


@query("g_neighbours", _POINTS.rstrip().rstrip(",") + " SELECT pos, same_count, any_count FROM near")
def g_neighbours(spark, sf_dir):
    """Records within 25 m, of the same surveyor and of any."""
    out = spatial.neighbour_counts(spatial.projected(narrow(spark, sf_dir, "latitude", "longitude", "surveyor_name")))
    return out.select("pos", F.col("Nearby_Same_Surveyor_25m").alias("same_count"), F.col("Nearby_Any_Surveyor_25m").alias("any_count"))


@query("g_clusters", _CLUSTERS.rstrip().rstrip(",") + " SELECT pos, cluster_size, group_id FROM located")
def g_clusters(spark, sf_dir):
    """Connected records of one surveyor, numbered by first appearance."""
    df = spatial.clusters(spatial.projected(narrow(spark, sf_dir, "latitude", "longitude", "surveyor_name")))
    out = df.join(settled(spatial.group_ids(df)), "_cluster", "left").fillna("", ["Group_ID"])
    return out.select("pos", F.col("Cluster_Size").alias("cluster_size"), F.col("Group_ID").alias("group_id"))


@query("g_suggestion", _CLUSTERS + """ last AS (SELECT 1)
SELECT pos, on_field, remark AS suggested_remark, CASE remark WHEN 'Same Location - QC Required' THEN 95 WHEN 'Same Location - Low Damage' THEN 75 WHEN 'Review - Multiple Records' THEN 65 ELSE 55 END AS suggest_pct FROM suggested""")
def g_suggestion(spark, sf_dir):
    """Records of one survey number, and what is suggested."""
    df = spatial.neighbour_counts(spatial.records_on_field(spatial.projected(narrow(spark, sf_dir, "latitude", "longitude", "surveyor_name", "khasra_number", "patwar_circle", "village", "tehsil", "total_damage_pct", "crop_loss_pct"))))
    remark, share = spatial.suggestion()
    return df.select("pos", F.col("Records_On_Same_Field").cast("long").alias("on_field"), remark.alias("suggested_remark"), share.alias("suggest_pct"))


_G = "CASE WHEN {0} IS NULL THEN '?' WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.4f', {0}), '0+$', ''), '\\.$', '') END"


@query("g_same_values", _CLUSTERS + f"""
entries AS (SELECT cluster, affected_area_pct AS a, crop_loss_pct AS l, min(pos) AS at_, count(*) AS n FROM suggested WHERE cluster IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY at_) AS r, sum(n) OVER (PARTITION BY cluster) AS total, count(*) OVER (PARTITION BY cluster) AS kinds FROM entries),
texts AS (SELECT cluster, any_value(total) AS total, any_value(kinds) AS kinds, arg_min(a, r) AS a0, arg_min(l, r) AS l0,
    string_agg({_G.format("a")} || '%/' || {_G.format("l")} || '%', '; ' ORDER BY r) FILTER (WHERE r <= 4) AS shown FROM ranked GROUP BY cluster)
SELECT s.pos, coalesce(CASE WHEN kinds = 1 THEN 'all ' || total || ' surveys at this spot have the SAME app entry (' || {_G.format("a0")} || '% area / ' || {_G.format("l0")} || '% loss)' || CASE WHEN coalesce(a0, 0) > 0 OR coalesce(l0, 0) > 0 THEN ' - possible copied entry' ELSE '' END
  ELSE 'the ' || total || ' surveys at this spot have different app entries (' || shown || CASE WHEN kinds > 4 THEN ' ...' ELSE '' END || ')' END, '') AS same_location_values
FROM suggested s LEFT JOIN texts t USING (cluster)""")  # fmt: skip
def g_same_values(spark, sf_dir):
    """Whether the records of a cluster carry one entry."""
    df = spatial.clusters(spatial.projected(narrow(spark, sf_dir, "latitude", "longitude", "surveyor_name", "affected_area_pct", "crop_loss_pct")))
    out = df.join(settled(spatial.cluster_values(df)), "_cluster", "left").fillna("", ["Same_Location_Values"])
    return out.select("pos", F.col("Same_Location_Values").alias("same_location_values"))


@query("g_examples", _POINTS + """
cand AS (SELECT x, y, pos, docket_id, row_number() OVER (PARTITION BY x, y ORDER BY pos) AS r FROM near WHERE x IS NOT NULL AND y IS NOT NULL),
few AS (SELECT *, floor(x / 25) AS cx, floor(y / 25) AS cy FROM cand WHERE r <= 4),
pairs AS (SELECT a.x, a.y, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, b.pos AS p, b.docket_id AS dk FROM spots a, steps s JOIN few b ON b.cx = a.cx + s.i AND b.cy = a.cy + s.j),
best AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY d, p) AS r FROM pairs WHERE d < 25),
others AS (SELECT n.pos, b.d, b.p, coalesce(b.dk, 'None') AS dk, row_number() OVER (PARTITION BY n.pos ORDER BY b.r) AS k FROM near n JOIN best b ON b.x = n.x AND b.y = n.y AND b.r <= 4 AND b.p <> n.pos)
SELECT n.pos, coalesce(string_agg(o.dk, ', ' ORDER BY o.k) FILTER (WHERE o.k <= 3), '') AS examples FROM near n LEFT JOIN others o USING (pos) WHERE n.x IS NOT NULL AND n.y IS NOT NULL GROUP BY n.pos""")
def g_examples(spark, sf_dir):
    """Up to three nearest other dockets."""
    return spatial.examples(spatial.projected(narrow(spark, sf_dir, "latitude", "longitude", "surveyor_name", "docket_id"))).select("pos", F.array_join("examples", ", ").alias("examples"))


@query("g_location")
def g_location(spark, sf_dir):
    """G1 to G13 in one frame, remarks included (its parts have SQL of their own)."""
    out = spatial.with_location(narrow(spark, sf_dir, "latitude", "longitude", "surveyor_name", "docket_id", "khasra_number", "patwar_circle", "village", "tehsil", "affected_area_pct", "crop_loss_pct", "total_damage_pct"))
    return out.select("pos", *[F.col(c).alias(c.lower().replace("%", "pct")) for c in spatial.OUTPUT])


@query("g_photo_distance", """SELECT pos, round(2 * 6371000.0E0 * asin(sqrt(pow(sin((radians(plat) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(plat)) * pow(sin(radians(plng - longitude) / 2), 2))), 3) AS distance_m,
  2 * 6371000.0E0 * asin(sqrt(pow(sin((radians(plat) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(plat)) * pow(sin(radians(plng - longitude) / 2), 2))) > 200 AS far
FROM (SELECT pos, latitude, longitude, latitude + (l_partkey % 7) * 0.0007E0 AS plat, longitude + (l_orderkey % 5) * 0.0003E0 AS plng FROM survey)""")
def g_photo_distance(spark, sf_dir):
    """Metres between record and photo."""
    df = survey(spark, sf_dir).withColumns({"photo_lat": F.expr("latitude + (l_partkey % 7) * 0.0007E0"), "photo_lng": F.expr("longitude + (l_orderkey % 5) * 0.0003E0")})
    return spatial.far_photos(df).select("pos", F.round("photo_distance_m", 3).alias("distance_m"), F.col("photo_far").alias("far"))
