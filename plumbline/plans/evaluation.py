"""Queries of verdicts, assembled output and summaries, over readings derived from the survey view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import assemble, evaluate, report
from plumbline.plans.catalogue import query, survey
from plumbline.sources.survey import SURVEY_SQL  # noqa: F401

#: Flat readings of forms and photos, by remainders of keys; both engines read it.
READINGS_SQL = """
SELECT s.*,
  CASE WHEN pdf_url IS NULL THEN 'no_link' WHEN l_partkey % 13 = 0 THEN 'not_found' WHEN l_partkey % 59 = 0 THEN 'skipped' ELSE 'ok' END AS fs,
  l_partkey % 61 <> 0 AS p3,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE affected_area_pct + (l_partkey % 4) * 3.0E0 - 3.0E0 END AS fa,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE crop_loss_pct END AS fl,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE affected_area_pct END AS ra,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE crop_loss_pct END AS rl,
  CASE WHEN l_partkey % 10 = 0 THEN 0.5E0 WHEN l_partkey % 10 < 4 THEN 0.7E0 ELSE 0.95E0 END AS fc,
  CASE WHEN l_partkey % 6 = 0 THEN FALSE WHEN l_partkey % 6 = 1 THEN NULL ELSE TRUE END AS po,
  l_orderkey % 11 <> 0 AS farmer, l_orderkey % 17 <> 0 AS company, l_partkey % 71 = 0 AS over,
  CASE WHEN media_urls = '' THEN 'no_link' WHEN l_partkey % 19 = 0 THEN 'error' ELSE 'ok' END AS ps,
  l_partkey % 4 + 1 AS n_photos, CASE WHEN l_partkey % 23 = 0 THEN l_partkey % 4 + 1 WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END AS n_form,
  (l_partkey % 23 = 0 OR l_partkey % 9 = 0) AS is_form,
  CASE WHEN l_orderkey % 13 = 0 THEN 'person-only' WHEN l_orderkey % 29 = 0 THEN 'blurry-dark-irrelevant' ELSE 'field' END AS scene,
  CASE WHEN l_partkey % 3 = 0 THEN 'no' ELSE 'yes' END AS crop, CASE WHEN l_partkey % 5 = 0 THEN 'yes' ELSE 'no' END AS flooded,
  CASE WHEN l_orderkey % 2 = 0 THEN 'high' ELSE 'low' END AS pc,
  CASE WHEN l_partkey % 5 < 2 THEN 'healthy' WHEN l_partkey % 5 = 2 THEN 'lodged' ELSE NULL END AS damage,
  CASE WHEN l_partkey % 4 = 0 THEN 'standing crop' ELSE 'cut & spread' END AS field,
  l_partkey % 8 = 0 AS mism, (l_orderkey % 40) * 10.0E0 AS dist, l_partkey % 2 AS dups, l_partkey % 7 = 0 AS rotated,
  CASE WHEN l_suppkey % 4 = 0 THEN 'Same Location - QC Required' WHEN l_suppkey % 4 = 1 THEN 'Review - Multiple Records' ELSE 'OK' END AS sugg,
  CASE WHEN l_suppkey % 3 = 0 THEN 'near others' ELSE '' END AS slr, CASE WHEN l_suppkey % 8 = 0 THEN 'x possible copied entry' ELSE '' END AS slv,
  CASE WHEN l_partkey % 12 = 0 THEN 'Possible duplicate field' WHEN l_partkey % 12 = 1 THEN 'Missing: photo links, Duplicate record' ELSE '' END AS dflags,
  (l_partkey % 100) * 1.0E0 AS rscore
FROM {survey} s
"""


def readings(spark, sf_dir) -> DataFrame:
    """The survey view with ``form`` and ``photo`` structs and what the evaluator reads beside them."""
    flat = spark.sql(READINGS_SQL, survey=survey(spark, sf_dir))
    lit = lambda kind: F.lit(None).cast(kind)
    form = {
        "_state": F.col("fs"), "is_proforma3": F.col("p3"), "quality": F.lit("good"), "form_no": F.concat(F.lit("HR0126"), F.lpad(F.col("l_orderkey").cast("string"), 6, "0")), "po_id": F.col("docket_id"),
        "po_id_matches": F.col("po"), "form_area": F.col("fa"), "form_loss": F.col("fl"), "row_area": F.col("ra"), "row_loss": F.col("rl"), "total_row_blank": F.lit(False), "area_written": F.lit(True), "loss_written": F.col("l_orderkey") % 14 != 0,
        "farmer_signed": F.col("farmer"), "company_signed": F.col("company"), "worker_signed": lit("boolean"), "officer_signed": lit("boolean"), "officer_stamp_only": F.lit(False), "overwrite_suspected": F.col("over"), "confidence": F.col("fc"),
    }
    photo = {
        "_state": F.col("ps"), "n_photos": F.col("n_photos").cast("int"), "n_form_photos": F.col("n_form").cast("int"), "photo_is_form": F.col("is_form"), "scene_type": F.col("scene"), "field_photo": F.col("field"),
        "crop_seen": F.lit("paddy"), "crop_matches_declared": ~F.col("mism"), "crop_present": F.col("crop"), "flooded": F.col("flooded"), "damage_state": F.col("damage"), "photo_conf": F.col("pc"), "photo_agree": F.lit(True),
        "person_each": F.array(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 5 == 0), "photo_is_form_each": F.array(F.col("is_form"), F.lit(False)), "n_duplicates": F.col("dups").cast("int"), "rotated": F.col("rotated"), "stamp_dist_m": F.col("dist"), "stamp_date": F.lit("15061996"),
    }
    return flat.withColumns({
        "form": assemble.record(form, "form"), "photo": assemble.record(photo, "photo"),
        "Suggested_Remark": F.col("sugg"), "Same_Location_Remark": F.col("slr"), "Same_Location_Values": F.col("slv"), "Data_QC_Flags": F.col("dflags"), "Risk_Score": F.col("rscore"), "Risk_Reasons": F.lit("reason"),
        "survey_start_date": F.date_format("survey_start_date", "yyyy-MM-dd"), "survey_end_date": F.date_format("survey_end_date", "yyyy-MM-dd"),
    })


_FOUND = "readings AS (" + READINGS_SQL.format(survey="survey") + """),
v AS (SELECT *, fs = 'ok' AND p3 AS fok, fc < 0.6 AS low, ps = 'ok' AND NOT is_form AS pf, fc >= 0.6 AS cok, pc = 'high' AS tr,
  CAST(survey_start_date AS DATE) AS sd, CAST(survey_end_date AS DATE) AS ed FROM readings),
w AS (SELECT *, CASE WHEN NOT fok OR NOT cok THEN NULL WHEN fa IS NOT NULL AND fl IS NOT NULL THEN fa WHEN ra IS NOT NULL THEN ra WHEN fa IS NOT NULL AND rl IS NOT NULL THEN fa END AS va,
  CASE WHEN NOT fok OR NOT cok THEN NULL WHEN fa IS NOT NULL AND fl IS NOT NULL THEN fl WHEN ra IS NOT NULL THEN rl WHEN fa IS NOT NULL AND rl IS NOT NULL THEN rl END AS vl,
  fok AND cok AND fa IS NOT NULL AND fl IS NOT NULL AS total_used FROM v),
x AS (SELECT *, CASE WHEN va IS NULL THEN 'NA' WHEN abs(va - affected_area_pct) <= 5 AND abs(vl - crop_loss_pct) <= 5 THEN 'Match' ELSE 'Mismatch' END AS mt FROM w),
f AS (SELECT *, list_filter([
  CASE WHEN fs = 'no_link' THEN 'Form link missing|reject' END, CASE WHEN fs = 'not_found' THEN 'Form not found|manual' END, CASE WHEN fs = 'ok' AND NOT p3 THEN 'Not Proforma-3|reject' END,
  CASE WHEN fok AND NOT po THEN 'PO ID mismatch|partial' END, CASE WHEN fok AND va IS NULL AND NOT low THEN 'Form not readable|manual' END, CASE WHEN fok AND mt = 'Mismatch' THEN 'Form vs app mismatch|review' END,
  CASE WHEN total_used AND ra IS NOT NULL AND (abs(ra - fa) > 0.5 OR abs(rl - fl) > 0.5) THEN 'Form row/total inconsistent|review' END,
  CASE WHEN fok AND (NOT farmer OR NOT company) THEN 'Signature missing|info' END, CASE WHEN fok AND over THEN 'Form overwrite|review' END, CASE WHEN fok AND low THEN 'Low confidence - manual review|manual' END,
  CASE WHEN ps = 'no_link' THEN 'Photo link missing|reject' END, CASE WHEN ps = 'error' THEN 'Photos not found|manual' END,
  CASE WHEN ps = 'ok' AND is_form AND n_form >= n_photos THEN 'Photo is form image|reject' WHEN ps = 'ok' AND is_form THEN 'Photo is form image|review' END,
  CASE WHEN pf AND mism AND tr THEN 'Crop mismatch|review' END, CASE WHEN pf AND flooded = 'yes' THEN 'Flooding seen|info' END,
  CASE WHEN pf AND crop = 'no' AND scene = 'field' AND tr THEN CASE WHEN crop_loss_pct <= 50 THEN 'No crop in photo|review' ELSE 'No crop in photo|info' END END,
  CASE WHEN pf AND scene = 'person-only' THEN 'Photo not of the field|review' WHEN pf AND scene = 'blurry-dark-irrelevant' THEN 'Photo not of the field|manual' END,
  CASE WHEN ps = 'ok' AND dups > 0 THEN 'Duplicate photos|info' END, CASE WHEN ps = 'ok' AND rotated THEN 'Photos rotated|info' END, CASE WHEN ps = 'ok' AND dist > 200 THEN 'Photo GPS mismatch|review' END,
  CASE WHEN pf AND (DATE '1996-06-15' < least(sd, ed) OR date_diff('day', greatest(sd, ed), DATE '1996-06-15') > 30) THEN 'Photo date outside survey period|review' END,
  CASE WHEN pf AND CASE WHEN damage IS NOT NULL THEN tr AND ((damage = 'healthy' AND crop_loss_pct >= 50) OR (damage = 'lodged' AND crop_loss_pct <= 10 AND affected_area_pct <= 10))
    WHEN field = 'standing crop' THEN crop_loss_pct >= 50 ELSE crop_loss_pct <= 10 END THEN 'Field state vs reported loss|review' END,
  CASE WHEN slr <> '' THEN 'Same location|review' END, CASE WHEN slv <> '' THEN 'Same app entry at same spot|review' END, CASE WHEN sugg <> 'OK' THEN 'GPS cluster|review' END,
  CASE WHEN l_partkey % 12 = 0 THEN 'Data: Possible duplicate field|' || CASE WHEN slr <> '' OR slv <> '' OR sugg <> 'OK' THEN 'info' ELSE 'review' END END, CASE WHEN l_partkey % 12 = 1 THEN 'Data: Duplicate record|review' END,
  CASE WHEN rscore >= 60 THEN 'High risk score (' || CAST(rscore AS BIGINT) || ')|review' END
], lambda a: a IS NOT NULL) AS found FROM x),
g AS (SELECT *, list_transform(found, lambda a: split_part(a, '|', 1)) AS flags, list_transform(found, lambda a: split_part(a, '|', 2)) AS levels FROM f),
h AS (SELECT *, CASE WHEN list_contains(levels, 'reject') OR list_contains(levels, 'manual') THEN 'Manual QC Required' WHEN list_contains(levels, 'review') THEN 'Review' WHEN list_contains(levels, 'partial') THEN 'Partially OK' ELSE 'OK' END AS verdict,
  CASE WHEN fs IN ('no_link', 'not_found') OR ps IN ('no_link', 'error') OR list_contains(levels, 'reject') OR list_contains(levels, 'manual') OR (fs = 'ok' AND fc < 0.6) THEN 'Low'
    WHEN list_contains(levels, 'review') OR (fs = 'ok' AND fc < 0.8) OR fs = 'skipped' THEN 'Medium' ELSE 'High' END AS confidence FROM g)
"""


@query("v_evaluate", _FOUND + "SELECT pos, array_to_string(flags, ', ') AS flags, verdict, confidence, mt AS match, va AS f_area, vl AS f_loss FROM h")
def v_evaluate(spark, sf_dir):
    """Flags in their order, verdict, confidence, form values and match."""
    out = evaluate.evaluate(readings(spark, sf_dir))
    return out.select("pos", F.array_join("flags", ", ").alias("flags"), "verdict", "confidence", "match", "f_area", "f_loss")


_COUNTERS = "map([" + ", ".join(f"'{k}'" for k in evaluate.COUNTERS) + "], [" + ", ".join(f"'{v}'" for v in evaluate.COUNTERS.values()) + "])"


@query("v_counters", _FOUND + f", c AS (SELECT DISTINCT pos, {_COUNTERS}[unnest(flags)] AS counter FROM h) SELECT counter, count(*) AS records FROM c WHERE counter IS NOT NULL GROUP BY counter")
def v_counters(spark, sf_dir):
    """Live counters."""
    return report.marks(evaluate.evaluate(readings(spark, sf_dir)), "counters", "counter").groupBy("counter").agg(F.count(F.lit(1)).alias("records"))


@query("v_remarks")
def v_remarks(spark, sf_dir):
    """The short and the long remark of each record."""
    return evaluate.evaluate(readings(spark, sf_dir)).select("pos", "remark", "remark_detail", F.array_join("tags", ", ").alias("tags"))


@query("p_main")
def p_main(spark, sf_dir):
    """The assembled main columns."""
    return assemble.main_columns(assemble.assemble(evaluate.evaluate(readings(spark, sf_dir)), detail=False))


@query("a_overall", _FOUND + """, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE verdict = 'OK') AS a, count(*) FILTER (WHERE verdict = 'Partially OK') AS b, count(*) FILTER (WHERE verdict = 'Review') AS c, count(*) FILTER (WHERE verdict = 'Manual QC Required') AS d,
  count(*) FILTER (WHERE mt = 'Match') AS m, count(*) FILTER (WHERE mt = 'Mismatch') AS mm FROM h)
SELECT item, rows, CASE WHEN n = 0 THEN 0 ELSE round_even(100.0E0 * rows / n, 1) END AS pct FROM (
  SELECT n, unnest(['Rows checked', 'OK', 'Partially OK', 'Review', 'Manual QC Required', 'Form vs app: Match', 'Form vs app: Mismatch', 'Form vs app: not comparable (value not read)']) AS item, unnest([n, a, b, c, d, m, mm, n - m - mm]) AS rows FROM t)""")
def a_overall(spark, sf_dir):
    """Totals by verdict and match."""
    return report.overall(evaluate.evaluate(readings(spark, sf_dir)))


@query("a_issues", _FOUND + ", c AS (SELECT DISTINCT pos, unnest(flags) AS issue FROM h) SELECT issue, count(*) AS rows FROM c GROUP BY issue")
def a_issues(spark, sf_dir):
    """How many records have each flag."""
    return report.issues(evaluate.evaluate(readings(spark, sf_dir)), "flags").select("issue", "rows")


_PER = """ SELECT {k} AS {a}, count(*) AS rows, count(*) FILTER (WHERE verdict = 'OK') AS ok, count(*) FILTER (WHERE verdict = 'Partially OK') AS partially_ok, count(*) FILTER (WHERE verdict = 'Review') AS review, count(*) FILTER (WHERE verdict = 'Manual QC Required') AS manual,
  round_even(100.0E0 * count(*) FILTER (WHERE verdict = 'OK') / count(*), 1) AS ok_pct, count(*) FILTER (WHERE mt = 'Match') AS matches, count(*) FILTER (WHERE mt = 'Mismatch') AS mismatches,
  round_even(100.0E0 * count(*) FILTER (WHERE mt = 'Match') / nullif(count(*) FILTER (WHERE mt IN ('Match', 'Mismatch')), 0), 1) AS match_pct FROM h GROUP BY 1"""


@query("a_by_district", _FOUND + _PER.format(k="coalesce(district, 'Unknown')", a="district"))
def a_by_district(spark, sf_dir):
    """Verdicts by district."""
    return report.by_group(evaluate.evaluate(readings(spark, sf_dir)), "district").drop("same_spot")


@query("a_by_surveyor", _FOUND + _PER.format(k="coalesce(surveyor_name, 'Unknown')", a="surveyor_name"))
def a_by_surveyor(spark, sf_dir):
    """Verdicts by surveyor."""
    return report.by_group(evaluate.evaluate(readings(spark, sf_dir)), "surveyor_name").drop("same_spot")
