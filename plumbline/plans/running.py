"""Queries of labelled texts, running and judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.operators import monitor
from plumbline.plans.catalogue import query, survey
from plumbline.sources.survey import table

_LINES = """lines AS (SELECT l_orderkey AS k, l_linenumber AS no, l_partkey AS p, l_quantity::BIGINT AS q, (l_tax * 100)::BIGINT AS t, l_shipdate AS d FROM lineitem)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_tax") * 100).cast("long").alias("t"), F.col("l_shipdate").alias("d"))


@query("f_labelled_numbers", _LINES + """ SELECT k, no, p, CASE WHEN no = 6 THEN NULL WHEN no = 3 AND q * 3 > 100 THEN NULL WHEN no = 3 THEN q * 3.0E0 WHEN no = 5 THEN q + 0.5E0 ELSE q * 1.0E0 END AS area, CASE WHEN no = 4 THEN NULL ELSE t * 1.0E0 END AS loss,
  CASE WHEN no % 2 = 0 THEN strftime(d, '%d%m%Y') END AS day FROM lines""")
def f_labelled_numbers(spark, sf_dir):
    """percentages and dates after their labels: own line, line below, Hindi labels and digits, none."""
    q, t, no = F.col("q").cast("string"), F.col("t").cast("string"), F.col("no")
    hindi = F.translate(q, "0123456789", "०१२३४५६७८९")
    area = (
        F.when(no == 1, F.array(F.concat(F.lit("Affected  Area (%): "), q), F.lit("2. remarks 7")))
        .when(no == 2, F.array(F.concat(F.lit("प्रभावित क्षेत्र "), hindi)))
        .when(no == 3, F.array(F.concat(F.lit("AREA AFFECTED "), (F.col("q") * 3).cast("string"))))
        .when(no == 4, F.array(F.lit("affected area"), F.concat(q, F.lit(" percent"))))
        .when(no == 5, F.array(F.lit("affected area"), F.concat(F.lit("area affected "), q, F.lit(",5"))))
        .when(no == 6, F.array(F.lit("area"), q))
        .otherwise(F.array(F.lit("x"), F.concat(F.lit("affected area no "), q)))
    )
    loss = F.when(no == 4, F.lit("loss")).when(no == 2, F.lit("फसल की क्षति")).otherwise(F.concat(F.lit("Crop Loss % - "), t))
    below = F.when(no == 2, t).otherwise(F.lit("end"))
    day = F.when(no % 2 == 0, F.date_format("d", "'Date of Survey :' d / M - yyyy")).otherwise(F.date_format("d", "'Date of birth' dd-MM-yyyy"))
    lines = F.concat(area, F.array(loss, below, day))
    return _lines(spark, sf_dir).select("k", "no", "p", L.labelled_number(lines, L.AREA_LABELS).alias("area"), L.labelled_number(lines, L.LOSS_LABELS).alias("loss"), L.labelled_date(lines).alias("day"))


@query("f_assembled_dates", _LINES + """ SELECT k, no, p, CASE no WHEN 4 THEN NULL WHEN 5 THEN strftime(d, '%d%m') || '202' || (year(d) % 10) WHEN 6 THEN strftime(d, '%d%m') || '2026' WHEN 7 THEN NULL WHEN 3 THEN strftime(d, '%d%m') || '20' || right(strftime(d, '%Y'), 2) ELSE strftime(d, '%d%m%Y') END AS day FROM lines WHERE strftime(d, '%d%m') <> '2902'""")
def f_assembled_dates(spark, sf_dir):
    """dates from groups of digits, with years of one to four digits and days that are none."""
    no, d = F.col("no"), lambda form: F.date_format("d", form)
    groups = (
        F.when(no == 1, F.array(d("d"), d("M"), d("yyyy"), F.lit("9")))
        .when(no == 2, F.array(d("ddMMyyyy")))
        .when(no == 3, F.array(d("ddMMyy")))
        .when(no == 4, F.array(d("ddMM"), d("yyyy")))
        .when(no == 5, F.array(d("dd"), d("MM"), F.right(d("yyyy"), F.lit(1))))
        .when(no == 6, F.array(d("d"), d("MM"), F.lit("026")))
        .otherwise(F.array(F.lit("31"), F.lit("2"), d("yyyy")))
    )
    # A leap day can be a day of one year and not of the next.
    return _lines(spark, sf_dir).filter(d("ddMM") != "2902").select("k", "no", "p", L.assembled_date(groups).alias("day"))


_HAS = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query("f_weak_labels", f"""said AS (SELECT l_orderkey AS k, l_linenumber AS no, l_partkey AS p, lower(trim(CASE l_linenumber WHEN 1 THEN ' All OK ' WHEN 2 THEN 'Famer sign ' || l_returnflag WHEN 3 THEN 'farmer mismatch, govt. missing' WHEN 4 THEN 'Surveyor ' || l_linestatus WHEN 5 THEN l_comment_ WHEN 6 THEN 'no form of company' ELSE NULL END)) AS t FROM (SELECT *, 'aao not there ' || l_linestatus AS l_comment_ FROM lineitem)),
flags AS (SELECT *, {_HAS(["farmer", "famer", "farmar"])} AS f, {_HAS(["surveyor", "company"])} AS c, {_HAS(["aao", "govt"])} AS a, {_HAS(["mismatch", "mis match"])} AS m, {_HAS(L.NO_LABEL)} AS s FROM said)
SELECT k, no, p, CASE WHEN t IS NULL THEN NULL WHEN t = 'all ok' THEN 1 WHEN s OR NOT (f OR c OR a) THEN NULL WHEN f THEN CASE WHEN m THEN NULL ELSE 0 END ELSE 1 END AS farmer, CASE WHEN t IS NULL THEN NULL WHEN t = 'all ok' THEN 1 WHEN s OR NOT (f OR c OR a) THEN NULL WHEN c THEN 0 ELSE 1 END AS company, CASE WHEN t IS NULL THEN NULL WHEN t = 'all ok' THEN 1 WHEN s OR NOT (f OR c OR a) THEN NULL WHEN a THEN 0 ELSE 1 END AS aao FROM flags""")
def f_weak_labels(spark, sf_dir):
    """what remarks say of signatures."""
    no = F.col("l_linenumber")
    said = F.when(no == 1, F.lit(" All OK ")).when(no == 2, F.concat(F.lit("Famer sign "), "l_returnflag")).when(no == 3, F.lit("farmer mismatch, govt. missing")).when(no == 4, F.concat(F.lit("Surveyor "), "l_linestatus")).when(no == 5, F.concat(F.lit("aao not there "), "l_linestatus")).when(no == 6, F.lit("no form of company"))
    out = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), no.alias("no"), F.col("l_partkey").alias("p"), L.weak_labels(said).alias("w"))
    return out.select("k", "no", "p", "w.farmer", "w.company", "w.aao")


_CROP_SQL = "CASE " + " ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in L.CROPS.items()) + " END"


@query("f_crop_and_form", f"""t AS (SELECT doc_id, lower(coalesce(text, '')) || CASE doc_id % 5 WHEN 0 THEN ' bajra' WHEN 1 THEN ' dhan kapas' WHEN 2 THEN ' patwar, fasal' WHEN 3 THEN ' crop loss  joint survey form' ELSE '' END AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[^a-z0-9]+'), lambda x: x <> '') AS words FROM t)
SELECT doc_id, {_CROP_SQL} AS crop, len(list_filter(words, lambda x: x IN ({", ".join(repr(x) for x in L.FORM_WORDS)}))) >= 2 OR regexp_matches(array_to_string(words, ' '), 'crop\\s*loss\\s*joint\\s*survey\\s*form') AS second_form FROM w""")
def f_crop_and_form(spark, sf_dir):
    """declared crops and the second form, over whole texts."""
    k = F.col("doc_id") % 5
    more = F.when(k == 0, " bajra").when(k == 1, " dhan kapas").when(k == 2, " patwar, fasal").when(k == 3, " crop loss  joint survey form").otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), more)
    return table(spark, sf_dir, "documents").select("doc_id", L.declared_crop(text).alias("crop"), L.is_second_form(text).alias("second_form"))


@query("f_costs_and_sizes", """SELECT l_orderkey AS k, l_linenumber AS no, l_partkey AS p, round((l_partkey * 3.0E0 + l_quantity * 15.0E0) / 1e6, 9) AS cost, CASE WHEN l_partkey * 8 >= 1024 THEN printf('%.1f GB', l_partkey * 8 / 1024.0E0) ELSE printf('%d MB', l_partkey * 8) END AS size, CASE WHEN l_suppkey * 500 >= 1000 THEN printf('%.1f km', l_suppkey * 500 / 1000.0E0) ELSE printf('%d m', l_suppkey * 500) END AS far FROM lineitem WHERE l_partkey % 64 = 0 OR l_partkey < 128""")
def f_costs_and_sizes(spark, sf_dir):
    """cost of tokens, sizes and distances as texts (sizes whose first place is no tie)."""
    rows = table(spark, sf_dir, "lineitem").filter("l_partkey % 64 = 0 or l_partkey < 128")
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("p"), F.round(L.token_cost(F.col("l_partkey"), F.col("l_quantity")), 9).alias("cost"), L.size_text(F.col("l_partkey") * 8).alias("size"), L.distance_text(F.col("l_suppkey") * 500).alias("far"))


@query("p_place", "SELECT pos FROM survey WHERE lower(trim(state)) = 'state' AND lower(trim(district)) = 'nation_3'")
def p_place(spark, sf_dir):
    """Records of one state and district."""
    return monitor.of_place(survey(spark, sf_dir), " STATE", "Nation_3").select("pos")


@query("a_class_report", """p AS (SELECT quality AS class, CASE WHEN toxic = 1 THEN 0 WHEN doc_id % 7 = 0 THEN NULL ELSE 1 END AS said FROM labels WHERE quality IS NOT NULL),
r AS (SELECT class, count(*) AS n, count(*) FILTER (WHERE said = class) AS hit FROM p GROUP BY class), s AS (SELECT said, count(*) AS predicted FROM p GROUP BY said)
SELECT r.class, n, coalesce(predicted, 0) AS predicted, round(hit * 1.0E0 / n, 9) AS recall, round(CASE WHEN predicted > 0 THEN hit * 1.0E0 / predicted END, 9) AS precision, round(avg(hit * 1.0E0 / n) OVER (), 9) AS balanced_accuracy FROM r LEFT JOIN s ON s.said = r.class""")
def a_class_report(spark, sf_dir):
    """Recall, precision and balanced accuracy of each class."""
    rows = table(spark, sf_dir, "labels").withColumn("said", F.when(F.col("toxic") == 1, 0).when(F.col("doc_id") % 7 == 0, None).otherwise(1))
    out = monitor.class_report(rows, "quality", "said")
    return out.select("class", "n", "predicted", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "balanced_accuracy")])


@query("a_wide_labels", "SELECT l_orderkey, " + ", ".join(f"min(CASE WHEN l_linenumber = {k} THEN l_returnflag END) AS l_linenumber_{k}" for k in range(1, 8)) + " FROM lineitem GROUP BY l_orderkey")
def a_wide_labels(spark, sf_dir):
    """Labels from one row a field to one row a record."""
    return monitor.wide_labels(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", list(range(1, 8)))


@query("a_estimate", """w AS (SELECT CASE WHEN pdf_url LIKE '%http%' THEN 1 ELSE 0 END AS f, least(len(list_filter(regexp_split_to_array(coalesce(media_urls, ''), '[\\s,;]+'), lambda x: starts_with(x, 'http'))), 10) AS ph FROM survey),
n AS (SELECT count(*) AS rows, sum(f + ph)::BIGINT AS files FROM w WHERE f = 1 OR ph > 0)
SELECT rows, files, round(greatest(rows * 3.0E0 / 8, files / 5.0E0), 6) AS seconds, round(rows * 3.2E0 / 1024, 6) AS output_mb, round(rows * 4.6E0 / 1024, 6) AS store_mb, round(rows * 1.45E0, 6) AS media_mb, ceil(rows / 1000.0E0)::BIGINT AS parts FROM n""")
def a_estimate(spark, sf_dir):
    """What a run over these records needs."""
    out = monitor.estimate(survey(spark, sf_dir), 8, part_rows=1000)
    return out.select("rows", "files", *[F.round(c, 6).alias(c) for c in ("seconds", "output_mb", "store_mb", "media_mb")], "parts")


@query("a_agents", "SELECT l_suppkey % 8 AS agent, count(*) AS rows_done, round(avg(l_quantity), 2) AS avg_sec, count(*) FILTER (WHERE l_returnflag = 'R') AS errors FROM lineitem GROUP BY 1")
def a_agents(spark, sf_dir):
    """Rows, seconds a row and errors of each worker."""
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.col("l_suppkey") % 8)
    return monitor.agents(rows, "a", "l_quantity", F.col("l_returnflag") == "R")


@query("t_latest", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC LIMIT 400")
def t_latest(spark, sf_dir):
    """The latest rows, as a monitor shows them (a top-n)."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    return monitor.latest(table(spark, sf_dir, "lineitem").select(*order), order, 400)


@query("m_without_noisy", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.88) FROM lineitem)")
def m_without_noisy(spark, sf_dir):
    """The rows that a second round of training keeps."""
    return monitor.without_noisy(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "l_extendedprice")


@query("k_unneeded", "SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')")
def k_unneeded(spark, sf_dir):
    """Cached files that no waiting record names."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), "l_returnflag")
    return monitor.unneeded(rows.select("path").distinct(), rows.filter("l_returnflag = 'N'"))
