"""Queries of keys, joins, sets, windows, scalar functions and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline import functions as P
from plumbline.operators import compare, keys, stats
from plumbline.operators.numbering import dealt
from plumbline.plans.catalogue import query, survey
from plumbline.sources.survey import table

_KEYED = """keyed AS (SELECT *, CASE WHEN docket_id IS NULL THEN 'none-' || pos ELSE docket_id END AS base FROM survey),
numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS no FROM keyed)"""


@query("w_row_keys", _KEYED + " SELECT pos, CASE WHEN no = 1 THEN base ELSE base || '#' || no END AS row_key FROM numbered WHERE docket_id IS NOT NULL")
def w_row_keys(spark, sf_dir):
    """Keys of rows; later rows of a docket get #2, #3."""
    return keys.with_row_keys(survey(spark, sf_dir)).filter("docket_id is not null").select("pos", "row_key")


@query("w_keys_without_docket")
def w_keys_without_docket(spark, sf_dir):
    """Hashed keys of rows without a docket."""
    return keys.with_row_keys(survey(spark, sf_dir)).filter("docket_id is null").select("pos", "row_key")


@query("j_resume", _KEYED + ", k AS (SELECT pos, CASE WHEN no = 1 THEN base ELSE base || '#' || no END AS row_key, l_linenumber FROM numbered WHERE docket_id IS NOT NULL) SELECT pos, row_key FROM k WHERE row_key NOT IN (SELECT row_key FROM k WHERE pos % 3 = 0) AND NOT l_linenumber = 2")
def j_resume(spark, sf_dir):
    """Rows that are neither in the store nor done in the input."""
    rows = keys.with_row_keys(survey(spark, sf_dir)).filter("docket_id is not null").withColumn("QC Done", F.when(F.col("l_linenumber") == 2, " true"))
    store = rows.filter("pos % 3 = 0").select("row_key", F.lit(True).alias("done"))
    return keys.to_do(rows, store, "`QC Done`").select("pos", "row_key")


@query("p_work_plan", "SELECT pos, kind FROM (SELECT pos, unnest(list_filter([CASE WHEN pdf_url LIKE 'http%' AND pos % 3 <> 0 THEN 'form' END, CASE WHEN media_urls LIKE 'http%' THEN 'photo' END], lambda x: x IS NOT NULL)) AS kind FROM survey WHERE pos % 5 <> 0)")
def p_work_plan(spark, sf_dir):
    """P10: forms and photos still to read."""
    rows = survey(spark, sf_dir).withColumn("row_key", F.col("pos").cast("string"))
    store = rows.filter("pos % 5 = 0 or pos % 3 = 0").select("row_key", (F.col("pos") % 5 == 0).alias("done"), F.when(F.col("pos") % 3 == 0, "OK").alias("pdf_status"), F.lit("Error").alias("photo_status"))
    plan = keys.work_plan(rows, store)
    return plan.select(F.col("row_key").cast("long").alias("pos"), "kind")


@query("j_lookup", "SELECT pos, CASE WHEN pos % 2 = 0 THEN 'new' WHEN pos % 7 = 0 THEN 'old' END AS verdict FROM survey")
def j_lookup(spark, sf_dir):
    """Results by key, else by the older key of place and docket."""
    rows = survey(spark, sf_dir).withColumn("row_key", F.concat(F.lit("k"), F.col("pos").cast("string")))
    old = F.concat_ws("|", F.col("pos").cast("string"), F.coalesce("docket_id", F.lit("None")))
    store = rows.filter("pos % 2 = 0").select("row_key", F.lit("new").alias("verdict")).unionByName(rows.filter("pos % 7 = 0").select(old.alias("row_key"), F.lit("old").alias("verdict")))
    return keys.looked_up(rows, store, ["verdict"]).select("pos", "verdict")


@query("k_upsert", "SELECT l_orderkey AS row_key, arg_max(l_linenumber, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 1000 + l_linenumber) AS seq, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS done FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def k_upsert(spark, sf_dir):
    """The latest result of each key; done is never undone."""
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey")
    rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f")).select(F.col("l_orderkey").alias("row_key"), F.col("l_linenumber").alias("seq"), (F.col("f") == "R").alias("done"))
    return keys.upsert(rows.filter("seq <= 3"), rows.filter("seq > 3"))


@query("w_first_of_key", "SELECT docket_id, min(pos) AS pos FROM survey WHERE docket_id IS NOT NULL GROUP BY 1")
def w_first_of_key(spark, sf_dir):
    """The first row of each docket."""
    return keys.first_of(survey(spark, sf_dir), "docket_id").select("docket_id", "pos")


@query("p_slice", "SELECT pos, no FROM (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS no FROM survey) WHERE no >= 100 AND no < 350")
def p_slice(spark, sf_dir):
    """A batch of rows, cut after what is computed over all."""
    from plumbline.operators.numbering import numbered

    return keys.slice_rows(numbered(survey(spark, sf_dir).select("pos"), [F.col("pos")], "no"), 100, 250).select("pos", "no")


@query("u_sets", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT 'first only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT 'any', count(DISTINCT l_partkey) FROM lineitem WHERE l_linenumber <= 2")
def u_sets(spark, sf_dir):
    """Intersection, difference and union of keys."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber")
    a, b = rows.filter("l_linenumber = 1").select("l_partkey"), rows.filter("l_linenumber = 2").select("l_partkey")
    n = F.count(F.lit(1)).alias("n")
    parts = {"both": a.intersect(b), "first only": a.join(b, "l_partkey", "left_anti").distinct(), "any": compare.strict_union([a, b]).distinct()}
    out = [df.agg(n).select(F.lit(k).alias("kind"), "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("w_hash_split", "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10 = 0 THEN 'eval' ELSE 'train' END AS role FROM orders")
def w_hash_split(spark, sf_dir):
    """A split by the md5 of the key."""
    return compare.split_by_hash(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "role")


@query("w_sample", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE r <= ceil(n * 0.1E0)")
def w_sample(spark, sf_dir):
    """A repeatable tenth of each group (sampling is the feature)."""
    return compare.sampled(table(spark, sf_dir, "orders"), "o_orderpriority", 0.1, "o_orderkey").select("o_orderkey")


@query("a_majority", "SELECT l_suppkey, l_shipmode_like AS flag, c AS votes FROM (SELECT l_suppkey, l_returnflag AS l_shipmode_like, count(*) AS c, min(l_orderkey) AS f, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, min(l_orderkey)) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def a_majority(spark, sf_dir):
    """The most frequent value of each group, ties to the one seen first."""
    return stats.majority(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "l_orderkey").select("l_suppkey", F.col("l_returnflag").alias("flag"), "votes")


@query("a_group_stats", "SELECT l_suppkey, median(l_extendedprice) AS med, round(stddev_samp(l_extendedprice), 4) AS sd, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(avg(l_quantity), 6) AS mean_quantity, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def a_group_stats(spark, sf_dir):
    """Size, median, deviation, distinct, mean, quantile."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.percentile("l_extendedprice", F.lit(0.5)).alias("med"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd"), F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"),
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.percentile("l_extendedprice", F.lit(0.9)), 4).alias("p90"),
    )


@query("w_rolling", "SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 90 SECONDS PRECEDING AND CURRENT ROW) AS last_90s FROM events")
def w_rolling(spark, sf_dir):
    """Events of the last 90 seconds (dealt by the half hour, with the part before)."""
    # A bucket also gets the events of the 90 s before it, so buckets are numbered apart.
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    width, reach = 1_800_000_000, 90_000_000
    events = table(spark, sf_dir, "events").select("event_id", us.alias("us"))
    own = events.withColumn("b", F.floor(F.col("us") / width)).withColumn("own", F.lit(True))
    after = events.withColumn("b", F.floor((F.col("us") + reach) / width)).filter(F.col("b") > F.floor(F.col("us") / width)).withColumn("own", F.lit(False))
    w = Window.partitionBy("b").orderBy("us").rangeBetween(-reach, 0)
    return own.unionByName(after).withColumn("last_90s", F.count(F.lit(1)).over(w)).filter("own").select("event_id", "last_90s")


@query("f_text", "SELECT page_id, len(regexp_extract_all(url, '[A-Za-z0-9]+')) AS tokens, len(string_split_regex(url, '[\\s,;]+')) AS links, md5(url) AS m, sha1(url) AS s FROM pages")
def f_text(spark, sf_dir):
    """links and tokens of a cell, hashes."""
    return table(spark, sf_dir, "pages").select("page_id", F.size(P.path_tokens("url")).alias("tokens"), F.size(P.urls("url")).alias("links"), F.md5("url").alias("m"), F.sha1("url").alias("s"))


@query("f_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d1, strftime(o_orderdate, '%Y-%m-%d') AS d2, strftime(o_orderdate, '%Y-%m-%d') AS d3, strftime(o_orderdate, '%d-%m-%Y') AS d4 FROM orders")
def f_dates(spark, sf_dir):
    """dates from year-first, day-first and packed texts."""
    t = lambda f: F.date_format("o_orderdate", f)
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", show(P.dates(t("yyyy-MM-dd"))).alias("d1"), show(P.dates(t("d/M/yyyy"))).alias("d2"), show(P.form_date(t("ddMMyyyy"))).alias("d3"), P.day_text(t("dd.MM.yyyy")).alias("d4"))


@query("f_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS q, len(split_part(CAST(l_discount AS VARCHAR), '.', 2)) AS places FROM lineitem")
def f_numbers(spark, sf_dir):
    """numbers as texts, digits behind the point."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", P.general("l_quantity").alias("q"), P.decimals("l_discount").alias("places"))


@query("f_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f_json(spark, sf_dir):
    """the JSON object in a fenced reply."""
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(P.json_object(fenced), "$.k").cast("long").alias("k"))


@query("j_compare", """ref AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 11 <> 0), t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source FROM documents WHERE doc_id % 13 <> 0),
j AS (SELECT d.doc_id, r.doc_id AS rd, t.doc_id AS td, r.lang AS rl, t.lang AS tl, r.source AS rs, t.source AS ts FROM documents d LEFT JOIN ref r USING (doc_id) LEFT JOIN t USING (doc_id)),
l AS (SELECT 'lang' AS "column", CASE WHEN rd IS NULL OR td IS NULL THEN 'M' WHEN rl = tl THEN 'A' ELSE 'D' END AS st FROM j UNION ALL SELECT 'source', CASE WHEN rd IS NULL OR td IS NULL THEN 'M' WHEN ts = '' THEN 'T' WHEN rs = ts THEN 'A' ELSE 'D' END FROM j)
SELECT "column", count(*) FILTER (WHERE st = 'A') AS "AGREE", count(*) FILTER (WHERE st = 'D') AS "DISAGREE", count(*) FILTER (WHERE st = 'T') AS "TEST_EMPTY", count(*) FILTER (WHERE st = 'M') AS "MISSING_ROW" FROM l GROUP BY 1""")
def j_compare(spark, sf_dir):
    """Two outputs against each other."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docket_id"), F.col("doc_id").alias("pos"), "lang", "source")
    ref = d.filter("pos % 11 <> 0")
    test = d.filter("pos % 13 <> 0").withColumns({"lang": F.when(F.col("pos") % 5 == 0, "xx").otherwise(F.col("lang")), "source": F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("source"))})
    out = compare.status_table(compare.compared(d, ref, test, {"lang": "cat", "source": "cat"}))
    return out.select("column", "AGREE", "DISAGREE", "TEST_EMPTY", "MISSING_ROW")


@query("a_accuracy", "SELECT lang, count(*) AS labelled, count(*) FILTER (WHERE d.doc_id % 4 <> 0) AS answered, round_even(100.0E0 * count(*) FILTER (WHERE d.doc_id % 4 <> 0) / count(*), 1) AS coverage_pct, round_even(100.0E0 * count(*) FILTER (WHERE d.doc_id % 4 <> 0 AND quality = toxic) / nullif(count(*) FILTER (WHERE d.doc_id % 4 <> 0), 0), 1) AS precision_pct, round_even(100.0E0 * count(*) FILTER (WHERE d.doc_id % 4 <> 0 AND quality = toxic) / count(*), 1) AS accuracy_pct FROM labels l JOIN documents d USING (doc_id) GROUP BY 1")
def a_accuracy(spark, sf_dir):
    """Coverage, precision and accuracy against labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    answer = F.when(F.col("doc_id") % 4 != 0, F.col("toxic"))
    return compare.accuracy(rows, ["lang"], F.col("quality"), answer, answer == F.col("quality"))


@query("j_feedback", "SELECT 'lang' AS field, count(*) AS compared, round_even(100.0E0 * avg(CASE WHEN doc_id % 5 = 0 THEN 0.0E0 ELSE 1.0E0 END), 1) AS agreement_pct, CAST(NULL AS DOUBLE) AS exact_pct FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'n_chars', count(*), round_even(100.0E0 * avg(CASE WHEN doc_id % 3 * 4 <= 5 THEN 1.0E0 ELSE 0.0E0 END), 1), round_even(100.0E0 * avg(CASE WHEN doc_id % 3 = 0 THEN 1.0E0 ELSE 0.0E0 END), 1) FROM documents WHERE doc_id % 2 = 0")
def j_feedback(spark, sf_dir):
    """Agreement of our fields with human ones."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docket_id"), F.col("doc_id").alias("pos"), "lang", "n_chars")
    human = d.filter("pos % 2 = 0").withColumns({"lang": F.when(F.col("pos") % 5 == 0, "other").otherwise(F.upper("lang")), "n_chars": F.col("n_chars") + F.col("pos") % 3 * 4})
    return compare.feedback(d, human, {"n_chars": 5.0}, ["lang"])[0]


@query("a_confusions", "SELECT 'lang' AS field, lang AS ours, 'other' AS human, count(*) AS count FROM documents WHERE doc_id % 10 = 0 GROUP BY lang ORDER BY count DESC, ours LIMIT 5")
def a_confusions(spark, sf_dir):
    """The most frequent confusions (a top-5 report)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docket_id"), F.col("doc_id").alias("pos"), "lang")
    human = d.filter("pos % 2 = 0").withColumn("lang", F.when(F.col("pos") % 5 == 0, "other").otherwise(F.upper("lang")))
    return compare.feedback(d, human, {}, ["lang"])[1]


@query("j_photo_pairs", "bits AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS b, vec_id // 6 AS docket FROM embeddings), p AS (SELECT a.vec_id AS later, b.vec_id AS earlier, list_sum(list_transform(list_zip(a.b, b.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS gap FROM bits a JOIN bits b ON a.docket = b.docket AND a.vec_id > b.vec_id) SELECT later, min(earlier) AS duplicate_of FROM p WHERE gap <= 24 GROUP BY 1")
def j_photo_pairs(spark, sf_dir):
    """The first earlier photo of the docket whose hash is near."""
    from plumbline.operators.perception import first_near_hash

    bits = F.aggregate(F.transform(F.slice("embedding", 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    photos = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("docket"), F.col("vec_id").alias("photo"), bits.alias("hash"))
    return first_near_hash(photos, 24).select(F.col("photo").alias("later"), "duplicate_of")
