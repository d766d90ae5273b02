"""Local files of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import functions as P


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind): forms (pdf) and photos (image) below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return files.select("path", rel.alias("rel"), F.when(ext == ".pdf", "pdf").when(ext.isin(".jpg", ".jpeg", ".png", ".webp"), "image").alias("kind")).filter("kind is not null")


def matched(files: DataFrame, df: DataFrame) -> DataFrame:
    """(docket_id, kind, path): by a GUID of the record's links in the path, else
    by a part of the path that is the docket (the last one first), else by the
    file's or folder's whole name; letter case does not matter."""
    known = df.filter(~P.blank("docket_id")).select(F.trim("docket_id").alias("docket_id"), "pdf_url", "media_urls")
    links = known.select("docket_id", F.explode(P.guids(F.concat_ws(" ", "pdf_url", "media_urls"))).alias("key"))
    links = links.groupBy("key").agg(F.max("docket_id").alias("docket_id"))
    names = known.select(F.lower("docket_id").alias("key"), "docket_id").groupBy("key").agg(F.max("docket_id").alias("docket_id"))
    stem = F.regexp_replace("rel", r"\.[^./]*$", "")
    tokens = F.posexplode(P.path_tokens(stem))
    whole = F.array(F.element_at(F.split(stem, "/"), -1), F.get(F.split(stem, "/"), F.size(F.split(stem, "/")) - 2))
    keys = (
        files.select("path", F.lit(1).alias("stage"), F.posexplode(P.guids("rel")).alias("at", "key"))
        .unionByName(files.select("path", F.lit(2).alias("stage"), tokens.alias("at", "key")).withColumns({"key": F.lower("key"), "at": -F.col("at")}))
        .unionByName(files.select("path", F.lit(3).alias("stage"), F.posexplode(whole).alias("at", "key")).withColumn("key", F.lower("key")))
    )
    hits = keys.filter("stage = 1").join(links, "key").unionByName(keys.filter("stage > 1").join(names, "key"))
    best = Window.partitionBy("path").orderBy("stage", "at")
    return hits.withColumn("_r", F.row_number().over(best)).filter("_r = 1").join(files.select("path", "kind"), "path").select("docket_id", "kind", "path")
