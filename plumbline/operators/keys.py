"""Row keys, resume and the result store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import functions as P
from plumbline.operators.numbering import dealt
from plumbline.operators.rules import spread_nulls

IDENTIFYING = ["application_no", "farmer_name", "khasra_number", "division_number", "village", "latitude", "longitude", "pdf_url", "media_urls"]


def with_row_keys(df: DataFrame, name: str = "row_key") -> DataFrame:
    """A key that survives filters and reordering: the docket, or a hash of what
    identifies a record without one; later rows of a key get #2, #3 and so on."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in IDENTIFYING if c in df.columns]
    base = F.when(P.blank("docket_id"), F.concat(F.lit("nodocket-"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))).otherwise(F.trim(F.col("docket_id").cast("string")))
    out = df.withColumn("_base", base)
    no = F.row_number().over(Window.partitionBy("_base").orderBy("pos"))
    return out.withColumn("_no", no).withColumn(name, F.when(F.col("_no") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("#"), F.col("_no").cast("string")))).drop("_base", "_no")


def is_done(c: Column | str) -> Column:
    """Whether a prior output says that a row is done."""
    return F.upper(F.trim(P.col(c).cast("string"))).isin("TRUE", "YES", "Y", "1")


def upsert(store: DataFrame, new: DataFrame, key: str = "row_key", order: str = "seq") -> DataFrame:
    """The latest row of each key of both; what is done is never replaced by
    what is not."""
    both = dealt(store.unionByName(new), key)
    latest = Window.partitionBy(key).orderBy(F.desc("done"), F.desc(order))
    return both.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")


def import_legacy(store: DataFrame, legacy: DataFrame, key: str = "row_key") -> DataFrame:
    """The store with legacy results of keys that it has not finished."""
    return store.filter(~F.col("done")).join(legacy.select(key), key, "left_anti").unionByName(store.filter("done")).unionByName(legacy.join(store.filter("done").select(key), key, "left_anti"))


def looked_up(df: DataFrame, store: DataFrame, payload: list[str]) -> DataFrame:
    """Results by row key, else by the older key of place and docket; of several
    results of one key the greatest, so that no record is multiplied."""
    one = store.groupBy("row_key").agg(F.max(F.struct(*payload)).alias("_p")).select("row_key", *[F.col(f"_p.{c}").alias(c) for c in payload])
    old = F.concat_ws("|", F.col("pos").cast("string"), F.coalesce("docket_id", F.lit("None")))
    first = one.select("row_key", *[F.col(c).alias(f"_a_{c}") for c in payload])
    second = one.select(F.col("row_key").alias("_old"), *[F.col(c).alias(f"_b_{c}") for c in payload])
    out = df.withColumn("_old", old).join(first, "row_key", "left").join(second, "_old", "left")
    return out.select(*df.columns, *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in payload])


def to_do(df: DataFrame, store: DataFrame, prior: str | None = None) -> DataFrame:
    """Rows that neither the store nor the input's own column says are done."""
    left = df.join(store.filter("done").select("row_key"), "row_key", "left_anti")
    return left.filter(~F.coalesce(is_done(prior), F.lit(False))) if prior else left


def work_plan(df: DataFrame, store: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """(row_key, kind): forms and photos to read: a link or a local file is
    there, and the kind's earlier status is none or Error."""
    kinds = []
    # A key is one row: done if any says so, and read if any status is not Error.
    best = lambda c: F.coalesce(F.max(F.when(F.col(c) != "Error", F.col(c))), F.max(c)).alias(c)
    status = store.groupBy("row_key").agg(F.max("done").alias("done"), best("pdf_status"), best("photo_status"))
    joined = df.join(status, "row_key", "left")
    files = media.groupBy("docket_id").agg(F.max((F.col("kind") == "pdf").cast("int")).alias("_pdf"), F.max((F.col("kind") == "image").cast("int")).alias("_img")) if media is not None else None
    if files is not None:
        joined = joined.join(files, "docket_id", "left")
    for kind, link, column, file in (("form", "pdf_url", "pdf_status", "_pdf"), ("photo", "media_urls", "photo_status", "_img")):
        there = F.size(P.urls(link)) > 0
        if files is not None:
            there = there | F.coalesce(F.col(file) == 1, F.lit(False))
        kinds.append(F.when(there & (F.col(column).isNull() | (F.col(column) == "Error")), F.lit(kind)))
    return joined.filter(~F.coalesce("done", F.lit(False))).select("row_key", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def slice_rows(df: DataFrame, offset: int, limit: int | None, order: str = "no") -> DataFrame:
    """Rows of a batch, after whatever was computed over all rows."""
    out = df.filter(F.col(order) >= offset)
    return out if limit is None else out.filter(F.col(order) < offset + limit)


def first_of(df: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """The first row of each key; rows without one are left out."""
    w = Window.partitionBy(key).orderBy(order)
    return df.filter(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


__all__ = ["with_row_keys", "is_done", "upsert", "import_legacy", "looked_up", "to_do", "work_plan", "slice_rows", "first_of", "spread_nulls"]
