"""Results as they come: idempotent store, resume, two-part records, live counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators import keys
from plumbline.operators.numbering import running_before


#: Parts of a store by a hash of the key; a batch rewrites those it touches.
BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, there = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(there)] if fs.exists(there) else []


def _versions(spark: SparkSession, path: str) -> dict[int, set[int]]:
    """The batches that are whole, each with the buckets it wrote."""
    batches = {int(n[6:]): _names(spark, f"{path}/{n}") for n in _names(spark, path) if n.startswith("batch-")}
    return {k: {int(n[7:]) for n in names if n.startswith("bucket=")} for k, names in batches.items() if "_SUCCESS" in names}


def read_store(spark: SparkSession, path: str, schema: str, below: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The rows of the store, each bucket by its latest batch (of those
    ``below`` a number, if given); empty before the first."""
    latest: dict[int, int] = {}
    for batch, own in sorted(_versions(spark, path).items()):
        if below is None or batch < below:
            latest |= dict.fromkeys(own, batch)
    paths = [f"{path}/batch-{k}/bucket={b}" for b, k in sorted(latest.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, path: str, schema: str, number: int) -> None:
    """Merges one batch: the buckets it touches are read as they were before
    this number and written under it, so a batch that is run again gives the
    same. What neither the batch before nor this one needs is deleted."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("row_key"), F.lit(BUCKETS)).cast("int")
    touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # BUCKETS at most
    if not touched:
        return
    merged = keys.upsert(read_store(spark, path, schema, number, touched), batch).withColumn("bucket", bucket)
    merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/batch-{number}")
    later: set[int] = set()
    for k, own in sorted(_versions(spark, path).items(), reverse=True):
        if k < number - 1:
            for b in own & later:
                fs, there = _folder(spark, f"{path}/batch-{k}/bucket={b}")
                fs.delete(there, True)
        # A replay of this number reads what was there before it.
        later |= own if k < number else set()


def upsert_stream(results: DataFrame, path: str, checkpoint: str, files_at_once: bool = True) -> StreamingQuery:
    """Merges a stream of (row_key, seq, done, ...) into a store."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema.fields)
    writer = results.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, path, schema, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if files_at_once else writer.trigger(processingTime="60 seconds")).start()


PARTS = "row_key string, form string, photo string, tries long, complete boolean"


def joined_parts(parts: DataFrame, most_tries: int = 2, timeout_ms: int = 180_000) -> DataFrame:
    """Form and photo readings (row_key, kind, payload, failed) as one row a
    record when both are there. A part that fails is waited for once more, each
    kind by its own count; a record whose time runs out comes with what it has."""
    kinds = ("form", "photo")

    def row(key: tuple, got: dict, tries: dict, complete: bool) -> pd.DataFrame:
        return pd.DataFrame([{"row_key": key[0], **got, "tries": sum(tries.values()), "complete": complete}])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (None, None, 0, 0)
        got, tries = dict(zip(kinds, before[:2])), dict(zip(kinds, before[2:]))
        if state.hasTimedOut:
            state.remove()
            yield row(key, got, tries, False)
            return
        for frame in frames:
            for kind, payload, failed in zip(frame["kind"], frame["payload"], frame["failed"]):
                tries[kind] += 1
                if not failed:
                    got[kind] = payload
                elif tries[kind] >= most_tries and got[kind] is None:
                    got[kind] = "error"
        if None not in got.values():
            state.remove()
            yield row(key, got, tries, True)
        else:
            state.update((*got.values(), *tries.values()))
            state.setTimeoutDuration(timeout_ms)

    known = parts.filter(F.col("kind").isin(*kinds))
    return known.groupBy("row_key").applyInPandasWithState(update, PARTS, "form string, photo string, form_tries long, photo_tries long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_counters(evaluated: DataFrame) -> DataFrame:
    """Counters over a stream of evaluated records."""
    return evaluated.select(F.explode("counters").alias("counter")).groupBy("counter").agg(F.count(F.lit(1)).alias("records"))


def throughput(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Records of 90 seconds, every 30 seconds, with late ones waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "90 seconds", "30 seconds")).agg(F.count(F.lit(1)).alias("records"))


def within_budget(costs: DataFrame, cap: float) -> DataFrame:
    """Rows whose costs before them, in the order of ``seq`` (which must not
    tie), stay below the cap. Range partitions and their sums, not one task."""
    spent = running_before(costs, [F.col("seq")], "cost", "_spent")
    return spent.filter(F.col("_spent") < cap).drop("_spent")


def rows_since(store: DataFrame, seq: int, most: int = 3_000) -> DataFrame:
    """The rows that came after ``seq``, the latest ``most`` of them."""
    return store.filter(F.col("seq") > seq).orderBy(F.desc("seq")).limit(most)
