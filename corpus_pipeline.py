"""The corpus pipeline: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before
kept, and returns a DataFrame; all but the last return the columns of
``documents``. :func:`run` writes each result as Parquet in the shared folder
and reads it back as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, language_id, packing, quality_nbsvm
from plumbline.llm._tables import written

#: A document stays if its quality score is this high at least, and if the
#: language that holds most of it is this sure.
QUALITY, LANGUAGE = 0.7, 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, by a model of ``labels``. Without labels of
    both classes there is nothing to tell by, and all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_nbsvm.fit(docs, labels)
    if not model.weight.any():
        return docs
    scored = quality_nbsvm.with_scores(docs, model, score_col="quality_score")
    return scored.filter(F.col("quality_score") >= QUALITY).select(*docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that ``lang`` of these documents names. Null and
    blank texts, those without a letter and those in other scripts go."""
    model = language_id.fit(docs)
    labelled = language_id.with_languages(docs, model)
    return labelled.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LANGUAGE)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), whatever
    its ids are: that of the smallest id, and of several rows with that id, or
    of a group without ids, the least by text. Texts without a word are in no
    group; of them only rows that repeat both id and text go."""
    found = jaccard_join.near_duplicates(docs, words=5, percent=80, keys=True).filter("doc <=> component_id")
    # Both keys of a row without a word: an id has fewer digits than an md5.
    group = F.coalesce(F.col("component_key").cast("string"), F.concat_ws(" ", F.lit("row"), "doc", "text_key"))
    first = written(found.groupBy(group.alias("_group"), "doc", "text_key").agg(F.count(F.lit(1)).alias("times")), "stay")
    stay = written(first.groupBy("_group").agg(F.sum("times").alias("times"), F.first("doc").alias("doc"), F.first("text_key").alias("text_key")), "stay")

    def rows_of(keys: DataFrame, how: str) -> DataFrame:
        return docs.join(keys, docs["doc_id"].eqNullSafe(keys["doc"]) & F.md5(docs["text"]).eqNullSafe(keys["text_key"]), how)

    kept = rows_of(stay.filter("times = 1"), "left_semi")
    again = stay.filter("times > 1").select("_group")
    if not again.isEmpty():
        order = ["text", *[c for c in docs.columns if c != "text"]]
        least = rows_of(first.join(again, "_group", "left_semi"), "inner").groupBy("_group").agg(F.min(F.struct(*[docs[c] for c in order])).alias("_row"))
        kept = kept.unionByName(least.select("_row.*"))
    return kept.select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_each_group),
    ("packing", pack_windows),
]

#: The classifiers and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
