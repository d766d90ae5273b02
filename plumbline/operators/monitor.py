"""Running and judging: filters, estimates, agents, models, latest rows
(P6, A26 to A28, A30, M7, M11, T6, T8, K15, K17, P21)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import functions as P

#: Measured needs of a row (fixed values): core seconds; MB of media; KB of store, workbook and csv; photos read at most.
CORE_SECONDS, MEDIA_MB, STORE_KB, XLSX_KB, CSV_KB, MOST_PHOTOS = 3.0, 1.45, 4.6, 0.9, 2.3, 10


def of_place(df: DataFrame, state: str | None = None, district: str | None = None) -> DataFrame:
    """Records of a state and a district, in any case; None asks for all."""
    for column, wanted in (("state", state), ("district", district)):
        if wanted is not None:
            df = df.filter(F.lower(F.trim(column)) == wanted.strip().lower())
    return df


def column_like(columns: list[str], *names: str) -> str | None:
    """The first column whose letters and digits are a name's, or else begin with one."""
    bare = lambda x: re.sub(r"[\W_]", "", x.lower())
    wanted = tuple(map(bare, names))
    return next((c for c in columns if bare(c) in wanted), None) or next((c for c in columns if bare(c).startswith(wanted)), None)


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, n, predicted, recall, precision, balanced_accuracy) of each true
    class; a class that is never predicted has no precision. Counts of pairs
    first, so one row a pair of classes is what is joined."""
    pairs = df.filter(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("class"), F.col(predicted).alias("said")).agg(F.count(F.lit(1)).alias("c"))
    own = pairs.groupBy("class").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("class").eqNullSafe(F.col("said")), F.col("c")).otherwise(0)).alias("hit"))
    said = pairs.groupBy(F.col("said").alias("class")).agg(F.sum("c").alias("predicted"))
    out = own.join(said, "class", "left").withColumn("recall", F.col("hit") / F.col("n")).withColumn("precision", F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")))
    mean = out.agg(F.avg("recall").alias("balanced_accuracy"))
    return out.crossJoin(F.broadcast(mean)).select("class", "n", F.coalesce("predicted", F.lit(0)).alias("predicted"), "recall", "precision", "balanced_accuracy")  # one row


def wide_labels(df: DataFrame, key: str, field: str, value: str, fields: list) -> DataFrame:
    """Labels of one row a field as one row a key; of several values the least."""
    return df.groupBy(key).agg(*[F.min(F.when(F.col(field) == x, F.col(value))).alias(f"{field}_{x}") for x in fields])


def estimate(df: DataFrame, cores: int, rate: float = 5.0, part_rows: int = 0) -> DataFrame:
    """One row: records with work, files to fetch, hours at ``cores`` and at
    ``rate`` files a second, MB of outputs, of the store and of media."""
    form = F.coalesce(F.col("pdf_url").contains("http"), F.lit(False))
    photos = F.least(F.size(P.urls("media_urls")), F.lit(MOST_PHOTOS))
    work = df.select(form.cast("int").alias("form"), photos.alias("photos")).filter("form = 1 or photos > 0")
    total = work.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("form") + F.col("photos")), F.lit(0)).alias("files"))
    n = F.col("rows")
    seconds = F.greatest(n * CORE_SECONDS / max(1, cores), F.col("files") / rate)
    written = n * (XLSX_KB + (CSV_KB if part_rows else 0.0)) / 1024
    return total.select("rows", "files", seconds.alias("seconds"), written.alias("output_mb"), (n * STORE_KB / 1024).alias("store_mb"), (n * MEDIA_MB).alias("media_mb"), (F.ceil(n / part_rows) if part_rows else F.lit(1)).cast("long").alias("parts"))


def agents(events: DataFrame, agent: str, seconds: str, failed: Column) -> DataFrame:
    """(agent, rows_done, avg_sec, errors): what each worker has done so far."""
    return events.groupBy(F.col(agent).alias("agent")).agg(F.count(seconds).alias("rows_done"), F.round(F.avg(seconds), 2).alias("avg_sec"), F.count_if(failed).alias("errors"))


def latest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows along ``order``: a top-n, not a sort of all."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def reading_order(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with forms (pdf) first, then by path."""
    return files.withColumn("_form", F.lower(F.col(path)).endswith(".pdf")).orderBy(F.desc("_form"), path).drop("_form")


def without_noisy(df: DataFrame, loss: str, keep: float = 0.88) -> DataFrame:
    """Rows whose loss is within the ``keep`` quantile; the rest are taken for
    wrong labels. Equal losses are counted first, which is what the quantile
    is taken from."""
    counted = df.filter(F.col(loss).isNotNull()).groupBy(F.col(loss).alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
    bound = counted.agg(F.expr(f"percentile(_v, {keep}, _w)").alias("_bound"))
    return df.crossJoin(F.broadcast(bound)).filter(F.col(loss) <= F.col("_bound")).drop("_bound")  # one row


def unneeded(cached: DataFrame, waiting: DataFrame, path: str = "path") -> DataFrame:
    """Cached files that no record still waits for."""
    return cached.join(waiting.select(path).distinct(), path, "left_anti")


def failures(df: DataFrame, failed: Column) -> DataFrame:
    """(docket, file, url, reason) of what could not be fetched, as it is listed."""
    return df.filter(failed).select("docket", "file", "url", "reason").orderBy("docket", "file")


@dataclass(frozen=True)
class Holdout:
    """What a model does on rows it was not fitted on."""

    cells: int
    answered: int
    correct: int

    @property
    def precision(self) -> float:
        return self.correct / max(1, self.answered)


def adopts(new: Holdout, old: Holdout, enough: float = 0.95, slack: float = 0.01) -> bool:
    """Whether a new model takes the old one's place: as many right answers at
    least, and as precise but for ``slack`` or precise ``enough``."""
    return new.correct >= old.correct and new.precision >= min(enough, old.precision - slack)


def holdout(df: DataFrame, truth: str, value: str) -> Holdout:
    known = df.filter(F.col(truth).isNotNull())
    return Holdout(*known.agg(F.count(F.lit(1)), F.count(value), F.count_if(F.abs(F.col(value) - F.col(truth)) < 1e-6)).first())
