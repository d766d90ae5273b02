"""Outputs against each other and against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import functions as P
from plumbline.operators.keys import first_of


def is_empty(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(P.col(c).cast("string"), F.lit("")))).isin("", "nan", "none", "na", "n/a", "-")


def docket(c: Column | str) -> Column:
    t = F.regexp_replace(F.trim(P.col(c).cast("string")), r"^'+", "")
    t = F.regexp_replace(F.trim(t), r"\.0$", "")
    return F.when(F.lower(t) != "nan", t).otherwise("")


def comparable(c: Column | str, kind: str) -> Column:
    """A value as it is compared: num, yn, date, text or cat; null if empty."""
    s = F.lower(F.trim(P.col(c).cast("string")))
    if kind == "num":
        digits = F.regexp_extract(F.regexp_replace(s, ",", "."), r"(\d+(?:\.\d+)?)", 1)
        v = F.when(digits != "", digits.try_cast("double").cast("string")).otherwise(s)
    elif kind == "yn":
        v = F.when(s.rlike("^(y|true|1|present)"), "yes").when(s.rlike("^(n|false|0|absent)"), "no").otherwise(s)
    elif kind == "date":
        v = F.coalesce(F.date_format(P.dates(s), "yyyy-MM-dd"), s)
    elif kind == "text":
        v = F.lit("filled")
    else:
        v = F.regexp_replace(s, r"\s+", " ")
    return F.when(~is_empty(c), v)


def compared(listed: DataFrame, ref: DataFrame, test: DataFrame, columns: dict[str, str], key: str = "docket_id") -> DataFrame:
    """(key, column, ref, test, status) for each listed docket and column:
    AGREE, DISAGREE, TEST_EMPTY, REF_EMPTY, BOTH_EMPTY or MISSING_ROW. Of a
    docket's rows the first counts on either side."""
    sides = {}
    for name, df in (("r", ref), ("t", test)):
        one = first_of(df.withColumn("_k", docket(key)), "_k")
        sides[name] = one.select("_k", F.lit(True).alias(f"_{name}_there"), *[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast("string").alias(f"_{name}_{i}") for i, c in enumerate(columns)])
    rows = listed.select(docket(key).alias("_k")).filter("_k <> ''").distinct().join(sides["r"], "_k", "left").join(sides["t"], "_k", "left")
    there = F.coalesce(F.col("_r_there") & F.col("_t_there"), F.lit(False))
    each = []
    for i, (c, kind) in enumerate(columns.items()):
        a, b = comparable(f"_r_{i}", kind), comparable(f"_t_{i}", kind)
        status = F.when(~there, "MISSING_ROW").when(a.isNull() & b.isNull(), "BOTH_EMPTY").when(b.isNull(), "TEST_EMPTY").when(a.isNull(), "REF_EMPTY").when(a == b, "AGREE").otherwise("DISAGREE")
        each.append(F.struct(F.lit(c).alias("column"), F.col(f"_r_{i}").alias("ref"), F.col(f"_t_{i}").alias("test"), status.alias("status")))
    return rows.select(F.col("_k").alias(key), F.explode(F.array(*each)).alias("x")).select(key, "x.*")


STATUSES = ["AGREE", "DISAGREE", "TEST_EMPTY", "REF_EMPTY", "BOTH_EMPTY", "MISSING_ROW"]


def status_table(detail: DataFrame) -> DataFrame:
    """Counts of each status by column, and shares answered and agreed."""
    out = detail.groupBy("column").pivot("status", STATUSES).agg(F.count(F.lit(1))).fillna(0)
    both = F.col("AGREE") + F.col("DISAGREE")
    return out.withColumns({"answered_pct": F.bround(100 * both / F.greatest(F.lit(1), both + F.col("TEST_EMPTY")), 1), "agreement_pct": F.bround(100 * F.col("AGREE") / F.greatest(F.lit(1), both), 1)})


def feedback(ours: DataFrame, human: DataFrame, numeric: dict[str, float], labels: list[str], key: str = "docket_id") -> tuple[DataFrame, DataFrame]:
    """(field, compared, agreement_pct, exact_pct) and the five most frequent
    confusions of each label, of dockets that both have."""
    a, h = first_of(ours, key), first_of(human, key)
    both = a.select(key, *[F.col(f"`{c}`").alias(f"a_{i}") for i, c in enumerate([*numeric, *labels])]).join(h.select(key, *[F.col(f"`{c}`").alias(f"h_{i}") for i, c in enumerate([*numeric, *labels])]), key)
    each = []
    for i, c in enumerate([*numeric, *labels]):
        if c in numeric:
            x, y = P.number(f"a_{i}"), P.number(f"h_{i}")
            each.append(F.struct(F.lit(c).alias("field"), (F.abs(x - y) <= numeric[c]).alias("agree"), (F.abs(x - y) < 1e-9).alias("exact"), F.lit(None).cast("string").alias("ours"), F.lit(None).cast("string").alias("human")))
        else:
            x, y = P.clean_label(f"a_{i}"), P.clean_label(f"h_{i}")
            each.append(F.struct(F.lit(c).alias("field"), (x == y).alias("agree"), F.lit(None).cast("boolean").alias("exact"), x.alias("ours"), y.alias("human")))
    long = both.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    ok = F.col("agree").isNotNull()
    table = long.groupBy("field").agg(F.count_if(ok).alias("compared"), F.bround(100 * F.avg(F.col("agree").cast("double")), 1).alias("agreement_pct"), F.bround(100 * F.avg(F.col("exact").cast("double")), 1).alias("exact_pct"))
    wrong = long.filter(~F.col("agree") & F.col("ours").isNotNull()).groupBy("field", "ours", "human").agg(F.count(F.lit(1)).alias("count"))
    rank = Window.partitionBy("field").orderBy(F.desc("count"), "ours", "human")
    return table, wrong.withColumn("r", F.row_number().over(rank)).filter("r <= 5").drop("r")


def needs_correction(df: DataFrame, ours: DataFrame, columns: list[str], key: str = "docket_id") -> DataFrame:
    """``df`` with 1 where a label differs from ours, 0 where none does, null
    where the docket is not in ours."""
    one = first_of(ours, key).select(key, F.lit(True).alias("_there"), *[F.col(f"`{c}`").alias(f"_o_{i}") for i, c in enumerate(columns)])
    differs = F.lit(False)
    for i, c in enumerate(columns):
        differs = differs | F.coalesce(P.clean_label(f"`{c}`") != P.clean_label(f"_o_{i}"), F.lit(False))
    joined = df.join(one, key, "left")
    return joined.withColumn("needs_correction", F.when(F.col("_there"), differs.cast("int"))).select(*df.columns, "needs_correction")


def accuracy(rows: DataFrame, by: list[str], label: Column, answer: Column, right: Column) -> DataFrame:
    """(by, labelled, answered, coverage, precision, accuracy with abstentions)."""
    n, ans, ok = F.count(label), F.count_if(label.isNotNull() & answer.isNotNull()), F.count_if(label.isNotNull() & answer.isNotNull() & right)
    pct = lambda a, b: F.bround(100 * a / F.when(b > 0, b), 1)
    return rows.groupBy(*by).agg(n.alias("labelled"), ans.alias("answered"), pct(ans, n).alias("coverage_pct"), pct(ok, ans).alias("precision_pct"), pct(ok, n).alias("accuracy_pct"))


def gate_sweep(rows: DataFrame, gates: list[float], confidence: str, label: Column, answer: Column) -> DataFrame:
    """Coverage and precision at each gate of confidence."""
    each = rows.withColumn("gate", F.explode(F.array(*[F.lit(g) for g in gates])))
    held = F.when(F.col(confidence) >= F.col("gate"), answer)
    return accuracy(each, ["gate"], label, held, held == label)


def strict_union(frames: list[DataFrame]) -> DataFrame:
    """Batches put together; their headers must be the same, in one order."""
    for f in frames[1:]:
        if f.columns != frames[0].columns:
            raise ValueError(f"headers differ: {frames[0].columns} and {f.columns}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def repeats(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def override(human: DataFrame, app: DataFrame, key: str, value: str) -> DataFrame:
    """Human values before the app's; ids of either."""
    return human.select(key, F.col(value).alias("_h")).join(app.select(key, F.col(value).alias("_a")), key, "full").select(key, F.coalesce("_h", "_a").alias(value))


def split_by_hash(df: DataFrame, key: str, held: int = 10) -> DataFrame:
    """``role``: eval for one bucket of ``held``, by the md5 of the key."""
    return df.withColumn("role", F.when(P.hash_bucket(F.col(key).cast("string"), held) == 0, "eval").otherwise("train"))


def sampled(df: DataFrame, by: str, share: float, key: str) -> DataFrame:
    """A repeatable share of each group, by the md5 of the key."""
    w = Window.partitionBy(by)
    order = w.orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumns({"_r": F.row_number().over(order), "_n": F.count(F.lit(1)).over(w)}).filter(F.col("_r") <= F.ceil(F.col("_n") * share)).drop("_r", "_n")
