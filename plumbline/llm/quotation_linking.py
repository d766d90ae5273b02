"""Chat formatting: quotations are linked to the messages they come from.

DataFrame functions only. Lines are parsed for nested quote levels, runs of one
level are passages, and normalised passages and lines are hashed and joined to
what earlier messages of the conversation said themselves. A message replies to
the turn that most of its outermost quotation comes from; replies inherit the
thread of what they reply to. The result holds every message without its
quotations, in the order in which the conversation reads: threads by their
first message, replies after it as they came.

Messages of one conversation and turn are one node of the reply graph. Long
conversations are not gathered: the join looks for the latest earlier message
within buckets of turns and across them, threads are found by pointer jumping
over the replies alone, and positions come from a range partitioning and
prefix sums over its partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm._tables import dropped, written

#: Turns of a bucket in the search for the latest earlier message.
BUCKET = 1_024
#: A line before a quotation that says whose it is.
ATTRIBUTION = r"(wrote|writes|schrieb|a écrit|escribió):\s*$"
#: Quote marks at the start of a line: the longest run of white space and marks
#: that ends in a mark. One class of characters, so that no line is too long.
_MARKS = r"^[ \t>]*>"
_WHITE = " \t\n\x0b\f\r"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def _lines_of(text: Column) -> Column:
    """level (how many marks) and body of each line; an attribution has level -1."""
    marked = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(
            F.length(F.translate(F.regexp_extract(x, _MARKS, 0), " \t", "")).alias("level"),
            F.regexp_replace(x, _MARKS + " ?", "").alias("body"),
        ),
    )
    return marked


def _attributed(lines: Column) -> Column:
    says = lambda x, i: (x["level"] == 0) & (F.get(lines, i + 1)["level"] > 0) & x["body"].rlike(ATTRIBUTION)
    return F.transform(lines, lambda x, i: F.struct(F.when(says(x, i), -1).otherwise(x["level"]).alias("level"), x["body"].alias("body")))


def _unit(said: Column, level: Column) -> Column:
    return F.struct(level.alias("level"), F.xxhash64(said).alias("unit"), F.length(said).alias("weight"))


def _units(lines: Column, level: Column) -> Column:
    """Units of lines of one level: all of them as one passage, and each line."""
    whole = F.array(normalised(F.array_join(F.transform(lines, lambda x: x["body"]), " ")))
    said = F.concat(whole, F.transform(lines, lambda x: normalised(x["body"])))
    return F.transform(F.filter(said, lambda x: x != ""), lambda x: _unit(x, level))


def parsed(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, own (the message without quotations, null where
    that is the text without white space around it), quoted and said (arrays of
    level, unit, weight; of what is quoted and of what the message says itself).

    Passages are put together within each row, so that only hashes of them are
    ever shuffled."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")
    )
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "\r", "")
    rows = rows.withColumn("lines", _lines_of(plain)).withColumn("lines", _attributed(F.col("lines")))
    lines = F.col("lines")
    level = lambda i: F.get(lines, i)["level"]
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (level(i) != level(i - 1))))
    ends = lambda k: F.coalesce(F.get("starts", k + 1), F.size(lines))
    passages = F.filter(F.transform("starts", lambda at, k: F.struct(at.alias("at"), ends(k).alias("end"))), lambda p: level(p["at"]) > 0)
    quoted = F.flatten(F.transform(passages, lambda p: _units(F.slice(lines, p["at"] + 1, p["end"] - p["at"]), level(p["at"]))))
    own = F.filter(lines, lambda x: x["level"] == 0)
    body = F.btrim(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), F.lit(_WHITE))
    return rows.select(
        "conv", "turn", "role", "text",
        F.when(F.exists(lines, lambda x: x["level"] != 0), body).alias("own"),
        F.array_distinct(quoted).alias("quoted"),
        F.array_distinct(_units(own, F.lit(0))).alias("said"),
    )


def quoted_units(messages: DataFrame) -> DataFrame:
    """conv, turn, level, unit, weight of what messages quote."""
    return messages.select("conv", "turn", F.explode("quoted").alias("x")).select("conv", "turn", "x.*").distinct()


def own_units(messages: DataFrame) -> DataFrame:
    """conv, turn, unit of what messages say themselves."""
    return messages.select("conv", "turn", F.explode("said").alias("x")).select("conv", "turn", "x.unit").distinct()


def linked(quoted: DataFrame, own: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``quoted`` with ``source``: the latest earlier turn of the conversation
    that says the unit itself, null where none does."""
    asked = quoted.select("conv", "unit").distinct()
    said = own.join(asked, ["conv", "unit"]).select("conv", "unit", "turn", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("weight"), F.col("turn").alias("own"))
    both = said.unionByName(quoted.select("conv", "unit", "turn", "level", "weight", F.lit(None).cast("long").alias("own")))
    both = both.withColumn("bucket", F.floor(F.col("turn") / bucket))
    near = Window.partitionBy("conv", "unit", "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("conv", "unit", "bucket").agg(F.max("own").alias("end"))
    before = Window.partitionBy("conv", "unit").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv", "unit", "bucket", F.max("end").over(before).alias("far"))
    placed = both.withColumn("near", F.max("own").over(near)).filter("level is not null").join(ends, ["conv", "unit", "bucket"])
    return placed.select("conv", "turn", "level", "unit", "weight", F.coalesce("near", "far").alias("source"))


def replies(links: DataFrame) -> DataFrame:
    """conv, turn, parent: the source of most of the outermost quotation that
    has one; of two, the later."""
    found = links.filter("source is not null")
    outer = found.groupBy("conv", "turn").agg(F.min("level").alias("level"))
    held = found.join(outer, ["conv", "turn", "level"]).groupBy("conv", "turn", "source").agg(F.sum("weight").alias("weight"))
    return held.groupBy("conv", "turn").agg(F.max(F.struct("weight", "source"))["source"].alias("parent"))


def threads(parents: DataFrame) -> DataFrame:
    """conv, turn, parent, root, depth of each reply, by pointer jumping: in
    each round a pointer passes over as many messages as in all before."""
    now = written(parents.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        up = now.select(F.col("conv"), F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = now.join(up, ["conv", "root"], "left")
        stepped = joined.select("conv", "turn", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        before, stepped = now, written(stepped, "replies")
        dropped(before)
        if stepped.filter("moved").isEmpty():
            return stepped.drop("moved")
        now = stepped.drop("moved")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, position (from 0 in each conversation), root_turn,
    depth, reply_to, n_quoted (units quoted), n_linked (of them, with a source),
    text without quotations: one row for each row of ``conversations``.

    Defined cases: a null text is empty; a null turn neither quotes nor is
    quoted and stands last; rows without conversation stand together and are
    not linked; repeated rows stay, next to each other; of equal places the
    order is by role and text; an empty table gives an empty one; other columns
    are not read.
    """
    messages = written(parsed(conversations), "messages")
    ordered = messages.filter("conv is not null and turn is not null")
    links = written(linked(quoted_units(ordered), own_units(ordered)), "quotations")
    counts = links.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_quoted"), F.count("source").alias("n_linked"))
    # Replies quote, so what is known of them has a row among the counts.
    known = counts.join(threads(replies(links)), ["conv", "turn"], "left")
    rows = messages.drop("quoted", "said").join(known, ["conv", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    order = [F.asc_nulls_last("root"), F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text")]
    ranged = written(rows.repartitionByRange(F.asc_nulls_last("conv"), *order).withColumn("pid", F.spark_partition_id()), "ranged")
    dropped(messages, links)
    before = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("conv", "pid").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv").alias("c"), F.col("pid").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = ranged.withColumn("row", F.row_number().over(Window.partitionBy("pid", "conv").orderBy(*order)) - 1)
    placed = numbered.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p")))
    plain = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", ""), F.lit(_WHITE))
    return placed.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        (F.col("first") + F.col("row")).alias("position"),
        F.col("root").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.col("parent").alias("reply_to"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("own", plain).alias("text"),
    )


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id AS conv, turn, role, text, row_number() OVER () AS msg, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS raw FROM conversations
), numbered AS (
  SELECT conv, turn, msg, no, raw[no + 1] AS line FROM base, range(len(raw)) AS r(no)
), marked AS (
  SELECT conv, turn, msg, no, len(regexp_replace(regexp_extract(line, '^([ \t]*>)+', 0), '[ \t]', '', 'g')) AS mark, regexp_replace(line, '^([ \t]*>)+ ?', '') AS body FROM numbered
), lines AS (
  SELECT *, CASE WHEN mark = 0 AND lead(mark) OVER (PARTITION BY msg ORDER BY no) > 0 AND regexp_matches(body, '(wrote|writes|schrieb|a écrit|escribió):\s*$') THEN -1 ELSE mark END AS level FROM marked
), own AS (
  SELECT msg, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g') AS own FROM lines GROUP BY msg
), runs AS (
  SELECT conv, turn, msg, level, no, body, CASE WHEN level = 0 THEN 0 ELSE no - row_number() OVER (PARTITION BY msg, level ORDER BY no) END AS run
  FROM lines WHERE level >= 0 AND conv IS NOT NULL AND turn IS NOT NULL
), said AS (
  SELECT conv, turn, level, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS unit FROM runs
  UNION
  SELECT conv, turn, level, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY no)), '\s+', ' ', 'g')) FROM runs GROUP BY conv, turn, msg, level, run
), links AS (
  SELECT q.conv, q.turn, q.level, q.unit, len(q.unit) AS weight, max(o.turn) AS source
  FROM said q LEFT JOIN said o ON o.level = 0 AND o.conv = q.conv AND o.unit = q.unit AND o.turn < q.turn
  WHERE q.level > 0 AND q.unit <> '' GROUP BY ALL
), held AS (
  SELECT conv, turn, source, sum(weight) AS weight FROM links l
  WHERE source IS NOT NULL AND level = (SELECT min(level) FROM links m WHERE m.conv = l.conv AND m.turn = l.turn AND m.source IS NOT NULL) GROUP BY ALL
), replies AS (
  SELECT conv, turn, source AS parent FROM held QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY weight DESC, source DESC) = 1
), walk AS (
  SELECT conv, turn, parent AS above, 1 AS depth FROM replies
  UNION ALL
  SELECT w.conv, w.turn, r.parent, w.depth + 1 FROM walk w JOIN replies r ON r.conv = w.conv AND r.turn = w.above
), roots AS (
  SELECT conv, turn, arg_max(above, depth) AS root, max(depth) AS depth FROM walk GROUP BY ALL
), counts AS (
  SELECT conv, turn, count(*) AS n_quoted, count(source) AS n_linked FROM links GROUP BY ALL
)
SELECT b.conv AS conv_id, b.turn, b.role,
  row_number() OVER (PARTITION BY b.conv ORDER BY coalesce(t.root, b.turn) NULLS LAST, b.turn NULLS LAST, b.role NULLS LAST, b.text NULLS LAST) - 1 AS position,
  coalesce(t.root, b.turn) AS root_turn, coalesce(t.depth, 0)::BIGINT AS depth, r.parent AS reply_to,
  coalesce(c.n_quoted, 0)::BIGINT AS n_quoted, coalesce(c.n_linked, 0)::BIGINT AS n_linked, o.own AS text
FROM base b JOIN own o USING (msg) LEFT JOIN roots t ON t.conv = b.conv AND t.turn = b.turn LEFT JOIN replies r ON r.conv = b.conv AND r.turn = b.turn LEFT JOIN counts c ON c.conv = b.conv AND c.turn = b.turn
"""
