"""What is portable of reading forms and photos.

Readers of pixels are plugged in: a reader is a function of a pandas frame of
(docket, path) that returns rows of the schema's struct. What follows the
pixels (votes, gates, parsers, matching) is here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import functions as P
from plumbline import schema as S

#: Confidence of a form number by how many passes agree; passes that end a vote; the gate (fixed values).
VOTES, ENOUGH_VOTES, NUMBER_GATE = {1: 0.6, 2: 0.75, 3: 0.93, 4: 0.97, 5: 0.98}, 4, 0.9
#: Gates of cell readings (fixed values).
CELL_GATE, CELL_DISAGREE, CELL_AGREE, SEQUENCE_GATE = 0.85, 0.5, 0.5, 0.9
YEAR = 2026
#: Days that a field's date may fall on (fixed values).
WINDOWS = {"sow": (date(2026, 3, 1), date(2026, 9, 30)), "loss": (date(2026, 6, 1), date(2026, 12, 31)), "intim": (date(2026, 6, 1), date(2026, 12, 31)), "insp": (date(2026, 6, 1), date(2026, 12, 31))}


def first_near_hash(photos: DataFrame, most: int, docket: str = "docket", photo: str = "photo", hash_: str = "hash") -> DataFrame:
    """(docket, photo, duplicate_of): the first earlier photo of the docket whose
    64-bit hash differs in ``most`` bits at most."""
    a = photos.select(docket, F.col(photo), F.col(hash_).alias("_a"))
    b = photos.select(docket, F.col(photo).alias("_earlier"), F.col(hash_).alias("_b"))
    near = a.join(b, docket).filter((F.col("_earlier") < F.col(photo)) & (F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= most))
    return near.groupBy(docket, photo).agg(F.min("_earlier").alias("duplicate_of"))


def stamp_spread(photos: DataFrame, docket: str = "docket") -> DataFrame:
    """(docket, spread_m): the widest distance between a docket's stamps."""
    b = photos.select(docket, F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    return photos.join(b, docket).groupBy(docket).agg(F.max(P.haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))).alias("spread_m"))


def voted_number(reads: DataFrame, docket: str = "docket", order: str = "pass", value: str = "number") -> DataFrame:
    """(docket, number, votes, conf): the form number most passes agree on, up to
    the pass that brings any number to four; below the gate it is a hint only."""
    w = Window.partitionBy(docket)
    run = reads.filter(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(docket, value).orderBy(order)))
    run = run.withColumn("_stop", F.min(F.when(F.col("_k") >= ENOUGH_VOTES, F.col(order))).over(w)).filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))
    best = run.groupBy(docket, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    top = best.groupBy(docket).agg(F.max(F.struct("votes", F.negate("_first").alias("f"), F.col(value).alias("v"))).alias("b"))
    conf = F.lit(0.99)
    for n, c in VOTES.items():
        conf = F.when(F.col("b.votes") == n, c).otherwise(conf)
    return top.select(docket, F.when(conf >= NUMBER_GATE, F.col("b.v")).alias(value), F.col("b.v").alias("guess"), F.col("b.votes").alias("votes"), conf.alias("conf"))


def decided_value(total: Column, row: Column, sequence: Column | None = None) -> Column:
    """(value, conf) of a total and a row cell, each (value, conf, blank)."""
    there = lambda c: ~F.coalesce(c["blank"], F.lit(True)) & c["value"].isNotNull()
    t, r = there(total), there(row)
    pair = lambda v, c: F.struct(v.cast("double").alias("value"), c.cast("double").alias("conf"))
    strong = F.when(total["conf"] >= row["conf"], pair(total["value"], total["conf"])).otherwise(pair(row["value"], row["conf"]))
    none = pair(F.lit(None), F.lit(0.0))
    low = F.least(total["conf"], row["conf"])
    apart = t & r & (F.abs(total["value"] - row["value"]) > 0.01)
    one = lambda c: F.when(c["conf"] >= CELL_GATE, pair(c["value"], c["conf"])).otherwise(none)
    both = F.when(strong["conf"] >= CELL_GATE, strong).when(low >= CELL_AGREE, pair(total["value"], F.lit(0.9))).otherwise(none)
    out = F.when(apart, F.when((low < CELL_DISAGREE) & (strong["conf"] >= CELL_GATE), strong).otherwise(none)).when(t & r, both).when(t, one(total)).when(r, one(row)).otherwise(none)
    if sequence is not None:
        out = F.when(sequence["value"].isNotNull() & (sequence["conf"] >= SEQUENCE_GATE), pair(sequence["value"], sequence["conf"])).otherwise(out)
    return out


def form_number(text: Column | str) -> Column:
    """A form number in OCR text: exact, or with a misread second character or a dropped zero."""
    t = F.regexp_replace(P.col(text), " ", "")
    exact, loose = F.regexp_extract(t, r"(HR0126\d{6})", 1), F.regexp_extract(t, r"[H4K]R0?126(\d{6})", 1)
    return F.when(exact != "", exact).when(loose != "", F.concat(F.lit("HR0126"), loose))


def cell_number(text: Column | str) -> Column:
    """90%, 090 or 00 as a number up to 100; null for anything else."""
    t = F.regexp_replace(F.regexp_replace(P.col(text), "-", ""), "%+$", "")
    v = F.when(t.rlike(r"^\d{1,3}$"), t.try_cast("double"))
    return F.when(v <= 100, v)


def cell_class(v: Column) -> Column:
    """1 to 21 for 0, 5 ... 100; 22 for other values; null for none."""
    return F.when((v % 5 == 0) & v.between(0, 100), (v / 5).cast("int") + 1).when(v.isNotNull(), 22)


#: Degrees with their point, or digits that lost it after the second.
_DEGREES = re.compile(r"(?P<whole>\d{2,3})\.(?P<rest>[\d.]+)|(?P<bare>\d{2})(?P<tail>\d+)")


def coordinate(text: str | None, low: float, high: float) -> tuple[float | None, int]:
    """(degrees, places) of what a line says after its label; (None, 0) for
    fewer than three places or degrees beyond the bounds."""
    m = _DEGREES.fullmatch(re.sub(r"[^\d.]", "", text or "").strip("."))
    places = re.sub(r"\.", "", (m["rest"] or m["tail"]) if m else "")
    degrees = float(f"{m['whole'] or m['bare']}.{places}") if len(places) >= 3 else None
    return (degrees, len(places)) if degrees is not None and low <= degrees <= high else (None, 0)


def _said(line: str) -> str:
    """What stands after a line's label."""
    return re.sub(r"^(?:[^:]*:|[A-Za-z()]+)", "", line, count=1)


def _read_metres(line: str) -> dict:
    m = re.search(r"\d+(?:\.\d+)?", _said(line))
    return {"acc": float(m[0]) if m else None}


def _read_moment(line: str) -> dict:
    """Day of 2024 to 2027 as ddmmyyyy, and time of a twelve-hour clock."""
    m = re.search(r"(?P<day>\d{2}-\d{2}-20\d{2})(?:\s*(?P<clock>\d{1,2}:?\d{2}\s*(?:AM|PM)))?", line.replace("O", "0"))
    day = pd.to_datetime(m["day"], format="%d-%m-%Y", errors="coerce") if m else pd.NaT
    if pd.isna(day) or not 2024 <= day.year <= 2027:
        return {}
    clock = re.sub(r"[:\s]", "", m["clock"] or "").rjust(6, "0")
    time = pd.to_datetime(clock, format="%I%M%p", errors="coerce") if m["clock"] else pd.NaT
    return {"date": f"{day:%d%m%Y}", "time": None if pd.isna(time) else f"{time:%H:%M}"}


#: Fields of a stamp: what their line looks like, how it is read, whether a later line counts again.
_STAMP = [
    ("lat", re.compile(r"^.{0,2}lat|^(?!.*long).*itude", re.I), lambda line: {"lat": coordinate(_said(line), *S.LATITUDES)[0]}, False),
    ("lng", re.compile(r"^.{0,2}long|ngitude", re.I), lambda line: {"lng": coordinate(_said(line), *S.LONGITUDES)[0]}, False),
    ("acc", re.compile(r"acc", re.I), _read_metres, False),
    ("date", re.compile(r"[\dO]{2}-"), _read_moment, True),
]


def stamp_of(text: str) -> dict:
    """Latitude, longitude, accuracy, date (ddmmyyyy) and time of one stamp's
    text: each line goes to the first field that it looks like and that has no
    value yet."""
    out: dict = dict.fromkeys(("lat", "lng", "acc", "date", "time"))
    for line in map(str.strip, text.splitlines()):
        read = next((read for field, looks, read, again in _STAMP if looks.search(line) and (again or out[field] is None)), None)
        out |= {k: v for k, v in (read(line) if read else {}).items() if v is not None}
    return out


def stamp_blocks(text: str) -> list[str]:
    """OCR text of stacked stamps, one text each: a stamp starts at its latitude."""
    parts = re.split(r"^(?=[ \t]*lat)", text, flags=re.I | re.M)
    return [block for part in parts if (block := "\n".join(filter(str.strip, part.splitlines())))]


#: What the year 2026 is read as (fixed values); any two to four digits that end in 26 are as well.
_YEARS = ("26", "2026", "202", "026", "206", "20", "6")


def _is_year(y: str) -> bool:
    return y in _YEARS or (2 <= len(y) <= 4 and y.endswith("26"))


def _spells(groups: list[str], d: str, m: str) -> bool:
    """Whether groups of digits can be the day ``d``, the month ``m`` and a year,
    with up to two of the dashes between them lost."""
    if len(groups) > 2:
        return any(x == d and y == m and _is_year(z) for x, y, z in zip(groups, groups[1:], groups[2:]))
    digits = "".join(groups)
    rest = digits[len(d + m) :] if digits.startswith(d + m) else ""
    if not _is_year(rest):
        return False
    if len(groups) == 1:
        return len(rest) in (2, 4)
    after_day = groups[0] == d and 3 <= len(groups[1]) <= 6 and len(rest) >= 2
    after_month = groups[0] == d + m and len(rest) in (2, 4)
    return after_day or after_month or (len(digits) in (6, 8) and len(d + m) == 4)


def date_candidates(text: str, field: str | None = None) -> list[date]:
    """The days of the field's window that a read date can spell."""
    low, high = WINDOWS.get(field or "", (date(YEAR, 3, 1), date(YEAR, 12, 31)))
    groups = [p for p in text.replace(" ", "").split("-") if p]
    days = (low + timedelta(k) for k in range((high - low).days + 1)) if groups else ()
    forms = lambda n: {str(n), f"{n:02d}"}
    return [day for day in days if any(_spells(groups, d, m) for d in forms(day.day) for m in forms(day.month))]


def ctc_text(p: np.ndarray, separator: int = 11) -> tuple[str, list[float]]:
    """Greedy CTC: classes 0 blank, 1 to 10 digits, ``separator`` a dash."""
    best = p.argmax(1)
    edge = np.flatnonzero(np.diff(best, prepend=-1))
    stops = np.append(edge[1:], len(best))
    runs = [(int(best[a]), float(p[a:b, best[a]].max())) for a, b in zip(edge, stops) if best[a]]
    return "".join("-" if k == separator else str(k - 1) for k, _ in runs), [c for _, c in runs]


def ctc_loss(p: np.ndarray, digits: str) -> float:
    """-log probability of a digit string under CTC, by the forward sums."""
    marks = [0]
    for c in digits:
        marks += [int(c) + 1, 0]
    m = np.array(marks)
    logs = np.log(np.maximum(p, 1e-12))[:, m]
    skip = np.zeros(len(m), bool)
    skip[2:] = (m[2:] != 0) & (m[2:] != m[:-2])
    a = np.full(len(m), -np.inf)
    a[:2] = logs[0, :2]
    for t in range(1, len(p)):
        one = np.concatenate([[-np.inf], a[:-1]])
        two = np.where(skip, np.concatenate([[-np.inf, -np.inf], a[:-2]])[: len(m)], -np.inf)
        a = np.logaddexp(np.logaddexp(a, one), two) + logs[t]
    return float(-np.logaddexp(a[-1], a[-2]) if len(m) > 1 else -a[-1])


def best_row(rows: DataFrame, docket: str = "docket") -> DataFrame:
    """The row of each form that most likely holds the record's values."""
    return rows.groupBy(docket).agg(F.max_by("row", F.col("p_area") * F.col("p_loss")).alias("row"))


def read_with(jobs: DataFrame, reader: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs a plugged-in reader over batches of jobs; a batch that fails is read
    row by row, and a row that fails has ``_state`` error and ``_error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield reader(batch)
            except Exception:  # noqa: BLE001  a reader is foreign code
                for i in range(len(batch)):
                    one = batch.iloc[i : i + 1]
                    try:
                        yield reader(one)
                    except Exception as e:  # noqa: BLE001
                        yield pd.DataFrame({"docket": one["docket"], "_state": "error", "_error": f"{type(e).__name__}: {e}"})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0].strip("`") for c in schema.split(", ")]
        for out in run(batches):
            yield out.reindex(columns=names)

    return jobs.mapInPandas(whole, schema)
