"""Scalar expressions shared by all operators; columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import schema as S

GUID = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Null or only spaces."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) == ""


def void(c: Column | str) -> Column:
    """Blank, or a word that stands for nothing."""
    return F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))).isin("", "nan", "none", "nat")


def number(c: Column | str) -> Column:
    """The number a value holds; null if it holds none or NaN."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def general(c: Column | str) -> Column:
    """A number as ``%g`` writes it: six significant digits, no needless zeros,
    whole numbers without a point; ``?`` for null."""
    v = col(c).cast("double")
    size = F.abs(v)
    digits = F.greatest(F.lit(0), F.least(F.lit(20), F.lit(5) - F.floor(F.log10(F.when(size > 0, size))).cast("int")))
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(v, 6)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    few = F.when(digits >= 6, fixed).otherwise(F.regexp_replace(F.regexp_replace(_rounded(v, digits), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    whole = F.when(size < 1e15, v.cast("bigint").cast("string"))
    return F.when(v.isNull() | F.isnan(v), "?").when((v == F.floor(v)) & (size < 1e6), whole).otherwise(few)


def _rounded(v: Column, digits: Column) -> Column:
    out = F.format_string("%.0f", v)
    for k in range(1, 6):
        out = F.when(digits == k, F.format_string(f"%.{k}f", v)).otherwise(out)
    return out


def whole_or_general(c: Column | str) -> Column:
    """As :func:`general`, with whole numbers of any size in full."""
    v = col(c).cast("double")
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("bigint").cast("string")).otherwise(general(v))


def yes_no(c: Column | str) -> Column:
    """Yes or No of a tri-state; null stays null."""
    return F.when(col(c), "Yes").when(~col(c), "No")


_CLOCK = r"(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?.*)?\s*$"


def _stamp(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    def two(i: int) -> Column:
        return F.lpad(F.when(part(i) == "", "0").otherwise(part(i)), 2, "0")

    made = F.concat(part(year), F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(4), F.lit(":"), two(5), F.lit(":"), two(6))
    return F.when(part(year) != "", F.try_to_timestamp(made, F.lit("yyyy-MM-dd HH:mm:ss")))


def dates(c: Column | str) -> Column:
    """Timestamps of mixed date texts: year first as written, all else day
    first; month first only where day first is no date."""
    t = F.trim(col(c).cast("string"))
    iso = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _CLOCK
    own = r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})" + _CLOCK
    named = [F.try_to_timestamp(t, F.lit(f)) for f in ("d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMM d, yyyy")]
    return F.coalesce(_stamp(t, iso, 1, 2, 3), _stamp(t, own, 3, 2, 1), _stamp(t, own, 3, 1, 2), *named).cast("timestamp_ntz")


def form_date(c: Column | str) -> Column:
    """Dates as forms and stamps write them: ddMMyyyy, dd-MM-yyyy, dd/MM/yyyy,
    yyyy-MM-dd or dd.MM.yyyy, by the first characters."""
    t = F.trim(col(c).cast("string"))
    tries = [F.try_to_timestamp(F.when(F.substring(t, 1, n).rlike(shape), F.substring(t, 1, n)), F.lit(f)) for f, n, shape in (
        ("ddMMyyyy", 8, r"^\d{8}$"), ("dd-MM-yyyy", 10, r"^\d\d-\d\d-\d{4}$"), ("dd/MM/yyyy", 10, r"^\d\d/\d\d/\d{4}$"), ("yyyy-MM-dd", 10, r"^\d{4}-\d\d-\d\d$"), ("dd.MM.yyyy", 10, r"^\d\d\.\d\d\.\d{4}$"),
    )]
    return F.when(~void(c), F.coalesce(*tries)).cast("date")


def day_text(c: Column | str) -> Column:
    """A date as dd-MM-yyyy; a text that is none stays as it is."""
    return F.coalesce(F.date_format(form_date(c), "dd-MM-yyyy"), F.when(~blank(c), col(c).cast("string")))


def urls(c: Column | str) -> Column:
    """Links of a cell, parted by white space, commas or semicolons."""
    text = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"_x000D_", " ")
    return F.filter(F.split(text, r"[\s,;]+"), lambda x: x.startswith("http"))


def guids(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(GUID), 1), F.lower)


def path_tokens(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"[^A-Za-z0-9]+"), lambda x: x != "")


def decimals(c: Column | str) -> Column:
    """Digits behind the point of a number's shortest form; 0 for null and for
    exponent notation."""
    t = col(c).cast("double").cast("string")
    return F.when(t.isNull() | t.contains("E"), 0).otherwise(F.length(F.regexp_extract(t, r"\.(\d+)$", 1)))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two places on the sphere."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * S.EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def degrees_of_dms(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Signed degrees of degrees, minutes and seconds; south and west are negative."""
    v = d + m / 60 + s / 3600
    return F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)


def values_match(form_area: Column, form_loss: Column, app_area: Column, app_loss: Column) -> Column:
    ok = (F.abs(form_area - app_area) <= S.AREA_TOLERANCE) & (F.abs(form_loss - app_loss) <= S.LOSS_TOLERANCE)
    return F.when(ok, "Match").when(~ok, "Mismatch").otherwise("NA")


def media_type(content: Column | str) -> Column:
    """Type of a file by its first bytes."""
    h = F.hex(F.substring(col(content), 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
        .when(h.startswith("25504446"), "application/pdf")
        .when(h.startswith("504B0304"), "application/zip")
        .otherwise("")
    )


def clean_label(c: Column | str) -> Column:
    """A label in lower case; blanks and texts over 40 characters are none."""
    t = F.trim(col(c).cast("string"))
    return F.when((t != "") & (F.length(t) <= 40), F.lower(t))


def cell_value(c: Column | str, limit: int = 32_000) -> Column:
    """A text fit for a sheet: control characters go, length is bounded."""
    return F.substring(F.regexp_replace(col(c).cast("string"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), 1, limit)


def json_object(c: Column | str) -> Column:
    """The JSON object in a reply: fences go, else from the first to the last brace."""
    t = F.trim(F.regexp_replace(F.trim(col(c)), r"(?m)^```(?:json)?|```$", ""))
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(t).isNotNull(), t).when(F.try_parse_json(inner).isNotNull(), inner)


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def hash_bucket(c: Column, buckets: int) -> Column:
    """A stable bucket by the first 32 bits of the md5."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
