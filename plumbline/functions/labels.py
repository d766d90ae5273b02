"""Expressions over text that was read from forms: labelled values, dates in
parts, kinds of form, weak labels (F21, F22, F28, F31, F33, F34, F36)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels before a value, English and Hindi (fixed values).
AREA_LABELS = [r"affected\s*area", r"area\s*affected", r"प्रभावित\s*क्षेत्र", r"क्षति\s*क्षेत्र", r"प्रभावित\s*रकबा"]
LOSS_LABELS = [r"crop\s*loss", r"loss\s*(?:of\s*crop)?\s*%", r"फसल\s*(?:की\s*)?(?:क्षति|हानि|नुकसान)", r"नुकसान"]
DATE_LABELS = [r"date\s*of\s*(?:survey|inspection)", r"survey\s*date", r"सर्वे\s*(?:की\s*)?तारीख", r"सर्वेक्षण\s*(?:की\s*)?दिनांक", r"दिनांक"]
#: Words of the second form, and how many of them make one (fixed values).
FORM_WORDS = (
    "gci girdhwar patwar generali fasal bima yojana pradhan prodhan mantri mantn insured tehsil localized calamity inundation landslide hailstorm surveyor "
    "intimations lasses losses farmer famer damage insurance crop harvest sowing sow1ng"
).split()
FORM_WORDS_LEAST, FORM_HEADER = 2, r"crop\s*loss\s*joint\s*survey\s*form"
#: Remarks that say nothing of a signature (fixed values).
NO_LABEL = ["not found", "not clear", "not crear", "link", "no doc", "no form", "blur", "no data", "not match", "not upload", "no field", "docket", "na", "-", "wrong", "crop"]
#: Short names of crops by what a crop's name holds, the first that fits (fixed values).
CROPS = {"cotton": "cotton", "kapas": "cotton", "pearl millet": "pearl millet", "bajra": "pearl millet", "green gram": "green gram", "moong": "green gram", "paddy": "paddy", "dhan": "paddy", "rice": "paddy"}
#: Price of a million tokens, read and written (fixed values).
PRICES = (3.0, 15.0)

_NUMBER = r"(\d{1,3}(?:[.,]\d{1,2})?)"


def plain_digits(c: Column) -> Column:
    """Devanagari digits as 0 to 9."""
    return F.translate(c, "०१२३४५६७८९", "0123456789")


def _percentage(text: Column, pattern: str) -> Column:
    v = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ".").try_cast("double")
    # In an array the value is found once, not for each comparison.
    return F.get(F.filter(F.array(v), lambda x: x.between(0, 100)), F.lit(0))


def labelled_number(lines: Column, labels: list[str]) -> Column:
    """The percentage after one of the labels: in the label's own line, of all
    lines first; else the first number of the line below it."""
    lines = F.transform(lines, plain_digits)
    after = lambda line: F.coalesce(*[_percentage(line, f"(?i){x}.*?{_NUMBER}") for x in labels])
    bare = lambda line, x: line.rlike(f"(?i){x}") & ~line.rlike(f"(?i){x}.*?\\d")
    below = lambda line, i: F.when(F.greatest(*[bare(line, x) for x in labels]), _percentage(F.get(lines, i + 1), _NUMBER))
    first = lambda found: F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))
    # One pattern of all labels goes first: most lines bear none of them.
    named = lambda line: line.rlike("(?i)" + "|".join(labels))
    return F.coalesce(first(F.transform(F.filter(lines, named), after)), first(F.transform(lines, lambda line, i: F.when(named(line), below(line, i)))))


def labelled_date(lines: Column) -> Column:
    """ddmmyyyy of the first line that bears a date's label and a date."""
    parts = r"(\d{1,2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{2,4})"

    def read(line: Column) -> Column:
        d, m, y = (F.regexp_extract(line, parts, k) for k in (1, 2, 3))
        year = F.when(F.length(y) == 4, y).otherwise(F.concat(F.lit("20"), y))
        return F.when(line.rlike("(?i)" + "|".join(DATE_LABELS)) & (d != ""), F.concat(F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), year))

    return F.get(F.filter(F.transform(F.transform(lines, plain_digits), read), lambda v: v.isNotNull()), F.lit(0))


def assembled_date(groups: Column) -> Column:
    """ddmmyyyy of groups of digits: the first three, or one of six or eight.
    Short years are of this century; three digits that end in 26 are 2026."""
    one = F.element_at(groups, 1)
    three = F.size(groups) >= 3
    whole = (F.size(groups) == 1) & F.length(one).isin(6, 8)
    part = lambda k, at, n: F.when(three, F.get(groups, F.lit(k))).when(whole, F.substring(one, at, n))
    d, m, y = part(0, 1, 2), part(1, 3, 2), part(2, 5, 4)
    n = F.length(y)
    year = F.when(n == 2, F.concat(F.lit("20"), y)).when(n == 1, F.concat(F.lit("202"), y)).when((n == 3) & y.endswith("26"), F.lit("2026")).otherwise(F.right(y, F.lit(4)))
    numbers = [x.try_cast("int") for x in (year, m, d)]
    # make_date raises for days that are not; a text that is no date gives null.
    there = F.to_char(numbers[0], F.lit("0000")), F.to_char(numbers[1], F.lit("00")), F.to_char(numbers[2], F.lit("00"))
    day = F.try_to_timestamp(F.regexp_replace(F.concat_ws("-", *there), " ", ""), F.lit("yyyy-MM-dd"))
    known = numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    return F.when(known, F.date_format(day, "ddMMyyyy"))


def is_second_form(text: Column) -> Column:
    """Whether a page's words are the second form's: its heading, or two of its words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.isin(*FORM_WORDS)))
    return (hits >= FORM_WORDS_LEAST) | F.array_join(words, " ").rlike(FORM_HEADER)


def weak_labels(remark: Column) -> Column:
    """struct(farmer, company, aao) of 1 for a signature that is there, 0 for one
    that is missing and null for one that is doubtful; null where a remark says
    nothing about them."""
    t = F.lower(F.trim(remark))
    has = lambda *words: F.greatest(F.lit(False), *[t.contains(w) for w in words])
    farmer, company, officer = has("farmer", "famer", "farmar"), has("surveyor", "company"), has("aao", "govt")
    doubt = has("mismatch", "mis match")
    labels = lambda f, c, a: F.struct(f.cast("int").alias("farmer"), c.cast("int").alias("company"), a.cast("int").alias("aao"))
    named = labels(F.when(~farmer, 1).when(~doubt, 0), F.when(company, 0).otherwise(1), F.when(officer, 0).otherwise(1))
    nothing = t.isNull() | t.isin("", "nan")
    return F.when(nothing, None).when(t.isin("yes", "ok", "all ok", "present"), labels(F.lit(1), F.lit(1), F.lit(1))).when(~has(*NO_LABEL) & (farmer | company | officer), named)


def declared_crop(name: Column) -> Column:
    """The short name of the crop that a record declares."""
    t = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(*[F.when(t.contains(k), F.lit(v)) for k, v in CROPS.items()])


def token_cost(read: Column, wrote: Column) -> Column:
    return (read * PRICES[0] + wrote * PRICES[1]) / 1e6


def size_text(mb: Column) -> Column:
    return F.when(mb >= 1024, F.format_string("%.1f GB", (mb / 1024).cast("double"))).otherwise(F.format_string("%.0f MB", mb.cast("double")))


def distance_text(metres: Column) -> Column:
    return F.when(metres >= 1000, F.format_string("%.1f km", (metres / 1000).cast("double"))).otherwise(F.format_string("%.0f m", metres.cast("double")))
