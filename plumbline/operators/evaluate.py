"""One verdict a record from its form, photos, place, data flags and risk.

Everything is columns: findings are ordered conditions with a flag, a severity
and a headline; verdict, confidence, tags, counters and remarks derive from them,
each from no more than it says, so that verdicts make no texts.
A reading that is not there is null; what a reader is not sure of is never
turned into a value. Expects columns ``form`` and ``photo`` (see schema) beside
the canonical, location, rule and risk columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import functions as P
from plumbline import schema as S

#: Flags that count on the live board, and their counters (fixed values).
COUNTERS = {
    "Form not found": "form_not_found", "Form link missing": "missing_form_link", "Photo link missing": "missing_photo_link", "Photo is form image": "photo_is_form",
    "No crop in photo": "no_crop_in_photo", "Crop mismatch": "crop_mismatch", "Flooding seen": "flooded", "Photo not of the field": "photo_not_field",
    "Same location": "same_location", "Photo GPS mismatch": "gps_mismatch", "Signature missing": "signature_missing", "Form vs app mismatch": "mismatch",
    "Form overwrite": "overwrite", "Duplicate photos": "duplicate_photos", "Form not readable": "form_unreadable", "Not Proforma-3": "not_proforma3",
    "GPS cluster": "gps_cluster", "PO ID mismatch": "po_id_mismatch",
}
#: Tags as the short remark writes them (fixed values).
TAGS = {
    "Form link missing": "Form Link Missing", "Photo link missing": "Photo Link Missing", "Form not found": "Form Not Found", "Photos not found": "Photos Not Found",
    "Not Proforma-3": "Not Proforma-3 (Wrong Document)", "Form not readable": "Form Not Readable (Handwriting Unclear)",
    "Low confidence - manual review": "Low Confidence (Verify Manually)", "Signature missing": "Signature Missing",
    "Photo is form image": "Form Image Uploaded Instead of Field Photo", "Photo not of the field": "Wrong Photo (Not a Field Photo)",
    "Field state vs reported loss": "Photo vs Reported Loss Mismatch", "Crop mismatch": "Crop in Photo Differs from Declared Crop",
    "Form vs app mismatch": "Form & App Values Mismatch", "Flooding seen": "Flooding Visible in Photo", "Photo GPS mismatch": "Photo Location Differs from App GPS",
    "Photo date outside survey period": "Photo Date Outside Survey Period", "Same app entry at same spot": "Same Location (Possible Copied Entry)",
    "Same location": "Multiple Surveys at Same Spot", "GPS cluster": "Multiple Surveys at Same Spot", "Data: Possible duplicate field": "Same Land Record (Khasra) in Another Docket",
}
#: Data flags that the form and photo findings already say.
COVERED = ["Missing: signed form link", "Missing: photo links"]
PLACE = ["Same location", "GPS cluster", "Same app entry at same spot"]


@dataclass(eq=False)
class Finding:
    when: Column
    flag: str | Column
    level: str | None
    headline: str | Column | None = None

    def of(self, held: Column, what: str) -> Column:
        """The flag or the headline where ``held``, else null."""
        v = getattr(self, what)
        return F.when(held, v if isinstance(v, Column) else F.lit(v).cast("string"))


def _f(name: str) -> Column:
    return F.col(f"form.{name}")


def _p(name: str) -> Column:
    return F.col(f"photo.{name}")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def readable(value: Column, *names: str) -> Column:
    """A value that is there and not of low confidence: by the first confidence
    of these fields, else by the form's own."""
    known = F.coalesce(*[F.try_element_at(_f("field_conf"), F.lit(n)) for n in names])
    own = _f("confidence")
    return value.isNotNull() & F.when(known.isNotNull(), known >= S.LOW_FIELD_CONFIDENCE).otherwise(own.isNull() | (own >= S.LOW_CONFIDENCE))


def states(df: DataFrame) -> DataFrame:
    """``form_state`` and ``photo_state``: ok, no_link, not_found, error, skipped."""
    failed = _p("photo_status").isin("Unavailable", "Error")
    form = F.coalesce(_f("_state"), F.when(F.col("form").isNull() & P.void("pdf_url"), "no_link").when(F.col("form").isNull() | _f("_error").isNotNull(), "not_found").otherwise("ok"))
    photo = F.coalesce(_p("_state"), F.when(F.col("photo").isNull() & P.void("media_urls"), "no_link").when(F.col("photo").isNull() | _p("_error").isNotNull() | failed, "not_found").otherwise("ok"))
    return df.withColumns({"form_state": form, "photo_state": photo})


def form_values(df: DataFrame) -> DataFrame:
    """``f_area``, ``f_loss``, ``f_source`` and ``match``: total row, table row,
    a mixture of both, or the one of several rows that fits the record."""
    area, loss, r_area, r_loss = _f("form_area"), _f("form_loss"), _f("row_area"), _f("row_loss")
    ok = {"a": readable(area, "area", "form_area"), "l": readable(loss, "loss", "form_loss"), "ra": readable(r_area, "row_area", "area"), "rl": readable(r_loss, "row_loss", "loss")}
    pick = lambda a, l, s: F.struct(a.alias("area"), l.alias("loss"), F.lit(s).alias("source"))  # noqa: E731,E741
    app_area, app_loss = F.col("affected_area_pct"), F.col("crop_loss_pct")
    fits = F.filter(_f("raj_pairs"), lambda r: (F.abs(r["area"] - app_area) <= S.AREA_TOLERANCE) & (F.abs(r["loss"] - app_loss) <= S.LOSS_TOLERANCE))
    several = (_f("template") == "rajasthan") & (F.size(_f("raj_pairs")) > 0) & app_area.isNotNull() & app_loss.isNotNull()
    hit = several & (F.size(fits) > 0)
    usable = (F.col("form_state") == "ok") & (F.coalesce(_f("is_proforma3"), F.lit(True)))
    chosen = (
        F.when(usable & ok["a"] & ok["l"], pick(area, loss, "total row"))
        .when(usable & ok["ra"] & ok["rl"], pick(r_area, r_loss, "table row"))
        .when(usable & ok["a"] & ok["rl"], pick(area, r_loss, "mixed (total area, row loss)"))
        .when(usable & ok["ra"] & ok["l"], pick(r_area, loss, "mixed (row area, total loss)"))
        .when(usable & hit, pick(fits[0]["area"], fits[0]["loss"], "one of several rows"))
    )
    out = df.withColumn("_v", chosen)
    none = F.col("_v").isNull() & usable & several & ~hit & _yes(_f("raj_all_read"))
    inconsistent = (F.col("_v.source") == "total row") & ok["ra"] & ok["rl"] & ((F.abs(r_area - area) > 0.5) | (F.abs(r_loss - loss) > 0.5))
    match = F.when(_yes(none), "Mismatch").otherwise(P.values_match(F.col("_v.area"), F.col("_v.loss"), app_area, app_loss))
    out = out.withColumns({"f_area": F.col("_v.area"), "f_loss": F.col("_v.loss"), "f_source": F.col("_v.source"), "_no_row": _yes(none), "_uneven": _yes(inconsistent), "match": match})
    return out.drop("_v")


def _signatures() -> tuple[Column, Column]:
    """Missing signatures that matter, and all as the remark lists them."""
    raj = _f("template") == "rajasthan"

    def missing(pairs: list[tuple[str, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in pairs]))

    def listed(pairs: list[tuple[str, Column]], unsure: str) -> Column:
        each = [F.when(c, f"{n} Yes").when(~c, f"{n} NO").otherwise(f"{n} not assessed" if n == unsure else f"{n} not readable") for n, c in pairs]
        return F.concat(F.lit("Signatures: "), F.concat_ws(", ", *each), F.lit("."))

    own = [("farmer", _f("farmer_signed")), ("insurance company", _f("company_signed")), ("agriculture supervisor (AAO)", _f("officer_signed"))]
    usual = [("farmer", _f("farmer_signed")), ("company", _f("company_signed")), ("primary worker", _f("worker_signed")), ("block officer", _f("officer_signed"))]
    return F.when(raj, missing(own)).otherwise(missing(usual[:2])), F.when(raj, listed(own, own[2][0])).otherwise(listed(usual, "block officer"))


def findings(df: DataFrame) -> DataFrame:
    """Adds ``flags`` in their order, ``headlines``, whether there is a finding
    of each level, and the texts of the form and photo sections."""
    app_area, app_loss = F.col("affected_area_pct"), F.col("crop_loss_pct")
    fg, fl = P.whole_or_general("f_area"), P.whole_or_general("f_loss")
    ag, al = P.whole_or_general(app_area), P.whole_or_general(app_loss)
    form_ok = (F.col("form_state") == "ok") & F.coalesce(_f("is_proforma3"), F.lit(True))
    low = _yes(_f("confidence") < S.LOW_CONFIDENCE)
    missing, signed = _signatures()
    dates = {k: P.form_date(_f(k)) for k in ("sow_date", "loss_date", "intimation_date", "inspection_date")}
    start, end = P.form_date("survey_start_date"), P.form_date("survey_end_date")
    given = F.array_compact(F.array(*dates.values()))
    backwards = F.exists(F.sequence(F.lit(1), F.greatest(F.size(given) - 1, F.lit(1))), lambda i: F.coalesce(F.get(given, i) < F.get(given, i - 1), F.lit(False)))
    form_lost = F.col("form_state").isin("not_found", "error")
    photo_ok = F.col("photo_state") == "ok"
    n, n_form = F.coalesce(_p("n_photos"), F.lit(0)), F.coalesce(_p("n_form_photos"), F.lit(0))
    scene, state, damage = _p("scene_type"), _p("field_photo"), _p("damage_state")
    is_form = _yes(_p("photo_is_form")) | _yes(scene == "paper form")
    field = photo_ok & ~is_form
    trusted = _yes(_p("photo_conf") == "high") & F.coalesce(_p("photo_agree"), F.lit(True))
    unsure_crop = _yes(_p("crop_seen_conf") < S.LOW_FIELD_CONFIDENCE) | ~trusted
    absent = F.coalesce(_p("crop_present") == "no", state == "no crop", F.lit(False))
    own_scene = scene.isNull() | (scene == "field")
    modest = _yes(app_loss <= 50)
    stamp = P.form_date(F.coalesce(_p("stamp_date"), _p("photo_date")))
    outside = (stamp < F.least(start, end)) | (F.datediff(stamp, F.greatest(start, end)) > S.PHOTO_DAYS_AFTER)
    far = _p("stamp_dist_m")
    estimate = P.number(_p("photo_loss"))
    clash = (
        F.when(damage.isNotNull(), trusted & (((damage == "healthy") & (app_loss >= 50)) | (damage.isin("lodged", "submerged", "dried-burnt", "cut & spread", "partly damaged") & (app_loss <= 10) & (F.coalesce(app_area, F.lit(0.0)) <= 10))))
        .when((state == "standing crop") & (app_loss >= 50) & (estimate.isNull() | (estimate < app_loss - S.PHOTO_LOSS_GAP)), True)
        .otherwise(state.isin("no crop", "cut & spread") & (app_loss <= 10))
    )
    same_text = F.when(~P.void("Same_Location_Remark"), F.trim("Same_Location_Remark"))
    copied = F.coalesce(F.col("Same_Location_Values"), F.lit("")).contains("possible copied entry")
    suggested = F.coalesce(F.col("Suggested_Remark"), F.lit("OK"))
    cluster = suggested.startswith("Same Location") | suggested.startswith("Review")
    metres = F.concat(F.format_number(far, 0), F.lit(" m"))

    listed = [
        Finding(F.col("form_state") == "no_link", "Form link missing", "reject", "signed form link missing in the record"),
        Finding(form_lost, "Form not found", "manual", "signed form could not be retrieved"),
        Finding((F.col("form_state") == "ok") & ~_f("is_proforma3"), "Not Proforma-3", "reject", "uploaded form is not a Proforma-3 document"),
        Finding(form_ok & ~_f("po_id_matches"), "PO ID mismatch", "partial", "PO ID on the form differs from the docket"),
        Finding(form_ok & F.col("_no_row"), "Form vs app mismatch", "review", F.concat(F.lit("no row on the form equals the app values "), ag, F.lit("/"), al)),
        Finding(form_ok & F.col("f_area").isNull() & ~low, "Form not readable", "manual"),
        Finding(form_ok & F.col("f_area").isNotNull() & (F.col("match") == "Mismatch"), "Form vs app mismatch", "review", F.concat(F.lit("form "), fg, F.lit("/"), fl, F.lit(" vs app "), ag, F.lit("/"), al)),
        Finding(form_ok & F.col("_uneven"), "Form row/total inconsistent", "review"),
        Finding(form_ok & (dates["loss_date"] != start), "Form date differs from app", "partial"),
        Finding(form_ok & (dates["intimation_date"] != end), "Form date differs from app", "partial"),
        Finding(form_ok & backwards, "Form dates out of order", "partial"),
        Finding(form_ok & (F.size(missing) > 0), "Signature missing", None, F.concat(F.lit("signature missing: "), F.array_join(missing, ", "))),
        Finding(form_ok & _f("officer_stamp_only"), "Officer stamp only", "review"),
        Finding(form_ok & _f("overwrite_suspected"), "Form overwrite", "review", "overwriting suspected on the form"),
        Finding(form_ok & low, "Low confidence - manual review", "manual", "form reading confidence low"),
        Finding(F.col("photo_state") == "no_link", "Photo link missing", "reject", "no photo link in the record"),
        Finding(F.col("photo_state").isin("not_found", "error"), "Photos not found", "manual", "photos could not be retrieved"),
        Finding(photo_ok & is_form & ((n == 0) | (n_form >= n)), "Photo is form image", "reject", "photographs are pictures of the form, not the field"),
        Finding(photo_ok & is_form & (n > 0) & (n_form < n), "Photo is form image", "review", F.format_string("%d photo(s) are pictures of the form", n_form)),
        Finding(field & (F.coalesce(_p("crop_seen"), F.lit("")) != "") & ~_p("crop_matches_declared") & ~unsure_crop, "Crop mismatch", "review", "crop in the photo differs from the declared crop"),
        Finding(field & (_p("flooded") == "yes"), "Flooding seen", None),
        Finding(field & absent & own_scene & trusted & modest, "No crop in photo", "review", F.concat(F.lit("no crop visible but reported loss is only "), al, F.lit("%"))),
        Finding(field & absent & own_scene & trusted & ~modest, "No crop in photo", None),
        Finding(field & scene.isin("person-only", "house-road-sky-other"), "Photo not of the field", "review", "photo does not show the field"),
        Finding(field & (scene == "blurry-dark-irrelevant"), "Photo not of the field", "manual", "photos unusable (blurry/dark/irrelevant)"),
        Finding(photo_ok & (_p("n_duplicates") > 0), "Duplicate photos", None),
        Finding(photo_ok & _p("rotated"), "Photos rotated", None),
        Finding(photo_ok & (far > S.PHOTO_DISTANCE_M), "Photo GPS mismatch", "review", F.concat(F.lit("photo GPS "), metres, F.lit(" from app point"))),
        Finding(field & outside, "Photo date outside survey period", "review"),
        Finding(field & app_loss.isNotNull() & clash, "Field state vs reported loss", "review"),
        Finding(same_text.isNotNull(), "Same location", "review"),
        Finding(copied, "Same app entry at same spot", "review"),
        Finding(cluster, "GPS cluster", "review"),
    ]
    place = _yes(same_text.isNotNull() | copied | cluster)
    data = F.filter(F.transform(F.split(F.coalesce(F.col("Data_QC_Flags"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin(COVERED))
    score = F.col("Risk_Score")
    listed.append(Finding(score >= S.RISK_REVIEW, F.format_string("High risk score (%s)", F.bround(score).cast("bigint").cast("string")), "review"))
    held = {f"_c{i}": _yes(x.when) for i, x in enumerate(listed)}
    at = lambda x: F.col(f"_c{listed.index(x)}")
    of = lambda xs, what: F.array_compact(F.array(*[x.of(at(x), what) for x in xs]))
    any_ = lambda *levels: reduce(or_, [at(x) for x in listed if x.level in levels])
    # A shared field says no more than the place does, where there is one.
    told = F.size(F.when(F.col("_place"), F.filter("_data", lambda x: x != "Possible duplicate field")).otherwise(F.col("_data"))) > 0

    source = F.col("f_source")
    shown = F.concat(F.lit(" affected area "), fg, F.lit("% / loss "), fl, F.lit("%"))
    value_text = F.concat(
        F.when(source == "total row", F.concat(F.lit("Form total"), shown))
        .when(source.startswith("mixed"), F.concat(F.lit("Form area "), fg, F.lit("% / loss "), fl, F.lit("% ("), source, F.lit(")")))
        .when(source == "one of several rows", F.concat(F.format_string("One of the %d rows on the form shows", F.size(_f("raj_pairs"))), shown))
        .when(_f("template") == "rajasthan", F.concat(F.lit("Form row shows"), shown))
        .otherwise(F.concat(F.lit("Form total row not usable; table row shows"), shown)),
        F.when(app_area.isNull() | app_loss.isNull(), " (app values missing)").when(F.col("match") == "Match", " = app (Match)").otherwise(F.concat(F.lit(" vs app "), ag, F.lit("% / "), al, F.lit("% (Mismatch)"))),
        F.lit("."),
    )
    number_text = F.concat(
        F.when(readable(_f("form_no"), "form_no"), F.concat(F.lit("Form No "), _f("form_no"))).when(_f("template") == "rajasthan", "Form No not applicable (Rajasthan form)").otherwise("Form No not readable"),
        F.when(_f("po_id_matches"), "; PO ID matches docket").when(~_f("po_id_matches"), "; PO ID does NOT match docket").otherwise(""),
        F.lit("."),
    )
    dmy = lambda d: F.date_format(d, "dd-MM-yyyy")
    names = {"sow_date": "sowing", "loss_date": "loss", "intimation_date": "intimation", "inspection_date": "inspection"}
    date_text = F.when(F.size(given) > 0, F.concat(F.lit("Dates on form: "), F.concat_ws(", ", *[F.concat(F.lit(names[k] + " "), dmy(d)) for k, d in dates.items()]), F.when(F.size(given) < 4, F.format_string(" (%d other date(s) not readable)", 4 - F.size(given))).otherwise(""), F.lit(".")))
    form_text = (
        F.when(F.col("form_state") == "no_link", "No signed-form link in the record, so the form could not be checked.")
        .when(form_lost, F.concat(F.lit("Signed form could not be retrieved"), F.coalesce(F.concat(F.lit(" ("), _f("_error"), F.lit(")")), F.lit("")), F.lit(" - check the link / download manually.")))
        .when((F.col("form_state") == "ok") & ~_f("is_proforma3"), F.concat(F.lit("Uploaded form is not a Proforma-3 document"), F.coalesce(F.concat(F.lit(" (image quality: "), _f("quality"), F.lit(")")), F.lit("")), F.lit(".")))
        .when(form_ok, F.concat_ws(
            " ",
            F.when(_f("quality") != "good", F.concat(F.lit("Form image quality: "), _f("quality"), F.lit("."))),
            number_text,
            F.when(F.col("f_area").isNull(), "Affected area % / loss % not readable on the form.").otherwise(value_text),
            F.when(F.col("_uneven"), F.concat(F.lit("Table row shows "), P.whole_or_general(_f("row_area")), F.lit("% / "), P.whole_or_general(_f("row_loss")), F.lit("% but the total row shows "), fg, F.lit("% / "), fl, F.lit("% - inconsistent."))),
            F.when(_yes(_f("total_row_blank")) & (F.coalesce(source, F.lit("")) != "table row"), "Total row blank on form."),
            signed,
            date_text,
            F.when(_f("officer_stamp_only"), "Block officer block has a rubber stamp only (not a signature)."),
            F.when(_f("overwrite_suspected"), "Overwriting / cutting suspected on the form."),
            F.when(low, F.concat(F.lit("Form reading confidence low ("), F.format_string("%.2f", _f("confidence")), F.lit(")."))),
        ))
    )
    each, each_form = _p("person_each"), F.coalesce(_p("photo_is_form_each"), F.array().cast("array<boolean>"))
    numbered = F.transform(each, lambda x, i: F.struct((i + 1).alias("no"), F.coalesce(x, F.lit(False)).alias("person"), F.coalesce(F.get(each_form, i), F.lit(False)).alias("form")))
    seen = F.transform(F.filter(numbered, lambda x: x["person"] & ~x["form"]), lambda x: x["no"].cast("string"))
    plain = F.size(F.filter(numbered, lambda x: ~x["form"]))
    photo_text = (
        F.when(F.col("photo_state") == "no_link", "No photo link in the record.")
        .when(F.col("photo_state").isin("not_found", "error"), F.concat(F.lit("Photos could not be retrieved"), F.coalesce(F.concat(F.lit(" ("), _p("_error"), F.lit(")")), F.lit("")), F.lit(".")))
        .when(photo_ok, F.concat_ws(
            " ",
            F.when(is_form, F.concat(F.when((n > 0) & (n_form >= n), F.format_string("all %d", n)).when(n > 0, F.format_string("%d of %d", n_form, n)).otherwise("the"), F.lit(" uploaded photos are pictures of the paper form - no field photograph uploaded."))),
            F.when(~is_form, F.concat(
                F.when(n > 0, F.format_string("%d photo(s) analysed", n)).otherwise("Photos analysed"),
                F.coalesce(F.concat(F.lit("; scene: "), scene), F.lit("")),
                F.coalesce(F.concat(F.lit("; crop seen: "), _p("crop_seen"), F.when(unsure_crop, " (low confidence)").when(~_p("crop_matches_declared"), F.concat(F.lit(" - does NOT match declared crop "), F.coalesce("crop_name", F.lit("")))).otherwise(""), F.when(_p("crop_matches_declared"), " (matches declared crop)").otherwise("")), F.lit("")),
                F.when(_p("flooded") == "yes", F.when(trusted, "; flooding/waterlogging seen").otherwise("; possible flooding (low confidence - manual check)")).otherwise(""),
                F.coalesce(F.concat(F.when(trusted, "; damage state: ").otherwise("; possible damage state: "), damage), F.lit("")),
                F.coalesce(F.concat(F.lit("; field state: "), state, F.lit(" (heuristic)")), F.lit("")),
                F.lit("."),
            )),
            F.when(~is_form & (F.size(seen) > 0), F.concat(F.lit("Farmer available: person visible in photo "), F.array_join(seen, ", "), F.format_string(" of %d.", F.size(each)))),
            F.when(~is_form & (F.size(each) > 0) & (F.size(seen) == 0) & (plain > 0), F.format_string("Farmer not available: no person with at least 25%% of the body visible in the %d field photo(s).", plain)),
            F.when(_p("n_duplicates") > 0, F.format_string("%d duplicate photo(s) in this record.", _p("n_duplicates"))),
            F.when(_p("rotated"), "Photo(s) are rotated 90 degrees."),
            F.when(far > S.PHOTO_DISTANCE_M, F.concat(F.lit("GPS stamp "), metres, F.lit(f" from the app location (limit {S.PHOTO_DISTANCE_M} m)."))).when(far.isNotNull(), F.concat(F.lit("GPS stamp "), metres, F.lit(" from app."))).when(~is_form, "No readable GPS stamp on the photos."),
            F.when(~is_form & stamp.isNotNull(), F.concat(F.lit("Photo date "), dmy(stamp), F.when(_yes(outside), " is outside the survey window.").otherwise("."))),
        ))
    )
    data_text = F.when(F.size("_data") > 0, F.concat(F.lit("DATA: "), F.array_join("_data", "; "), F.lit(".")))
    risk_text = F.when(score >= S.RISK_REVIEW, F.concat(F.lit("RISK "), F.bround(score).cast("bigint").cast("string"), F.when(P.blank("Risk_Reasons"), ".").otherwise(F.concat(F.lit(": "), F.col("Risk_Reasons"), F.lit(".")))))
    # What is asked for alone is computed alone: verdicts ask for no texts.
    return df.withColumns(held | {"_place": place, "_data": data}).withColumns({
        "flags": F.array_distinct(F.concat(of(listed[:-1], "flag"), F.transform("_data", lambda x: F.concat(F.lit("Data: "), x)), of(listed[-1:], "flag"))),
        "headlines": of([x for x in listed if x.headline is not None], "headline"),
        "_worst": any_("reject", "manual"), "_review": any_("review") | told, "_partial": any_("partial"),
        "_form_text": F.concat(F.lit("FORM: "), form_text), "_photo_text": F.concat(F.lit("PHOTOS: "), photo_text),
        "_place_text": F.concat(F.lit("SAME LOCATION: "), same_text), "_data_text": data_text, "_risk_text": risk_text,
        "_gps_text": F.when(copied, "GPS: Surveys at the same spot carry the same app entry - possible copied entry."),
    }).drop(*held, "_place", "_data")


def verdicts(df: DataFrame) -> DataFrame:
    """Adds flags, verdict, confidence, tags, counters, remark, remark_detail."""
    verdict = F.when(F.col("_worst"), "Manual QC Required").when(F.col("_review"), "Review").when(F.col("_partial"), "Partially OK").otherwise("OK")
    conf = F.when(F.col("form_state") == "ok", _f("confidence"))
    gone = F.col("form_state").isin("no_link", "not_found", "error") | F.col("photo_state").isin("no_link", "not_found", "error")
    low = gone | F.col("_worst") | _yes(conf < S.LOW_CONFIDENCE)
    medium = F.col("_review") | _yes(conf < 0.8) | (F.col("form_state") == "skipped") | (F.col("photo_state") == "skipped")
    out = df.withColumns({"verdict": verdict, "confidence": F.when(low, "Low").when(medium, "Medium").otherwise("High")})
    lookup = lambda table: F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    spot = F.arrays_overlap("flags", F.array(*[F.lit(x) for x in PLACE]))
    copied = F.array_contains("flags", "Same app entry at same spot")
    spoken = F.filter("flags", lambda x: ~(
        x.isin("Duplicate photos", "Photos rotated") | (x.isin("Same location", "GPS cluster") & copied) | ((x == "Data: Possible duplicate field") & spot)
    ))
    named = F.transform(spoken, lambda x: F.coalesce(
        F.try_element_at(lookup(TAGS), x),
        F.when(x.startswith("Data: "), F.concat(F.lit("Data Issue ("), F.substring(x, F.lit(7), F.length(x)), F.lit(")"))).when(x.startswith("High risk score"), "High Risk Score").otherwise(x),
    ))
    out = out.withColumn("tags", F.array_distinct(named))
    counters = F.array_sort(F.array_distinct(F.array_compact(F.transform("flags", lambda x: F.try_element_at(lookup(COUNTERS), x)))))
    lines = F.col("headlines")
    head = (
        F.when((F.col("verdict") == "OK"), "OK: no issues found. ")
        .when(F.col("verdict") == "Partially OK", "Partially OK. ")
        .when(F.size(lines) > 0, F.concat(F.col("verdict"), F.lit(": "), F.array_join(F.array_distinct(F.slice(lines, 1, 3)), "; "), F.lit(". ")))
        .otherwise("")
    )
    remark = F.when(F.size("tags") > 0, F.concat(F.col("verdict"), F.lit(" - "), F.array_join("tags", ", "))).otherwise(F.col("verdict"))
    detail = F.trim(F.concat(head, F.concat_ws(" | ", "_form_text", "_photo_text", "_place_text", "_gps_text", "_data_text", "_risk_text")))
    return out.withColumns({"counters": counters, "remark": remark, "remark_detail": detail}).drop("_form_text", "_photo_text", "_place_text", "_gps_text", "_data_text", "_risk_text", "_no_row", "_uneven", "_worst", "_review", "_partial")


def evaluate(df: DataFrame) -> DataFrame:
    return verdicts(findings(form_values(states(df))))
