"""Output columns from evaluated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import functions as P
from plumbline import schema as S

FORM_AREA, FORM_LOSS, MATCH = "Affected area% (Form)", "Crop Loss% (Form)", "Match/Mismatch (Form&app)"
PHOTO_DATE = "Date of survey (as per Geo Tagged Image)"
FIELD_PHOTO = "Field photo (no crop / cut & spread / crop mismatch / standing crop)"
SURVEYOR_SIG, FARMER_SIG, GOVT_SIG = "Surveyor Signature (Yes/No)", "Farmer Signature (Yes/No)", "Government Signature (Yes/No)"
FORM_STATUS, FORM_REMARKS = "Form Status (correct / incomplete/ overwrite)", "Survey remarks on form"
FARMER_PHOTO, PHOTO_LOSS, OTHER, REMARK, DONE_BY = "Farmer Photo (Yes/No)", "Loss as per Photo (Yes/No)", "Any Other Remarks", "AI Remark", "Done By"
MAIN = ["QC Verdict", "Form No", "PO ID (Form)", FORM_AREA, FORM_LOSS, MATCH, PHOTO_DATE, FIELD_PHOTO, SURVEYOR_SIG, FARMER_SIG, GOVT_SIG, FORM_STATUS, FORM_REMARKS, FARMER_PHOTO, PHOTO_LOSS, OTHER, REMARK, DONE_BY]
#: Beginnings of remarks that an earlier run wrote (fixed values).
OWN_REMARKS = ["OK", "PARTIALLY OK", "REVIEW", "MANUAL QC REQUIRED", "FORM:", "PHOTOS:", "GPS:", "DATA:", "RISK "]


def record(values: dict[str, Column], kind: str) -> Column:
    """A form or photo struct of the schema; fields not given are null."""
    fields = T.StructType.fromDDL(S.FORM if kind == "form" else S.PHOTOS)
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def put(new: Column, old: Column | None) -> Column:
    """The new value, else what was there."""
    return new if old is None else F.coalesce(new, old)


def form_status() -> Column:
    f = lambda n: F.col(f"form.{n}")
    cells = f("_cells")
    written = F.exists(F.map_entries(cells), lambda e: (e["key"].startswith("area_") | e["key"].startswith("loss_")) & ~F.coalesce(e["value"]["blank"], F.lit(True)))
    unsigned = F.coalesce(~f("farmer_signed"), F.lit(False)) | F.coalesce(~f("company_signed"), F.lit(False))
    return F.when(F.coalesce(f("overwrite_suspected"), F.lit(False)), "overwrite").when(F.size(cells) > 0, F.when(unsigned | ~written, "incomplete").otherwise("correct"))


def field_photo_type() -> Column:
    p = lambda n: F.col(f"photo.{n}")
    n = F.coalesce(p("n_photos"), F.size(p("photo_is_form_each")))
    crop = F.coalesce(p("crop_present") == "yes", F.lit(False))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "No").when(p("photo_is_form"), "Form image").when(crop | (p("scene_type") == "field"), "Yes").otherwise("Other image")


def farmer_photo() -> Column:
    p = lambda n: F.col(f"photo.{n}")
    seen = F.coalesce(F.exists(p("person_each"), lambda x: F.coalesce(x, F.lit(False))), F.lit(False)) | F.coalesce(p("scene_type") == "person-only", F.lit(False))
    return F.coalesce(P.yes_no(p("farmer_present_v2")), F.when(seen, "Yes").otherwise("No"))


def photo_loss() -> Column:
    p = lambda n: F.col(f"photo.{n}")
    v = F.lower(F.trim(F.coalesce(p("photo_loss"), F.lit(""))))
    damaged = (F.coalesce(p("flooded"), F.lit("")) == "yes") | v.rlike("25-50|50-75|75-100|100%")
    return F.when(p("photo_is_form"), "N/A (form image)").otherwise(F.coalesce(P.yes_no(p("photo_loss_yn_v2")), F.when(damaged, "Yes").when(v.startswith("0%") | (v == "no"), "No").otherwise("Not clear")))


def person_remark() -> Column:
    each, form = F.col("photo.person_each"), F.coalesce(F.col("photo.photo_is_form_each"), F.array().cast("array<boolean>"))
    field = F.filter(F.transform(each, lambda x, i: F.struct(F.coalesce(x, F.lit(False)).alias("p"), F.coalesce(F.get(form, i), F.lit(False)).alias("f"))), lambda s: ~s["f"])
    return F.when(F.size(each) > 0, F.when(F.size(field) == 0, "Not checked (photos are the paper form)").when(F.exists(field, lambda s: s["p"]), "Farmer available").otherwise("Farmer not available"))


def assemble(df: DataFrame, detail: bool = True) -> DataFrame:
    """``df`` (evaluated) with the output columns; every blank gets the word
    that says why. A person's own remark of the input is kept behind ours."""
    f, p = (lambda n: F.col(f"form.{n}")), (lambda n: F.col(f"photo.{n}"))
    ok, pok = F.col("form_state") == "ok", F.col("photo_state") == "ok"
    right = F.coalesce(f("is_proforma3"), F.lit(True))
    lost = F.when(F.col("form_state").isin("not_found", "no_link"), "N/A (form not found)").otherwise("Not readable")
    cant = "Can't Read"
    text = lambda c: c.cast("string")

    def of_form(good: Column, wrong: str | Column) -> Column:
        return F.when(ok & right, good).when(ok, wrong)

    area = F.coalesce(F.col("f_area"), F.when(right, f("form_area")))
    loss = F.coalesce(F.col("f_loss"), F.when(right, f("form_loss")))
    unread = lambda c: F.when(F.coalesce(f(c), F.lit(True)), "Mentioned but can't read").otherwise("Blank on form")
    remarks = F.coalesce(f("remarks_text"), P.yes_no(f("remarks_written")), F.lit(cant))
    sig = lambda c: F.when(ok & right, F.coalesce(P.yes_no(f(c)), F.lit("Not assessed"))).otherwise("N/A")
    photo = lambda c, none="No photos": F.when(pok, c).otherwise(none)
    form_photo = F.coalesce(p("photo_is_form"), F.lit(False))
    out = {
        "QC Verdict": F.col("verdict"),
        "Form No": F.coalesce(of_form(F.coalesce(f("form_no"), F.lit(cant)), F.lit(cant)), lost),
        "PO ID (Form)": F.coalesce(of_form(F.coalesce(f("po_id"), F.lit(cant)), F.lit(cant)), lost),
        FORM_AREA: F.when(ok, F.coalesce(F.when(area.isNotNull(), P.whole_or_general(area)), unread("area_written"))).otherwise(lost),
        FORM_LOSS: F.when(ok, F.coalesce(F.when(loss.isNotNull(), P.whole_or_general(loss)), unread("loss_written"))).otherwise(lost),
        MATCH: F.when(ok, F.coalesce("match", F.lit("NA"))).otherwise("NA"),
        PHOTO_DATE: photo(F.coalesce(P.day_text(F.coalesce(p("stamp_date"), p("photo_date"))), F.lit("Not read"))),
        FIELD_PHOTO: photo(F.coalesce(F.when(form_photo, "form image").otherwise(p("field_photo")), F.lit("No photos"))),
        SURVEYOR_SIG: sig("company_signed"), FARMER_SIG: sig("farmer_signed"), GOVT_SIG: sig("officer_signed"),
        FORM_STATUS: F.when(ok & right, F.coalesce(form_status(), F.lit("Not checked"))).otherwise("N/A"),
        FORM_REMARKS: F.coalesce(of_form(remarks, F.lit("N/A")), F.concat(F.lit("Form "), F.col("form_state"))),
        FARMER_PHOTO: photo(farmer_photo()), PHOTO_LOSS: photo(photo_loss()),
        OTHER: F.col("remark_detail"), DONE_BY: F.lit("AI-Auto"),
    }
    if detail:
        out |= {
            "AI_Confidence": F.col("confidence"), "AI_Flags": F.coalesce(F.nullif(F.array_join("flags", ", "), F.lit("")), F.lit("None")),
            "QC Done": ok | pok, "PO ID matches docket": F.coalesce(of_form(F.coalesce(P.yes_no(f("po_id_matches")), F.lit("Not checked")), F.lit(cant)), lost),
            "Form Row Area %": F.when(ok, text(f("row_area"))), "Form Row Loss %": F.when(ok, text(f("row_loss"))), "Form Total Row Blank": F.when(ok, P.yes_no(f("total_row_blank"))),
            "Sowing date (Form)": F.when(ok, P.day_text(f("sow_date"))), "Loss date (Form)": F.when(ok, P.day_text(f("loss_date"))), "Intimation date (Form)": F.when(ok, P.day_text(f("intimation_date"))), "Inspection date (Form)": F.when(ok, P.day_text(f("inspection_date"))),
            "Primary Worker Signature (Yes/No)": sig("worker_signed"), "Officer Stamp Only (Yes/No)": sig("officer_stamp_only"), "Form Quality": f("quality"), "Form Confidence": f("confidence"),
            "Field photo type": photo(field_photo_type()), "Photo is form image (Yes/No)": photo(P.yes_no(form_photo)), "Form-image photos (n)": p("n_form_photos"), "Duplicate photos (n)": p("n_duplicates"),
            "Photos rotated (Yes/No)": photo(P.yes_no(F.coalesce(p("rotated"), F.lit(False)))), "Photo GPS distance (m)": F.bround(p("stamp_dist_m"), 1), "Photos analysed (n)": p("n_photos"), "Photo scene type": p("scene_type"),
            "Crop present in photo": F.initcap(p("crop_present")), "Crop seen in photo": p("crop_seen"), "Crop matches declared": P.yes_no(p("crop_matches_declared")), "Flooding/waterlogging seen": F.initcap(p("flooded")), "Crop damage state": p("damage_state"),
            "Farmer/person present in photos (remark)": person_remark(),
        }
    made = df.withColumns({k: v for k, v in out.items() if k not in (OTHER,)})
    if OTHER in df.columns:
        old = F.col(OTHER)
        own = F.lit(False)
        for start in OWN_REMARKS:
            own = own | F.upper(F.trim(old)).startswith(start)
        keep = ~P.blank(old) & ~own
        made = made.withColumn(OTHER, F.when(keep, F.concat(out[OTHER], F.lit(" | INPUT REMARK: "), old)).otherwise(out[OTHER]))
    else:
        made = made.withColumn(OTHER, out[OTHER])
    return made.withColumn(REMARK, compiled_remark(ok, pok, right))


def compiled_remark(ok: Column, pok: Column, right: Column) -> Column:
    """One line of everything: verdict and issues, then form and photos."""
    percent = lambda c: F.when(c.try_cast("double").isNotNull(), F.concat(P.general(c.try_cast("double")), F.lit("%"))).otherwise(F.lower(c))
    app = lambda c: F.coalesce(F.concat(P.general(F.col(c)), F.lit("%")), F.lit("NA"))
    good = ok & right
    missing = F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == "No", n) for n, c in (("farmer", FARMER_SIG), ("surveyor", SURVEYOR_SIG), ("government officer", GOVT_SIG))]))
    col = lambda c: F.col(f"`{c}`")
    gone = lambda what, state: F.concat(F.lit(f"{what}: "), F.when(F.col(state) == "no_link", "link missing").when(F.col(state).isin("not_found", "error"), "not found / could not be downloaded").otherwise("not checked"))
    return F.concat_ws(
        " | ",
        F.col("remark"),
        F.when(~ok, gone("Form", "form_state")),
        F.when(ok & ~right, "Form: uploaded document is not a Proforma-3"),
        F.when(good, F.concat(F.lit("Form No "), F.when(F.lower(col("Form No")).startswith("can"), "not readable").otherwise(col("Form No")))),
        F.when(good, F.when(F.col("form.po_id_matches"), "PO ID matches docket").when(~F.col("form.po_id_matches") & col("PO ID (Form)").rlike("^[0-9]"), F.concat(F.lit("PO ID "), col("PO ID (Form)"), F.lit(" differs from docket"))).otherwise("PO ID not readable")),
        F.when(good, F.concat(F.lit("Area "), percent(col(FORM_AREA)), F.lit(" (app "), app("affected_area_pct"), F.lit(")"))),
        F.when(good, F.concat(F.lit("Loss "), percent(col(FORM_LOSS)), F.lit(" (app "), app("crop_loss_pct"), F.lit(")"))),
        F.when(good & col(MATCH).isin("Match", "Mismatch"), F.concat(F.lit("Form vs app: "), col(MATCH))),
        F.when(good, F.when(F.size(missing) > 0, F.concat(F.lit("Signature missing: "), F.array_join(missing, ", "))).otherwise("All signatures present")),
        F.when(good, F.concat(F.lit("Survey remarks on form: "), col(FORM_REMARKS))),
        F.when(good, F.concat(F.lit("Form status: "), col(FORM_STATUS))),
        F.when(~pok, gone("Photos", "photo_state")),
        F.when(pok, F.concat(F.lit("Field photo: "), col(FIELD_PHOTO))),
        F.when(pok, F.concat(F.lit("Farmer photo: "), col(FARMER_PHOTO))),
        F.when(pok, F.concat(F.lit("Photo date "), F.when(col(PHOTO_DATE).rlike("^[0-9]"), col(PHOTO_DATE)).otherwise("not read"))),
    )


def main_columns(df: DataFrame) -> DataFrame:
    """pos and the main output columns, named as identifiers for tables."""
    return df.select("pos", *[F.col(f"`{c}`") for c in MAIN])
