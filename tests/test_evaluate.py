import pytest
from pyspark.sql import functions as F

from plumbline import schema as S
from plumbline.operators import assemble, evaluate
from tests.helpers import good

FORM = {"_state": "ok", "is_proforma3": True, "quality": "good", "form_no": "HR0126000001", "po_id_matches": True, "form_area": 50.0, "form_loss": 40.0, "row_area": 50.0, "row_loss": 40.0, "farmer_signed": True, "company_signed": True, "worker_signed": True, "officer_signed": True, "confidence": 0.9}
PHOTO = {"_state": "ok", "n_photos": 2, "n_form_photos": 0, "field_photo": "standing crop", "scene_type": "field", "crop_seen": "paddy", "crop_matches_declared": True, "crop_present": "yes", "photo_conf": "high", "photo_agree": True, "stamp_dist_m": 10.0, "stamp_date": "03092026", "photo_loss": "30"}

CASES = [
    ("clean", {}, {}, {}, "OK", "High", []),
    ("no form link", {"pdf_url": ""}, None, {}, "Manual QC Required", "Low", ["Form link missing"]),
    ("form lost", {}, {"_state": "not_found"}, {}, "Manual QC Required", "Low", ["Form not found"]),
    ("not the form", {}, {"is_proforma3": False}, {}, "Manual QC Required", "Low", ["Not Proforma-3"]),
    ("mismatch", {}, {"form_loss": 60.0, "row_loss": 60.0}, {}, "Review", "Medium", ["Form vs app mismatch"]),
    ("within tolerance", {}, {"form_area": 55.0, "row_area": 55.0}, {}, "OK", "High", []),
    ("low field", {}, {"field_conf": {"form_area": 0.2, "area": 0.2, "row_area": 0.2}}, {}, "Manual QC Required", "Low", ["Form not readable"]),
    ("row and total", {}, {"row_area": 52.0}, {}, "Review", "Medium", ["Form row/total inconsistent"]),
    ("row only", {}, {"form_area": None, "form_loss": None}, {}, "OK", "High", []),
    ("po id", {}, {"po_id_matches": False}, {}, "Partially OK", "High", ["PO ID mismatch"]),
    ("farmer unsigned", {}, {"farmer_signed": False}, {}, "OK", "High", ["Signature missing"]),
    ("officer unsigned", {}, {"officer_signed": False, "worker_signed": False}, {}, "OK", "High", []),
    ("stamp only", {}, {"officer_stamp_only": True}, {}, "Review", "Medium", ["Officer stamp only"]),
    ("low confidence", {}, {"confidence": 0.5, "field_conf": {"area": 0.9, "loss": 0.9}}, {}, "Manual QC Required", "Low", ["Low confidence - manual review"]),
    ("dates", {}, {"loss_date": "02092026"}, {}, "Partially OK", "High", ["Form date differs from app"]),
    ("order", {}, {"sow_date": "05092026", "loss_date": "01092026"}, {}, "Partially OK", "High", ["Form dates out of order"]),
    ("raj row", {}, {"template": "rajasthan", "form_area": None, "form_loss": None, "row_area": None, "row_loss": None, "raj_pairs": [(10.0, 10.0), (50.0, 40.0)], "raj_all_read": True}, {}, "OK", "High", []),
    ("raj none", {}, {"template": "rajasthan", "form_area": None, "form_loss": None, "row_area": None, "row_loss": None, "raj_pairs": [(10.0, 10.0)], "raj_all_read": True}, {}, "Manual QC Required", "Low", ["Form vs app mismatch", "Form not readable"]),
    ("photos are the form", {}, {}, {"photo_is_form": True, "n_form_photos": 2}, "Manual QC Required", "Low", ["Photo is form image"]),
    ("some are the form", {}, {}, {"photo_is_form": True, "n_form_photos": 1}, "Review", "Medium", ["Photo is form image"]),
    ("far", {}, {}, {"stamp_dist_m": 900.0}, "Review", "Medium", ["Photo GPS mismatch"]),
    ("late photo", {}, {}, {"stamp_date": "01122026"}, "Review", "Medium", ["Photo date outside survey period"]),
    ("copies", {}, {}, {"n_duplicates": 1, "rotated": True}, "OK", "High", ["Duplicate photos", "Photos rotated"]),
    ("standing crop", {"crop_loss_pct": 90.0}, {"form_loss": 90.0, "row_loss": 90.0}, {}, "Review", "Medium", ["Field state vs reported loss"]),
    ("unsure crop", {}, {}, {"crop_matches_declared": False, "photo_conf": "low"}, "OK", "High", []),
    ("other crop", {}, {}, {"crop_matches_declared": False}, "Review", "Medium", ["Crop mismatch"]),
    ("no crop", {}, {}, {"crop_present": "no"}, "Review", "Medium", ["No crop in photo"]),
    ("blurry", {}, {}, {"scene_type": "blurry-dark-irrelevant"}, "Manual QC Required", "Low", ["Photo not of the field"]),
    ("skipped", {}, {"_state": "skipped"}, {"_state": "skipped"}, "OK", "Medium", []),
]


@pytest.fixture(scope="module")
def judged(spark):
    form = spark.createDataFrame([], S.FORM).schema
    photo = spark.createDataFrame([], S.PHOTOS).schema
    rows = []
    for i, (_, row, f, p, *_) in enumerate(CASES):
        values = {**good(i), **row}
        fs = None if f is None else tuple((FORM | f).get(x.name) for x in form.fields)
        ps = None if p is None else tuple((PHOTO | p).get(x.name) for x in photo.fields)
        rows.append((i, values["affected_area_pct"], values["crop_loss_pct"], values["pdf_url"], values["media_urls"], values["survey_start_date"], values["survey_end_date"], fs, ps))
    schema = f"pos long, affected_area_pct double, crop_loss_pct double, pdf_url string, media_urls string, survey_start_date string, survey_end_date string, form struct<{_ddl(form)}>, photo struct<{_ddl(photo)}>"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(None).cast("string") for c in ("crop_name", "Same_Location_Remark", "Same_Location_Values", "Suggested_Remark", "Data_QC_Flags", "Risk_Reasons")}).withColumn("Risk_Score", F.lit(None).cast("double"))
    out = assemble.assemble(evaluate.evaluate(df)).select("pos", "verdict", "confidence", "flags", "remark", "remark_detail", "counters", "`AI Remark`", "`Form No`").collect()
    return {r.pos: r for r in out}


def _ddl(schema):
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema.fields)


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_case(judged, i):
    _, _, _, _, verdict, confidence, flags = CASES[i]
    got = judged[i]
    assert (got.verdict, got.confidence, got.flags) == (verdict, confidence, flags)
    assert got.remark.startswith(verdict) and got.remark_detail


def test_texts(judged):
    at = {c[0]: i for i, c in enumerate(CASES)}
    assert judged[at["clean"]].remark == "OK" and judged[at["clean"]].remark_detail.startswith("OK: no issues found. FORM: Form No HR0126000001; PO ID matches docket.")
    assert judged[at["mismatch"]].remark == "Review - Form & App Values Mismatch" and judged[at["mismatch"]].counters == ["mismatch"]
    assert "form 50/60 vs app 50/40" in judged[at["mismatch"]].remark_detail
    assert judged[at["no form link"]]["Form No"] == "N/A (form not found)"
