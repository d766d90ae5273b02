"""Canonical columns, thresholds and result types of the survey engine."""

from __future__ import annotations

#: Canonical columns in the order of an export without header (fixed values).
COLUMNS = [
    "docket_id", "application_no", "farmer_name", "calamity_type", "survey_start_date", "survey_end_date", "farm_area", "crop_name", "khasra_number",
    "division_number", "state", "district", "tehsil", "block", "village", "patwar_circle", "surveyor_name", "surveyor_mobile", "affected_area_pct",
    "crop_loss_pct", "total_damage_pct", "surveyor_remark", "latitude", "longitude", "pdf_url", "media_urls",
]
NUMERIC = ["farm_area", "affected_area_pct", "crop_loss_pct", "total_damage_pct", "latitude", "longitude"]
REQUIRED = ["docket_id", "farmer_name", "crop_name", "khasra_number", "latitude", "longitude", "affected_area_pct", "crop_loss_pct"]

#: Other headers of each canonical column (fixed values).
ALIASES = {
    "docket_id": ["docketID", "Docket_ID", "docket id", "docketid"],
    "application_no": ["Application_No", "applicationNo", "app_no"],
    "farmer_name": ["farmerName", "Farmer_Name", "farmer name"],
    "calamity_type": ["calamityType", "Type_Of_Incidence", "typeofincidence"],
    "survey_start_date": ["surveyStartDate", "Date_Of_Incidence", "survey_date"],
    "survey_end_date": ["surveyEndDate", "Farmer_Intimation_Date"],
    "farm_area": ["farmArea", "Farm_Area", "farm area"],
    "crop_name": ["cropName", "Crop_Name", "crop name"],
    "khasra_number": ["landSurveyNumber", "Land_Survey_Number", "survey_no"],
    "division_number": ["landDivisionNumber", "Land_Division_Number"],
    "state": ["State", "State_Name", "state_name"],
    "district": ["District", "District_Name", "district"],
    "tehsil": ["Tehsil", "Level4_Name", "level4"],
    "block": ["Patwar", "Level5_Name", "level5", "block"],
    "village": ["Level6_Name", "level6", "village"],
    "patwar_circle": ["Level7_Name", "level7", "patwar"],
    "surveyor_name": ["surveyorName", "Surveyor_Name"],
    "surveyor_mobile": ["surveyorMobile", "Surveyor_Mobile"],
    "affected_area_pct": ["Affected_Area_%", "affectedAreaPercentage", "affected area %", "Affected_area_%"],
    "crop_loss_pct": ["Crop_Loss_%", "cropLossPercentage", "crop loss %", "Crop_loss_%"],
    "total_damage_pct": ["Total_Damage_%", "totalDamagePercentage"],
    "surveyor_remark": ["surveyorRemark", "Surveyor_Remark"],
    "latitude": ["latitude", "Latitude", "lat"],
    "longitude": ["longitude", "Longitude", "lng", "lon"],
    "pdf_url": ["Signed_Copy_URL", "signed_copy_url", "pdf_url", "form_url"],
    "media_urls": ["Media", "media", "media_urls", "photo_urls"],
}
FUZZY_RATIO = 92

#: Thresholds (fixed values).
AREA_TOLERANCE, LOSS_TOLERANCE, DAMAGE_TOLERANCE = 5, 5, 10
RADIUS_M, PHOTO_DISTANCE_M = 25, 200
SAME_FIELD_COUNT, SAME_SURVEYOR_COUNT, HOT_DAMAGE = 3, 3, 15
LOW_CONFIDENCE, LOW_FIELD_CONFIDENCE = 0.6, 0.5
PHOTO_LOSS_GAP, SEASON_DAYS, PHOTO_DAYS_AFTER = 25, 400, 30
LATITUDES, LONGITUDES = (8.0, 37.0), (68.0, 97.0)
MAX_PHOTOS, RISK_REVIEW = 10, 60
MIN_SURVEYOR_ROWS, MIN_GROUP_ROWS, MIN_LABELLED = 20, 10, 200
METRES_PER_DEGREE, EARTH_RADIUS_M = 111_320.0, 6_371_000.0

VERDICTS = ["OK", "Partially OK", "Review", "Manual QC Required"]

#: What a reading of one form holds; readers are plugged in (see operators.perception).
FORM = (
    "_state string, _error string, template string, is_proforma3 boolean, quality string, form_no string, po_id string, po_id_matches boolean, "
    "form_area double, form_loss double, row_area double, row_loss double, total_row_blank boolean, area_written boolean, loss_written boolean, "
    "farmer_signed boolean, company_signed boolean, worker_signed boolean, officer_signed boolean, officer_stamp_only boolean, overwrite_suspected boolean, "
    "confidence double, field_conf map<string,double>, notes array<string>, sow_date string, loss_date string, intimation_date string, inspection_date string, "
    "raj_pairs array<struct<area:double,loss:double>>, raj_all_read boolean, remarks_text string, remarks_written boolean, "
    "_cells map<string,struct<value:double,conf:double,blank:boolean>>"
)
#: What a reading of a record's photos holds.
PHOTOS = (
    "_state string, _error string, n_photos int, n_form_photos int, photo_is_form boolean, photo_status string, scene_type string, field_photo string, "
    "crop_seen string, crop_seen_conf double, crop_matches_declared boolean, crop_present string, flooded string, water_frac double, damage_state string, "
    "photo_conf string, photo_agree boolean, person_each array<boolean>, photo_is_form_each array<boolean>, n_duplicates int, rotated boolean, "
    "stamp_dist_m double, stamp_date string, photo_date string, photo_loss string, photo_quality string, remarks array<string>, "
    "farmer_present_v2 boolean, photo_loss_yn_v2 boolean"
)
