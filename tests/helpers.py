from plumbline import schema as S

SCHEMA = "pos long, " + ", ".join(f"{c} {'double' if c in S.NUMERIC else 'string'}" for c in S.COLUMNS)


def good(i, **changes):
    row = {
        "pos": i, "docket_id": str(2_000_000_000 + i), "application_no": f"APP{i}", "farmer_name": f"Farmer {i}", "calamity_type": "Flood", "survey_start_date": "2026-09-01", "survey_end_date": "2026-09-05",
        "farm_area": 1.2, "crop_name": "Paddy", "khasra_number": str(i), "division_number": "0", "state": "A", "district": "D0", "tehsil": "T1", "block": "B1", "village": f"V{i}", "patwar_circle": f"P{i}",
        "surveyor_name": f"Surveyor {i}", "surveyor_mobile": "9123456789", "affected_area_pct": 50.0, "crop_loss_pct": 40.0, "total_damage_pct": 20.0, "surveyor_remark": "", "latitude": 29.0 + i * 0.01, "longitude": 76.0,
        "pdf_url": "https://example.invalid/0.pdf", "media_urls": "https://example.invalid/0.jpg",
    }
    return row | changes


def frame(spark, rows):
    names = ["pos", *S.COLUMNS]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], SCHEMA)
