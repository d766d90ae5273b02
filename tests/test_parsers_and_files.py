from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import functions as P
from plumbline.operators import compare, keys, numbering, perception, risk
from plumbline.sources import files, headers, media


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("value,want", [(50.0, "50"), (0.5, "0.5"), (0.123456789, "0.123457"), (None, "?"), (33.333333, "33.3333"), (-2.5, "-2.5")])
def test_general(spark, value, want):
    assert one(spark, P.general(F.lit(value).cast("double"))) == want


@pytest.mark.parametrize("text,want", [("2026-09-01", "2026-09-01"), ("01/09/2026", "2026-09-01"), ("1-9-2026 10:30", "2026-09-01"), ("09/25/2026", "2026-09-25"), ("2999-01-01", "2999-01-01"), ("soon", None), ("", None), ("31/02/2026", None), ("5 Jan 2026", "2026-01-05")])
def test_dates(spark, text, want):
    got = one(spark, P.dates(F.lit(text)))
    assert (got and str(got.date())) == want


def test_small_functions(spark):
    assert one(spark, P.urls(F.lit("https://a,b;http://c_x000D_\nhttps://d"))) == ["https://a", "http://c", "https://d"]
    assert one(spark, P.decimals(F.lit(29.0))) == 1 and one(spark, P.decimals(F.lit(1e-9))) == 0
    assert one(spark, P.json_object(F.lit('say: {"a": 1} done'))) == '{"a": 1}' and one(spark, P.json_object(F.lit("none"))) is None
    assert one(spark, P.media_type(F.lit(bytearray(b"\x89PNG\r\n\x1a\n...")))) == "image/png"
    assert abs(one(spark, P.haversine(F.lit(29.0), F.lit(76.0), F.lit(29.001), F.lit(76.0))) - 111.19) < 0.1
    assert one(spark, P.degrees_of_dms(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("S"))) == -10.5
    assert one(spark, P.duration(F.lit(3725))) == "1h 02m"


def test_headers():
    assert headers.map_columns(["DOCKET ID", "farmer-name", "Affected_Area_%", "Crop Loss %", "lat", "Lon"]) == {"docket_id": 0, "farmer_name": 1, "affected_area_pct": 2, "crop_loss_pct": 3, "latitude": 4, "longitude": 5}
    got = headers.map_columns(["Surveyer_Name", "Latitud", "Weird Extra"])
    assert got == {"surveyor_name": 0, "latitude": 1}
    assert headers.has_header(["Docket_ID", "Farmer_Name", "Crop_Name"]) and not headers.has_header(["2000000000", "x"]) and not headers.has_header(["abc", "1.5"])
    assert headers.column_names(["docket_id", "X", "X"])[0] == ["docket_id", "X", "X_2"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Docket_ID,Farmer_Name,Latitude,Crop Loss %,Extra\n 12.0 ,A, 29.5,oops,50\n,,,,\n'13,nan,30,40,\n")
    got = files.load(spark, str(tmp_path / "a.csv")).orderBy("pos").collect()
    assert [(r.docket_id, r.farmer_name, r.latitude, r.crop_loss_pct, r.Extra) for r in got] == [("12", "A", 29.5, None, "50"), ("13", None, 30.0, 40.0, None)]
    n = files.write_xlsx(spark.createDataFrame([("D1", "B & <c>", 1.5), ("D2", None, None)], "docket_id string, farmer_name string, latitude double"), str(tmp_path / "b.xlsx"))
    assert n == 2
    both = files.load(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.docket_id, r.farmer_name, r.latitude) for r in both] == [("12", "A", 29.5), ("13", None, 30.0), ("D1", "B & <c>", 1.5), ("D2", None, None)]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        files.load(spark, str(tmp_path / "none"))


def test_media(spark, tmp_path):
    guid = "0a0b0c0d-1111-2222-3333-444455556666"
    for p in ("D1/form/x.pdf", f"other/{guid}.jpg", "D2.png", "notes.txt", "stray/none.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    df = spark.createDataFrame([("D1", None, None), ("d2", None, None), ("D3", f"https://x/{guid.upper()}", None)], "docket_id string, pdf_url string, media_urls string")
    got = media.matched(media.listed(spark, str(tmp_path)), df).collect()
    assert sorted((r.docket_id, r.kind) for r in got) == [("D1", "pdf"), ("D3", "image"), ("d2", "image")]


def test_stamps_and_dates():
    text = "Latitude: 29.4106963\nLongitude: 76.9876543\nAccuracy: 4.5(m)\nDate: 03-09-2026 02:15 PM\nLat:281246425\nLong 77.1234567"
    first, second = map(perception.stamp_of, perception.stamp_blocks(text))
    assert first == {"lat": 29.4106963, "lng": 76.9876543, "acc": 4.5, "date": "03092026", "time": "14:15"}
    assert second["lat"] == 28.1246425
    assert perception.date_candidates("10-06-26") == [date(2026, 6, 10)] and perception.date_candidates("10-06-2026", "sow") == [date(2026, 6, 10)]
    assert perception.date_candidates("1126", "loss") == [] and len(perception.date_candidates("11126", "loss")) >= 1 and perception.date_candidates("99-99-26") == []


def test_ctc():
    p = np.full((6, 12), 0.001)
    for t, k in enumerate([2, 2, 0, 2, 11, 4]):
        p[t, k] = 0.99
    text, conf = perception.ctc_text(p)
    assert text == "11-3" and len(conf) == 4
    total = sum(np.exp(-perception.ctc_loss(np.full((3, 3), 1 / 3), s)) for s in ["", "0", "1", "00", "01", "10", "11", "010", "101"])
    assert abs(total - 1) < 1e-9


def test_votes_and_values(spark):
    reads = spark.createDataFrame([("d", i, n) for i, n in enumerate(["A", "B", "A", "A", None, "A", "B", "B", "B"])] + [("e", 0, "C")], "docket string, pass int, number string")
    got = {r.docket: r for r in perception.voted_number(reads).collect()}
    assert (got["d"].number, got["d"].votes, got["d"].conf) == ("A", 4, 0.97) and (got["e"].number, got["e"].guess) == (None, "C")
    cells = [((40.0, 0.9, False), (40.0, 0.3, False), 40.0), ((40.0, 0.6, False), (60.0, 0.6, False), None), ((40.0, 0.9, False), (60.0, 0.3, False), 40.0), ((40.0, 0.6, False), (40.0, 0.6, False), 40.0), ((40.0, 0.7, False), (None, 0.9, True), None)]
    df = spark.createDataFrame([(t, r) for t, r, _ in cells], "t struct<value:double,conf:double,blank:boolean>, r struct<value:double,conf:double,blank:boolean>")
    assert [x.v for x in df.select(perception.decided_value(F.col("t"), F.col("r"))["value"].alias("v")).collect()] == [w for _, _, w in cells]
    assert one(spark, perception.form_number(F.lit("no HR0126 123456"))) == "HR0126123456" and one(spark, perception.form_number(F.lit("4R126123456"))) == "HR0126123456"
    assert one(spark, perception.cell_number(F.lit("090%"))) == 90.0 and one(spark, perception.cell_number(F.lit("999"))) is None


def test_reader_failures_stay_apart(spark):
    def reader(batch):
        if (batch["docket"] == "bad").any():
            raise ValueError("torn")
        return batch.assign(_state="ok", _error=None)[["docket", "_state", "_error"]]

    got = perception.read_with(spark.createDataFrame([("a", "p"), ("bad", "p")], "docket string, path string").coalesce(1), reader, "docket string, _state string, _error string")
    assert {r.docket: r._state for r in got.collect()} == {"a": "ok", "bad": "error"}


def test_keys_and_compare(spark):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(["A", "A", None, "A", None])], "pos long, docket_id string")
    got = {r.pos: r.row_key for r in keys.with_row_keys(rows).collect()}
    assert [got[0], got[1], got[3]] == ["A", "A#2", "A#3"] and got[2].startswith("nodocket-") and got[4] == got[2] + "#2"
    with pytest.raises(ValueError):
        compare.strict_union([rows, rows.select("docket_id", "pos")])
    corrected = compare.needs_correction(rows.filter("docket_id = 'A'").withColumn("x", F.lit("Yes")), rows.limit(1).withColumn("x", F.lit("no")), ["x"])
    assert {r.needs_correction for r in corrected.collect()} == {1}


def test_ranks(spark):
    values = spark.createDataFrame([(x,) for x in [5, 1, 1, 9, 5, 5]], "v int").withColumn("k", F.lit(0))
    got = {r.v: r.rank for r in numbering.average_ranks(values.repartition(3), ["k"], "v", "rank").collect()}
    assert got == {1: 1.5 / 6, 5: 4 / 6, 9: 1.0}


def test_forest_finds_the_odd_row():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(300, 3)), [[9.0, 9.0, 9.0]]])
    s = risk.forest_scores(risk.fit_forest(x, trees=50), x, len(x))
    assert s.argmax() == 300 and np.array_equal(s, risk.forest_scores(risk.fit_forest(x, trees=50), x, len(x)))
