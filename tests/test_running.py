from plumbline.operators.monitor import Holdout, adopts, column_like, failures, holdout, reading_order
from pyspark.sql import functions as F


def test_columns_by_likeness():
    columns = ["Affected area% (Form)", "Affected_Area_%", "Crop Loss %"]
    assert column_like(columns, "affected_area") == "Affected_Area_%"
    assert column_like(columns, "x", "crop") == "Crop Loss %" and column_like(columns, "docket") is None


def test_a_model_that_is_not_worse_is_adopted(spark):
    old = Holdout(100, 60, 57)
    assert adopts(Holdout(100, 61, 58), old) and adopts(Holdout(100, 60, 57), old)
    assert not adopts(Holdout(100, 50, 50), old) and not adopts(Holdout(100, 80, 60), old)
    rows = spark.createDataFrame([(5.0, 5.0), (5.0, 4.0), (5.0, None), (None, 1.0)], "human double, read double")
    assert holdout(rows, "human", "read") == Holdout(3, 2, 1) and holdout(rows.limit(0), "human", "read").precision == 0


def test_files_in_reading_order_and_failures(spark):
    files = spark.createDataFrame([("b.jpg",), ("z.PDF",), ("a.jpg",), ("c.pdf",)], "path string")
    assert [r.path for r in reading_order(files).collect()] == ["c.pdf", "z.PDF", "a.jpg", "b.jpg"]
    rows = spark.createDataFrame([("2", "f", "u", None), ("1", "p", "u", "404"), ("1", "f", "u", "timeout")], "docket string, file string, url string, reason string")
    assert [(r.docket, r.file) for r in failures(rows, F.col("reason").isNotNull()).collect()] == [("1", "f"), ("1", "p")]
