"""A label that the features give away is learnt; too few labels are refused."""

from plumbline.operators import learning


def labelled(spark, n):
    rows = [(i, f"s{i % 23}", f"Crop {i % 3}", "Flood", "D", "T", float(i % 2 * 60 + i % 7), float(i % 5), None if i % 9 == 0 else ("Genuine" if i % 2 else "DOUBTFUL")) for i in range(n)]
    return spark.createDataFrame(rows, "pos long, surveyor_name string, crop_name string, calamity_type string, district string, tehsil string, crop_loss double, farm double, verdict string")


def test_train_and_predict(spark):
    df = labelled(spark, 260)
    model, report = learning.train(df, "verdict")
    assert sorted(report["classes"]) == ["doubtful", "genuine"] and report["rows"] == 231 and report["f1"][report["chosen"]] > 0.95
    got = learning.predict(model, df, "verdict").join(df, "pos").collect()
    assert all(r.ML_verdict == r.verdict.lower() and 0.5 <= r.ML_verdict_Conf <= 1 for r in got if r.verdict)


def test_too_few_labels(spark):
    assert learning.train(labelled(spark, 60), "verdict") is None
