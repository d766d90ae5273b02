"""More rows go to more tasks."""

from plumbline.operators import numbering


def test_tasks_grow_with_size(spark, monkeypatch):
    df = spark.range(10_000)
    assert numbering.dealt(df, "id").rdd.getNumPartitions() == 4
    monkeypatch.setattr(numbering, "PART_BYTES", 8_000)
    assert numbering.dealt(df, "id").rdd.getNumPartitions() == 10
