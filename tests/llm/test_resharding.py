import itertools
import zlib

from pyspark.sql import functions as F

from plumbline.llm import resharding as R


def test_flow_moves_the_fewest_bytes():
    supply, demand = [10, 0, 7, 3], [4, 4, 4, 4, 4]
    cost = [[int(i != j) for j in range(5)] for i in range(4)]
    flow = R.cheapest_flow(supply, demand, cost)
    assert [sum(x for (i, _), x in flow.items() if i == a) for a in range(4)] == supply
    assert [sum(x for (_, j), x in flow.items() if j == b) for b in range(5)] == demand
    assert sum(x for (i, j), x in flow.items() if i != j) == sum(max(0, s - d) for s, d in itertools.zip_longest(supply, demand, fillvalue=0))


def test_flow_with_other_costs_against_all_plans():
    supply, demand, cost = [2, 3], [1, 2, 2], [[4, 1, 3], [2, 5, 1]]
    flow = R.cheapest_flow(supply, demand, cost)
    plans = [(a, b, 2 - a - b) for a in range(2) for b in range(3) if 0 <= 2 - a - b <= 2]
    least = min(sum(x * c for x, c in zip(p, cost[0])) + sum((d - x) * c for x, d, c in zip(p, demand, cost[1])) for p in plans)
    assert sum(x * cost[i][j] for (i, j), x in flow.items()) == least


def test_level_capacities():
    assert R.level_capacities([0, 0, 0], 10) == [4, 3, 3]
    assert R.level_capacities([5, 0, 1], 4) == [0, 3, 1] or sum(R.level_capacities([5, 0, 1], 4)) == 4
    assert R.level_capacities([9, 0], 0) == [0, 0]


def check(rows, out, old, shards):
    assert len(out) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc), r.size, r.text_crc32) for r in out) == want
    loads = [0] * shards
    for s in range(shards):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        loads[s] = sum(r.size for r in own)
    return loads


def test_reshard(spark):
    rows = [(i, "é" * (i % 97)) for i in range(3000)] + [(7, "copy")] * 40 + [(8, None), (9, ""), (None, "no id"), (None, "no id"), (5000, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    old = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    out = R.reshard(docs, old, 5, 8).collect()
    loads = check(rows, out, old, 8)
    fair = sum(loads) / 8
    assert max(loads) - min(loads) < 0.03 * fair
    surplus = [sum(r.size for r in out if r.old_shard == i) for i in range(5)]
    moved = sum(r.size for r in out if r.shard != r.old_shard)
    assert moved <= sum(max(0, x - fair) for x in surplus) + 0.05 * fair * 5
    assert R.reshard(docs.limit(0), old, 5, 8).count() == 0


def test_rewrite_keeps_untouched_shards(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = docs.select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 4).cast("int").alias("old_shard"), F.when(F.col("doc_id") == 1, 3).otherwise(F.col("doc_id") % 4).cast("int").alias("shard"), F.col("doc_id").alias("slot"))
    layout = {s: f"old/{s}" for s in range(4)}
    new = R.rewrite(docs, placed, layout, str(tmp_path / "new"))
    assert new[0] == "old/0" and new[2] == "old/2"
    assert {r.doc_id for r in spark.read.parquet(new[3]).collect()} == {1} | {i for i in range(200) if i % 4 == 3}
    assert {r.doc_id for r in spark.read.parquet(new[1]).collect()} == {i for i in range(200) if i % 4 == 1 and i != 1}


def test_rewrite_writes_each_row_once(spark, tmp_path):
    rows = [(i % 40, f"text {i % 60}" * (i % 7), i % 3) for i in range(400)] + [(None, "no id", 0), (None, "no id", 1), (None, "other", 2), (None, None, 0), (7, None, 1), (7, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").withColumn("slot", F.lit("clash"))
    for k, old in enumerate((F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)), F.col("part"))):
        placed = R.reshard(docs, old, 3, 5).cache()
        new = R.rewrite(docs, placed, {s: f"old/{s}" for s in range(3)}, str(tmp_path / f"new{k}"), old_shard=old)
        assert sorted(new) == list(range(5)) and all(p.startswith(str(tmp_path)) for p in new.values())
        found = {s: spark.read.parquet(p).collect() for s, p in new.items()}
        assert sorted(((r.doc_id, r.text, r.part) for rs in found.values() for r in rs), key=str) == sorted(rows, key=str)
        want = sorted((r.shard, r.slot, str(r.doc), r.size, r.text_crc32) for r in placed.collect())
        assert sorted((s, r.slot, str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for s, rs in found.items() for r in rs) == want


def test_rewrite_leaves_copies_in_untouched_shards(spark, tmp_path):
    rows = [(5, "same", "a", 0), (5, "same", "b", 1), (None, "x", "c", 1), (6, "y", "d", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string, part int")
    placed = docs.select(F.col("doc_id").alias("doc"), F.crc32("text").alias("text_crc32"), F.col("part").alias("old_shard"), F.when(F.col("part") == 1, 2).otherwise(F.col("part")).alias("shard"), F.col("part").alias("slot"))
    new = R.rewrite(docs, placed, {s: f"old/{s}" for s in range(3)}, str(tmp_path / "new"), old_shard=F.col("part"))
    assert new[0] == "old/0" and sorted(new) == [0, 2]
    assert sorted(r.note for r in spark.read.parquet(new[2]).collect()) == ["b", "c", "d"]
