"""Resharding by minimum-cost flow.

Old shards are sources, new shards sinks; a unit of flow is a byte, and a byte
costs nothing where it stays and one where it moves. The cheapest flow that
fills the new capacities says how many bytes each old shard sends to each new
one. The bytes of an old shard lie in blocks (by a hash of the row), a block's
rows in a fixed order; the flow cuts this line of bytes into stretches, so
whole blocks move together and only blocks on a cut are parted row by row.

What reaches the driver is bounded by parameters: old shards x blocks totals
and at most new shards x ``fine`` large documents. Those (each above one
``fine``-th of an even share) are placed one by one, largest first, where they
are if there is room, so that stretches only hold small ones and end close to
their mark.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm._tables import written


def cheapest_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Transport of ``supply`` to ``demand`` (equal sums) at least cost, by
    shortest augmenting paths with potentials."""
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    m, n = len(supply), len(demand)
    source, sink, size = m + n, m + n + 1, m + n + 2
    graph: list[list[list[int]]] = [[] for _ in range(size)]  # [to, room, cost, place of the reverse arc]

    def arc(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        arc(source, i, x, 0)
        for j in range(n):
            arc(i, m + j, x, cost[i][j])
    for j, x in enumerate(demand):
        arc(m + j, sink, x, 0)
    potential = [0] * size
    left = sum(supply)
    while left:
        far: list[float] = [float("inf")] * size
        came: list[tuple[int, int] | None] = [None] * size
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                to = d + price + potential[a] - potential[b]
                if room and to < far[b]:
                    far[b], came[b] = to, (a, k)
                    heapq.heappush(heap, (to, b))
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far)]
        path, b = [], sink
        while b != source:
            a, k = came[b]
            path.append((a, k))
            b = a
        push = min(left, *(graph[a][k][1] for a, k in path))
        for a, k in path:
            step = graph[a][k]
            step[1] -= push
            graph[step[0]][step[3]][1] += push
        left -= push
    flow = {}
    for i in range(m):
        for b, room, price, _ in graph[i]:
            if m <= b < m + n and supply[i] - room > 0:
                flow[i, b - m] = supply[i] - room
    return flow


def level_capacities(loads: list[int], rest: int) -> list[int]:
    """Shares of ``rest`` that make loads as even as they can be: all are
    raised to one level, those above it get nothing. Remainders go to the
    lowest shard numbers."""
    low, high = min(loads), max(loads) + rest
    while low < high:  # the highest level that rest can pay for
        mid = (low + high + 1) // 2
        if sum(max(0, mid - x) for x in loads) <= rest:
            low = mid
        else:
            high = mid - 1
    out = [max(0, low - x) for x in loads]
    spare = rest - sum(out)
    for j in (j for j, x in enumerate(loads) if x <= low):
        if not spare:
            break
        out[j] += 1
        spare -= 1
    return out


def place_large(docs: list[tuple[int, int]], shards: int, total: int) -> tuple[list[int], list[int]]:
    """Shards of (size, old shard) documents given largest first, and the loads."""
    loads, out = [0] * shards, []
    share = total // shards
    for size, old in docs:
        if not (old < shards and loads[old] + size <= share):
            old = min(range(shards), key=lambda j: (loads[j], j))
        loads[old] += size
        out.append(old)
    return out, loads


def stretches(supply: list[int], flow: dict[tuple[int, int], int]) -> list[list[tuple[int, int]]]:
    """For each old shard, (end of stretch, new shard) along its bytes; what
    stays comes first."""
    out = []
    for i in range(len(supply)):
        parts = sorted(((j != i, j, x) for (a, j), x in flow.items() if a == i))
        end, line = 0, []
        for _, j, x in parts:
            end += x
            line.append((end, j))
        out.append(line)
    return out


def reshard(
    docs: DataFrame, old_shard: Column, old_shards: int, shards: int, overhead: int = 8, blocks: int = 256, fine: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, size, text_crc32, old_shard, block, shard, slot) for each row.

    ``size`` is the UTF-8 bytes of the text and ``overhead``. Slots count from
    0 in each shard without gaps. Defined cases: a null text has no bytes, and
    crc32 0; a null id is a row like others; repeated rows are placed apart;
    no rows, no result; other columns are not read. ``old_shard`` outside 0 to
    ``old_shards`` - 1 or null counts as 0.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    where = old_shard.cast("int")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when((where >= 0) & (where < old_shards), where).otherwise(0).alias("old_shard"),
    ).withColumn("block", F.pmod(F.xxhash64("doc", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    rows = written(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    large_from = total // (shards * fine) + 1
    is_large = F.col("size") >= large_from  # fewer than shards * fine rows can be

    same = Window.partitionBy("doc", "size", "text_crc32", "old_shard").orderBy("block")
    large = rows.filter(is_large).withColumn("copy", F.row_number().over(same))
    listed = sorted((tuple(r) for r in large.select("size", "doc", "text_crc32", "old_shard", "copy").collect()), key=lambda r: (-r[0], str(r[1]), *r[2:]))
    at, loads = place_large([(r[0], r[3]) for r in listed], shards, total)
    placed = spark.createDataFrame([(*r, s) for r, s in zip(listed, at)], "size long, doc long, text_crc32 long, old_shard int, copy int, shard int")
    match = [large[c].eqNullSafe(placed[c]) for c in ("doc", "size", "text_crc32", "old_shard", "copy")]
    large_out = large.join(F.broadcast(placed), match).select(large.doc, large.size, large.text_crc32, large.old_shard, F.lit(-1).alias("block"), "shard")

    small = rows.filter(~is_large)
    totals = {(r.old_shard, r.block): r.n for r in small.groupBy("old_shard", "block").agg(F.sum("size").alias("n")).collect()}
    bases, supply = [], []
    for i in range(old_shards):
        end = 0
        for b in range(blocks):
            bases.append((i, b, end))
            end += totals.get((i, b), 0)
        supply.append(end)
    cost = [[int(i != j) for j in range(shards)] for i in range(old_shards)]
    lines = stretches(supply, cheapest_flow(supply, level_capacities(loads, sum(supply)), cost))
    # old_shards x blocks rows, and old_shards rows of at most shards stretches each.
    base = spark.createDataFrame(bases, "old_shard int, block int, base long")
    line = spark.createDataFrame(list(enumerate(lines)), "old_shard int, line array<struct<end:long,shard:int>>")
    order = Window.partitionBy("old_shard", "block").orderBy("doc", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = small.withColumn("run", F.sum("size").over(order))
    # Twice the middle of the row's bytes, in whole numbers.
    middle = 2 * (F.col("base") + F.col("run")) - F.col("size")
    cut = F.filter("line", lambda s: 2 * s["end"] > middle)[0]["shard"]
    small_out = small.join(F.broadcast(base), ["old_shard", "block"]).join(F.broadcast(line), "old_shard").select("doc", "size", "text_crc32", "old_shard", "block", cut.alias("shard"))

    return with_slots(small_out.unionByName(large_out))


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds ``slot`` by two passes: counts of (shard, old shard, block) summed
    along each shard, then the row's number within its own."""
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "old_shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("old_shard", "block", "shard").orderBy("doc", "text_crc32", "size")
    numbered = placed.withColumn("row", F.row_number().over(own) - 1)
    # Bounded by old shards x blocks x 2 and a few more.
    return numbered.join(F.broadcast(bases), ["shard", "old_shard", "block"]).withColumn("slot", F.col("first") + F.col("row")).drop("first", "row")


def rewrite(
    documents: DataFrame, placed: DataFrame, layout: dict[int, str], target: str, id_col: str = "doc_id", text_col: str = "text", old_shard: Column | None = None
) -> dict[int, str]:
    """Writes the shards that gain or lose rows below ``target`` and returns the
    new layout; shards that keep all their rows keep their folder. ``layout``:
    the old shards' folders. Rows meet their places by id (null too), text_crc32
    where ``placed`` has it, and the number of the copy, so each row is written
    once. ``old_shard``, as given to :func:`reshard`, is needed where rows equal
    in id and text lie in different old shards. Nothing old is touched, so a
    run that breaks off leaves the old layout whole."""
    changed = {s for r in placed.filter("shard <> old_shard").select("shard", "old_shard").distinct().collect() for s in r}
    kept = {s: p for s, p in layout.items() if s not in changed}
    if changed:
        text = F.coalesce(F.col(text_col), F.lit(""))
        own = {"_doc": F.col(id_col).cast("long")}
        there = {"_doc": F.col("doc")}
        if "text_crc32" in placed.columns:
            own["_crc32"], there["_crc32"] = F.crc32(text), F.col("text_crc32")
        if old_shard is not None:
            where = old_shard.cast("int")
            own["_old"], there["_old"] = F.when((where >= 0) & (where <= F.lit(max(layout))), where).otherwise(0), F.col("old_shard")
        # Copies of one key are numbered by size on both sides, so that sizes agree.
        plain = [c for c, kind in documents.dtypes if "map<" not in kind and kind != "variant"]
        keys, clash = list(own), [c for c in ("shard", "slot") if c in documents.columns]
        number = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = documents.withColumns(own).withColumn("_copy", number(F.octet_length(text), *plain)).drop(*clash)
        by_size = ["size"] if "size" in placed.columns else []
        moved = placed.withColumns(there).withColumn("_copy", number(*by_size, "shard", "slot")).filter(F.col("shard").isin(*changed)).select(*keys, "_copy", "shard", "slot")
        match = [rows[c].eqNullSafe(moved[c]) for c in (*keys, "_copy")]
        out = rows.join(moved, match).select(*[rows[c] for c in documents.columns if c not in clash], "shard", "slot")
        out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(target)
    filled = {r.shard for r in placed.select("shard").distinct().collect()}
    return kept | {s: f"{target}/shard={s}" for s in changed if s in filled}


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 16 shards by a hash of the id to 24 of even bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(16))
    out = reshard(docs, old, 16, 24)
    return out.select(
        F.col("doc").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", "block"
    )
