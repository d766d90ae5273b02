"""Connected components of a link table, on the executors alone.

Every partition first replaces its links by a forest of their ends, which keeps
components and leaves at most one link an end. Then alternating large-star and
small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014) turn the rest into stars around each component's smallest id in
about log(n) rounds; each is two aggregations with partial sums and joins. A
table that is stars already needs none. Rounds are written tables in the shared
folder, and each is deleted when the next one is whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._tables import dropped, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id in a or b, the smallest id it is joined to by these links."""
    ids, pos = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(a)
    x, y = pos[:n], pos[n:]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        new = root.copy()
        np.minimum.at(new, rx, low)
        np.minimum.at(new, ry, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


#: Links that a partition gathers before it reduces them to a forest.
GATHERED = 1 << 18


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of a partition's links: (end, smallest end it is joined to)."""
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def merge() -> None:
        ids, low = forest(*(np.concatenate(x) for x in zip(*kept)))
        kept[:] = [(ids[ids != low], low[ids != low])]

    new = 0
    for batch in batches:
        kept.append((batch["a"].to_numpy(np.int64), batch["b"].to_numpy(np.int64)))
        new += len(batch)
        # At least as many new links as the forest holds, so that merging costs a factor only.
        if new > max(GATHERED, len(kept[0][0])):
            merge()
            new = 0
    merge()
    a, b = kept[0]
    for i in range(0, len(a), 50_000):
        yield pd.DataFrame({"a": a[i : i + 50_000], "b": b[i : i + 50_000]})


def _are_stars(edges: DataFrame) -> bool:
    """Whether each link (a, b) is its a's only one and leads to no other's a."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("as_a"), F.lit(0).alias("as_b")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("as_a"), F.lit(1).alias("as_b")))
    return ends.groupBy("id").agg(F.sum("as_a").alias("as_a"), F.max("as_b").alias("as_b")).filter("as_a + as_b > 1").isEmpty()


def _with_least(links: DataFrame) -> DataFrame:
    """Adds to (u, v) the least of u and all its partners."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return links.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component_id) for each id that has a link to another one.

    Links may come in any direction and more than once; links of an id with
    itself and links with a null end are left out; no links give no rows.
    """
    first = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    edges = written(first.mapInPandas(_contract, "a long, b long").distinct().mapInPandas(_contract, "a long, b long"), "links")
    for _ in range(most_rounds):
        if _are_stars(edges):
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        star = _with_least(down)
        small = star.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(star.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, edges = edges, written(small.filter("a <> b").distinct().mapInPandas(_contract, "a long, b long"), "links")
        dropped(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    )
