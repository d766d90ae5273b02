"""Exact top-k by inner product through M-trees.

An inner product becomes a metric by one more component: with every vector's
squared length raised to the largest one, M, by a last component (0 for a
query), the squared distance of query and vector is |q|^2 + M - 2 q.v, so the
nearest vectors are those of highest score.

The top level of the metric tree is a bounded set of pivots of a sample: every
row goes to its nearest pivot, whose covering radius is the largest distance of
its rows. A cell is dealt into M-trees of about :data:`TREE_ROWS` rows, so that
no task holds a hot cell; all trees of a cell have its pivot as root. A tree is
a row of a table: pages with, for each entry, its covering radius and its
distance to the page's routing object. Queries come in blocks of one cell, and a
block is sent only to cells whose radius some query of it can reach; each tree
meets the blocks in lots of :data:`LOT_BLOCKS`, and a task holds one tree and
one lot. A query takes the pages of a tree in the order of their least possible
distance and ends when that exceeds the distance of its k-th best. Before any
product is taken, the stored parent distance rules entries out by the triangle
inequality. Each query starts with the k-th best of the sample as its mark.
Scores are whole numbers, so results and ties are exact; bounds carry a slack
far above rounding.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm._tables import written

#: Rows of a tree, of a leaf page and of an inner page; queries of a block;
#: rows of the sample that gives the pivots and each query's first mark.
TREE_ROWS, LEAF_ROWS, FANOUT, BLOCK_ROWS, SAMPLE_ROWS = 4_096, 256, 16, 512, 4_096
#: The most pivots of a vector length, and blocks that meet a tree in one task.
MOST_CELLS, LOT_BLOCKS = 1_024, 32
_SLACK = 1e-6


def quantised(column: pa.Array, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None for one that is null or empty or
    has null or non-finite components."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = np.array(v.values.to_numpy(zero_copy_only=False), np.float64) if v.is_valid else np.zeros(0)
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.floor(x * scale)
        out.append(y if len(y) and np.isfinite(y).all() else None)
    return out


def products(rows: np.ndarray, q: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Inner products of whole numbers: by floats where no sum can reach 2**53."""
    if exact_floats:
        return rows @ q
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q)) for r in rows], object)


@dataclass
class Page:
    """One node. ``rows``: routing objects of the children, or a leaf's members."""

    rows: np.ndarray
    to_parent: np.ndarray
    radius: np.ndarray | None = None
    children: list[Page] = field(default_factory=list)
    ids: np.ndarray | None = None


def _distances(rows: np.ndarray, lift: np.ndarray, one: np.ndarray, one_lift: float, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 * most - 2 * (rows @ one) - 2 * lift * one_lift))


def lifts(rows: np.ndarray, most: float) -> np.ndarray:
    """The component that raises each row's squared length to ``most``."""
    return np.sqrt(np.maximum(0.0, most - (rows**2).sum(1)))


def build(
    ids: np.ndarray, rows: np.ndarray, most: float, leaf: int = LEAF_ROWS, fanout: int = FANOUT, centre: np.ndarray | None = None
) -> Page:
    """An M-tree over all rows. ``most``: squared length that all are lifted to;
    ``centre``: the root's routing object, the first row unless given."""
    lift = lifts(rows, most)
    rng = np.random.default_rng(7)

    def page(members: np.ndarray, routing: np.ndarray, routing_lift: float, distance: np.ndarray) -> Page:
        if len(members) <= leaf:
            return Page(rows[members], distance, ids=ids[members])
        some = rng.choice(len(members), min(len(members), fanout, 1 + len(members) // leaf), replace=False)
        pivots = members[some]
        table = np.stack([_distances(rows[members], lift[members], rows[p], lift[p], most) for p in pivots], 1)
        near = table.argmin(1)
        parts = [(p, np.flatnonzero(near == c), table[:, c]) for c, p in enumerate(pivots)]
        parts = [x for x in parts if len(x[1])]
        if len(parts) == 1:  # all rows alike: halves around the one pivot
            p, all_, far = parts[0]
            parts = [(p, half, far) for half in np.array_split(all_, 2)]
        chosen = [p for p, _, _ in parts]
        out = Page(
            rows[chosen],
            _distances(rows[chosen], lift[chosen], routing, routing_lift, most),
            np.array([far[own].max() for _, own, far in parts]),
        )
        out.children = [page(members[own], rows[p], lift[p], far[own]) for p, own, far in parts]
        return out

    root = rows[0] if centre is None else centre
    root_lift = float(lifts(root[None], most)[0])
    return page(np.arange(len(ids)), root, root_lift, _distances(rows, lift, root, root_lift, most))


def spread(rows: np.ndarray, count: int, most: float) -> np.ndarray:
    """``count`` of the rows at most, each the furthest from those before it."""
    lift = lifts(rows, most)
    chosen, far = [0], _distances(rows, lift, rows[0], lift[0], most)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(rows, lift, rows[chosen[-1]], lift[chosen[-1]], most))
    return rows[chosen]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    """(-score, id) of the k best, ties to the smaller id."""
    some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    some = some[np.lexsort((ids[some], -scores[some]))[:k]]
    return list(zip((-scores[some]).tolist(), ids[some].tolist()))


def search(root: Page, root_row: np.ndarray, q: np.ndarray, q_id: int, k: int, mark: float, most: float, exact_floats: bool, radius: float = np.inf) -> list[tuple[int, int]]:
    """(score, id) of the k best of the tree, ties to the smaller id; those
    below ``mark`` may be left out. ``radius``: covering radius of the root."""
    base = float(q @ q) + most
    slack = _SLACK * (1 + np.sqrt(base))
    best: list[tuple] = []  # heap of (score, -id)

    def reach(score: float) -> float:
        return float(np.sqrt(max(0.0, base - 2 * float(score))) + slack)

    limit = reach(mark) if mark > -np.inf else np.inf
    d_root = reach(products(root_row[None], q, exact_floats)[0]) - slack
    queue = [(max(0.0, d_root - radius), 0, root, d_root)]
    n = 0
    while queue:
        bound, _, page, d_parent = heapq.heappop(queue)
        if bound > limit:
            break
        gap = np.abs(d_parent - page.to_parent)
        if page.ids is not None:
            open_ = np.flatnonzero((gap <= limit) & (page.ids != q_id))
            found, ids = products(page.rows[open_], q, exact_floats), page.ids[open_]
            if len(best) == k:
                some = np.flatnonzero(found >= best[0][0])
                found, ids = found[some], ids[some]
            if len(ids) > 2 * k and exact_floats:
                first = _first(found, ids, k)
            else:
                first = sorted(zip((-found).tolist(), ids.tolist()))[:k]
            for score, i in first:
                item = (-score, -i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                limit = min(limit, reach(best[0][0]))
        else:
            open_ = np.flatnonzero(gap - page.radius <= limit)
            score = products(page.rows[open_], q, exact_floats).astype(np.float64)
            d = np.sqrt(np.maximum(0.0, base - 2 * score))
            low = np.maximum(0.0, d - page.radius[open_])
            for c, x, b in zip(open_.tolist(), d.tolist(), low.tolist()):
                if b <= limit:
                    n += 1
                    heapq.heappush(queue, (b, n, page.children[c], x))
    return [(int(s), -i) for s, i in best]


def top_k(
    vectors: DataFrame, is_query: str, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` that satisfy
    the SQL condition ``is_query`` on the id column.

    Defined cases: an id stands for one vector (where it is repeated, the one
    of least bytes); null ids take no part, nor do vectors that are null or
    empty, hold null or non-finite components or have a squared length beyond
    double precision; vectors of unlike length are no candidates for each
    other; a score beyond 64 bits ranks as it is and is given as the nearest long; fewer than k
    candidates give fewer rows; no queries or no rows give no rows; other
    columns are not read.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext

    def to_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = quantised(batch.column(1), scale)
            with np.errstate(over="ignore"):
                squares = [np.inf if y is None else float(y @ y) for y in ys]
            keep = [i for i, s in enumerate(squares) if s < np.inf]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array([ys[i].tobytes() for i in keep], pa.binary()),
                    pa.array([squares[i] for i in keep], pa.float64()),
                ],
                names=["vec_id", "body", "square"],
            )

    rows = vectors.filter(f"{id_col} is not null").select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    whole = rows.mapInArrow(to_whole, "vec_id long, body binary, square double")
    whole = written(whole.groupBy("vec_id").agg(F.min(F.struct("body", "square")).alias("v")).select("vec_id", "v.*"), "whole-vectors")
    is_asked = F.expr(is_query.replace(id_col, "vec_id"))
    total, most, asked = whole.agg(F.count(F.lit(1)), F.max("square"), F.count_if(is_asked)).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not asked:
        return spark.createDataFrame([], out)
    exact_floats = most < 2.0**52

    def matrix(bodies) -> np.ndarray:
        return np.stack([np.frombuffer(b, np.float64) for b in bodies])

    share = int(min(1.0, SAMPLE_ROWS / total) * (1 << 30))
    picked = whole.filter(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(1 << 30)) <= share).select("vec_id", "body")
    by_dim: dict[int, list] = {}
    for r in sorted(map(tuple, picked.collect())):  # about SAMPLE_ROWS vectors
        by_dim.setdefault(len(r[1]), []).append(r)
    cells = min(MOST_CELLS, -(-total // TREE_ROWS))
    like = {dim: (np.array([i for i, _ in known]), matrix([b for _, b in known])) for dim, known in by_dim.items()}
    pivots = {dim: spread(x, max(1, round(cells * len(x) / sum(map(len, by_dim.values())))), most) for dim, (_, x) in like.items()}
    model = sc.broadcast((like, pivots))

    def from_pivots(x: np.ndarray, lift: np.ndarray, centres: np.ndarray) -> np.ndarray:
        d = 2 * most - 2 * (x @ centres.T) - 2 * lift[:, None] * lifts(centres, most)
        return np.sqrt(np.maximum(0.0, d))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, centres = model.value
        for batch in batches:
            for dim, some in batch.groupby(batch["body"].map(len)):
                cell, near = np.zeros(len(some), np.int32), np.full(len(some), np.inf)
                if dim in centres:  # a length that the sample lacks has one cell without a bound
                    x = matrix(some["body"])
                    d = from_pivots(x, lifts(x, most), centres[dim])
                    cell = d.argmin(1)
                    near = d[np.arange(len(x)), cell]
                yield pd.DataFrame({"dim": dim, "cell": cell, "near": near, "vec_id": some["vec_id"], "body": some["body"]})

    placed = written(whole.select("vec_id", "body").mapInPandas(place, "dim int, cell int, near double, vec_id long, body binary"), "placed-vectors")
    parts = lambda n, most_rows: F.ceil(n / most_rows).cast("int")
    sizes = placed.groupBy("dim", "cell").agg(parts(F.count(F.lit(1)), TREE_ROWS).alias("trees"), parts(F.count_if(is_asked), BLOCK_ROWS).alias("blocks"), F.max("near").alias("radius"))
    sizes = sizes.collect()  # one row a pivot, and one for each length that the sample lacks
    first, blocks, radii = [], 0, {}
    for r in sizes:
        first.append((r.dim, r.cell, r.trees, r.blocks, blocks))
        blocks += r.blocks
        radii[r.dim, r.cell] = r.radius
    known = spark.createDataFrame(first, "dim int, cell int, trees int, blocks int, first int")
    reaches = sc.broadcast(radii)

    def to_tree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        dim, cell, shard = map(int, key)
        group = group.sort_values("vec_id")
        x = matrix(group["body"])
        centre = model.value[1][dim][cell] if dim in model.value[1] else x[0]
        tree = build(group["vec_id"].to_numpy(), x, most, centre=centre)
        return pd.DataFrame({"dim": [dim], "cell": [cell], "shard": [shard], "tree": [pickle.dumps((tree, centre, reaches.value[dim, cell]), protocol=5)]})

    dealt = placed.join(F.broadcast(known), ["dim", "cell"])
    sharded = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("trees")).cast("int"))
    forest = written(sharded.select("dim", "cell", "shard", "vec_id", "body").groupBy("dim", "cell", "shard").applyInPandas(to_tree, "dim int, cell int, shard int, tree binary"), "m-trees")

    def to_block(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        dim, no = map(int, key)
        samples, centres = model.value
        group = group.sort_values("vec_id")
        q, ids = matrix(group["body"]), group["vec_id"].to_numpy()
        marks = np.full(len(q), -np.inf)
        open_ = [0]
        if dim in samples:
            others, x = samples[dim]
            if len(x) > k and exact_floats:
                s = q @ x.T
                s[ids[:, None] == others[None]] = -np.inf
                marks = np.partition(s, -k, axis=1)[:, -k]
            base = (q**2).sum(1) + most
            slack = _SLACK * (1 + np.sqrt(base))
            limit = np.where(marks > -np.inf, np.sqrt(np.maximum(0.0, base - 2 * np.maximum(marks, -base))) + slack, np.inf)
            d = np.sqrt(np.maximum(0.0, base[:, None] - 2 * (q @ centres[dim].T)))
            radius = np.array([reaches.value.get((dim, c), -np.inf) for c in range(len(centres[dim]))])
            open_ = np.flatnonzero((d - radius <= (limit + slack)[:, None]).any(0) & (radius > -np.inf)).tolist()
        return pd.DataFrame({"dim": [dim], "lot": [no // LOT_BLOCKS], "cells": [open_], "queries": [pickle.dumps((ids, q, marks), protocol=5)]})

    asked_rows = dealt.filter(is_asked).withColumn("no", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int"))
    in_blocks = asked_rows.select("dim", "no", "vec_id", "body").groupBy("dim", "no").applyInPandas(to_block, "dim int, lot int, cells array<int>, queries binary")
    query_blocks = written(in_blocks, "query-blocks")
    sent = query_blocks.select("dim", "lot", "queries", F.explode("cells").alias("cell")).join(F.broadcast(known.select("dim", "cell", "trees")), ["dim", "cell"])
    sent = sent.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("shard"), "lot", "queries")
    in_lots = forest.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // LOT_BLOCKS))))

    def look(trees: pd.DataFrame, lot: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(trees):
            root, centre, radius = pickle.loads(trees["tree"].iloc[0])
            for block in lot["queries"]:
                ids, q, marks = pickle.loads(block)
                for i, x, m in zip(ids.tolist(), q, marks):
                    best = search(root, centre, x, i, k, m, most, exact_floats, radius)
                    found += [(i, v, max(-(2**63), min(2**63 - 1, s)), b"" if exact_floats else (s + 2**1151).to_bytes(144, "big")) for s, v in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "whole"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    key = ["dim", "cell", "shard", "lot"]
    found = in_lots.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(look, "query_id long, vec_id long, score long, whole binary")
    # ``whole``: the score in bytes that sort as it does, where 64 bits may not hold it.
    order = Window.partitionBy("query_id").orderBy(F.desc("whole"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")
