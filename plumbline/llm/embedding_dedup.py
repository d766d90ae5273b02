"""Near-duplicate vectors: spherical k-means cells, blocked cosine products.

Equal vectors are one row with a weight before anything is compared, so a hot
group of copies is a single row. Cells have two levels, each with centroids that
are fitted on a bounded sample (:data:`SAMPLE`, :data:`PART_SAMPLE`): a vector
goes to its nearest cell, and there to its nearest part, so the number of parts
grows with the rows (up to :data:`MOST_CELLS` squared, about eight thousand
million rows). A part is dealt into blocks of about ``block`` rows, so that no
task holds a cell or a part. Each pair of blocks is one group, unless their parts are so far apart
that no link can lead from one to the other: two unit vectors at the threshold
are arccos(threshold) apart, so by the triangle inequality cells or parts whose
centroids are further apart than that and both covering angles have no link.
The same bound thins out the rows of a group. What it does not rule out is
compared, so the result is exact. Where vectors fill the sphere evenly it rules
out nothing, and the products grow with the square of the rows.

A group yields rows for the vectors that have links there: their number, and
the smallest vector its links lead to. Pairs themselves are never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm._tables import written
from plumbline.llm.components import components, forest

#: At most about so many vectors are used to fit the centroids.
SAMPLE = 32_768
#: Vectors a cell should hold, the most cells there are and parts of a cell, and
#: vectors for each part that fit the centroids of a cell's parts.
CELL_ROWS, MOST_CELLS, PART_SAMPLE = 8_192, 1_024, 32
#: Rows of a block that are compared with the other block at once.
TILE_ROWS = 512
#: Blocks that meet one block in a task.
LOT_BLOCKS = 4
#: Slack of the bounds on angles, far above their rounding.
SLACK = 1e-6


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length 1 in double precision; None for one that is null,
    empty or zero or has null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: list[np.ndarray | None] = []
    for v in column:
        if not v.is_valid:
            out.append(None)
            continue
        x = np.array(v.values.to_numpy(zero_copy_only=False), np.float64)
        # A null component reads as NaN. Scaling first keeps tiny and huge vectors exact.
        top = np.abs(x).max(initial=0.0)
        if not np.isfinite(x).all() or top == 0:
            out.append(None)
            continue
        x /= top
        out.append(x / np.sqrt(x @ x))
    return out


def _to_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = unit_vectors(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())], names=["vec_id", "unit"]
        )


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Spherical k-means: centroids of length 1, fewer than k if rows are few."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.sqrt((sums**2).sum(1))
        full = length > 1e-12
        new = centres.copy()
        new[full] = sums[full] / length[full, None]
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def _padded(units: list[bytes], width: int) -> np.ndarray:
    x = np.zeros((len(units), width))
    for i, u in enumerate(units):
        v = np.frombuffer(u, np.float64)
        x[i, : len(v)] = v[:width]
    return x


def reach(centres: np.ndarray, angles: np.ndarray, threshold: float, others: np.ndarray | None = None, their: np.ndarray | None = None) -> np.ndarray:
    """Whether a link can lead from one cell to another (or to ``others``), by
    their covering angles."""
    others, their = (centres, angles) if others is None else (others, their)
    apart = np.arccos(np.clip(centres @ others.T, -1, 1))
    return apart <= angles[:, None] + their + np.arccos(np.clip(threshold, -1, 1)) + SLACK


def _hits(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products reach the threshold: in single precision (``x32``,
    ``y32``), and in double where that is too close to tell."""
    s = x32 @ y32.T
    slack = (x.shape[1] + 4) * 2.0**-23
    p, q = np.nonzero(s >= np.float32(threshold - slack))
    sure = s[p, q] >= threshold + slack
    close = np.flatnonzero(~sure)
    for at in range(0, len(close), 1 << 16):
        some = close[at : at + (1 << 16)]
        sure[some] = np.einsum("ij,ij->i", x[p[some]], y[q[some]]) >= threshold
    return p[sure], q[sure]


def _links(a: np.ndarray, v: np.ndarray, x: np.ndarray, b: np.ndarray, w: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> list[pd.DataFrame]:
    """Link counts and smallest partners of two blocks (ids, weights, units), or
    of a block with itself."""
    out = []
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    for at in range(0, len(a), TILE_ROWS):
        end = at + TILE_ROWS
        own = a[at:end]
        # Of a block with itself, each pair once: the rows up to this tile's end.
        other = b[: at + len(own)] if same else b
        p, q = _hits(x[at:end], y[: len(other)], x32[at:end], y32[: len(other)], threshold)
        if same:
            once = q < at + p
            p, q = p[once], q[once]
        if not len(p):
            continue
        # Sums of weights are whole numbers far below 2**53.
        to_own = np.bincount(p, w[q], len(own))
        to_other = np.bincount(q, v[at:end][p], len(other))
        count = pd.concat([pd.Series(to_own, own), pd.Series(to_other, other)]).groupby(level=0).sum()
        ids, low = forest(own[p], other[q])
        out.append(pd.DataFrame({"vec_id": ids, "n_links": count.reindex(ids).to_numpy().astype(np.int64), "low": low}))
    return out


def linked_in_cells(units: DataFrame, threshold: float, block: int) -> DataFrame:
    """(vec_id, n_links, low): partial link counts of vectors and, for each, the
    smallest vector that this group's links lead to. ``units``: vec_id, unit,
    weight; a link counts as often as the weight of the other vector says."""
    sc = units.sparkSession.sparkContext
    total, width = units.agg(F.count(F.lit(1)), F.max(F.octet_length("unit"))).first()
    if not total:
        return units.sparkSession.createDataFrame([], "vec_id long, n_links long, low long")
    width //= 8
    share = min(1.0, SAMPLE / total)
    picked = units if share == 1 else units.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sorted(map(tuple, picked.select("vec_id", "unit").collect()))  # about SAMPLE rows
    k = int(min(MOST_CELLS, max(1, total // CELL_ROWS)))
    centres = sc.broadcast(fit_centroids(_padded([r[1] for r in rows], width), k))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centres.value
        for batch in batches:
            s = _padded(batch["unit"].tolist(), width) @ c.T
            cell = s.argmax(1)
            yield pd.DataFrame({"cell": cell, "near": s[np.arange(len(s)), cell], "vec_id": batch["vec_id"], "unit": batch["unit"], "weight": batch["weight"]})

    # Vectors of unlike length never meet: the length is part of the cell.
    placed = written(units.mapInPandas(place, "cell int, near double, vec_id long, unit binary, weight long").withColumn("dim", F.octet_length("unit")), "cells")
    # One row a cell, MOST_CELLS for each vector length.
    sizes = placed.groupBy("cell", "dim").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect()
    angle = np.zeros(len(centres.value))
    for r in sizes:
        angle[r.cell] = max(angle[r.cell], np.arccos(np.clip(r.near, -1, 1)))
    near = reach(centres.value, angle, threshold)
    near |= near.T
    known = []
    for r in sizes:
        lots = -(-r.n // block)
        parts = min(MOST_CELLS, max(1, r.n // block))
        others = [x.cell for x in sizes if x.dim == r.dim and near[r.cell, x.cell]]
        known.append((r.cell, r.dim, lots, parts, int(min(1.0, parts * PART_SAMPLE / r.n) * (1 << 30)), others))
    cells = units.sparkSession.createDataFrame(known, "cell int, dim int, lots int, parts int, share int, others array<int>")
    dealt = placed.join(F.broadcast(cells.drop("others")), ["cell", "dim"])
    columns = ["dim", "cell", "part", "near", "vec_id", "unit", "weight"]
    settled = dealt.filter("parts = 1").withColumn("part", F.lit(0)).select(columns)

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        c = fit_centroids(_padded(group["unit"].tolist(), width), int(group["parts"].iloc[0]))
        return pd.DataFrame({"cell": [key[0]], "dim": [key[1]], "centres": [c.tobytes()]})

    # At most MOST_CELLS * PART_SAMPLE rows a cell; a cell of one part has its own centroid.
    few = dealt.filter((F.col("parts") > 1) & (F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(1 << 30)) <= F.col("share")))
    fitted = few.select("cell", "dim", "parts", "vec_id", "unit").groupBy("cell", "dim").applyInPandas(fit, "cell int, dim int, centres binary")
    split = any(parts > 1 for _, _, _, parts, _, _ in known)
    model = cells.select("cell", "dim", "lots", "parts", "others")
    model = written(model.join(fitted, ["cell", "dim"], "left"), "cell-parts") if split else model.withColumn("centres", F.lit(None).cast("binary"))

    def centres_of(cell: int, packed: bytes | None) -> np.ndarray:
        return centres.value[cell][None] if packed is None else np.frombuffer(packed, np.float64).reshape(-1, width)

    def settle(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        cell, dim, _ = map(int, key)
        if not len(rows):  # a lot that no row was dealt to
            return pd.DataFrame({name: [] for name in columns})
        s = _padded(rows["unit"].tolist(), width) @ centres_of(cell, own["centres"].iloc[0]).T
        part = s.argmax(1)
        return pd.DataFrame({"dim": dim, "cell": cell, "part": part, "near": s[np.arange(len(s)), part], "vec_id": rows["vec_id"], "unit": rows["unit"], "weight": rows["weight"]})

    if split:
        lots = dealt.filter("parts > 1").withColumn("lot", F.pmod(F.xxhash64("vec_id"), F.col("lots")).cast("int"))
        models = model.filter("parts > 1").select("cell", "dim", "centres", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
        key = ["cell", "dim", "lot"]
        parted = lots.select("cell", "dim", "lot", "vec_id", "unit", "weight").groupBy(*key).cogroup(models.groupBy(*key)).applyInPandas(settle, "dim int, cell int, part int, near double, vec_id long, unit binary, weight long")
        settled = settled.unionByName(written(parted, "settled"))
    counted = settled.groupBy("dim", "cell", "part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.min("near").alias("near"))
    parts = written(counted.groupBy("dim", "cell").agg(F.sort_array(F.collect_list(F.struct("part", "blocks", "near"))).alias("parts")).join(model.drop("parts"), ["dim", "cell"]), "parts")  # MOST_CELLS parts a row at most

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Pairs of parts of two cells that a link can join."""
        sides = []
        for r in group.itertuples():
            no = np.array([p["part"] for p in r.parts])
            close = np.array([p["near"] for p in r.parts])
            sides.append((r.cell << 10 | no, np.array([p["blocks"] for p in r.parts]), centres_of(r.cell, r.centres)[no], np.arccos(np.clip(close, -1, 1))))
        (a, m, x, u), (b, n, y, v) = sides[0], sides[-1]
        p, q = np.nonzero(reach(x, u, threshold, y, v) & ((len(sides) == 2) | (a[:, None] <= b)))
        return pd.DataFrame({"dim": int(key[0]), "a": a[p], "b": b[q], "m": m[p], "n": n[q], "ca": [c.tobytes() for c in x[p]], "cb": [c.tobytes() for c in y[q]], "ua": u[p], "ub": v[q]})

    sides = parts.select("dim", "cell", "centres", "parts", F.explode("others").alias("other"))
    by_pair = sides.groupBy("dim", F.least("cell", "other").alias("c"), F.greatest("cell", "other").alias("d"))
    pairs = by_pair.applyInPandas(meet, "dim int, a long, b long, m int, n int, ca binary, cb binary, ua double, ub double")
    code = lambda part, no: F.shiftleft(F.col(part), 32).bitwiseOR(F.col(no).cast("long"))
    pairs = pairs.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = pairs.withColumn("start", F.when(F.col("a") == F.col("b"), F.col("p")).otherwise(0))
    pairs = pairs.withColumn("q", F.explode(F.sequence(F.col("start"), F.col("n") - 1)))
    pairs = pairs.select("dim", code("a", "p").alias("i"), code("b", "q").alias("j"), "ca", "cb", "ua", "ub")
    # A block goes once to each lot of its partners; of the partners, the block itself comes first.
    pairs = pairs.withColumn("no", F.row_number().over(Window.partitionBy("dim", "i").orderBy("j")) - 1)
    bounds = ["ca", "ua", "cb", "ub"]
    once = F.when(F.col("no") % LOT_BLOCKS == 0, F.struct(F.col("i").alias("own"), *[F.lit(None).cast("double" if c[0] == "u" else "binary").alias(c) for c in bounds]))
    partner = F.when(F.col("i") != F.col("j"), F.struct(F.col("j").alias("own"), *bounds))
    asked = pairs.select("dim", "i", F.floor(F.col("no") / LOT_BLOCKS).alias("lot"), F.explode(F.array_compact(F.array(once, partner))).alias("x")).select("dim", "i", "lot", "x.*")

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        packed = {"dim": key[0], "own": key[1], "ids": group["vec_id"].to_numpy(np.int64).tobytes(), "weights": group["weight"].to_numpy(np.int64).tobytes(), "units": b"".join(group["unit"])}
        return pd.DataFrame({name: [value] for name, value in packed.items()})

    sized = settled.join(counted.drop("near"), ["dim", "cell", "part"])
    sized = sized.withColumn("part", F.shiftleft(F.col("cell").cast("long"), 10).bitwiseOR(F.col("part").cast("long"))).withColumn("no", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    packed = sized.select("dim", code("part", "no").alias("own"), "vec_id", "unit", "weight").groupBy("dim", "own").applyInPandas(pack, "dim int, own long, ids binary, weights binary, units binary")
    both = written(packed, "blocks").join(asked, ["dim", "own"])

    widest = np.arccos(np.clip(threshold, -1, 1)) + SLACK

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        dim, i, lot = map(int, key)
        out = [pd.DataFrame({"vec_id": [], "n_links": [], "low": []}).astype("int64")]

        def side(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return np.frombuffer(r.ids, np.int64), np.frombuffer(r.weights, np.int64), np.frombuffer(r.units, np.float64).reshape(-1, dim // 8)

        def near(block: tuple, centre: bytes, angle: float) -> list[np.ndarray]:
            """Rows of a block; those out of reach of the other's part have no links there."""
            s = block[2] @ np.frombuffer(centre, np.float64)[: dim // 8]
            within = np.arccos(np.clip(s, -1, 1)) <= angle + widest
            return [z[within] for z in block]

        rows = list(group.itertuples())
        own_block = next((side(r) for r in rows if r.own == i), None)
        if own_block is None:  # a block that no row was dealt to
            return out[0]
        if lot == 0:
            out += _links(*own_block, *own_block, threshold, True)
        for r in rows:
            if r.own != i:
                out += _links(*near(own_block, r.cb, r.ub), *near(side(r), r.ca, r.ua), threshold, False)
        return pd.concat(out)

    return both.groupBy("dim", "i", "lot").applyInPandas(compare, "vec_id long, n_links long, low long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, block: int = 8_192, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each id.

    Defined cases: an id stands for one vector, and where it is repeated the
    least of its vectors counts (repeated rows are thus one); a null id is
    dropped; a vector that is null, empty or zero, or holds null or non-finite
    components links with nothing; vectors of unlike length do not link; ties
    at the threshold link; an empty table gives an empty one; a threshold
    above 1 is an error.
    """
    if threshold > 1:
        raise ValueError("a cosine is 1 at most")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter("vec_id is not null")
    units = rows.mapInArrow(_to_units, "vec_id long, unit binary").groupBy("vec_id").agg(F.min("unit").alias("unit"))
    units = written(units.withColumn("same", F.md5("unit")), "units")
    # Of equal vectors the one of the smallest id stands for all.
    distinct = written(units.filter("unit is not null").groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("weight")), "distinct-units")
    links = written(linked_in_cells(distinct.drop("same"), threshold, block), "vector-links")
    counts = links.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    found = components(links, "vec_id", "low").withColumnRenamed("id", "vec_id")
    stands = distinct.select("same", "vec_id", "weight").join(counts, "vec_id", "left").join(found, "vec_id", "left")
    more = F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1  # copies link with each other
    stands = stands.select("same", more.alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = units.select("vec_id", "same").join(stands, "same", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
