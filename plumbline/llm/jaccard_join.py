"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles (64-bit hashes). Shingles are put in
one order, rarest first, by counts over all documents in a table of fixed size.
Two sets of similarity t or more share one of their first
n - ceil(t n) + 1 shingles, their prefixes. Then:

* documents with equal sets are one class, and classes with the same prefix and
  size are one group; only groups have postings (shingle, group, n, position);
* groups that share a prefix shingle are paired if their sizes and the places
  of the shingle in both prefixes leave room for a link: no link is lost, as the
  first shingle that two linked sets share always leaves it;
* pairs are then filtered by parity sketches of the member classes: the bits in
  which two of them differ are a lower bound of the sets' difference;
* what is left is verified on the whole sets.

Links only need to connect, so a pair whose ends are in one component already is
not looked at. The first round pairs all groups of a shingle that few groups
have, those of other shingles with the least group of their size band, and the
classes of a group with its head. It leaves open only shingles of many groups,
or of groups of several classes, whose classes lie in different components. Of
these the second round verifies a spanning forest of the pairs that sketches
allow, and the third every pair that is still open, which makes the result exact.
Shingles of many classes are compared in blocks that hold one band of sizes
each, with the blocks of the same and of the next band; nothing but fixed-size
tables reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _kernels as K
from plumbline.llm._tables import dropped, lean, runs_of_bytes, text_buffer, written
from plumbline.llm.components import components

#: Counters for shingle frequencies, and bits of the filter of wanted documents.
COUNTERS, WANTED_BITS = 1 << 20, 1 << 24
RUN_BYTES = 512 << 10
#: Groups of a shingle that are all paired at once; classes of one that are compared in one piece.
FEW, BLOCK = 16, 1_024
_SLICES = 64


def shingle_sets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingles of each text."""
    at, to = K.word_spans(raw, starts)
    h = K.span_hashes(K.LOWER[raw], at, to)
    first = np.append(np.searchsorted(at, starts), len(at))
    for a, b in zip(first, first[1:]):
        yield np.unique(K.shingles(h[a:b], words)) if b > a else h[:0]


def _sets_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    raw, starts, ends = text_buffer(column)
    for i, j in runs_of_bytes(starts, ends, RUN_BYTES):
        base = starts[i]
        yield from shingle_sets(raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base, words)


def total_of_arrays(df: DataFrame, size: int, fill: Callable[[np.ndarray, pa.RecordBatch], None], either: bool = False) -> np.ndarray:
    """One array of ``size`` counters over all partitions: ``fill`` adds a batch
    to a partition's own. ``either``: 0 or 1 in place of the sum. Partitions
    send their array in slices, which are summed on the executors."""
    step = size // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint8 if either else np.int32)
        empty = True
        for batch in batches:
            fill(own, batch)
            empty = False
        if not empty:
            parts = [(np.packbits(own[k * step : (k + 1) * step]) if either else own[k * step : (k + 1) * step]).tobytes() for k in range(_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "body"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b, np.uint8 if either else np.int32) for b in group["body"]]
        total = np.bitwise_or.reduce(parts) if either else np.minimum(np.sum(parts, axis=0, dtype=np.int64), 2**31 - 1).astype(np.int32)
        return pd.DataFrame({"slice": [key[0]], "body": [total.tobytes()]})

    schema = "slice int, body binary"
    # Sums of some partitions first, so that no task gets a slice of all of them.
    some = df.mapInArrow(lean(count), schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    partly = some.groupBy("slice", "part").applyInPandas(lambda key, g: add(key, g), schema)
    out = np.zeros(size // 8 if either else size, np.uint8 if either else np.int32)
    width = len(out) // _SLICES
    for k, body in partly.groupBy("slice").applyInPandas(add, schema).collect():
        out[k * width : (k + 1) * width] = np.frombuffer(body, out.dtype)
    return out


def parity_sketch(h: np.ndarray, percent: int = 80) -> bytes:
    """Bit i: whether an odd number of shingles fall on i. As many bits as the
    set has shingles, rounded up to a power of two, 256 at least; half of them
    tell sets apart where the similarity asked for is high."""
    bits = 1 << max(8, int(len(h) - 1).bit_length() - (percent >= 85))
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same set with ``size`` bytes."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def sketch_distance(a: bytes, b: bytes) -> int:
    """Lower bound of the number of shingles in one set alone."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def set_hashes(h: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set of shingles."""
    with np.errstate(over="ignore"):
        total = np.array([K.mix(h).sum(dtype=np.uint64) + np.uint64(len(h)), K.mix(h ^ np.uint64(0x5BF0_3635_DCF9_8A1D)).sum(dtype=np.uint64) * np.uint64(3)])
    return tuple(K.mix(total).view(np.int64).tolist())


_DESCRIBED = [("n", pa.int64(), "long"), ("class", pa.int64(), "long"), ("check", pa.int64(), "long"), ("group", pa.int64(), "long"), ("prefix", pa.binary(), "binary"), ("sketch", pa.binary(), "binary")]


def described(docs: DataFrame, counts, words: int, percent: int) -> DataFrame:
    """doc, n, class and check (hashes of the set; null without words), group,
    prefix (rarest shingle first), sketch of each row, and ``text_key`` if
    ``docs`` has it as its third column. ``counts``: broadcast shingle counters."""
    keys = docs.columns[2:]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.minimum(counts.value, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)
        for batch in batches:
            rows: list[list] = [[] for _ in _DESCRIBED]
            for h in _sets_of(batch.column(1), words):
                n = len(h)
                if not n:
                    for r, x in zip(rows, (0, None, None, None, None, None)):
                        r.append(x)
                    continue
                order = often[(h >> np.uint64(44)).astype(np.int64)] | (h & np.uint64((1 << 44) - 1))
                p = prefix_length(n, percent)
                first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                prefix = h[first[np.lexsort((h[first], order[first]))]]
                with np.errstate(over="ignore"):
                    part = K.mix(np.array([K.mix(prefix).sum(dtype=np.uint64) * np.uint64(31) + np.uint64(n)]))
                for r, x in zip(rows, (n, *set_hashes(h), int(part.view(np.int64)[0]), prefix.tobytes(), parity_sketch(h, percent))):
                    r.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(r, t) for r, (_, t, _) in zip(rows, _DESCRIBED)), *batch.columns[2:]], names=["doc", *(x for x, _, _ in _DESCRIBED), *keys]
            )

    return docs.mapInArrow(lean(describe), ", ".join(["doc long", *(f"`{x}` {kind}" for x, _, kind in _DESCRIBED), *(f"{k} string" for k in keys)]))


def told_apart(table: DataFrame) -> DataFrame:
    """``table`` whose ``class`` differs where ``check`` does, so that unlike
    sets whose first hash is the same stay two classes."""
    hashes = table.filter("class is not null").groupBy("class", "check").agg(F.lit(1).alias("one"))
    clash = hashes.groupBy("class").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("class", F.lit(True).alias("clashes"))
    if clash.isEmpty():
        return table
    again = F.when(F.col("clashes"), F.xxhash64("class", "check")).otherwise(F.col("class"))
    return table.join(clash, "class", "left").withColumn("class", again).drop("clashes").select(*table.columns)


def _similar_sizes(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def has_room(x: Column, y: Column, percent: int) -> Column:
    """Whether sets of x.n and y.n shingles may link if the first one they share
    is at x.pos and y.pos: what they can share from there on is enough."""
    left = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent) & (left * (100 + percent) >= (x["n"] + y["n"]) * percent)


def band_of(n: Column, percent: int) -> Column:
    """A number of a size, so that sizes that may link differ by 1 at most."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100.0 / percent) * 1.01)).cast("int")


def _sketches_allow(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, sa, sb) whose sketches allow a link."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            far = np.array([sketch_distance(x, y) for x, y in zip(p["sa"], p["sb"])], np.int64)
            ok = far * (100 + percent) <= (p["na"] + p["nb"]).to_numpy() * (100 - percent)
            yield p.loc[ok, ["a", "b"]]

    return pairs.mapInPandas(check, "a long, b long")


def spanning(p: np.ndarray, q: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Places of a least spanning forest's edges among (p, q) of n nodes (Boruvka)."""
    root, chosen = np.arange(n), []
    rank = np.lexsort((q, p, far))
    p, q, place = p[rank], q[rank], rank
    while len(p):
        a, b = root[p], root[q]
        live = a != b
        p, q, place, a, b = p[live], q[live], place[live], a[live], b[live]
        if not len(p):
            break
        best = np.full(n, len(p))
        np.minimum.at(best, a, np.arange(len(p)))
        np.minimum.at(best, b, np.arange(len(p)))
        pick = np.unique(best[best < len(p)])
        chosen.append(place[pick])
        for x, y in zip(a[pick].tolist(), b[pick].tolist()):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while not np.array_equal(root, root[root]):
            root = root[root]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _open_pairs(postings: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """(token, a, b) of classes that share a prefix shingle, lie in different
    components and may link: a spanning forest of each block, or all of them.
    ``postings``: token, class, n, pos, sketch, component; tokens with one
    component are left out before."""
    total = postings.groupBy("token", band_of(F.col("n"), percent).alias("band")).agg(F.count(F.lit(1)).alias("rows"))
    entry = F.struct("band", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    # Sizes have a few hundred bands at most, which is what a shingle's map holds.
    sizes = total.groupBy("token").agg(F.sum("rows").alias("rows"), F.map_from_entries(F.collect_list(entry)).alias("bands"))
    dealt = postings.join(sizes, "token").withColumn("band", band_of(F.col("n"), percent))
    blocks = lambda band: F.coalesce(F.try_element_at("bands", band), F.lit(0))
    number = lambda band, k: band.cast("long") * (1 << 24) + k
    own = number(F.col("band"), F.pmod(F.xxhash64("class"), F.greatest(blocks(F.col("band")), F.lit(1)).cast("long")))
    near = F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)
    numbers = F.flatten(F.transform(near, lambda g: F.when(blocks(g) > 0, F.transform(F.sequence(F.lit(1), F.greatest(blocks(g), F.lit(1))), lambda k: number(g, k - 1))).otherwise(F.array().cast("array<bigint>"))))
    one = F.col("rows") <= BLOCK
    dealt = dealt.withColumn("own", F.when(one, F.lit(0).cast("long")).otherwise(own)).withColumn("other", F.explode(F.when(one, F.array(F.lit(0).cast("long"))).otherwise(numbers)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "n", "pos", "sketch", "component")
    keys = ["token", "i", "j"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, "class")

    def distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
        """Lower bounds of differences; each pair at the size of its smaller sketch."""
        a, b = np.array(list(map(len, left))), np.array(list(map(len, right)))
        far = np.zeros((len(left), len(right)), np.int32)
        for size in np.unique(np.concatenate([a, b])):
            for p, q in ((np.flatnonzero(a == size), np.flatnonzero(b >= size)), (np.flatnonzero(a > size), np.flatnonzero(b == size))):
                if not (len(p) and len(q)):
                    continue
                x = np.frombuffer(b"".join(folded(left[k], size).tobytes() for k in p), np.uint64).reshape(len(p), -1)
                y = np.frombuffer(b"".join(folded(right[k], size).tobytes() for k in q), np.uint64).reshape(len(q), -1)
                part = np.zeros((len(p), len(q)), np.int32)
                for w in range(x.shape[1]):
                    part += np.bitwise_count(x[:, w][:, None] ^ y[:, w][None])
                far[np.ix_(p, q)] = part
        return far

    def compare(own: np.ndarray, diagonal: bool, ids: np.ndarray, n: np.ndarray, pos: np.ndarray, parts: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(own)
        right = left if diagonal else np.flatnonzero(~own)
        x, y = n[left][:, None], n[right][None]
        room = np.minimum((n - pos)[left][:, None], (n - pos)[right][None])
        ok = (parts[left][:, None] != parts[right][None]) & (np.minimum(x, y) * 100 >= np.maximum(x, y) * percent) & (room * (100 + percent) >= (x + y) * percent)
        rows, columns = ok.any(1), ok.any(0)  # the rest needs no sketch
        left, right, ok = left[rows], right[columns], ok[np.ix_(rows, columns)]
        far = distances([sketches[k] for k in left], [sketches[k] for k in right])
        ok &= far * (100 + percent) <= (n[left][:, None] + n[right][None]) * (100 - percent)
        p, q = np.nonzero(ok)
        d = far[p, q]
        p, q = left[p], right[q]
        if diagonal:
            once = p < q
            p, q, d = p[once], q[once], d[once]
        if not all_pairs and len(p):
            _, node = np.unique(parts, return_inverse=True)
            keep = spanning(node[p], node[q], d, int(node.max()) + 1)
            p, q = p[keep], q[keep]
        return np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])

    none = np.zeros(0, np.int64)

    def compare_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            at = rows[keys].to_numpy()
            cut = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1, [len(at)]])
            own, ids, n, pos, parts = (rows["own"] == rows["i"]).to_numpy(), rows["class"].to_numpy(), rows["n"].to_numpy(), rows["pos"].to_numpy(), rows["component"].to_numpy()
            sketches = rows["sketch"].tolist()
            diagonal = (rows["i"] == rows["j"]).to_numpy()
            found = [(rows["token"].iat[x], *compare(own[x:y], bool(diagonal[x]), ids[x:y], n[x:y], pos[x:y], parts[x:y], sketches[x:y])) for x, y in zip(cut, cut[1:]) if y - x > 1]
            token = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
            return pd.DataFrame({"token": token, "a": np.concatenate([none, *(f[1] for f in found)]), "b": np.concatenate([none, *(f[2] for f in found)])})

        for batch in batches:
            # A group that the batch may not have ended waits for the next one.
            last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
            if not last.all():
                kept.append(batch[~last])
                yield done(pd.concat(kept, ignore_index=True))
                kept = []
                batch = batch[last]
            elif kept and tuple(kept[-1][keys].iloc[-1]) != tuple(batch[keys].iloc[0]):
                yield done(pd.concat(kept, ignore_index=True))
                kept = []
            kept.append(batch)
        if kept:
            yield done(pd.concat(kept, ignore_index=True))

    return ordered.mapInPandas(lean(compare_all), "token long, a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a written table) that link, as a written table.
    ``classes``: class, check, doc."""
    sc = docs.sparkSession.sparkContext
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = written(ends.join(classes.select("class", "check", "doc"), "class"), "wanted")
    spot = F.pmod(F.xxhash64("doc"), F.lit(WANTED_BITS))

    def fill(own: np.ndarray, batch: pa.RecordBatch) -> None:
        own[batch.column(0).to_numpy()] = 1

    # Documents that are not wanted are dropped where they are read.
    filter_bits = sc.broadcast(total_of_arrays(wanted.select(spot.alias("spot")), WANTED_BITS, fill, either=True))  # 2 MB

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_bits.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = pa.array(bits[at >> 3] >> (7 - (at & 7)) & 1 == 1)
            docs_, texts = batch.column(0).filter(keep), batch.column(1).filter(keep)
            found = list(_sets_of(texts, words))
            checks = [set_hashes(h)[1] if len(h) else None for h in found]
            yield pa.RecordBatch.from_arrays([docs_, pa.array(checks, pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], names=["doc", "check", "members"])

    made = docs.select("doc", "text", spot.alias("spot")).mapInArrow(lean(sets), "doc long, check long, members binary")
    # A class's set comes from its one listed document.
    same = (wanted["check"] == made["check"]) & wanted["doc"].eqNullSafe(made["doc"])
    bodies = written(wanted.join(made, same).select(wanted["class"], "members").groupBy("class").agg(F.first("members").alias("members")), "sets")
    filter_bits.destroy()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = []
            for x, y in zip(p["ma"], p["mb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield p.loc[np.array(ok, bool), ["a", "b"]]

    with_a = pairs.join(bodies.select(F.col("class").alias("a"), F.col("members").alias("ma")), "a")
    both = with_a.join(bodies.select(F.col("class").alias("b"), F.col("members").alias("mb")), "b")
    links = written(both.select("a", "b", "ma", "mb").mapInPandas(lean(check), "a long, b long"), "text-links")
    dropped(wanted, bodies)
    return links


def _grouped_postings(groups: DataFrame) -> DataFrame:
    """token, group, n, pos, groups (how many have the token) of the prefix
    shingles that two groups have. ``groups``: group, n, prefix."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                tokens = [np.frombuffer(b, np.int64) for b in part.column(2).to_pylist()]
                times = [len(t) for t in tokens]
                pos = np.concatenate([np.arange(t, dtype=np.int32) for t in times])
                own, n = (np.repeat(part.column(k).to_numpy(), times) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(own), pa.array(n.astype(np.int32)), pa.array(pos)], names=["token", "group", "n", "pos"])

    postings = groups.select("group", "n", "prefix").mapInArrow(lean(explode), "token long, `group` long, n int, pos int")
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    return postings.join(shared, "token")


def _first_pairs(postings: DataFrame, groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the first round: classes that stand for their groups, and
    classes of a group with its head."""
    row = F.struct("group", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))
    few = postings.filter(F.col("groups") <= FEW).groupBy("token").agg(F.array_sort(F.collect_list(row)).alias("all"))  # FEW rows a token
    pair = lambda x: F.transform(F.filter("all", lambda y: (y["group"] > x["group"]) & has_room(x, y, percent)), lambda y: F.struct(x["group"].alias("x"), y["group"].alias("y")))
    apart = few.select(F.explode(F.flatten(F.transform("all", pair))).alias("p")).select("p.x", "p.y")
    many = postings.filter(F.col("groups") > FEW).select("token", band_of(F.col("n"), percent).alias("band"), row.alias("y"))
    least = many.groupBy("token", "band").agg(F.min("y").alias("x"))
    stars = many.join(least, ["token", "band"]).filter((F.col("x.group") < F.col("y.group")) & has_room(F.col("x"), F.col("y"), percent)).select(F.col("x.group").alias("x"), F.col("y.group").alias("y"))
    group_pairs = apart.unionByName(stars).distinct()
    head = groups.select("group", "head")
    heads = group_pairs.join(head.select(F.col("group").alias("x"), F.col("head").alias("a")), "x").join(head.select(F.col("group").alias("y"), F.col("head").alias("b")), "y").select("a", "b")
    inside = classes.join(head, "group").filter("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    pairs = heads.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    of = lambda k: classes.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    return _sketches_allow(pairs.join(of("a"), "a").join(of("b"), "b"), percent)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """(doc, n_shingles, component_id), one row for each row of ``docs``; with
    ``keys`` also text_key, the text's md5, and component_key, which tells
    components apart where ids are null or repeated (null without a shingle).

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    than ``words`` words has the one shingle of them all. Documents link when
    100 * common >= ``percent`` * united. Defined cases: a null or blank text
    has no shingle, links with nothing and is its own component; repeated rows
    link as equal texts do; a null id links by its text, but names a component
    only if there is no other id in it (its component is then null); ties at
    the threshold link; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("text_key", F.md5("text")) if keys else rows

    def fill(own: np.ndarray, batch: pa.RecordBatch) -> None:
        for h in _sets_of(batch.column(1), words):
            np.add.at(own, (h >> np.uint64(44)).astype(np.int64), 1)

    counts = spark.sparkContext.broadcast(total_of_arrays(rows, COUNTERS, fill))  # 4 MB
    table = told_apart(written(described(keyed, counts, words, percent), "described"))
    counts.destroy()

    # Classes of equal sets, each with one document to read its set from.
    filled = table.filter("class is not null")
    classes = written(
        filled.groupBy("class").agg(F.min("doc").alias("doc"), *(F.first(c).alias(c) for c in ("check", "n", "group", "prefix", "sketch"))),
        "classes",
    )
    groups = classes.groupBy("group").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    groups = written(groups, "groups")
    postings = written(_grouped_postings(groups), "postings")
    groups = groups.drop("prefix")

    first = written(_first_pairs(postings, groups, classes, percent), "pairs")
    links = _verified(first, rows, classes, words, percent)
    dropped(first)

    # Shingles that the first round did not settle by itself.
    several = groups.filter("members > 1").select("group")
    kept = postings.join(several.withColumn("several", F.lit(1)), "group", "left").withColumn("several", F.coalesce("several", F.lit(0)))
    unsettled = kept.groupBy("token").agg(F.max("several").alias("several"), F.first("groups").alias("groups")).filter(f"several = 1 or groups > {FEW}").select("token")
    live = postings.join(unsettled, "token").select("token", "group", "pos")
    live = written(live.unionByName(several.select(F.col("group").alias("token"), "group", F.lit(0).alias("pos"))), "unsettled")
    for all_pairs in (False, True):
        known = components(links).select(F.col("id").alias("class"), F.col("component_id").alias("component"))
        placed = classes.select("class", "group", "n", "sketch").join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))
        spread = placed.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        # Shingles whose groups all lie in one component have nothing left to say.
        open_tokens = live.join(spread, "group").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("token")
        found = written(_open_pairs(live.join(open_tokens, "token").join(placed, "group").select("token", "class", "n", "pos", "sketch", "component"), percent, all_pairs), "open-pairs")
        pairs = written(found.select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            break
        links = links.unionByName(_verified(pairs, rows, classes, words, percent))
        # Pairs only get fewer, so a shingle that had none has none in the next round.
        now = written(live.join(found.select("token").distinct(), "token", "left_semi"), "unsettled")
        dropped(live, found, pairs)
        live = now

    found = components(links).select(F.col("id").alias("class"), F.col("component_id").alias("component"))
    of_class = written(classes.select("class", F.col("doc").alias("least")).join(found, "class", "left").withColumn("component", F.coalesce("component", "class")), "class-components")
    dropped(postings, classes, live)
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    more = ["text_key", F.col("component").alias("component_key")] if keys else []
    names = of_class.join(least, "component").select("class", "component_id", "component")
    out = table.select("doc", "n", "class", *(["text_key"] if keys else [])).join(names, "class", "left")
    return out.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"), *more)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=3, percent=90).withColumnRenamed("doc", "doc_id")
