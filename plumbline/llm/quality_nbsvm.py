"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams, of two kinds: words (one and two), and
shapes (one to three) where a word's shape is its case, its digits and signs
and whether it repeats the word before. Each indicator is scaled by the log
ratio of its smoothed counts in the two classes; the scaled words are brought to
length 1 so that long texts don't drown the shapes. A linear model with hinge
loss is fitted to them by dual coordinate descent (Hsieh et al., 2008), and
margins that were not fitted on give the logistic that turns a margin into a
score.

Fitting takes at most about :data:`SAMPLE` labelled rows, picked by a hash of
the id; only these rows' n-gram sets reach the driver. Scoring is one pass over
whole texts with a model of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _kernels as K
from plumbline.llm._tables import lean, runs_of_bytes, text_buffer

#: Labelled rows to fit on, at most about so many.
SAMPLE = 6_000
#: Slots for word n-grams and for shape n-grams.
WORDS, SHAPES = 1 << 18, 1 << 14
RUN_BYTES = 512 << 10

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWERS = np.zeros(256, bool)
_LOWERS[97:123] = True
_LOWERS[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = ~(_UPPER | _LOWERS | _DIGIT | K.SPACES)


def _slot(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(64 - size.bit_length() + 1)).astype(np.int32)


def indicators(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the ascending slots of its n-grams; shapes come after words."""
    low = K.LOWER[raw]
    at, to = K.word_spans(raw, starts)
    words = K.span_hashes(low, at, to)
    first = np.append(np.searchsorted(at, starts), len(at))

    def within(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag[raw])])
        return total[to] - total[at]

    if len(at):
        upper, lower, signs = within(_UPPER), within(_LOWERS), within(_SIGN)
        tail = raw[to - 1]
        same = np.zeros(len(at), np.uint64)
        same[1:] = words[1:] == words[:-1]
        same[first[:-1][first[:-1] < len(at)]] = 0
        shape = (
            np.minimum(upper, 2).astype(np.uint64)
            + np.uint64(3) * (lower > 0).astype(np.uint64)
            + np.uint64(6) * (within(_DIGIT) > 0).astype(np.uint64)
            + np.uint64(12) * np.minimum(signs, 3).astype(np.uint64)
            + np.uint64(48) * same
            + np.uint64(96) * np.where(_SIGN[tail], tail, 0).astype(np.uint64)
        )
        shape = K.mix(shape + np.uint64(77))
    else:
        shape = words
    for a, b in zip(first, first[1:]):
        w, s = words[a:b], shape[a:b]
        grams = [_slot(w, WORDS)] + ([_slot(K.shingles(w, 2), WORDS)] if len(w) > 1 else [])
        forms = [_slot(K.shingles(s, n), SHAPES) for n in (1, 2, 3) if len(s) >= n]
        yield np.concatenate([np.unique(np.concatenate(grams)), WORDS + np.unique(np.concatenate(forms))]) if len(w) else np.zeros(0, np.int32)


@dataclass
class Model:
    """``weight``: of each slot, log ratio and fitted weight multiplied;
    ``square``: the squared log ratios of words, for their length."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, slots: np.ndarray) -> float:
        cut = int(np.searchsorted(slots, WORDS))
        length = float(np.sqrt(self.square[slots[:cut]].sum())) or 1.0
        return float(self.weight[slots[:cut]].sum()) / length + float(self.weight[slots[cut:]].sum()) + self.bias

    def score(self, slots: np.ndarray) -> float:
        z = self.slope * self.margin(slots) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Of each slot; smoothing is dealt to the classes by their share of the
    rows, so that a slot that no row has says nothing (0)."""
    size = np.array([(y <= 0).sum(), (y > 0).sum()], float)
    counts = [np.full(WORDS + SHAPES, smooth * n / size.sum()) for n in size]
    for slots, label in zip(rows, y):
        counts[int(label > 0)][slots] += 1
    return np.log(counts[1] / size[1]) - np.log(counts[0] / size[0])


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum cost * hinge(y (w.x + b)).
    A constant component of 1 carries the bias."""
    w, bias = np.zeros(WORDS + SHAPES), 0.0
    alpha = np.zeros(len(y))
    square = np.array([v @ v + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            slots, v = rows[i]
            gradient = y[i] * (w[slots] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[slots] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def logistic_of_margins(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's logistic, by Newton steps with a floor."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step = step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    """With rows of one class only, every score is that class's smoothed share."""
    y = np.where(labels > 0, 1.0, -1.0)
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    if not pos or not neg:
        share = (pos + 1) / (pos + neg + 2)
        return Model(np.zeros(WORDS + SHAPES, np.float32), np.zeros(WORDS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))

    def trained(own: np.ndarray) -> Model:
        r = log_count_ratios([rows[i] for i in own], y[own])
        data = []
        for i in own:
            v = r[rows[i]]
            cut = int(np.searchsorted(rows[i], WORDS))
            v[:cut] /= float(np.sqrt(v[:cut] @ v[:cut])) or 1.0
            data.append((rows[i], v))
        share = np.where(y[own] > 0, len(own) / (2 * max(1, (y[own] > 0).sum())), len(own) / (2 * max(1, (y[own] < 0).sum())))
        w, bias = dual_coordinate_descent(data, y[own], cost * share)
        return Model((w * r).astype(np.float32), (r[:WORDS] ** 2).astype(np.float32), bias, 1.0, 0.0)

    fold = np.random.default_rng(5).permutation(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3):
        if set(y[fold != k]) == {1.0, -1.0}:
            part = trained(np.flatnonzero(fold != k))
            for i in np.flatnonzero(fold == k):
                margins[i] = part.margin(rows[i])
    model = trained(np.arange(len(y)))
    model.slope, model.offset = logistic_of_margins(margins, y)
    return model


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts, ends = text_buffer(batch.column(1))
        for i, j in runs_of_bytes(starts, ends, RUN_BYTES):
            base = starts[i]
            rows = list(indicators(raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc", "label", "slots"]
            )


def fit(
    docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model:
    """``learn_from``: which labels may be used, by a condition on the id.
    Labels that are null or contradict each other for an id are left out."""
    known = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col(id_col).isNotNull())
    if learn_from is not None:
        known = known.filter(learn_from)
    known = known.groupBy(id_col).agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select(F.col(id_col).alias("doc"), "label")
    share = int(min(1.0, sample / max(1, known.count())) * (1 << 30))
    picked = known.filter(F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) <= share)
    # About ``sample`` rows of two numbers.
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc").select("doc", "text", "label")
    got = rows.mapInArrow(lean(_slots_of), "doc long, label int, slots binary").toArrow().combine_chunks()
    label, slots = got.column("label").to_numpy(), got.column("slots").to_pylist()
    order = sorted(range(len(slots)), key=lambda i: (got.column("doc")[i].as_py(), slots[i]))
    return fit_rows([np.frombuffer(slots[i], np.int32) for i in order], label[order])


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score_col``, from 0 to 1, higher for good
    text. A column of that name is replaced. Null and empty texts are scored as
    a text without n-grams."""
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    place = names.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, starts, ends = text_buffer(batch.column(place))
            out = [
                m.score(slots)
                for i, j in runs_of_bytes(starts, ends, RUN_BYTES)
                for slots in indicators(raw[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean(score), f"{schema}, `{score_col}` double")


def op4_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = fit(docs, labels, fold != 2)
    scored = with_scores(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
