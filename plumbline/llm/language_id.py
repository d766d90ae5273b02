"""Language identification: scripts, word scores, Viterbi spans.

A word (a run without white space) is scored for each learned language by the
log likelihood of the byte trigrams around its letters. The script of its first
letter narrows the candidates to languages that use it. Viterbi with a penalty
for each switch then labels all words of a text, so mixed text falls into spans
and a stray word does not. A text's language is the one whose spans hold most
letters.

Fitting takes about :data:`SAMPLE` labelled rows at most, picked by a hash of
the id; only trigram counts, bounded by languages x :data:`SLOTS`, reach the
driver. Labelling is one pass over whole texts. Texts of one batch are walked
together, one word of each a step.
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

SAMPLE = 12_000
SLOTS = 1 << 16
RUN_BYTES = 1 << 20
#: Log likelihood that a switch of language costs, and a word out of script.
SWITCH, OUT_OF_SCRIPT = 12.0, 25.0
UNDETERMINED = "und"

#: Scripts by ranges of code points (fixed values of the Unicode blocks).
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Kana": [(0x3040, 0x30FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
_EDGES = sorted((a, b, i + 1) for i, r in enumerate(SCRIPTS.values()) for a, b in r)
_LOW = np.array([a for a, _, _ in _EDGES])
_HIGH = np.array([b for _, b, _ in _EDGES])
_WHICH = np.array([i for _, _, i in _EDGES])


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Script numbers of code points, 0 for any other script."""
    k = np.searchsorted(_LOW, points, "right") - 1
    inside = (k >= 0) & (points <= _HIGH[np.maximum(k, 0)])
    return np.where(inside, _WHICH[np.maximum(k, 0)], 0)


@dataclass
class Words:
    """Words of consecutive texts: their bytes, letters, scripts (-1 without a
    letter), the first word of each text, and the buffer's trigram slots."""

    at: np.ndarray
    to: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    first: np.ndarray
    letter: np.ndarray
    trigram: np.ndarray


def words_of(raw: np.ndarray, starts: np.ndarray) -> Words:
    at, to = K.word_spans(raw, starts)
    letter = K._byte_classes(raw) == K._LETTER
    # Bytes that are no letters count as one sort of gap.
    low = np.where(letter, K.LOWER[raw], 32).astype(np.uint32)
    padded = np.concatenate([[32], low, [32]]).astype(np.uint32)
    tri = (padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA6B) + padded[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    lead = letter & ((raw & 0xC0) != 0x80)
    total = np.concatenate([[0], np.cumsum(lead)])
    where = np.append(np.flatnonzero(lead), 0)
    head = where[total[at]]
    letters = total[to] - total[at]
    padded4 = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (padded4[head + i] for i in range(4))
    point = np.where(
        b0 < 0x80, b0,
        np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(b0 < 0xF0, (b0 & 0xF) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, (b0 & 7) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F)),
    )
    script = np.where(letters > 0, scripts_of(point), -1)
    return Words(at, to, letters, script, np.append(np.searchsorted(at, starts), len(at)), letter, (tri >> np.uint32(16)).astype(np.uint16))


@dataclass
class Model:
    """``table``: log likelihood of a trigram slot for each language;
    ``uses``: whether a language uses a script."""

    languages: list[str]
    table: np.ndarray
    uses: np.ndarray

    def word_scores(self, raw: np.ndarray, w: Words) -> np.ndarray:
        out = np.zeros((len(w.at), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            each = np.where(w.letter, self.table[k][w.trigram], 0).astype(np.float64)
            total = np.concatenate([[0], np.cumsum(each)])
            out[:, k] = total[w.to] - total[w.at]
        known = self.uses[:, np.maximum(w.script, 0)].T & (w.script >= 0)[:, None]
        some = known.any(1)
        out[some] -= OUT_OF_SCRIPT * ~known[some]
        out[~some] = 0
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; words ``first[i]`` to ``first[i + 1]`` are
    one text. Ties stay in the language, then go to the lower one."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, sizes = first[:-1][order], n[order]
    steps = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")  # texts with a word at step t
    labels = np.zeros(len(scores), np.int32)
    if not steps:
        return labels
    k = scores.shape[1]
    best_before = np.zeros(len(scores), np.int32)
    switched = np.zeros((len(scores), k), bool)
    v = np.zeros((live[0], k))
    final = np.zeros(live[0], np.int32)
    for t in range(steps):
        m = live[t]
        if m < len(v):
            final[m : len(v)] = v[m:].argmax(1)
            v = v[:m]
        row = begin[:m] + t
        top = v.argmax(1)
        jump = v[np.arange(m), top][:, None] - switch
        take = jump > v
        best_before[row] = top
        switched[row] = take
        v = np.where(take, jump, v) + scores[row]
    final[: len(v)] = v.argmax(1)
    now = final.copy()
    for t in range(steps - 1, -1, -1):
        m = live[t]
        row = begin[:m] + t
        labels[row] = now[:m]
        now[:m] = np.where(switched[row, now[:m]], best_before[row], now[:m])
    return labels


def identify(model: Model, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text its language, a score and spans (first byte, end, language).
    Letters of words in scripts that no language uses speak for none: they only
    lower the score, and a text of such words alone is undetermined."""
    if not model.languages:
        return [(UNDETERMINED, 0.0, [])] * len(starts)
    w = words_of(raw, starts)
    scores = model.word_scores(raw, w)
    labels = viterbi(scores, w.first)
    decided = np.where(scores.any(1), w.letters, 0)
    names = model.languages
    out = []
    for i, (a, b) in enumerate(zip(w.first, w.first[1:])):
        total, own = int(w.letters[a:b].sum()), labels[a:b]
        if not decided[a:b].any():
            out.append((UNDETERMINED, 0.0, []))
            continue
        held = np.bincount(own, decided[a:b], len(names))
        best = int(held.argmax())
        likely = np.sort(scores[a:b][own == best].sum(0, dtype=np.float64) - 0.0)
        mine = float(scores[a:b][own == best, best].sum(dtype=np.float64))
        rival = float(likely[-2] if likely[-1] == mine else likely[-1]) if len(names) > 1 else -np.inf
        sure = 1 / (1 + np.exp(-np.clip((mine - rival) / 4, -50, 50)))
        change = np.flatnonzero(np.diff(own)) + 1
        cut = np.concatenate([[0], change, [b - a]])
        spans = [(int(w.at[a + x] - starts[i]), int(w.to[a + y - 1] - starts[i]), names[own[x]]) for x, y in zip(cut, cut[1:])]
        out.append((names[best], float(held[best] / total * sure), spans))
    return out


def fit(docs: DataFrame, learn_from: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows with a text and a language; ``learn_from``: which rows
    may be used. Without such rows the model knows no language."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    if learn_from is not None:
        rows = rows.filter(learn_from)
    total = rows.count()
    share = int(min(1.0, sample / max(1, total)) * (1 << 30))
    rows = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) <= share).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            raw, starts, ends = text_buffer(batch.column(0))
            langs = batch.column(1).to_pylist()
            for i, j in runs_of_bytes(starts, ends, RUN_BYTES):
                base = starts[i]
                w = words_of(raw[base : ends[j - 1]], starts[i:j] - base)
                for d in range(i, j):
                    tri, script = seen.setdefault(langs[d], (np.zeros(SLOTS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)))
                    a, b = starts[d] - base, ends[d] - base
                    np.add.at(tri, w.trigram[a:b][w.letter[a:b]], 1)
                    own = slice(w.first[d - i], w.first[d - i + 1])
                    letters = w.letters[own] > 0
                    np.add.at(script, w.script[own][letters], w.letters[own][letters])
        for lang, (tri, script) in seen.items():
            slot = np.concatenate([np.flatnonzero(tri), -1 - np.flatnonzero(script)])
            n = np.concatenate([tri[tri > 0], script[script > 0]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(n)], names=["lang", "slot", "n"])

    counted = rows.mapInArrow(lean(count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in counted})
    at = {x: i for i, x in enumerate(languages)}
    tri, script = np.zeros((len(languages), SLOTS)), np.zeros((len(languages), len(SCRIPTS) + 1))
    for lang, slot, n in counted:
        if slot >= 0:
            tri[at[lang], slot] = n
        else:
            script[at[lang], -1 - slot] = n
    seen = max(1, int((tri.sum(0) > 0).sum()))
    table = np.log((tri + 0.5) / (tri.sum(1, keepdims=True) + 0.5 * seen))
    # A script is used if it has a hundredth of the language's letters.
    uses = script >= 0.01 * np.maximum(1, script.sum(1, keepdims=True))
    return Model(languages, table.astype(np.float32), uses)


def with_languages(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` (``und`` for a null text or one
    without a letter of a script that some language uses), ``score`` (0 to 1) and ``spans``, an array of (start,
    end, lang) in UTF-8 bytes. Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    place = names.index(text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = text_buffer(batch.column(place))
            found = []
            for i, j in runs_of_bytes(starts, ends, RUN_BYTES):
                base = starts[i]
                found += identify(shared.value, raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base)
            spans = [[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, span)],
                names=[*names, "lang_pred", "score", "spans"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean(label), f"{schema}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = fit(docs, fold != 1)
    out = with_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
