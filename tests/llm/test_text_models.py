import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import _kernels as K
from plumbline.llm import language_id as L
from plumbline.llm import quality_nbsvm as Q
from plumbline.llm._tables import text_buffer

SEEDS = {
    "en": "the house of that man is there with something and nothing would thing",
    "de": "das haus des mannes ist dort und nicht schön über eine straße gegangen",
    "fr": "la maison de cet homme est là avec quelque chose et rien ne serait où",
    "ru": "дом этого человека там и ничего не было бы вещь которая стоит",
}


def prose(lang, n, r):
    words = SEEDS[lang].split()
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = [(i, prose(lang := r.choice(list(SEEDS)), r.randint(3, 60), r), lang, "x") for i in range(400)]
    rows += [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "123 !!! ...", "de", "x"), (1003, prose("en", 20, r), None, "x"), (None, prose("ru", 5, r), None, "x")]
    rows += [(1004, prose("en", 3000, r) + " " + prose("ru", 20, r), None, "x"), (7, rows[7][1], rows[7][2], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language_id(docs):
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = L.fit(docs, fold != 1)
    assert model.languages == sorted(SEEDS)
    out = L.with_languages(docs, model).collect()
    assert len(out) == 407
    for r in out:
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
        elif r.lang and r.doc_id < 1000:
            assert r.lang_pred == r.lang and 0 <= r.score <= 1
        elif r.doc_id == 1004:
            assert r.lang_pred == "en" and [s.lang for s in r.spans] == ["en", "ru"]
            assert r.spans[1].end == len(r.text.encode()) and r.text.encode()[r.spans[1].start :].decode().split()[0] in SEEDS["ru"]
    assert L.with_languages(docs.limit(0), model).count() == 0


def test_no_language_to_learn(docs):
    model = L.fit(docs.filter("lang is null"))
    assert {r.lang_pred for r in L.with_languages(docs, model).collect()} == {"und"}


def test_viterbi_against_all_paths():
    r = np.random.default_rng(0)
    sizes = [0, 1, 5, 3, 0, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    s = r.normal(size=(first[-1], 3)).round(3) * 3
    got = L.viterbi(s.astype(np.float32), first, 1.5)
    for a, b in zip(first, first[1:]):
        def worth(path):
            return sum(s[a + t, x] for t, x in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))

        if b > a:
            assert worth(got[a:b]) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=int(b - a)))), abs=1e-4)


def test_words_and_hashes_do_not_depend_on_place():
    texts = ["Ein Wort", "", "wort\tein", None, " nbsp ein", "einein"]
    raw, s, e = text_buffer(pa.array(texts))
    at, to = K.word_spans(raw, s)
    words = [bytes(raw[a:b]).decode() for a, b in zip(at, to)]
    assert words == ["Ein", "Wort", "wort", "ein", " nbsp", "ein", "einein"]
    h = K.span_hashes(K.LOWER[raw], at, to)
    assert h[0] == h[3] == h[5] and h[1] == h[2] and len(set(h.tolist())) == 4


def junk(lang, n, r):
    return " ".join(w + r.choice(["%%%", "$$$", "###"]) for w in prose(lang, n, r).split())


def test_quality_classifier(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        good = r.random() < 0.8
        rows.append((i, (prose if good else junk)(r.choice(list(SEEDS)), r.randint(2, 80), r), 0.5))
        labels.append((i, int(good), 0))
    rows += [(1000, None, 0.5), (1001, "", 0.5), (None, "no id", 0.5), (3, rows[3][1], 0.5), (1002, prose("en", 20_000, r), 0.5)]
    labels += [(3, labels[3][1], 1), (4, 0, 0), (4, 1, 0), (1002, None, 0), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = Q.fit(docs, known, fold != 2)
    out = Q.with_scores(docs, model).collect()
    assert len(out) == 505 and all(0 <= x.score <= 1 for x in out)
    truth = {i: q for i, q, _ in labels[:500]}
    right = [(x.score >= 0.7) == bool(truth[x.doc_id]) for x in out if x.doc_id is not None and x.doc_id < 500 and x.doc_id != 4]
    assert np.mean(right) > 0.97
    again = {x.doc_id: x.score for x in Q.with_scores(docs.repartition(7), Q.fit(docs.repartition(3), known, fold != 2)).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-6 for x in out)
    assert Q.with_scores(docs.limit(0), model).count() == 0


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.score for x in Q.with_scores(docs, Q.fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(x.score > 0.5 for x in Q.with_scores(docs, Q.fit(docs, ones)).collect())


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(1)
    rows = [(np.sort(r.choice(50, 5, replace=False)), r.normal(size=5)) for _ in range(40)]
    y = np.where(r.random(40) < 0.5, 1.0, -1.0)
    cost = np.full(40, 0.5)
    w, b = Q.dual_coordinate_descent(rows, y, cost, rounds=500)

    def worth(w, b):
        return (w @ w + b * b) / 2 + sum(c * max(0, 1 - t * (w[i] @ v + b)) for (i, v), t, c in zip(rows, y, cost))

    least = worth(w, b)
    for _ in range(200):
        assert worth(w + np.pad(r.normal(size=50) * 0.01, (0, len(w) - 50)), b + r.normal() * 0.01) >= least - 1e-3


def test_more_languages_than_a_byte_holds():
    from plumbline.llm import language_id

    scores = np.zeros((6, 300), np.float32)
    scores[:3, 299], scores[3:, 128] = 50, 50
    assert language_id.viterbi(scores, np.array([0, 6])).tolist() == [299] * 3 + [128] * 3
