import random
import re

import numpy as np
import pytest

from plumbline.llm import jaccard_join as J


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((m for m in ms if m is not None), default=None) for r, ms in members.items()}
    return sorted(((str(rows[i][0]), len(sets[i]), str(least[find(i)])) for i in range(len(rows))))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    base = [[r.choice(vocab) for _ in range(r.choice([8, 25, 60, 120]))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(r.randint(1, 8)):
            t = list(b)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocab)
            if r.random() < 0.2:
                t = t + ["tail"] * r.randint(1, 4)
            rows.append(" ".join(t))
    hot = [r.choice(vocab) for _ in range(70)]
    for i in range(90):
        t = list(hot)
        t[r.randrange(70)] = f"x{i}"
        if r.random() < 0.5:
            t[r.randrange(70)] = f"y{i}"
        rows.append(" ".join(t))
    rows += [rows[0]] * 30 + ["A b C", "a\tB\nc", "a b", "a  b", "one", None, "", " \n ", "ÄÖ ä x", "äö ä x"]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(None, rows[3]), (3, rows[3]), (None, "no copy of this one is there")]


@pytest.mark.parametrize("words,percent,seed,block,few", [(3, 90, 1, 16, 2), (5, 80, 2, 16, 16), (3, 90, 3, 64, 4)])
def test_against_brute_force(spark, monkeypatch, words, percent, seed, block, few):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "FEW", few)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = J.near_duplicates(docs.selectExpr("doc_id", "text", "'clash' as class"), words, percent).collect()
    assert sorted((str(x.doc), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, words, percent)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(docs).count() == 0
    one = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, J.near_duplicates(one).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_sketches_bound_the_difference():
    r = np.random.default_rng(0)
    for _ in range(100):
        pool = r.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = np.unique(r.choice(pool, r.integers(1, 900))), np.unique(r.choice(pool, r.integers(1, 900)))
        assert J.sketch_distance(J.parity_sketch(a, 90), J.parity_sketch(b, 90)) <= len(np.setxor1d(a, b))


def test_prefix_length_keeps_every_link():
    for percent in (80, 90):
        for n in range(1, 300):
            assert J.prefix_length(n, percent) == n - -(-percent * n // 100) + 1


def test_spanning_forest_is_least():
    p, q, far = np.array([0, 1, 0, 3, 2]), np.array([1, 2, 2, 4, 2]), np.array([5, 1, 2, 9, 0])
    assert sorted(J.spanning(p, q, far, 6).tolist()) == [1, 2, 3]


def test_sets_of_one_hash_are_told_apart_by_the_other(spark):
    columns = "doc long, n long, class long, `check` long"
    table = spark.createDataFrame([(1, 3, 7, 1), (2, 3, 7, 2), (3, 3, 7, 1), (4, 2, 8, 1), (5, 0, None, None)], columns)
    got = {r.doc: r["class"] for r in J.told_apart(table).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 8 and got[5] is None
    assert J.told_apart(table.filter("doc <> 2")).filter("class = 7").count() == 2


def test_sizes_that_may_link_are_in_bands_next_to_each_other(spark):
    from pyspark.sql import functions as F

    for percent in (80, 90):
        rows = [(n, -(-percent * n // 100)) for n in range(1, 3000)]
        bands = spark.createDataFrame(rows, "n long, least long").select(J.band_of(F.col("n"), percent).alias("a"), J.band_of(F.col("least"), percent).alias("b"))
        assert bands.filter("a - b not in (0, 1)").isEmpty()
