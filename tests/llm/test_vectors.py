import numpy as np
import pytest

from plumbline.llm import embedding_dedup, metric_search
from plumbline.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k, every=5):
    ok = {}
    for i, v, _ in rows:
        if i is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        q = np.floor(256 * np.array(v, np.float32).astype(float))
        ok[i] = min(ok.get(i, q), q, key=lambda a: a.tobytes())
    out = []
    for i in (i for i in ok if i % every == 0):
        best = sorted((-int(ok[i] @ ok[j]), j) for j in ok if j != i and len(ok[j]) == len(ok[i]))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def make(n, dim=8, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0] + r.normal(size=(n // 3, dim)).astype(np.float32) * 0.01
    return [(i, v.tolist(), 0) for i, v in enumerate(x)]


ODD = [(9001, None, 0), (9005, [1.0, None], 0), (9010, [float("nan")] * 8, 0), (9015, [0.0] * 8, 0), (9020, [], 0), (9025, [1.0, 2.0], 0), (9030, [2.0, 2.0], 1), (None, [1.0] * 8, 0), (9035, [float("inf")] * 8, 0)]


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(metric_search, "TREE_ROWS", 150)
    monkeypatch.setattr(metric_search, "BLOCK_ROWS", 40)
    rows = make(600) + ODD + make(3)
    got = metric_search.top_k(spark.createDataFrame(rows, SCHEMA), "vec_id % 5 = 0").collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5)


def test_top_k_over_many_cells_trees_and_lots(spark, monkeypatch):
    for name, value in {"TREE_ROWS": 20, "BLOCK_ROWS": 8, "LOT_BLOCKS": 2, "SAMPLE_ROWS": 120, "MOST_CELLS": 9}.items():
        monkeypatch.setattr(metric_search, name, value)
    r = np.random.default_rng(5)
    groups = r.normal(size=(12, 6)) * 20
    x = (groups[r.integers(0, 12, 500)] + r.normal(size=(500, 6))).astype(np.float32)
    x[100:260] = x[100]  # a third of all rows are copies: one cell, many trees, ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD
    got = metric_search.top_k(spark.createDataFrame(rows, SCHEMA), "vec_id % 5 = 0").collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5)


def test_top_k_of_huge_vectors(spark):
    rows = [(0, [1e200, 0.0]), (5, [1e18, 1.0]), (10, [1.0, 2.0]), (11, [1e18, 3.0]), (12, [-1e18, 0.0])]
    got = metric_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 5 = 0", 2).collect()
    assert {(g.query_id, g["rank"], g.vec_id, g.score) for g in got if g.query_id == 5} == {(5, 1, 11, 2**63 - 1), (5, 2, 10, 2**63 - 1)}
    assert not [g for g in got if 0 in (g.query_id, g.vec_id)]


def test_spread_pivots_and_their_bounds():
    r = np.random.default_rng(8)
    x = np.floor(np.concatenate([c + r.normal(size=(50, 5)) for c in np.eye(5) * 500]))
    most = float((x**2).sum(1).max())
    pivots = metric_search.spread(x, 5, most)
    assert sorted(p.argmax() for p in pivots) == [0, 1, 2, 3, 4]
    assert len(metric_search.spread(np.repeat(x[:1], 9, 0), 4, most)) == 1


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert sorted(map(tuple, metric_search.top_k(df, "vec_id % 5 = 0").collect())) == brute_top(ODD, 5)
    assert metric_search.top_k(df.limit(0), "vec_id % 5 = 0").count() == 0


def test_tree_prunes_and_ties(spark):
    x = np.repeat(np.floor(np.random.default_rng(2).normal(size=(40, 4)) * 100), 30, axis=0)
    most = float((x**2).sum(1).max())
    tree = metric_search.build(np.arange(len(x)), x, most, leaf=16, fanout=4)
    for q in x[::97]:
        s = x @ q
        want = sorted(zip(-s, range(len(x))))[:5]
        got = sorted((-a, b) for a, b in metric_search.search(tree, x[0], q, -1, 5, -np.inf, most, True))
        assert got == [(int(a), b) for a, b in want]


def brute_links(rows, threshold):
    unit = {}
    for i, u in zip([r[0] for r in rows], embedding_dedup.unit_vectors(__import__("pyarrow").array([r[1] for r in rows]))):
        if i is not None and (u is not None or i not in unit):
            unit[i] = u if unit.get(i) is None else min(unit[i], u, key=lambda a: a.tobytes())
    ids = sorted(unit)
    links = {i: set() for i in ids}
    for i in ids:
        for j in ids:
            if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
    comp = {}
    for i in ids:
        if i not in comp:
            stack = [i]
            while stack:
                a = stack.pop()
                if a not in comp:
                    comp[a] = i
                    stack += links[a]
    return sorted((i, len(links[i]), comp[i], comp[i] == i) for i in ids)


@pytest.mark.parametrize("cell_rows,block", [(10_000, 64), (60, 16), (250, 8)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell_rows)
    rows = make(400, 24) + ODD + make(2, 24)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert sorted(map(tuple, got)) == brute_links(rows, 0.9)


@pytest.mark.parametrize("cell_rows,block", [(16, 8_192), (200, 32)])
def test_no_link_is_lost_with_many_cells(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(embedding_dedup, "PART_SAMPLE", 6)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 128)
    r = np.random.default_rng(7)
    x = r.normal(size=(800, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    y = r.normal(size=x.shape)
    y -= (x * y).sum(1)[:, None] * x
    y /= np.sqrt((y**2).sum(1))[:, None]
    partners = 0.9005 * x + np.sqrt(1 - 0.9005**2) * y
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, partners]).astype(np.float32))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert sorted(map(tuple, got)) == brute_links(rows, 0.9)
    assert sum(g.n_links > 0 for g in got) == 1600


def test_far_cells_are_ruled_out():
    x = np.random.default_rng(3).normal(size=(900, 16))
    x[:300] = [9.0, *[0.0] * 15] + x[:300] * 0.1
    x[300:600] = [-9.0, *[0.0] * 15] + x[300:600] * 0.1
    x /= np.sqrt((x**2).sum(1))[:, None]
    c = embedding_dedup.fit_centroids(x, 12)
    near = (x @ c.T).argmax(1)
    angles = np.array([np.arccos(np.clip((x[near == k] @ c[k]).min(initial=1), -1, 1)) for k in range(len(c))])
    meet = embedding_dedup.reach(c, angles, 0.9)
    p, q = np.nonzero(x @ x.T >= 0.9)
    assert meet[near[p], near[q]].all() and not meet.all()


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    r = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (230, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000 + i) for i in range(1, 90)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long").repartition(7)).collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_copies_and_a_tie_at_the_threshold(spark):
    from plumbline.llm.embedding_dedup import near_duplicates

    # (1, 0), (0.9, sqrt(0.19)) and copies of both; 3-4-5 vectors tie at exactly 0.8.
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(100 + i, [4.0, 3.0, 0.0]) for i in range(30)] + [(200, [0.0, 0.0, 2.0]), (201, [0.0, 0.0, 0.0]), (202, None)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.8, 16).collect()}
    assert got[0] == (69, 0, True) and got[39] == (69, 0, False) and got[129] == (69, 0, False)
    assert got[200] == (0, 200, True) and got[201] == (0, 201, True) and got[202] == (0, 202, True)
    apart = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.81, 16).collect()}
    assert apart[3] == (39, 0) and apart[105] == (29, 100)
