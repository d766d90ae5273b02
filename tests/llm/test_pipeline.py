import random

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))}


def brute_groups(rows):
    """Rows that near copies join, by all pairs; a text without a word joins its repeats."""
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][:2] == rows[j][:2] or (both and 100 * both >= 80 * len(sets[i] | sets[j])):
                group = [group[j] if g == group[i] else g for g in group]
    return [[r for r, g in zip(rows, group) if g == k] for k in sorted(set(group))]


def least(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))[:2]


def texts(n):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(60)) for _ in range(n)]
    return base, [f"{t} end" for t in base]


def test_each_group_keeps_one_row_whatever_its_ids(spark):
    (a, b, c, d, e), (a2, b2, c2, d2, _) = texts(5)
    cases = [
        [(5, a, "en"), (5, b, "en"), (9, b2, "en")],
        [(3, b2, "en"), (5, a, "en"), (5, b, "en")],
        [(None, a, "en"), (None, a2, "en"), (7, b, "en"), (None, b2, "en"), (None, b, "en"), (8, c, "en"), (8, c, "en"), (8, c2, "en")],
        [(1, "", "en"), (2, "", "en"), (2, "", "en"), (2, None, "en"), (None, None, "en"), (None, None, "en"), (None, " ", "en"), (4, d, "en"), (6, d2, "en"), (4, e, "en")],
    ]
    for rows in cases:
        got = P.keep_one_of_each_group(spark, frame(spark, rows).repartition(3), "").collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted((least(g) for g in brute_groups(rows)), key=str)


PROSE = {"en": "the house of that man is there with something and nothing would thing", "de": "das haus des mannes ist dort und nicht schön über eine straße gegangen"}
OTHER = "дом этого человека там и ничего не было бы вещь которая стоит"


def test_language_stage_drops_scripts_that_it_cannot_tell(spark):
    rows = [(i, t, lang) for i in range(0, 60, 2) for i, (lang, t) in enumerate(PROSE.items(), i)]
    odd = [(100, OTHER, "de"), (101, "家在那裡 沒有 什麼 東西", None), (102, "", "en"), (103, None, "de"), (104, "12 !?", "en")]
    odd += [(105, PROSE["en"] + " " + OTHER[:20], None), (106, PROSE["en"] + ". " + PROSE["de"], None), (107, "the " + OTHER * 3, None), (None, PROSE["de"], None)]
    learnt = [(i + 1000, t, lang) for i in range(0, 4000, 2) for i, (lang, t) in enumerate(PROSE.items(), i)]
    got = P.keep_known_language(spark, frame(spark, rows + odd + learnt), "").filter("doc_id is null or doc_id < 1000").collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted([str(r[0]) for r in rows] + ["105", "106", "None"])
    assert P.keep_known_language(spark, frame(spark, []), "").count() == 0
