"""The registered opN queries, with their own parameters and columns, and the
pipeline's stages and run, over one small set of tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from plumbline.llm import _bpe
from plumbline.llm import html_extraction as H
from tests.llm.test_jaccard_join import brute
from tests.llm.test_pipeline import PROSE, brute_groups, frame, least
from tests.llm.test_vectors import brute_links, brute_top
from tests.llm.test_vectors import make as vectors

QUERIES = __spark_entry__.queries()


def documents():
    r = random.Random(11)
    rows = []
    for i in range(120):
        lang = r.choice(list(PROSE))
        words = PROSE[lang].split()
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randint(20, 60))) if i % 3 else "!!! ### " + " ".join(r.choice("@#$%&*") * 4 + str(r.randrange(99)) for _ in range(30)) + " zzz", lang))
    return rows + [(500, rows[1][1], "en"), (501, rows[2][1] + " end", "de"), (502, None, "en"), (503, "", "en"), (7, rows[7][1], rows[7][2]), (None, rows[8][1], "en")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = documents()
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*vectors(300), (9000, None, 0), (None, [1.0] * 8, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    pages = [(i, f"http://h{i % 2}/p{i}", f"<nav>menu</nav><article><h1>T{i}</h1><p>text {i}</p></article>") for i in range(6)] + [(6, None, None), (7, "http://h0/x", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, rows, pages


def run(spark, tables, name):
    return QUERIES[name](spark, tables[0]).collect()


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES if n.startswith("op")} == {f"op{n}" for n in range(1, 11)} and QUERIES["pipeline"] is P.run


def test_op1(spark, tables):
    want = [(i, u, H.decided(H.blocks_of(h)) or "" if h else "") for i, u, h in tables[2]]
    got = run(spark, tables, "op1_html_extraction")
    assert sorted((r[0], str(r[1]), r.text, r.n_chars) for r in got) == [(i, str(u), t, len(t)) for i, u, t in want]


def test_op2_and_op8(spark, tables):
    rows = [*vectors(300), (9000, None, 0), (None, [1.0] * 8, 0)]
    assert sorted(map(tuple, run(spark, tables, "op2_metric_search"))) == brute_top(rows, 5, 50)
    assert sorted(map(tuple, run(spark, tables, "op8_embedding_dedup"))) == brute_links(rows, 0.9)


def test_op4_and_op10(spark, tables):
    rows = tables[1]
    quality = run(spark, tables, "op4_quality_nbsvm")
    assert len(quality) == len(rows) and all(r.predicted == int(r.score >= 0.7) for r in quality if r.score is not None)
    assert all(bool(r.predicted) == (r.doc_id % 3 > 0) for r in quality if r.doc_id is not None and r.doc_id < 120)
    for out, n, held in ((quality, 4, 2), (run(spark, tables, "op10_language_id"), 3, 1)):
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % n == held) for r in out)
    lang = {i: x for i, _, x in rows}
    assert len(out) == len(rows) and all(r.lang_pred == lang[r.doc_id] for r in out if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 3)
    assert all((r.lang_pred, r.score, r.n_spans) == ("und", 0.0, 0) for r in out if r.doc_id in (502, 503))


def pieces_are_whole(out, rows):
    enc = _bpe.encoding("test", public_tokenizers.PATTERN, _bpe.ranks_from_json(public_tokenizers.path("byte_bpe_50k.json"))[0])
    crcs = sorted((str(i), zlib.crc32(np.array([*enc.encode_ordinary(t or ""), 1], "<u4").tobytes())) for i, t in rows)
    whole = [r for r in out if not r.continues_before and not r.continues_after]
    assert set((str(r.doc_id), r.ids_crc32) for r in whole) <= set(crcs)
    assert sum(r.length for r in out) == sum(len(enc.encode_ordinary(t or "")) + 1 for _, t in rows)
    assert sum(not r.continues_before for r in out) == len(rows)
    ends = [r.sequence_id * 2048 + r.offset for r in out]
    assert sorted(ends) == list(np.cumsum([0, *[r.length for r in sorted(out, key=lambda r: (r.sequence_id, r.offset))]])[:-1])


def test_op5_and_op9(spark, tables):
    rows = [r[:2] for r in tables[1]]
    pieces_are_whole(run(spark, tables, "op5_packing"), rows)
    enc = _bpe.encoding("test2", public_tokenizers.PATTERN, _bpe.ranks_from_rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    got = run(spark, tables, "op9_chunked_bpe")
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in got) == sorted((str(i), len(x), digest(x)) for i, x in ((i, enc.encode_ordinary(t or "")) for i, t in rows))


def test_op6_and_op7(spark, tables):
    rows = [r[:2] for r in tables[1]]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in run(spark, tables, "op6_jaccard_join")) == brute(rows, 3, 90)
    out = run(spark, tables, "op7_resharding")
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None for r in out)


def test_stages_and_run(spark, tables):
    path, rows, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    good = P.keep_quality(spark, docs, path)
    assert good.columns == docs.columns
    kept = good.collect()
    assert {r.doc_id for r in kept if r.doc_id is not None and r.doc_id < 120} == {i for i in range(120) if i % 3}
    assert sum(r.doc_id == 7 for r in kept) == 2
    told = P.keep_known_language(spark, spark.createDataFrame(kept, docs.schema), path).drop("score", "lang_pred")
    left = [(r.doc_id, r.text, r.lang) for r in told.collect()]
    assert sorted(left, key=str) == sorted(((r.doc_id, r.text, r.lang) for r in kept if r.text), key=str)
    want = [least(g) for g in brute_groups(left)]
    one = P.keep_one_of_each_group(spark, told, path)
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=str) == sorted(want, key=str)
    pieces_are_whole(P.pack_windows(spark, one, path).collect(), want)
    pieces_are_whole(P.run(spark, path).collect(), want)
    empty = docs.limit(0)
    assert all(stage(spark, empty, path).count() == 0 for _, stage in P.STAGES)


def test_op3(spark, tmp_path):
    rows = [(1, 0, "user", "first line\nsecond line"), (1, 1, "assistant", "> first line\nan answer"), (1, 2, "user", "> an answer\n> > first line\nso"), (2, 0, "user", None), (2, 1, "user", "> gone"), (None, 0, "user", "x"), (1, 1, "assistant", "> first line\nan answer")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    result = con.execute(__spark_entry__.oracle_sql()["op3_quotation_linking"])
    names = [d[0] for d in result.description]
    got = QUERIES["op3_quotation_linking"](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(result.fetchall(), key=str)
