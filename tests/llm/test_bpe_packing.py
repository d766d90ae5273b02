import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import _bpe, chunked_bpe, packing
from plumbline.llm._tables import text_buffer

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
ALPHABET = [*"ab  '' strevemld\n\t 12.,!é中 ß٣", "'s", "'t", "'re", "'ll", " 's", "　", "word ", "<|endoftext|>"]


def some_texts(n, most, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def enc():
    return _bpe.encoding("test", P.PATTERN, _bpe.ranks_from_rank_file(RANKS))


def test_pretokens_agree_with_the_pattern(enc):
    texts = some_texts(5000, 30)
    ids, first = _bpe.encode_texts(*text_buffer(pa.array(texts)), _bpe.PieceCache(enc, limit=5_000))
    assert [enc.encode_ordinary(t) for t in texts] == [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def test_json_vocabulary_is_the_rank_file():
    ranks, added = _bpe.ranks_from_json(JSON)
    assert ranks == _bpe.ranks_from_rank_file(P.path("byte_bpe_50k.tiktoken"))
    assert added == {b"<|endoftext|>": 50256}


@pytest.mark.parametrize("text", ["x" * 300 + " y" * 300, "it's " * 200, " \n " * 300, "", *some_texts(30, 400, 7)])
def test_stitched_pieces_encode_like_the_whole(enc, text):
    pieces = chunked_bpe.stitched_pieces(text, P.PATTERN, 64, 16)
    assert "".join(pieces) == text
    assert sum((enc.encode_ordinary(p) for p in pieces), []) == enc.encode_ordinary(text)


def test_encode_decode_round_trip(spark, enc):
    long = "it's a long   text, " * 50
    rows = [(1, long), (1, long), (2, None), (3, ""), (4, "y" * 900), (None, "null id"), *((10 + i, t) for i, t in enumerate(some_texts(60, 500)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = chunked_bpe.encode(docs, RANKS, P.PATTERN, chunk=64, overlap=16)
    got = sorted((r.doc_id or -1, list(r.ids), bytes(r.decoded)) for r in coded.collect())
    want = sorted((i or -1, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert got == want
    back = chunked_bpe.decode(coded.select("doc_id", "ids"), RANKS)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted(w[2] for w in want)
    assert chunked_bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_digests(spark, enc):
    rows = [(1, "Ein Text mit vielen Wörtern. " * 9), (2, None)]
    got = {r.doc_id: r for r in chunked_bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, P.PATTERN, chunk=100, overlap=20).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_packing_against_brute_force(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    rows = [(1, None), (2, ""), (2, ""), (3, "long text " * 300), (4, "<|endoftext|>"), (5, "a <|endoftext|><|endoftext|> b<|endo"), (6, "ftext|> x"), (7, "c<|endoftext|>"), *((10 + i, t) for i, t in enumerate(some_texts(40, 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).repartition(5)
    out = packing.pack(docs, JSON, width=64).collect()
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    assert sum(p.length for p in out) == sum(len(want[i]) for i, _ in rows)
    taken = {}
    for p in out:
        ids = want[p.doc][p.start : p.start + p.length]
        assert p.doc_tokens == len(want[p.doc]) and p.length == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert p.continues_before == (p.start > 0) and p.continues_after == (p.start + p.length < p.doc_tokens)
        taken.setdefault(p.sequence_id, []).append((p.offset, p.length))
    last = max(taken)
    assert sorted(taken) == list(range(last + 1))
    for k, spans in taken.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 64 or k == last
    assert packing.pack(docs.limit(0), JSON).count() == 0
