"""Byte-level BPE: overlapping chunks are pre-tokenised apart and stitched.

A text longer than ``chunk`` characters is cut into chunks that overlap, and
these are dealt over all tasks. Each is scanned from its own start, which may
lie inside a pre-token. A match depends on nothing before it, so once two scans
have a boundary in common they agree from there on: the first boundary that the
scan of one chunk shares with the scan begun at the next chunk's start is where
the two are stitched. The pieces between such boundaries are encoded apart
(again dealt over all tasks), and their ids joined give the whole text's ids.
Where an overlap holds no common boundary (a pre-token longer than it), nothing
proves that later scans agree with the whole text's, so the rest of that text
is one piece.

Shorter texts are one piece each and are encoded where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _bpe
from plumbline.llm._tables import lean, written

#: Characters that a match may look ahead: a contraction has three.
LOOK_AHEAD = 4


def boundaries(scan: regex.Pattern, text: str, start: int, whole: bool) -> list[int]:
    """Starts of the matches from ``start`` on. Unless the text ends here,
    those that the cut end could have changed are left out."""
    safe = len(text) if whole else len(text) - LOOK_AHEAD
    found = []
    for m in scan.finditer(text, start):
        found.append(m.start())
        if m.end() > safe:
            break
    return found


def common_boundary(scan: regex.Pattern, text: str, start: int, next_start: int, whole: bool) -> int | None:
    """The first boundary at or after ``next_start`` that scans from both
    places share, or None if they share none before the text is cut.

    One after white space is passed over: a match of white space looks at what
    follows it, which a piece that ends there would hide."""
    late = set(boundaries(scan, text, next_start, whole))
    return next((b for b in boundaries(scan, text, start, whole) if b in late and not text[b - 1].isspace()), None)


def stitched_pieces(text: str, pattern: str, chunk: int, overlap: int) -> list[str]:
    """``text`` cut at boundaries found chunk by chunk; joined it is the same."""
    scan = regex.compile(pattern)
    cuts = [0]
    for s in range(0, max(0, len(text) - chunk), chunk):
        window = text[s : s + chunk + overlap]
        cut = common_boundary(scan, window, 0, chunk, s + len(window) == len(text))
        if cut is None:
            break
        cuts.append(s + cut)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _digest(ids: list[int], texts: list[str], decoded: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join([texts[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 32_768,
    overlap: int = 2_048,
) -> DataFrame:
    """``id_col``, ``ids`` array<int> and ``decoded`` binary of each row of ``docs``.

    Defined cases: a null or empty text has no ids; repeated rows and repeated
    or null document ids each give a row of their own; an empty table gives an
    empty one; other columns are not read.
    """

    def finish(ids: list[int], enc, texts) -> tuple:
        return ids, enc.decode_bytes(ids)

    return _encoded(docs, vocabulary, pattern, id_col, text_col, chunk, overlap, "ids array<int>, decoded binary", finish)


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, overlap: int = 2_048) -> DataFrame:
    """As :func:`encode`, with the number of ids and SHA-256 of the decimal ids
    joined by commas and of the decoded bytes in place of both."""

    def finish(ids: list[int], enc, texts) -> tuple:
        return _digest(ids, texts, enc.decode_bytes(ids))

    return _encoded(docs, vocabulary, pattern, id_col, text_col, chunk, overlap, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish)


def _encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, chunk: int, overlap: int, columns: str, finish: Callable) -> DataFrame:
    if overlap <= LOOK_AHEAD or chunk <= overlap:
        raise ValueError("chunk > overlap > LOOK_AHEAD is needed")
    sc = docs.sparkSession.sparkContext
    ranks = sc.broadcast(_bpe.ranks_from_rank_file(vocabulary))
    names = [c.split(" ")[0] for c in columns.split(", ")]
    kept: dict = {}

    def tools():
        enc = _bpe.encoding(vocabulary, pattern, ranks.value)
        if enc.name not in kept:
            kept[enc.name] = [str(i) for i in range(enc.n_vocab)]
        return enc, kept[enc.name]

    def frame(ids: list, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"doc": pd.array(ids, "Int64"), **{c: [r[k] for r in rows] for k, c in enumerate(names)}})

    def encode_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, texts = tools()
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                yield frame(part["doc"].tolist(), [finish(enc.encode_ordinary(t), enc, texts) for t in part["text"]])

    def find_cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = regex.compile(pattern)
        for batch in batches:
            cuts = []
            for i, text, whole in zip(batch["chunk_no"], batch["body"], batch["whole"]):
                cut = common_boundary(scan, text, 0, chunk, whole)
                cuts.append(None if cut is None else i * chunk + cut)
            yield batch[["text_key", "chunk_no"]].assign(cut=pd.array(cuts, "Int64"))

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, _ = tools()
        for batch in batches:
            ids = [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in batch["piece"]]
            yield batch[["text_key", "low"]].assign(piece_ids=ids)

    def join_pieces(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        enc, texts = tools()
        group = group.drop_duplicates("low").sort_values("low")
        ids = np.frombuffer(b"".join(group["piece_ids"]), "<u4").tolist()
        row = finish(ids, enc, texts)
        return pd.DataFrame({"text_key": [key[0]], **{c: [row[k]] for k, c in enumerate(names)}})

    def cut_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["text_key"], batch["text"]):
                for at in range(0, len(text) - chunk, chunk * 64):
                    starts = range(at, min(at + chunk * 64, len(text) - chunk), chunk)
                    yield pd.DataFrame({"text_key": key, "chunk_no": [x // chunk for x in starts], "body": [text[x : x + chunk + overlap] for x in starts], "whole": [x + chunk + overlap >= len(text) for x in starts]})

    def cut_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text, cuts in zip(batch["text_key"], batch["text"], batch["cuts"]):
                lows = [0, *(cuts if cuts is not None else ())]
                highs = [*lows[1:], len(text)]
                for i in range(0, len(lows), 64):
                    yield pd.DataFrame({"text_key": key, "low": lows[i : i + 64], "piece": [text[a:b] for a, b in zip(lows[i : i + 64], highs[i : i + 64])]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= chunk).mapInPandas(lean(encode_short), f"doc long, {columns}")

    # Long texts are known by their hash from here on, so equal ones are encoded
    # once. A text is cut where it lies, so that no row but its own holds it whole.
    long_rows = rows.filter(F.length("text") > chunk).withColumn("text_key", F.sha2("text", 256))
    long_texts = written(long_rows.groupBy("text_key").agg(F.first("text").alias("text")), "long-texts")
    chunks = long_texts.mapInPandas(cut_chunks, "text_key string, chunk_no long, body string, whole boolean").repartition("text_key", "chunk_no")
    found = chunks.mapInPandas(find_cut, "text_key string, chunk_no long, cut long")
    # A text's stitches up to the first that is missing: one number a chunk.
    listed = found.groupBy("text_key").agg(F.min(F.when(F.col("cut").isNull(), F.col("chunk_no"))).alias("torn"), F.array_sort(F.collect_list(F.struct("chunk_no", "cut"))).alias("all"))
    sound = F.filter("all", lambda x: F.col("torn").isNull() | (x["chunk_no"] < F.col("torn")))
    cuts = listed.select("text_key", F.array_sort(F.array_distinct(F.transform(sound, lambda x: x["cut"]))).alias("cuts"))
    pieces = long_texts.join(cuts, "text_key", "left").mapInPandas(cut_pieces, "text_key string, low long, piece string").repartition("text_key", "low")
    coded = pieces.mapInPandas(lean(encode_pieces), "text_key string, low long, piece_ids binary")
    joined = coded.groupBy("text_key").applyInPandas(join_pieces, f"text_key string, {columns}")
    long = long_rows.select("doc", "text_key").join(joined, "text_key").select("doc", *names)
    return short.unionByName(long).withColumnRenamed("doc", id_col)


def decode(coded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded``: the raw bytes of the ids put together. An id
    outside the vocabulary is an error; null ids decode to no bytes."""
    ranks = coded.sparkSession.sparkContext.broadcast(_bpe.ranks_from_rank_file(vocabulary))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = {i: b for b, i in ranks.value.items()}
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "decoded": [b"" if x is None else b"".join([token[i] for i in x]) for x in batch["ids"]]})

    rows = coded.select(F.col(id_col).cast("long").alias("doc"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(join, "doc long, decoded binary").withColumnRenamed("doc", id_col)


def op9_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
