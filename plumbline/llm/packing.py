"""Packing: concatenate all documents' tokens and cut the stream into windows.

Two passes. The first encodes each document once and writes its ids, with its
place within the partition, as a table in the shared folder. Partition totals
of that table (one row a partition) give, by a prefix sum, the offset at which
each partition's tokens start in the whole stream. With it every document
knows its own offset, so the second pass cuts each document at the window
bounds by itself: no shuffle of ids, no order between tasks. A document that
crosses a bound has a boundary record on either side (``continues_before`` and
``continues_after``). All windows are full but the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import _bpe
from plumbline.llm._tables import lean, runs_of_bytes, text_buffer, written

#: Bytes of text handled at once in a worker.
RUN_BYTES = 512 << 10
_CODED = pa.schema([("doc", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: doc, part, part_start (ids before it in its part), n, ids
    (little-endian unsigned 32-bit, ``end_id`` last). Null text counts as empty;
    repeated rows are documents of their own; other columns are not read. An
    added token of the vocabulary in a text is its one id, as ``tokenizers``
    has it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_bpe.ranks_from_json(vocabulary))  # a vocabulary
    from public_tokenizers import PATTERN

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, added = shared.value
        cache = _bpe.PieceCache(_bpe.encoding(vocabulary, PATTERN, ranks))
        part = TaskContext.get().partitionId()
        before = 0
        for batch in batches:
            raw, starts, ends = text_buffer(batch.column(1))
            for i, j in runs_of_bytes(starts, ends, RUN_BYTES):
                base = starts[i]
                ids, first = _bpe.encode_texts(raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base, cache, added)
                n = np.diff(first) + 1
                whole = np.full(len(ids) + (j - i), end_id, "<u4")
                stop = np.cumsum(n)
                keep = np.ones(len(whole), bool)
                keep[stop - 1] = False
                whole[keep] = ids
                offsets = pa.py_buffer(np.concatenate([[0], stop * 4]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array(np.full(j - i, part, np.int32)),
                        pa.array(before + stop - n),
                        pa.array(n),
                        pa.Array.from_buffers(pa.binary(), j - i, [None, offsets, pa.py_buffer(whole)]),
                    ],
                    schema=_CODED,
                )
                before += int(stop[-1])

    coded = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return coded.mapInArrow(lean(encode), "doc long, part int, part_start long, n long, ids binary")


def with_offsets(coded: DataFrame) -> DataFrame:
    """Adds ``start``, the document's first place in the whole stream."""
    totals = coded.groupBy("part").agg(F.sum("n").alias("part_n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("part_n").over(order), F.lit(0)).alias("part_base"))
    # One row a partition of the written table; that is what the broadcast holds.
    return coded.join(F.broadcast(bases), "part").withColumn("start", F.col("part_base") + F.col("part_start"))


def cut_windows(placed: DataFrame, width: int) -> DataFrame:
    """Second pass: one row for each piece of a document that lies in a window."""
    start, n, ids = F.col("start"), F.col("n"), F.col("ids")
    end = start + n

    def piece(w: Column) -> Column:
        low = F.greatest(start, w * width)
        high = F.least(end, (w + 1) * width)
        body = F.substring(ids, ((low - start) * 4 + 1).cast("int"), ((high - low) * 4).cast("int"))
        return F.struct(
            (low - start).alias("start"),
            (high - low).alias("length"),
            F.crc32(body).alias("ids_crc32"),
            w.alias("sequence_id"),
            (low - w * width).alias("offset"),
            (low > start).alias("continues_before"),
            (high < end).alias("continues_after"),
        )

    windows = F.sequence(F.floor(start / width), F.floor((end - 1) / width))
    pieces = placed.select("doc", F.col("n").alias("doc_tokens"), F.transform(windows, piece).alias("pieces"))
    return pieces.select("doc", "doc_tokens", F.explode("pieces").alias("p")).select("doc", "doc_tokens", "p.*")


def pack(docs: DataFrame, vocabulary: str, width: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in windows of ``width`` ids.

    Defined cases: no documents, no pieces; a null or empty text is the one id
    ``end_id``; a long text spans as many windows as it needs; repeated rows
    each have pieces of their own; a null id stays null.
    """
    coded = written(encode_documents(docs, vocabulary, end_id, id_col, text_col), "packed-ids")
    return cut_windows(with_offsets(coded), width)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues_before", "continues_after")
