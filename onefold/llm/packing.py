"""Packing by concatenating and cutting.

Pass one encodes every document once and writes, for each partition, its documents' ids with their offsets inside the
partition. A prefix sum over the partitions' totals then gives every document its place in one long row of ids, and
pass two cuts that row into windows of `length` ids; a document that crosses a cut gets one boundary record a window.
No text or id moves between executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onefold.llm import common
from onefold.llm.bpe import CODED_BYTES, word_bpe

VOCABULARY, END_ID, LENGTH = "byte_bpe_50k.json", 1, 2048

_ENCODED = "doc_id long, part long, part_start long, n_ids long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = word_bpe(path, special=True), TaskContext.get().partitionId(), 0
        end = np.array([end_id], bpe.dtype).tobytes()
        for step in common.steps(batches, "text", CODED_BYTES):
            packed = [ids + end for ids in bpe.encode(step.column("text").to_pylist())]
            sizes = np.array([len(ids) for ids in packed], np.int64) // bpe.dtype.itemsize
            starts = at + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(np.full(len(sizes), part)), pa.array(starts), pa.array(sizes), pa.array(packed, pa.binary())], ["doc_id", "part", "part_start", "n_ids", "ids"])

    return run


def _pieces(length: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in common.steps(batches, "ids"):
            begin = step.column("begin").to_numpy()
            sizes = step.column("n_ids").to_numpy()
            first, last = begin // length, (begin + sizes - 1) // length
            row = np.repeat(np.arange(len(sizes)), last - first + 1)
            sequence = first[row] + np.arange(len(row)) - np.searchsorted(row, row)
            lo = np.maximum(sequence * length, begin[row])
            hi = np.minimum((sequence + 1) * length, (begin + sizes)[row])
            ids = [np.frombuffer(packed, dtype) for packed in step.column("ids").to_pylist()]
            crc = [zlib.crc32(ids[r][a:b].astype("<u4").tobytes()) for r, a, b in zip(row, lo - begin[row], hi - begin[row], strict=True)]
            columns = [pa.array(step.column("doc_id")).take(pa.array(row)), *map(pa.array, (lo - begin[row], hi - lo, np.array(crc, np.int64), sizes[row], sequence, lo - sequence * length))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document in a sequence of `length` ids (`PIECES`).

    A special token that is written out in a text is that token, as the library's plain call has it. `docs` has doc_id and text; other columns are ignored, whatever their names. A null or empty text is the end id
    alone. A null doc_id stays null, repeated rows are packed each by itself, a very long text takes many sequences, and an
    empty table gives no rows. Sequences are full but the last one, which has only its own ids.
    The only broadcast is one row of two numbers for each partition of `docs`.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    encoded = common.written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text")).mapInArrow(_encoded(path, end_id), _ENCODED), "encoded")
    totals = encoded.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = encoded.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("begin"), "n_ids", "ids")
    return placed.mapInArrow(_pieces(length, word_bpe(path, special=True).dtype.str), PIECES)
