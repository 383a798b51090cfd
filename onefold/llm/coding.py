"""Byte-level BPE encoding and decoding over Arrow batches, with offsets of every token in bytes and characters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from onefold.llm import common
from onefold.llm.bpe import CODED_BYTES, WordBPE, word_bpe

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

ENCODED = "doc_id long, ids array<int>, byte_starts array<int>, char_starts array<int>"
DECODED = "doc_id long, text string, bytes binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def offsets(bpe: WordBPE, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each token, and the character which that byte is part of."""
    sizes = np.array([len(bpe.bytes_of[i]) for i in ids], np.int64)
    starts = np.cumsum(sizes) - sizes
    leads = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return starts, leads[starts] - 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text"))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """ids, byte_starts and char_starts of every text of `docs` (doc_id, text), one row a row, no special tokens.

    Null and empty texts have empty arrays; a null doc_id stays null; repeated rows are encoded each by itself; other
    columns are ignored. An empty table gives no rows.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for step in common.steps(batches, "text"):
            texts = step.column("text").to_pylist()
            ids = [bpe.ids(packed) for packed in bpe.encode(texts)]
            at = [offsets(bpe, i, text.encode()) for i, text in zip(ids, texts, strict=True)]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in ([i.tolist() for i in ids], [b.tolist() for b, _ in at], [c.tolist() for _, c in at])]
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), *lists], ["doc_id", "ids", "byte_starts", "char_starts"])

    return _texts(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """text and bytes of every row of `encoded` (doc_id, ids).

    Bytes that are no whole character (ids cut inside one) stay in bytes; in text they show as U+FFFD. Null ids are
    no ids; an id that the vocabulary lacks is an error.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for one in (batch.slice(i, 1) for i in range(batch.num_rows)):
                made = bpe.decode(one.column("ids")[0].as_py() or [])
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), pa.array([made.decode("utf-8", "replace")]), pa.array([made], pa.binary())], ["doc_id", "text", "bytes"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encodes and decodes every text; digests of the ids and of the decoded bytes (`DIGESTS`). Cases as in `encode`."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for step in common.steps(batches, "text", CODED_BYTES):
            rows = []
            for packed in bpe.encode(step.column("text").to_pylist()):
                ids = bpe.ids(packed).tolist()
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, DIGESTS)
