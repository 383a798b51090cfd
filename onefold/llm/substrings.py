"""Substring dedup: Rabin-Karp hashes of every window of words are counted, and what an earlier document has too is cut out.

Documents are dealt into buffers of about 16 MB of text, a scratch table. Every buffer hashes all of its windows and
keeps of each key its least and its greatest doc_id, so a passage that very many documents share is a few entries a
buffer. The entries go, sorted, into buckets of the key's range: one row for each buffer and bucket, none for each window. A bucket
finds the keys that two documents have, and answers each buffer that has such a key in a later document with the least
doc_id. A buffer then meets its answers, marks its windows, and neighbours merge into longest intervals.

Keys are counted in rounds, a share of them each, which bounds the disk that they take.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onefold.llm import common
from onefold.llm.words import PRIME, Words, mixed, rolling, window_hashes, words

WIDTH = 13
#: Bytes of text of a buffer, about; rounds; buffers for each bucket of a round.
BUFFER, ROUNDS, FILL = 16 << 20, 2, 2

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"

_INTERVALS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_ENTRIES = "bucket long, buffer long, keys binary, checks binary, docs binary"
_ANSWERS = "buffer long, keys binary, checks binary, firsts binary"


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _dealt(size: int):
    """Rows with the buffer that they are in, __buffer: those that begin in the same `size` bytes of a partition's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((part << 32) + begin // size)], [*batch.schema.names, "__buffer"])

    return run


def keys(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of every window, its key (62 bits, spread over 64) and a check of 31 more bits."""
    first, hashes = w.windows(width), w.hashes()
    if not len(first):
        return first, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    check = rolling(9).spans(mixed(hashes + np.uint64(0x9E3779B97F4A7C15)) & PRIME, first, width)
    return first, window_hashes(hashes, first, width), check.astype(np.uint32)


def _grouped(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows are neighbours, and where each begins in it."""
    order = np.argsort(key)
    k, c = key[order], check[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(k) else np.zeros(0, bool)
    if (new[1:] & (k[1:] == k[:-1])).any():  # different windows of one key: rare
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
    return order, np.flatnonzero(new)


def _packed(buffer: int, key: np.ndarray, check: np.ndarray, doc: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The entries of a buffer: each window's least doc_id, and its greatest if that is another one; a row for each bucket."""
    order, begin = _grouped(key, check)
    key, check, doc = key[order[begin]], check[order[begin]], doc[order]
    least, most = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
    again = np.repeat(np.arange(len(begin)), 1 + (most > least))
    second = np.append(False, again[1:] == again[:-1])
    key, check, doc = key[again], check[again], np.where(second, most[again], least[again])
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    at = np.concatenate([[0], np.searchsorted(key, edges), [len(key)]])
    full = np.flatnonzero(np.diff(at))
    cut = lambda x: pa.array([x[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())
    base = doc.min()
    near = doc - base
    docs = pa.array([base.tobytes() + near[at[b] : at[b + 1]].astype("<u4" if near.max() < 1 << 32 else "<i8").tobytes() for b in full], pa.binary())
    return _batch({"bucket": full, "buffer": np.full(len(full), buffer), "keys": cut(key), "checks": cut(check), "docs": docs})


def _entries(width: int, turn: int, rounds: int, buckets: int):
    """The entries of every buffer whose keys have their turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, held = None, []

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                yield _packed(buffer, *map(np.concatenate, zip(*held, strict=True)), buckets)
                held.clear()

        for step in common.steps(batches, "text"):
            w = words(step.column("text").fill_null(""))
            first, key, check = keys(w, width)
            own = np.flatnonzero(key % np.uint64(rounds) == turn) if rounds > 1 else np.arange(len(key))
            row = w.doc[first[own]]
            buffers, doc = (step.column(name).to_numpy() for name in ("__buffer", "doc_id"))
            for one in np.unique(buffers):
                if one != buffer:
                    yield from flushed()
                    buffer = int(one)
                some = own if buffers[0] == buffers[-1] else own[buffers[row] == one]
                if len(some):
                    held.append((key[some], check[some], doc[w.doc[first[some]]]))
        yield from flushed()

    return run


def _joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    packed = b"".join(column.to_pylist())
    return np.frombuffer(packed, dtype) if packed else np.zeros(0, dtype)


def _answers(group: pa.Table) -> pa.Table:
    """Of a bucket: for each buffer the windows that an earlier document has than one of its own, with the least doc_id."""
    key, check = _joined(group.column("keys"), "<u8"), _joined(group.column("checks"), "<u4")
    docs, size = [], []
    for packed, own in zip(group.column("docs").to_pylist(), group.column("keys").to_pylist(), strict=True):
        size.append(len(own) // 8)
        offsets = np.frombuffer(packed, "<u4" if len(packed) - 8 == 4 * size[-1] else "<i8", offset=8)
        docs.append(np.frombuffer(packed, "<i8", 1)[0] + offsets.astype(np.int64))
    doc, row = np.concatenate(docs), np.repeat(np.arange(group.num_rows), size)
    order, begin = _grouped(key, check)
    first = np.empty(len(key), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.append(begin, len(key))))
    some = np.flatnonzero(doc > first)
    at = np.searchsorted(row[some], np.arange(group.num_rows + 1))  # rows are in their order
    full = np.flatnonzero(np.diff(at))
    cut = lambda x: pa.array([x[some[at[r] : at[r + 1]]].tobytes() for r in full], pa.binary())
    return pa.table({"buffer": group.column("buffer").take(pa.array(full)), "keys": cut(key), "checks": cut(check), "firsts": cut(first)})


class Repeats:
    """The answers that a buffer got, to look its windows up in."""

    def __init__(self, answers: pa.Table):
        key, check, first = (_joined(answers.column(name), kind) for name, kind in (("keys", "<u8"), ("checks", "<u4"), ("firsts", "<i8")))
        order, begin = _grouped(key, check)
        self.key, self.check, self.first = (x[order[begin]] for x in (key, check, first))

    def gone(self, w: Words, doc: np.ndarray, width: int) -> np.ndarray:
        """Which words lie in a window that also starts in a document before theirs; doc: the doc_id of each text."""
        if not len(self.key):
            return np.zeros(len(w.doc), bool)
        first, key, check = keys(w, width)
        order = np.argsort(key)  # sorted ones are looked up faster
        at = np.empty(len(key), np.int64)
        at[order] = np.searchsorted(self.key, key[order])
        at = np.minimum(at, len(self.key) - 1)
        while True:  # different windows of one key: rare
            late = (self.key[at] == key) & (self.check[at] < check)
            late &= np.append(self.key[1:] == self.key[:-1], False)[at]
            if not late.any():
                break
            at += late
        hit = (self.key[at] == key) & (self.check[at] == check)
        hit[hit] = doc[w.doc[first[hit]]] > self.first[at[hit]]
        edge = np.zeros(len(w.doc) + 1, np.int64)
        edge[first[hit]] += 1
        edge[first[hit] + width] -= 1
        return np.cumsum(edge[:-1]) > 0


def intervals(gone: np.ndarray) -> np.ndarray:
    """Longest runs of words that go, as rows (first, end)."""
    return np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))).reshape(-1, 2)


def _digested(step: pa.RecordBatch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
    kept = np.flatnonzero(~gone)
    start, end, doc = w.start[kept], w.end[kept], w.doc[kept]
    more = np.append(doc[1:] == doc[:-1], False)[: len(doc)]
    stay = np.zeros(len(w.data) + 1, np.int8)
    stay[start] += 1
    stay[end] -= 1
    stay = np.cumsum(stay[:-1], dtype=np.int8).astype(bool)
    plain = w.data.copy()
    plain[end[more]] = 0x20
    stay[end[more]] = True
    plain = memoryview(plain[stay])
    at = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=end - start + more, minlength=w.n_texts).astype(np.int64))]).tolist()
    found = [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    return _batch({"doc_id": step.column("doc_id"), "n_words": w.counts(), "n_removed": np.bincount(w.doc[gone], minlength=w.n_texts), "kept_sha256": found})


def _rewritten(step: pa.RecordBatch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
    texts, removed, data, at = step.column("text").to_pylist(), [], w.data.tobytes(), w.first_words()
    for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
        runs = intervals(gone[lo:hi])
        removed.append([{"first": int(a), "end": int(b)} for a, b in runs])
        if not len(runs):
            continue
        last, kept = int(w.text_starts[i]), []
        for a, b in runs:
            kept.append(data[last : w.start[lo + a]])
            last = int(w.start[lo + b]) if lo + b < hi else int(w.text_starts[i + 1])
        texts[i] = b"".join([*kept, data[last : w.text_starts[i + 1]]]).decode()
    names = step.schema.names
    columns = dict(zip(names, step.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
    if "n_chars" in names:
        new = [len(text) if runs else old for text, runs, old in zip(texts, removed, step.column("n_chars").to_pylist(), strict=True)]
        columns["n_chars"] = pa.array(new, step.column("n_chars").type)
    return _batch(columns | {"__removed": pa.array(removed, _INTERVALS)})


def _cut(docs: DataFrame, width: int, rounds: int, buffer: int, made, schema: T.StructType) -> DataFrame:
    """What `made` makes of each step of `docs` (doc_id, text and more), its words, and which of them go."""
    dealt = common.written(docs.mapInArrow(_dealt(buffer), T.StructType([*docs.schema.fields, T.StructField("__buffer", T.LongType())])), "dealt")
    buckets = max(1, -(-dealt.select("__buffer").distinct().count() // FILL))
    known = dealt.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__buffer")
    found = [common.written(known.mapInArrow(_entries(width, turn, rounds, buckets), _ENTRIES).groupBy("bucket").applyInArrow(_answers, _ANSWERS), "answers") for turn in range(rounds)]
    answers = found[0]
    for more in found[1:]:
        answers = answers.unionByName(more)
    names = docs.columns

    def marked(left: pa.Table, right: pa.Table) -> pa.Table:
        repeats, out = Repeats(right), []
        for step in common.steps(iter(left.select(names).combine_chunks().to_batches()), "text"):
            w = words(step.column("text").fill_null(""))
            doc = step.column("doc_id").cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()  # which is after none
            out.append(made(step, w, repeats.gone(w, doc, width)))
        return pa.Table.from_batches(out, None if out else pa.schema([]))

    return dealt.groupBy("__buffer").cogroup(answers.groupBy("buffer")).applyInArrow(marked, schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, buffer: int = BUFFER) -> DataFrame:
    """Removes each word covered by a window of `width` words that also starts in a document with a smaller doc_id: `RESULT`.

    `docs` has doc_id and text; other columns are ignored, whatever their names. Windows are judged on the input. Null and
    empty texts have no words; texts under `width` words lose none. A document with a null doc_id loses none and is
    earlier than none. Of rows with one doc_id none is earlier. An empty table gives no rows.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    return _cut(docs, width, rounds, buffer, _digested, T._parse_datatype_string(RESULT))


def without_repeats(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, buffer: int = BUFFER) -> DataFrame:
    """`docs` with the same words removed from text, and the white space after them; other columns as they were.

    n_chars, if there is one, is counted anew where words went. __removed holds the longest removed intervals in words, from
    first to end (not included). Texts that lose nothing, nulls too, stay as they are. A column of `docs` that is named
    __removed or __buffer is an error. Other cases as in `remove_repeats`.
    """
    if clash := {"__removed", "__buffer"} & set(docs.columns):
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    common.text_of(docs)
    removed = T.StructField("__removed", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))
    return _cut(docs, width, rounds, buffer, _rewritten, T.StructType([*docs.schema.fields, removed]))
