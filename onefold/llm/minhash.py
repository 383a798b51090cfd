"""Near-duplicate texts by ProbMinHash over weighted word shingles, banding and exact verification.

A shingle is five words; its weight is how often the text has it. Each shingle sends arrivals of a Poisson process whose
rate is its weight, each to a random register; a register keeps the shingle of its earliest arrival. Two texts have the
same shingle in a register with the probability of their probability Jaccard similarity. A shingle's process ends as
soon as its next arrival is later than all that the registers hold.

Texts with equal words are one class before anything is compared. A bucket's hub is the text whose buckets are largest, as
is the middle of a group of copies; texts are first compared with the hubs of their buckets. Where that leaves the texts of
a hub in more than one component, they are dealt into blocks of a bounded size, and two blocks at a time their registers are
compared; pairs of different components whose registers agree often enough are then compared exactly, and those that are
similar are one component from then on. So a block hands on a forest, pairs within a group are never listed, and
no link that joins components is left out but by the odds below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.llm import common
from onefold.llm.words import Words, mixed, window_hashes, words
from onefold.operators.components import components
from onefold.scratch import joined

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8**5)**36, 6 in ten million.
BANDS, ROWS = 36, 5
#: Pairs whose registers agree less than the similarity by so many standard deviations are not compared exactly: 5 in a million.
DEVIATIONS = 4.4
#: The bound on a similarity may be lower than its value by this much, as both are rounded.
ROUNDING = 1e-9
#: Bytes of the texts of a block, about, and its texts.
BLOCK, BLOCK_TEXTS = 4 << 20, 1024

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), sorted. A text of fewer words has one shingle, of all of them."""
    first = w.windows(width)
    text, key = w.doc[first], window_hashes(w.hashes(), first, width)
    counts = w.counts()
    if len(short := np.flatnonzero((counts > 0) & (counts < width))):
        text, key = np.concatenate([text, short]), np.concatenate([key, w.digests()[short, 0].view(np.uint64)])
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], key[at], np.diff(np.append(at, len(key)))


def signatures(text: np.ndarray, key: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """The shingle in each of `size` registers of each text; a text without shingles has zeros."""
    times, held = np.full(n_texts * size, np.inf), np.zeros(n_texts * size, np.uint64)
    time, turn = np.zeros(len(key)), 0
    while len(key):
        turn += 1
        draw = mixed(key + np.uint64(turn * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        register = text * size + (mixed(draw) % np.uint64(size)).astype(np.int64)
        np.minimum.at(times, register, time)
        won = times[register] == time
        held[register[won]] = key[won]
        alive = time < times.reshape(n_texts, size).max(1)[text]
        text, key, weight, time = text[alive], key[alive], weight[alive], time[alive]
    return held.reshape(n_texts, size)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in common.steps(batches, "text"):
        w = words(step.column("text"))
        found = w.digests()
        yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("k"), pa.array(w.counts()), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "k", "n_words", "h1", "h2"])


def _registers(bands: int, rows: int):
    """Of each text with words: the keys of its bands, and sixteen bits of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in common.steps(batches, "text"):
            w = words(step.column("text"))
            some = np.flatnonzero(w.counts())
            held = signatures(*shingles(w), w.n_texts, bands * rows)[some]
            band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(some), bands)).copy()
            for r in range(rows):
                band = mixed(band ^ held[:, r::rows])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(band.ravel().view(np.int64)))
            short = [x.tobytes() for x in mixed(held).astype("<u2")]
            yield pa.RecordBatch.from_arrays([step.column("doc_id").take(pa.array(some)), keys, pa.array(short, pa.binary())], ["doc_id", "bands", "registers"])

    return run


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted shingles, weights): sum over the common d of 1 / sum over all e of max(a[e] / a[d], b[e] / b[d])."""
    i = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    j = np.flatnonzero(a[0][i] == b[0])
    if not len(j):
        return 0.0
    x, y = a[1][i[j]], b[1][j]
    if a[1].max() == 1 and b[1].max() == 1:
        return len(j) / (len(a[0]) + len(b[0]) - len(j))
    # max(x[e] / x[d], y[e] / y[d]) is the first where x[e] / y[e] >= x[d] / y[d], so prefix sums by that ratio give all; what only
    # one has comes last or first in that order whatever the pair, and so is one sum
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ys, xs = np.concatenate([[0], np.cumsum(y[order])]), np.concatenate([[0], np.cumsum(x[order])])
    below = np.searchsorted(ratio[order], ratio, side="left")
    return float((1 / ((a[1].sum() - xs[below]) / x + (b[1].sum() - y.sum() + ys[below]) / y)).sum())


def _by_steps(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of a group's texts, made a few texts at a time."""
    parts, done = [], 0
    for step in common.steps(iter(group.select(["text"]).to_batches()), "text"):
        text, key, weight = shingles(words(step.column("text")))
        parts.append((text + done, key, weight))
        done += step.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _similar_across(least: int, similarity: float):
    """Of the texts of two blocks (or one): similar pairs that join different components, a forest of them.

    Pairs whose registers agree in fewer than `least` places are passed over; the others are compared exactly, but for those that
    a bound rules out: the sum over all e of max(a[e] / a[d], b[e] / b[d]) is at least the larger of sum(a) / a[d] and
    sum(b) / b[d], so no similarity is above the sum over d of min(a[d] / sum(a), b[d] / sum(b)).
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, own = (group.column(name).to_numpy() for name in ("doc_id", "own"))
        component = np.unique(group.column("component").to_numpy(), return_inverse=True)[1]
        left, right = (np.flatnonzero(own == group.column(side)[0].as_py()) for side in ("lo", "hi"))
        registers = np.frombuffer(b"".join(group.column("registers").to_pylist()), "<u2").reshape(len(ids), -1)
        near = []
        for i in left:
            j = right[(component[right] != component[i]) & ((right > i) | (own[right] != own[i]))]
            j = j[(registers[j] == registers[i]).sum(1) >= least]
            near += [(i, j)] if len(j) else []
        # only texts that are to be compared are cut into shingles
        kept = np.unique(np.concatenate([np.append(j, i) for i, j in near])) if near else np.zeros(1, np.int64)
        ids, component = ids[kept], component[kept]
        text, key, weight = _by_steps(group.select(["text"]).take(pa.array(kept)))
        at = np.searchsorted(text, np.arange(len(ids) + 1))
        sizes, plain = np.diff(at), np.maximum.reduceat(weight, at[:-1]) == 1
        part = weight / np.repeat(np.add.reduceat(weight, at[:-1]), sizes)
        names, name = np.unique(key, return_inverse=True)
        mine, found = np.zeros(len(names)), []
        for i, j in ((np.searchsorted(kept, x) for x in pair) for pair in near):
            j = j[component[j] != component[i]]
            if not len(j):
                continue
            begin = np.cumsum(sizes[j]) - sizes[j]
            theirs = np.arange(sizes[j].sum()) + np.repeat(at[j] - begin, sizes[j])
            here = name[at[i] : at[i + 1]]
            mine[here] = part[at[i] : at[i + 1]]
            shared = mine[name[theirs]]
            mine[here] = 0
            common_keys = np.add.reduceat((shared > 0).astype(np.int64), begin)
            value = common_keys / (sizes[i] + sizes[j] - common_keys)
            bound = np.add.reduceat(np.minimum(shared, part[theirs]), begin)
            for k in np.flatnonzero(~(plain[j] & plain[i])):
                value[k] = 0 if bound[k] < similarity - ROUNDING else probability_jaccard(*((key[at[x] : at[x + 1]], weight[at[x] : at[x + 1]]) for x in (i, j[k])))
            j, value = j[value >= similarity], value[value >= similarity]
            joined, first = np.unique(component[j], return_index=True)
            found += [(min(ids[i], ids[j[k]]), max(ids[i], ids[j[k]]), value[k]) for k in first]
            component[np.isin(component, joined)] = component[i]
        return pa.table({name: pa.array([row[c] for row in found], kind) for c, (name, kind) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())))})

    return run


def _compared(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in common.steps(batches, "text_a", common.STEP_BYTES // 2):
            sets = []
            for side in ("text_a", "text_b"):
                text, key, weight = shingles(words(step.column(side)))
                at = np.searchsorted(text, np.arange(step.num_rows + 1))
                sets.append([(key[x:y], weight[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)])
            found = np.array([probability_jaccard(a, b) for a, b in zip(*sets, strict=True)])
            keep = pa.array(found >= least)
            yield pa.RecordBatch.from_arrays([step.column("a").filter(keep), step.column("b").filter(keep), pa.array(found).filter(keep)], ["a", "b", "similarity"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    one, two = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_compared(least), "a long, b long, similarity double")


def _linked(docs: DataFrame, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written tables: digests of every row, copies and their firsts, links between different texts, and (node, component) of all that is linked."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    docs = docs.withColumn("k", F.xxhash64("text"))  # tells apart rows with one doc_id
    digests = common.written(docs.mapInArrow(_digests, "doc_id long, k long, n_words long, h1 long, h2 long"), "digests")
    known = digests.where("n_words > 0 and doc_id is not null")
    firsts = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    firsts = common.written(firsts, "firsts")
    copies = common.written(known.join(firsts, ["h1", "h2"]).where("doc_id > first").select("doc_id", "k", "first").distinct(), "copies")
    originals = docs.where("doc_id is not null").join(copies, ["doc_id", "k"], "left_anti")

    registers = common.written(originals.mapInArrow(_registers(bands, rows), "doc_id long, bands array<long>, registers binary"), "registers")
    banded = registers.select("doc_id", F.explode("bands").alias("band"))
    sizes = common.written(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = common.written(banded.join(sizes, "band"), "members")
    reach = members.groupBy("doc_id").agg(F.sum("size").alias("reach"))
    hubs = members.join(reach, "doc_id").groupBy("band").agg(F.max_by("doc_id", F.struct("reach", -F.col("doc_id"))).alias("hub"))
    hubs = common.written(hubs, "hubs")  # so that the join below has a plain shuffle on either side, which Spark can split
    stars = common.written(members.join(hubs, "band").select("hub", "doc_id").distinct(), "stars")
    pairs = stars.where("hub <> doc_id").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    texts = common.written(originals.join(stars.select("doc_id").distinct(), "doc_id", "left_semi").drop("k"), "texts")
    links = common.written(_verified(pairs, texts, similarity), "links")
    found = components(links, "a", "b")

    known = common.written(stars.join(found, stars["doc_id"] == found["node"], "left").select("hub", "doc_id", F.coalesce("component", "doc_id").alias("component")), "known")
    split = known.groupBy("hub").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("hub")
    split = common.written(split, "split")
    left = known.join(split, "hub").join(registers.select("doc_id", "registers"), "doc_id").join(texts, "doc_id")
    left = common.written(left, "left")
    blocks = left.groupBy("hub").agg(F.greatest(F.ceil(F.sum(F.octet_length("text")) / BLOCK), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("blocks"))
    blocks = common.written(blocks, "blocks")  # so that a hub with very many texts isn't dealt to one task for the join
    left = left.join(blocks, "hub").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("hub", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc_id", "component", "registers", "text")
    size = bands * rows
    least = int(size * similarity - DEVIATIONS * (size * similarity * (1 - similarity)) ** 0.5)
    more = left.groupBy("hub", "lo", "hi").applyInArrow(_similar_across(least, similarity), "a long, b long, similarity double").distinct()
    more = common.written(more, "links")
    ends = found.select("node", "component").union(more.select("a", "b")).union(copies.select("first", "doc_id"))  # by position; what was found stands for the first links
    return digests, copies, links.unionByName(more), components(ends, "node", "component")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, copy_of, linked_to, similarity, n_words) for every row of `docs` (doc_id, text).

    class_id is the least doc_id that links of `similarity` or more lead to; copy_of is the least doc_id of the rows
    with the same words; linked_to and similarity are the most similar text (of least doc_id) that was compared with this one's
    first copy, where its class has other texts. A text without words is a class of its own, as is a row with a null doc_id (its
    class_id is null). Rows with one doc_id are one node, whatever their texts. Other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    digests, copies, links, classes = _linked(docs, similarity, bands, rows)
    ends = links.select("a", "b", "similarity").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    best = common.written(ends.groupBy("a").agg(F.max_by("b", F.struct("similarity", -F.col("b"))).alias("linked_to"), F.max("similarity").alias("similarity")), "best")  # so that Spark can split the join of a first copy with very many others
    out = digests.select("doc_id", "k", "n_words").join(copies, ["doc_id", "k"], "left").select("doc_id", "n_words", F.coalesce("first", "doc_id").alias("copy_of"))
    out = out.join(best, out["copy_of"] == best["a"], "left")
    return joined(out, classes, out["doc_id"] == classes["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), "copy_of", "linked_to", "similarity", "n_words")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of `docs` that are the least doc_id of their class, all columns as they were.

    Rows with a null doc_id stay, texts without words too; of rows with one doc_id all stay or go; an empty table stays empty. No
    column is added, so none can clash.
    """
    *_, classes = _linked(docs, similarity, bands, rows)
    gone = classes.where("node > component").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
