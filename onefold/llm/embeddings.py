"""Near-duplicate vectors by cosine, with a navigable small-world graph for each shard.

Equal vectors are one class. Classes are dealt into shards by their id, each shard becomes a graph, and every class is
looked for in every shard: a task loads a graph once, and its queries stream past it, a block at a time. A beam is widened for a
query while all that it holds are links, and for the whole block while an audit finds that links are missed: the audit
compares some of the block's queries with all the shard, and each query of the shard must find itself. The widest beam is the whole
shard. The links found are verified in double precision, counted and forgotten a few queries at a time; what a task hands on
is one link for each query and a spanning forest of its shard, and components are joined over those.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.llm import common
from onefold.llm.hnsw import Graph
from onefold.operators.components import components

SIMILARITY = 0.9
#: Shards there are at least, vectors of a shard and queries of a task at most, about, and queries of a block.
SHARDS, SHARD_SIZE, TASK, BLOCK = 6, 65_536, 65_536, 4_096
BEAM, AUDITED, RECALL = 64, 24, 0.999
#: Similarities that are held at a time.
HELD = 1 << 22

_FOUND = "u long, v long, links long"


def _matrix(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither very large nor very small numbers lose their length
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _graph(group: pa.Table) -> pa.Table:
    """The graph of a shard, with its vectors once, in single precision if that loses nothing."""
    group = group.sort_by("vec_id")
    vectors = _matrix(group.column("embedding"))
    graph = Graph(_unit(vectors))
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    layers = [(nodes.astype(np.int32), links.astype(np.int32)) for nodes, links in graph.layers]
    packed = pickle.dumps((layers, single if (single == vectors).all() else vectors, group.column("vec_id").to_numpy(), group.column("copies").to_numpy()), protocol=5)
    return pa.table({"dim": group.column("dim").slice(0, 1), "shard": group.column("shard").slice(0, 1), "graph": pa.array([packed], pa.binary())})


class Shard:
    """A loaded graph, what its queries found, and which of its vectors they join."""

    def __init__(self, packed: bytes, similarity: float, beam: int = BEAM):
        layers, vectors, self.ids, self.copies = pickle.loads(packed)
        self.base = _unit(vectors.astype(np.float64))
        self.graph = Graph.of(self.base, [(nodes.astype(np.int64), links.astype(np.int64)) for nodes, links in layers])
        self.similarity, self.beam = similarity, min(beam, len(self.ids))
        self.label = np.arange(len(self.ids))

    def _hits(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place) of the verified links, and how many near places each query's beam held."""
        single, n = q.astype(np.float32), len(self.ids)
        if width >= n:
            near = single @ self.graph.vectors.T >= self.similarity - 1e-5
            row, place = np.nonzero(near)
        else:
            sims, places = self.graph.search(single, width)
            near = (sims >= self.similarity - 1e-5) & (places >= 0)
            row, place = np.nonzero(near)[0], places[near]
        keep = np.zeros(len(row), bool)
        for lo in range(0, len(row), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            keep[part] = np.einsum("id,id->i", q[row[part]], self.base[place[part]]) >= self.similarity
        return row[keep], place[keep], near.sum(1)

    def _join(self, places: np.ndarray) -> None:
        labels = np.unique(self.label[places])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def search(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a block of queries: the links of each, copies counted, and a place that it links with (-1: none). A vector is no link of itself."""
        q, n = _unit(queries), len(self.ids)
        own = np.searchsorted(self.ids, query_ids)
        own = np.where((own < n) & (self.ids[np.minimum(own, n - 1)] == query_ids), own, -1)
        audited = set(np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int)).tolist())
        extra, held = AUDITED, {}
        links, link, itself = np.zeros(len(q), np.int64), np.full(len(q), -1), np.ones(len(q), bool)
        beams, todo = np.full(len(q), self.beam), np.arange(len(q))
        while True:
            full = np.zeros(len(q), bool)
            for width in np.unique(beams[todo]):
                group = todo[beams[todo] == width]
                size = max(1, min(256, HELD // max(n if width >= n else width, 1)))
                for lo in range(0, len(group), size):
                    some = group[lo : lo + size]
                    row, place, near = self._hits(q[some], int(width))
                    full[some] = (near >= width) & (width < n)
                    at = np.searchsorted(row, np.arange(len(some) + 1))
                    for i, query in enumerate(some.tolist()):
                        found = place[at[i] : at[i + 1]]
                        if query in audited or extra and len(found) > 1:
                            extra -= query not in audited
                            audited.add(query)
                            held[query] = found
                        if own[query] >= 0:
                            itself[query] = (found == own[query]).any()
                        self._join(found)
                        found = found[found != own[query]]
                        links[query] = self.copies[found].sum()
                        if len(found):
                            link[query] = found[0]
            if full.any():  # all that the beam holds are links: there may be more
                todo = np.flatnonzero(full)
                beams[todo] = np.minimum(beams[todo] * 4, n)
                continue
            truth = {i: np.flatnonzero(self.base @ q[i] >= self.similarity) for i in sorted(audited)}
            missed = sum(len(np.setdiff1d(t, held[i])) for i, t in truth.items())
            if missed > (1 - RECALL) * sum(map(len, truth.values())):
                todo = np.flatnonzero(beams < n)
            else:
                todo = np.flatnonzero(~itself & (own >= 0) & (beams < n))
            if not len(todo):
                return links, link
            beams[todo] = np.minimum(beams[todo] * 2, n)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of the vectors that queries joined, each with the first of its tree."""
        far = np.flatnonzero(self.label != np.arange(len(self.ids)))
        return self.ids[far], self.ids[self.label[far]]


def _searched(similarity: float):
    """Rows in the order of their shards, the graph before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, of, ids, vectors = None, None, [], []

        def row(u, v, links) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, links)], ["u", "v", "links"])

        def block() -> Iterator[pa.RecordBatch]:
            if ids:
                query_ids = np.concatenate(ids)
                links, link = shard.search(query_ids, np.concatenate(vectors))
                ids.clear()
                vectors.clear()
                some = np.flatnonzero(links)
                yield row(query_ids[some], shard.ids[link[some]], links[some])

        def end() -> Iterator[pa.RecordBatch]:
            if shard is not None:
                yield from block()
                u, v = shard.forest()
                yield row(u, v, np.zeros(len(u), np.int64))

        for batch in batches:
            graphs = batch.column("graph")
            heads = np.flatnonzero(graphs.is_valid().to_numpy(zero_copy_only=False)).tolist()
            keys = list(zip(*(batch.column(x).to_pylist() for x in ("dim", "shard", "slot")), strict=True))
            for lo, hi in zip([0, *heads], [*heads, batch.num_rows], strict=True):
                if lo in heads:
                    yield from end()
                    shard, of = Shard(graphs[lo].as_py(), similarity), keys[lo]
                    lo += 1
                while lo < hi:
                    some = min(hi, lo + BLOCK - sum(map(len, ids)))
                    if of == keys[lo] == keys[some - 1]:  # a shard without vectors has queries, but no graph
                        ids.append(batch.column("vec_id").slice(lo, some - lo).to_numpy())
                        vectors.append(_matrix(batch.column("embedding").slice(lo, some - lo)))
                        if sum(map(len, ids)) >= BLOCK:
                            yield from block()
                    lo = some
        yield from end()

    return run


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing; vectors of different
    lengths don't link. A null vec_id is no node: its row has no links and is kept. Rows with one vec_id and equal vectors are one
    node. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    fine = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.where("vec_id is not null").where(fine).distinct()
    classes = common.written(valid.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "classes")
    members = common.written(valid.join(classes.where("copies > 1"), "embedding").select("vec_id", "first", "copies"), "members")
    n = classes.count()
    shards, slots = max(SHARDS, -(-n // SHARD_SIZE)), max(1, -(-n // TASK))
    dealt = classes.select(F.col("first").alias("vec_id"), "copies", "embedding", F.size("embedding").alias("dim"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("slot", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(slots)).cast("int"))
    graphs = common.written(dealt.groupBy("dim", "shard").applyInArrow(_graph, "dim int, shard int, graph binary"), "graphs")
    each = lambda name, many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(name)
    queries = dealt.select("dim", "slot", "vec_id", "embedding", each("shard", shards))
    rows_of = graphs.select("dim", "shard", "graph", each("slot", slots)).unionByName(queries, allowMissingColumns=True)
    # a partition for each shard and slot: Spark would make one task of small ones, whose work isn't small
    ordered = rows_of.repartitionById(shards * slots, (F.col("shard") * slots + F.col("slot")).cast("int")).sortWithinPartitions("dim", "shard", "slot", F.col("graph").isNull())
    common.small_batches(spark)
    found = common.written(ordered.mapInArrow(_searched(similarity), _FOUND), "found")
    counts = found.where("links > 0").groupBy("u").agg(F.sum("links").alias("links"))
    linked = components(found.select("u", "v").unionByName(members.select(F.col("first").alias("u"), F.col("vec_id").alias("v"))), "u", "v")
    own = members.groupBy("vec_id").agg(F.min("first").alias("first"), F.sum(F.col("copies") - 1).alias("copies"))
    out = rows.select("vec_id").join(own, "vec_id", "left").join(linked, F.col("vec_id") == linked["node"], "left")
    out = out.join(counts, F.coalesce("first", "vec_id") == counts["u"], "left")
    component = F.coalesce("component", "vec_id")
    n_links = (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(0))).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
