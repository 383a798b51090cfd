"""Hierarchical navigable small-world graphs over unit vectors, built and searched for many vectors at a time.

Layers are numpy arrays of neighbours. Vectors join a layer in batches that at most double it: each batch searches the layer
for its nearest nodes, adds the nearest within the batch, and keeps those that are nearer to the new node than to each
other, so that a dense group keeps links to what lies around it. Neighbours link back, and full lists are chosen anew the same way.
"""

from __future__ import annotations

import numpy as np

LINKS, BUILD_BEAM, BATCH, SPREAD = 16, 48, 256, 4


def select(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of candidate neighbours (rows sorted by similarity, -1: none), those nearer to their node than to one chosen; then the next nearest."""
    rows, width = ids.shape
    own = vectors[np.maximum(ids, 0)]
    between = np.einsum("rid,rjd->rij", own, own)
    chosen = np.zeros((rows, width), bool)
    for i in range(width):
        near = (between[:, i] > sims[:, i : i + 1]) & chosen
        chosen[:, i] = (ids[:, i] >= 0) & ~near.any(1) & (chosen.sum(1) < most)
    rank = np.where(ids < 0, 2 * width, np.where(chosen, 0, width) + np.arange(width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def _sorted(sims: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling similarity, each id once, at most `keep`."""
    order = np.argsort(-sims, axis=1, kind="stable")
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    return sims[:, :keep], ids[:, :keep]


class Graph:
    """The vectors of a shard (unit length, float32) and the neighbours of each layer, the lowest first."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(1 - draw) / np.log(LINKS)).astype(int) if n else np.zeros(0, int)
        order = np.argsort(-level, kind="stable")
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # nodes, neighbours as places in nodes
        top = int(level.max()) if n else -1
        self.layers = [None] * (top + 1)
        for at in range(top, -1, -1):
            nodes = order[: int((level >= at).sum())]
            self.layers[at] = (nodes, self._joined(at, nodes))

    @classmethod
    def of(cls, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> Graph:
        """A graph that was built before."""
        made = cls(vectors[:0])
        made.vectors, made.layers = np.ascontiguousarray(vectors, np.float32), layers
        return made

    def _joined(self, at: int, nodes: np.ndarray) -> np.ndarray:
        most = 2 * LINKS if at == 0 else LINKS
        vectors = self.vectors[nodes]
        links = np.full((len(nodes), most), -1, np.int64)
        done = 0
        while done < len(nodes):
            new = np.arange(done, min(len(nodes), done + min(BATCH, max(1, done))))
            q = vectors[new]
            inner = q @ q.T
            np.fill_diagonal(inner, -np.inf)
            keep = min(len(new), LINKS * 2)
            near = np.argpartition(-inner, keep - 1, axis=1)[:, :keep]
            sims, ids = np.take_along_axis(inner, near, 1), new[near]
            ids = np.where(np.isinf(sims), -1, ids)
            if done:
                found_sims, found = _search(vectors[:done], links[:done], q, self._entry(at, q, done), BUILD_BEAM)
                sims, ids = np.concatenate([sims, found_sims], 1), np.concatenate([ids, found], 1)
            sims, ids = _sorted(np.where(ids < 0, -np.inf, sims), ids, BUILD_BEAM)
            links[new] = select(sims, ids, vectors, LINKS) if most == LINKS else np.pad(select(sims, ids, vectors, LINKS), ((0, 0), (0, LINKS)), constant_values=-1)
            self._link_back(vectors, links, new, most)
            done = int(new[-1]) + 1
        return links

    def _entry(self, at: int, q: np.ndarray, done: int) -> np.ndarray:
        """Where to begin in a layer: what the layer above finds. Its nodes come first in this one, in the same places."""
        if at + 1 >= len(self.layers):
            return np.zeros((len(q), 1), np.int64)
        found = self._descend(at + 1, q, 4)
        return np.where(found < done, found, 0)

    def _descend(self, to: int, q: np.ndarray, beam: int) -> np.ndarray:
        """The nearest nodes of layer `to`, searched from the top."""
        entry = np.zeros((len(q), 1), np.int64)
        for nodes, links in reversed(self.layers[to:]):
            entry = _search(self.vectors[nodes], links, q, entry, beam)[1]
        return np.where(entry < 0, entry[:, :1], entry)

    @staticmethod
    def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, most: int) -> None:
        source = np.repeat(new, (links[new] >= 0).sum(1))
        target = links[new][links[new] >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        begin = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, int)
        which = target[begin] if len(target) else target
        counts = np.diff(np.append(begin, len(target)))
        for lo in range(0, len(which), 512):
            some, n = which[lo : lo + 512], counts[lo : lo + 512]
            wide = np.full((len(some), most + int(n.max())), -1, np.int64)
            wide[:, :most] = links[some]
            row = np.repeat(np.arange(len(some)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            wide[row, most + place] = source[begin[lo] : begin[lo] + len(row)]
            wide = np.sort(wide, axis=1)[:, ::-1]
            wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
            fits = (wide >= 0).sum(1) <= most
            calm = np.sort(wide[fits], axis=1)[:, ::-1][:, :most]
            links[some[fits]] = calm
            if not fits.all():
                full = np.flatnonzero(~fits)
                ids = wide[full]
                sims = np.where(ids < 0, -np.inf, np.einsum("rid,rd->ri", vectors[np.maximum(ids, 0)], vectors[some[full]]))
                sims, ids = _sorted(sims, ids, 2 * most)
                links[some[full]] = select(sims, np.where(np.isinf(sims), -1, ids), vectors, most)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, places in the shard) of the `beam` nearest that a search finds for each query, falling; -1: none."""
        if not self.layers:
            return np.full((len(q), 1), -np.inf), np.full((len(q), 1), -1)
        entry = self._descend(1, q, min(beam, 8)) if len(self.layers) > 1 else np.zeros((len(q), 1), np.int64)
        nodes, links = self.layers[0]
        sims, ids = _search(self.vectors[nodes], links, q, entry, beam)
        return sims, np.where(ids < 0, -1, nodes[np.maximum(ids, 0)])


def _search(vectors: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries at once: each turn opens the best unopened nodes of every beam."""
    n, beam = len(vectors), min(beam, len(vectors))
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), bool)  # the last place stands for none
    ids = np.sort(entry, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    seen[rows, ids] = True
    sims = np.where(ids < 0, -np.inf, np.einsum("rid,rd->ri", vectors[np.maximum(ids, 0)], q))
    sims, ids = _sorted(sims, ids, beam)
    if (pad := beam - ids.shape[1]) > 0:
        sims, ids = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf), np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
    opened = ids < 0
    live = np.arange(len(q))
    while True:
        live = live[(~opened[live]).any(1)]
        if not len(live):
            break
        waiting = np.where(opened[live], -np.inf, sims[live])
        best = np.argpartition(-waiting, min(SPREAD, beam) - 1, axis=1)[:, : min(SPREAD, beam)]
        real = np.take_along_axis(waiting, best, 1) > -np.inf
        node = np.take_along_axis(ids[live], best, 1)
        opened[live[:, None], best] = True
        near = np.where(real[:, :, None], links[np.maximum(node, 0)], -1).reshape(len(live), -1)
        near = np.where(seen[live[:, None], near], -1, near)
        near = np.sort(near, axis=1)[:, ::-1]
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = near[:, : max(1, int((near >= 0).sum(1).max()))]
        seen[live[:, None], near] = True
        found = np.where(near < 0, -np.inf, np.einsum("rid,rd->ri", vectors[np.maximum(near, 0)], q[live]))
        all_sims, all_ids = np.concatenate([sims[live], found], 1), np.concatenate([ids[live], near], 1)
        flags = np.concatenate([opened[live], near < 0], 1)
        if all_sims.shape[1] > beam:
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            all_sims, all_ids, flags = (np.take_along_axis(x, top, 1) for x in (all_sims, all_ids, flags))
        all_ids = np.where(np.isinf(all_sims), -1, all_ids)
        sims[live], ids[live], opened[live] = all_sims, all_ids, flags | (all_ids < 0)
    return _sorted(sims, ids, beam)
