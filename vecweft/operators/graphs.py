"""NumPy kernels over the graph of one partition: bulk construction, beam search, diversification, block cover.

A graph has levels; level l holds the nodes whose level is at least l, and a search descends greedily to level 0,
where a beam of ``ef`` nodes explores. Everything is deterministic: equal distances go by id. The links of a level are one
array, a row of places for each node, -1 for none; searches take many queries at once, a step of all their beams together.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..functions.vector import distances, one_by_one, unit

#: Rows of a matrix product.
ROWS = 2048
#: Marks of visited nodes that a block of beams may hold.
MARKS = 1 << 25
NONE = -1


def diversified(dist: np.ndarray, rows: np.ndarray, cap: int, space: str) -> list[int]:
    """Which candidates, closest first, to keep: fewer than ``cap`` all, else each that is at least as close to the
    node as to every one kept before, until ``cap`` are kept."""
    if len(dist) < cap:
        return list(range(len(dist)))
    kept: list[int] = []
    worst = np.full(len(dist), np.inf)
    for c in range(len(dist)):
        if worst[c] >= dist[c]:
            kept.append(c)
            if len(kept) == cap:
                break
            np.minimum(worst[c + 1 :], distances(rows[c : c + 1], rows[c + 1 :], space)[0], out=worst[c + 1 :])
    return kept


def nearest(rows: np.ndarray, ids: np.ndarray, k: int, space: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest others of every row, closest first."""
    n = len(rows)
    k = min(k, n - 1)
    places, found = np.zeros((n, max(k, 0)), np.int64), np.zeros((n, max(k, 0)))
    if k < 1:
        return places, found
    for at in range(0, n, ROWS):
        dist = distances(rows[at : at + ROWS], rows, space)
        dist[np.arange(len(dist)), np.arange(at, at + len(dist))] = np.inf
        near = np.argpartition(dist, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(dist, near, 1)
        order = np.lexsort((ids[near], own), axis=1)
        places[at : at + ROWS], found[at : at + ROWS] = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    return places, found


def padded(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Pairs as an array with a row for each of n sources, -1 where there are no more; in the order given."""
    count = np.bincount(src, minlength=n)
    out = np.full((n, max(1, int(count.max(initial=0)))), NONE, np.int64)
    order = np.argsort(src, kind="stable")
    at = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
    out[src[order], at] = dst[order]
    return out


class Graph:
    """Vectors, ids and, for each level, the links of its nodes as places."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, space: str, levels: np.ndarray | None = None, links: list[np.ndarray] | None = None, shown: np.ndarray | None = None):
        self.ids, self.space = ids, space
        self.rows = unit(rows) if space == "cosine" else rows
        self.levels = np.zeros(len(ids), np.int64) if levels is None else levels
        self.links = links or []
        self.shown = shown
        self.outside = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Of the last search, by query: nodes explored, and distances computed.
        self.hops = self.computed = np.zeros(0, np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, space: str, m: int, ef_construction: int, levels: np.ndarray) -> Graph:
        """Each level's nodes are linked to their diversified nearest (``ef_construction`` looked at, ``m`` kept); links go
        both ways, and a node with more than ``m`` (level 0: twice that) is diversified again."""
        graph = cls(ids, rows, space, levels)
        for level in range(int(levels.max(initial=0)) + 1):
            nodes = np.flatnonzero(levels >= level)
            near, dist = nearest(graph.rows[nodes], ids[nodes], max(ef_construction, m), space)
            src, dst = [], []
            for i, node in enumerate(nodes):
                kept = diversified(dist[i], graph.rows[nodes[near[i]]], m, space)
                src += [node] * len(kept)
                dst += nodes[near[i, kept]].tolist()
            graph.links.append(graph.both_ways(np.array(src, np.int64), np.array(dst, np.int64), 2 * m if level == 0 else m))
        return graph

    def both_ways(self, src: np.ndarray, dst: np.ndarray, cap: int) -> np.ndarray:
        return self.capped(np.r_[src, dst], np.r_[dst, src], cap, len(self.ids))

    def distance(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        return one_by_one(self.rows[places], query, self.space)

    def entry(self) -> int:
        """The node of the highest level, the smallest id of equals."""
        top = np.flatnonzero(self.levels == self.levels.max())
        return int(top[self.ids[top].argmin()])

    def descend(self, queries: np.ndarray) -> np.ndarray:
        """The node at which each query enters level 0."""
        entry = self.entry()
        at = np.full(len(queries), entry)
        best = self.distance(queries, at)
        self.hops, self.computed = np.zeros(len(queries), np.int64), np.ones(len(queries), np.int64)
        for level in range(int(self.levels[entry]), 0, -1):
            going = np.arange(len(queries))
            while len(going):
                near = self.links[level][at[going]]
                self.hops[going] += 1
                self.computed[going] += (near != NONE).sum(1)
                dist = np.where(near == NONE, np.inf, one_by_one(self.rows[near], queries[going, None, :], self.space))
                i = dist.argmin(1)
                least = dist[np.arange(len(going)), i]
                better = least < best[going]
                at[going[better]], best[going[better]] = near[better, i[better]], least[better]
                going = going[better]
        return at

    def beams(self, queries: np.ndarray, ef: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances, closest first, of up to ``ef`` shown nodes that each query finds on level 0 from its row of
        ``starts``; -1 and infinity for none. Nodes that are not shown (deleted, or filtered out) are passed through but not returned."""
        n = len(self.ids)
        places, dist = np.full((len(queries), ef), NONE, np.int64), np.full((len(queries), ef), np.inf)
        if len(self.hops) != len(queries):
            self.hops, self.computed = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        step = max(1, MARKS // max(n, 1))
        for at in range(0, len(queries), step):
            part = slice(at, at + step)
            if self.shown is None:
                places[part], dist[part] = self._beams(queries[part], ef, starts[part], self.hops[part], self.computed[part])
            else:
                for i in range(at, min(at + step, len(queries))):
                    found, hops, computed = self._beam(queries[i], ef, starts[i][starts[i] != NONE].tolist())
                    self.hops[i] += hops
                    self.computed[i] += computed
                    for k, (d, p) in enumerate(found):
                        places[i, k], dist[i, k] = p, d
        return places, dist

    def _beams(self, queries: np.ndarray, ef: int, starts: np.ndarray, hops: np.ndarray, computed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All nodes are shown, so the nodes to explore are among the best ``ef``, and a query ends when all of those are."""
        m, n = len(queries), len(self.ids)
        ids = np.r_[self.ids, np.iinfo(np.int64).max]  # the last node stands for none
        links = np.where(self.links[0] == NONE, n, self.links[0])
        rows = self.rows
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        pool, dist, done = np.full((m, ef), n), np.full((m, ef), np.inf), np.ones((m, ef), bool)

        def merge(who: np.ndarray, near: np.ndarray) -> None:
            fresh = ~seen[who[:, None], near]
            some = np.flatnonzero(fresh.any(1))
            if not len(some):
                return
            who, near, fresh = who[some], near[some], fresh[some]
            q, c = np.nonzero(fresh)
            near = np.where(fresh, near, n)
            seen[who[q], near[q, c]] = True
            computed[who] += fresh.sum(1)
            new = np.full(near.shape, np.inf)
            new[q, c] = one_by_one(rows[near[q, c]], queries[who[q]], self.space)
            all_dist, all_pool = np.concatenate((dist[who], new), 1), np.concatenate((pool[who], near), 1)
            all_done = np.concatenate((done[who], ~fresh), 1)
            order = np.lexsort((ids[all_pool], all_dist), axis=1)[:, :ef]
            dist[who], pool[who], done[who] = (np.take_along_axis(x, order, 1) for x in (all_dist, all_pool, all_done))

        first = np.sort(np.where(starts == NONE, n, starts), axis=1)
        first[:, 1:][first[:, 1:] == first[:, :-1]] = n  # a start that comes twice
        merge(np.arange(m), first)
        going = np.arange(m)
        while True:
            going = going[~done[going].all(1)]
            if not len(going):
                break
            i = done[going].argmin(1)  # pools are sorted: the first that is not explored is the closest
            at = pool[going, i]
            done[going, i] = True
            hops[going] += 1
            merge(going, links[at])
        return np.where(pool == n, NONE, pool), dist

    def _beam(self, query: np.ndarray, ef: int, starts: list[int]) -> tuple[list[tuple[float, int]], int, int]:
        """One query, where some nodes are not shown: those lie among the nodes to explore, not among the best."""
        seen = np.zeros(len(self.ids), bool)
        starts = list(dict.fromkeys(starts))
        seen[starts] = True
        ranked = sorted((float(d), int(self.ids[p]), p) for d, p in zip(self.distance(query, np.array(starts, np.int64)), starts, strict=True))[:ef]
        todo = list(ranked)
        heapq.heapify(todo)
        best = [(-d, -i, p) for d, i, p in ranked if self.shown[p]]
        heapq.heapify(best)
        hops, computed = 0, len(starts)
        while todo:
            dist, _, at = heapq.heappop(todo)
            if len(best) >= ef and dist > -best[0][0]:
                break
            hops += 1
            near = self.links[0][at]
            near = near[near != NONE]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            computed += len(near)
            for d, p in zip(self.distance(query, near).tolist(), near.tolist(), strict=True):
                if len(best) < ef or d <= -best[0][0]:
                    i = int(self.ids[p])
                    heapq.heappush(todo, (d, i, p))
                    if self.shown[p]:
                        heapq.heappush(best, (-d, -i, p))
                        if len(best) > ef:
                            heapq.heappop(best)
        return [(d, p) for d, _, p in sorted((-d, -i, p) for d, i, p in best)], hops, computed

    def search(self, queries: np.ndarray, ef: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As ``beams``; without ``starts`` from where each query's descent ends."""
        if not len(self.ids) or not len(queries):
            return np.full((len(queries), ef), NONE, np.int64), np.full((len(queries), ef), np.inf)
        return self.beams(queries, ef, self.descend(queries)[:, None] if starts is None else starts)

    def widened(self, queries: np.ndarray, ef: int, enough: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, distances) for each query by beams that double until ``enough(places, distances)`` says so of each, or all that
        can be reached is found."""
        found: list = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        going = np.arange(len(queries))
        while len(going) and len(self.ids):
            places, dist = self.search(queries[going], ef)
            done = enough(places, dist) | (places[:, -1] == NONE) | (ef >= len(self.ids))
            for i in np.flatnonzero(done):
                real = places[i] != NONE
                found[going[i]] = places[i][real], dist[i][real]
            going, ef = going[~done], 2 * ef
        return found

    def inserted(self, ids: np.ndarray, rows: np.ndarray, levels: np.ndarray, m: int, ef_construction: int) -> Graph:
        """The graph with new nodes, whose ids it does not have. On each level of its own a new node is linked to its diversified
        nearest among what a beam finds of the old nodes and all other new ones; links go both ways, and only nodes that
        get too many are diversified again. Old nodes are not searched anew."""
        rows = unit(rows) if self.space == "cosine" else rows
        if not len(self.ids):
            return Graph.build(ids, rows, self.space, m, ef_construction, levels)
        old, n = len(self.ids), len(self.ids) + len(ids)
        graph = Graph(np.r_[self.ids, ids], np.concatenate((self.rows, rows)), self.space, np.r_[self.levels, levels])
        top = int(graph.levels.max())
        for level in range(top + 1):
            links = self.links[level] if level < len(self.links) else np.full((old, 1), NONE, np.int64)
            own, cap = np.flatnonzero(levels >= level), 2 * m if level == 0 else m
            src, dst = [], []
            if len(own):
                layer = np.flatnonzero(self.levels >= level)
                k = max(ef_construction, m)
                if level == 0:
                    near, dist = self.search(rows[own], k)
                else:  # few nodes
                    exact = distances(rows[own], self.rows[layer], self.space)
                    near, dist = np.broadcast_to(layer, exact.shape), exact
                among = distances(rows[own], rows[own], self.space)
                among[np.arange(len(own)), np.arange(len(own))] = np.inf
                places, all_dist = np.concatenate((near, np.broadcast_to(old + own, among.shape)), 1), np.concatenate((np.where(near == NONE, np.inf, dist), among), 1)
                order = np.lexsort((graph.ids[places], all_dist), axis=1)[:, :k]
                places, all_dist = np.take_along_axis(places, order, 1), np.take_along_axis(all_dist, order, 1)
                for i, node in enumerate(old + own):
                    real = ~np.isinf(all_dist[i])
                    kept = diversified(all_dist[i][real], graph.rows[places[i][real]], m, self.space)
                    src += [node] * len(kept)
                    dst += places[i][real][kept].tolist()
            src, dst = np.array(src, np.int64), np.array(dst, np.int64)
            a, c = np.nonzero(links != NONE)
            graph.links.append(graph.capped(np.r_[a, src, dst], np.r_[links[a, c], dst, src], cap, n))
        return graph

    def capped(self, src: np.ndarray, dst: np.ndarray, cap: int, n: int) -> np.ndarray:
        """Links, each once; those of nodes with more than ``cap`` diversified."""
        pairs = np.unique(src * n + dst)
        ways = padded(pairs // max(n, 1), pairs % max(n, 1), n)
        kept = np.full((n, cap), NONE, np.int64)
        kept[:, : min(cap, ways.shape[1])] = ways[:, :cap]
        for node in np.flatnonzero((ways != NONE).sum(1) > cap):
            near = ways[node][ways[node] != NONE]
            dist = self.distance(self.rows[node], near)
            order = np.lexsort((self.ids[near], dist))
            near = near[order][diversified(dist[order], self.rows[near[order]], cap, self.space)]
            kept[node] = NONE
            kept[node, : len(near)] = near
        return kept

    def updated(self, places: np.ndarray, rows: np.ndarray, m: int, ef_construction: int) -> Graph:
        """The graph with other vectors for some nodes. Each neighbour of such a node chooses its links anew among the nodes within two
        hops of it, and the node itself is linked like a new one."""
        rows = unit(rows) if self.space == "cosine" else rows
        n, moved = len(self.ids), np.zeros(len(self.ids), bool)
        moved[places] = True
        graph = Graph(self.ids, self.rows.copy(), self.space, self.levels)
        graph.rows[places] = rows
        for level, links in enumerate(self.links):
            cap, new = 2 * m if level == 0 else m, links.copy()
            touched = np.unique(links[places])
            for node in touched[(touched != NONE) & ~moved[touched]]:
                one = links[node][links[node] != NONE]
                near = np.unique(np.r_[one, links[one].ravel()])
                near = near[(near != NONE) & (near != node) & ~moved[near]]
                dist = graph.distance(graph.rows[node], near)
                order = np.lexsort((self.ids[near], dist))[: max(ef_construction, m)]
                near = near[order][diversified(dist[order], graph.rows[near[order]], cap, self.space)]
                new[node] = NONE
                new[node, : min(len(near), new.shape[1])] = near[: new.shape[1]]
            new[moved] = NONE
            new[moved[np.where(new == NONE, 0, new)] & (new != NONE)] = NONE
            graph.links.append(new)
        rest = np.flatnonzero(~moved)
        place = np.cumsum(~moved) - 1
        left = [np.where(x == NONE, NONE, place[np.where(x == NONE, 0, x)]) for x in (links[rest] for links in graph.links)]
        kept = Graph(self.ids[rest], graph.rows[rest], self.space, self.levels[rest], left)
        return kept.inserted(self.ids[places], rows, self.levels[places], m, ef_construction) if n else self

    def blocks_by_degree(self, self_ef: int) -> dict[int, list[int]]:
        """As ``blocks``, but nodes are taken once, in order of how many found them, the largest first and the smaller place of equals;
        an uncovered one is the centre of its uncovered finders."""
        n = len(self.ids)
        near, _ = self.beams(self.rows, self_ef, np.arange(n)[:, None])
        who, k = np.nonzero(near != NONE)
        finders = padded(near[who, k], who, n) if n else near
        free, found = np.ones(n, bool), {}
        for node in np.argsort(-(finders != NONE).sum(1), kind="stable").tolist():
            if free[node]:
                free[node] = False
                by = finders[node][finders[node] != NONE]
                found[node] = by[free[by]].tolist()
                free[by] = False
        return found

    def blocks(self, self_ef: int) -> dict[int, list[int]]:
        """Centres and the nodes they stand for: each node's ``self_ef`` nearest (itself included) are searched from itself;
        a node covers those that found it. Centres are taken greedily by how many uncovered nodes they cover, the larger
        place of equals last, until all are covered; gains are looked at again only when a centre comes up."""
        n = len(self.ids)
        near, _ = self.beams(self.rows, self_ef, np.arange(n)[:, None])
        who, k = np.nonzero(near != NONE)
        pairs = np.unique(np.r_[near[who, k] * max(n, 1) + who, np.arange(n) * (n + 1)])
        finders = np.split(pairs % max(n, 1), np.cumsum(np.bincount(pairs // max(n, 1), minlength=n))[:-1]) if n else []
        free = np.ones(n, bool)
        queue = [(-len(by), node) for node, by in enumerate(finders)]
        heapq.heapify(queue)
        found: dict[int, list[int]] = {}
        while queue:
            gain, node = heapq.heappop(queue)
            if not free[node]:
                continue
            now = finders[node][free[finders[node]]]
            if -gain != len(now):
                heapq.heappush(queue, (-len(now), node))
                continue
            free[now] = False
            found[node] = now[now != node].tolist()
        return found

    def nested_links(self) -> pa.Array:
        """The column ``links`` of the index table: ids by level and node."""
        n = len(self.ids)
        there = [(self.links[level] != NONE) & (self.levels >= level)[:, None] for level in range(len(self.links))]
        lists = np.minimum(self.levels, len(self.links) - 1) + 1 if n else np.zeros(0, np.int64)
        first = np.cumsum(lists) - lists
        sizes, owner, values = np.zeros(int(lists.sum()), np.int64), [], []
        for level, some in enumerate(there):
            nodes = np.flatnonzero(lists > level)
            sizes[first[nodes] + level] = some[nodes].sum(1)
            q, _ = np.nonzero(some)
            owner.append(first[q] + level)
            values.append(self.ids[self.links[level][some]])
        order = np.argsort(np.concatenate(owner), kind="stable") if owner else np.zeros(0, np.int64)
        flat = np.concatenate(values)[order] if values else np.zeros(0, np.int64)
        inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int64()))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lists)], pa.int32()), inner)

    @classmethod
    def from_columns(cls, ids: np.ndarray, rows: np.ndarray, levels: np.ndarray, links: pa.Array, space: str, shown: np.ndarray | None = None) -> Graph:
        """From columns of the index table; links to nodes that are not there are ``outside``, as (places, ids) of level 0."""
        ids = np.asarray(ids, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, rows, levels = ids[order], rows[order], np.asarray(levels, np.int64)[order]
        lists = np.diff(links.offsets.to_numpy())
        inner = links.flatten()
        sizes = np.diff(inner.offsets.to_numpy())
        to = inner.flatten().to_numpy(zero_copy_only=False)
        node, level = np.repeat(place, lists), np.arange(len(inner)) - np.repeat(np.cumsum(lists) - lists, lists)
        src, of = np.repeat(node, sizes), np.repeat(level, sizes)
        at = np.searchsorted(ids, to)
        at[at == len(ids)] = 0
        real = ids[at] == to if len(ids) else np.zeros(0, bool)
        outside = src[~real & (of == 0)], to[~real & (of == 0)]
        src, dst, of = src[real], at[real], of[real]
        by_level = [padded(src[of == i], dst[of == i], len(ids)) for i in range(int(levels.max(initial=0)) + 1)]
        graph = cls(ids, rows, space, levels, by_level, None if shown is None else np.asarray(shown)[order])
        graph.outside = outside
        return graph
