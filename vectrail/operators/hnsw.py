"""Approximate neighbours: one navigable small-world graph for each sealed segment.

Graphs are built and searched segment by segment in grouped Arrow tasks; a segment is bounded by its
capacity, so a task's memory is too, and scale comes from the number of segments. Growing segments are
scanned exactly, and the segments' results are merged by a global top-k.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schemas import ACTIVE, Metric
from .exact import DIGITS, allowed, block_scores, blocked_topk, matrix, query_parts, scores


@dataclass(frozen=True)
class Parameters:
    m: int = 16  # links of a node on upper layers
    m0: int = 32  # links on the lowest layer
    ef_construction: int = 64
    ef_search: int = 32
    seed: int = 42


def _score(m: Metric, d):
    return {Metric.COSINE: 1 - d, Metric.DOT: -d}.get(m, d)


@dataclass
class Graph:
    """Nodes are places in ``vectors``; ``links[layer][node]`` are its neighbours there."""

    metric: Metric
    p: Parameters
    vectors: np.ndarray
    levels: list[int] = field(default_factory=list)
    links: list[dict[int, list[int]]] = field(default_factory=list)
    entry: int = -1
    pairs: list[list[float]] | None = None  # distances of all nodes of a small graph, while it is built

    def distance(self, q: np.ndarray, nodes: Sequence[int]) -> np.ndarray:
        """Smaller is nearer for each metric."""
        s = scores(self.metric, self.vectors[list(nodes)], q)
        return {Metric.COSINE: 1 - s, Metric.DOT: -s}.get(self.metric, s)

    def between(self, node: int, nodes: Sequence[int]) -> list[float]:
        """Distances of one node from others."""
        if self.pairs is None:
            return self.distance(self.vectors[node], nodes).tolist()
        row = self.pairs[node]
        return [row[n] for n in nodes]

    def score(self, d: float) -> float:
        return _score(self.metric, d)

    def nearest(self, q: np.ndarray | int, entries: list[tuple[float, int]], ef: int, layer: int, ok: np.ndarray | None = None) -> list[tuple[float, int]]:
        """Up to ``ef`` nearest nodes of a layer to a vector or a node by best-first search; nodes that aren't ``ok`` lead on but aren't found."""
        far = (lambda ns: self.between(q, ns)) if isinstance(q, int) else (lambda ns: self.distance(q, ns).tolist())
        seen = {n for _, n in entries}
        open_ = list(entries)
        heapq.heapify(open_)
        found = [(-d, -n) for d, n in entries if ok is None or ok[n]]
        heapq.heapify(found)
        links = self.links[layer]
        while open_:
            d, node = heapq.heappop(open_)
            if len(found) >= ef and d > -found[0][0]:
                break
            new = [n for n in links.get(node, ()) if n not in seen]
            if not new:
                continue
            seen.update(new)
            for dn, n in zip(far(new), new, strict=True):
                if len(found) < ef or dn < -found[0][0]:
                    heapq.heappush(open_, (dn, n))
                    if ok is None or ok[n]:
                        heapq.heappush(found, (-dn, -n))
                        if len(found) > ef:
                            heapq.heappop(found)
        return sorted((-d, -n) for d, n in found)

    def diverse(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that aren't nearer to a chosen one than to the base; then the nearest others, up to ``most``."""
        chosen: list[int] = []
        spare: list[int] = []
        for d, n in near:
            if len(chosen) == most:
                break
            if chosen and min(self.between(n, chosen)) < d:
                spare.append(n)
            else:
                chosen.append(n)
        return chosen + spare[: most - len(chosen)]

    def add(self, node: int, level: int) -> None:
        self.levels.append(level)
        while len(self.links) <= level:
            self.links.append({})
        if self.entry < 0:
            for layer in range(level + 1):
                self.links[layer][node] = []
            self.entry = node
            return
        top = self.levels[self.entry]
        at = [(self.between(node, [self.entry])[0], self.entry)]
        for layer in range(top, level, -1):
            at = self.nearest(node, at[:1], 1, layer)
        for layer in range(min(top, level), -1, -1):
            at = self.nearest(node, at, self.p.ef_construction, layer)
            most = self.p.m0 if layer == 0 else self.p.m
            mine = self.diverse(at, self.p.m)
            self.links[layer][node] = mine
            for n in mine:
                back = self.links[layer][n]
                back.append(node)
                if len(back) > most:
                    self.links[layer][n] = self.diverse(sorted(zip(self.between(n, back), back, strict=True)), most)
        for layer in range(top + 1, level + 1):
            self.links[layer][node] = []
        if level > top:
            self.entry = node

    def search(self, q: np.ndarray, k: int, ef: int | None = None, ok: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(distance, node) of up to k nearest nodes."""
        if self.entry < 0:
            return []
        at = [(float(self.distance(q, [self.entry])[0]), self.entry)]
        for layer in range(self.levels[self.entry], 0, -1):
            at = self.nearest(q, at[:1], 1, layer)
        return self.nearest(q, at, max(ef or self.p.ef_search, k), 0, ok)[:k]

    def search_many(self, queries: np.ndarray, k: int, ef: int | None = None, ok: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes), a row of up to k for each query, nearest first; places without a node have the distance NaN.

        The search of ``search`` for all queries of a small graph at once: a round follows the links of every node
        that is among the ``ef`` nearest found so far, where ``nearest`` follows those of one. It ends likewise, when all
        of the ``ef`` nearest have been followed.
        """
        count, n = len(queries), len(self.vectors)
        k = min(k, n)
        if self.entry < 0:
            return np.full((count, k), np.nan), np.zeros((count, k), dtype=np.int64)
        s = block_scores(self.metric, self.vectors, queries).T
        raw = {Metric.COSINE: 1 - s, Metric.DOT: -s}.get(self.metric, s)
        far = np.nan_to_num(np.ascontiguousarray(raw), nan=np.finfo(float).max)  # infinity is left for nodes that aren't found
        who, at = np.arange(count), np.full(count, self.entry)
        for layer in range(self.levels[self.entry], 0, -1):
            linked = self._linked(layer)
            while True:
                next_ = np.where(linked[at], far, np.inf).argmin(1)
                nearer = linked[at, next_] & (far[who, next_] < far[who, at])
                if not nearer.any():
                    break
                at = np.where(nearer, next_, at)
        linked = self._linked(0).astype(np.float32)
        most = max(ef or self.p.ef_search, k)
        seen, followed = np.zeros((count, n), dtype=bool), np.zeros((count, n), dtype=bool)
        seen[who, at] = True
        todo = who  # queries that aren't done
        while len(todo):
            near = np.where(seen[todo] if ok is None else seen[todo] & ok, far[todo], np.inf)
            worst = np.partition(near, most - 1, axis=1)[:, most - 1 : most] if most <= n else np.inf  # infinite while fewer are found
            follow = seen[todo] & ~followed[todo] & (far[todo] <= worst)
            some = follow.any(1)
            todo, follow = todo[some], follow[some]
            followed[todo] |= follow
            seen[todo] |= follow.astype(np.float32) @ linked > 0
        found = seen if ok is None else seen & ok
        nodes = np.argsort(np.where(found, far, np.inf), axis=1, kind="stable")[:, :k]
        return np.take_along_axis(np.where(found, raw, np.nan), nodes, 1), nodes

    def _linked(self, layer: int) -> np.ndarray:
        """Which nodes the links of each node of a layer lead to."""
        out = np.zeros((len(self.vectors), len(self.vectors)), dtype=bool)
        for i, ns in self.links[layer].items():
            out[i, ns] = True
        return out


#: Nodes of a graph whose distances are all computed before it is built: 1024 squared Python numbers are 32 MB.
PAIRS = 1024


def build(vectors: np.ndarray, metric: Metric = Metric.COSINE, p: Parameters | None = None, seed: int = 0) -> Graph:
    p = p or Parameters()
    g = Graph(metric, p, np.asarray(vectors, dtype=np.float64))
    if len(g.vectors) <= PAIRS:
        every = range(len(g.vectors))
        g.pairs = [g.distance(v, every).tolist() for v in g.vectors]
    draws = np.random.default_rng([p.seed, seed]).random(len(g.vectors))
    for i, u in enumerate(draws.tolist()):
        g.add(i, int(-np.log(max(u, 1e-12)) / np.log(p.m)))
    g.pairs = None
    return g


INDEX_SCHEMA = "segment_id long, vec_id long, vector_idx long, level int, is_entry boolean, neighbors array<array<long>>"


def build_index(rows: DataFrame, metric: str | Metric = Metric.COSINE, p: Parameters | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Graph rows of each segment of ``rows`` (segment_id, vector_idx, key, vector): neighbours by layer, as vector_idx.

    Nodes are inserted in the order of vector_idx with a generator seeded by the segment, so a rebuilt
    segment is the same. Tombstones and rows without a usable vector, or of another length than most of
    their segment, aren't inserted.
    """
    m, p = Metric.of(metric), p or Parameters()
    if "status" in rows.columns:
        rows = rows.where(F.col("status") == ACTIVE)
    rows = rows.where(V.usable(F.col(vector), F.size(vector)) & (F.size(vector) > 0))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vector_idx")
        lengths = pc.list_value_length(t.column("v"))
        t = t.filter(pc.equal(lengths, pc.mode(lengths)[0]["mode"]))
        x = matrix(t.column("v"))
        segment = t.column("segment_id")[0].as_py()
        g = build(x, m, p, segment)
        idx = t.column("vector_idx").to_pylist()
        links = [[[idx[n] for n in g.links[layer][i]] for layer in range(g.levels[i] + 1)] for i in range(len(idx))]
        return pa.table({
            "segment_id": t.column("segment_id"), "vec_id": t.column("vec_id"), "vector_idx": t.column("vector_idx"),
            "level": pa.array(g.levels, pa.int32()), "is_entry": pa.array([i == g.entry for i in range(len(idx))]),
            "neighbors": pa.array(links, pa.list_(pa.list_(pa.int64()))),
        })

    chosen = rows.select(F.col("segment_id").cast("long").alias("segment_id"), F.col("vector_idx").cast("long").alias("vector_idx"), F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return chosen.groupBy("segment_id").applyInArrow(run, INDEX_SCHEMA)


def restore(t: pa.Table, metric: Metric, p: Parameters) -> tuple[Graph, list[int]]:
    """A graph from the rows of one segment's index, with the vectors in column v."""
    t = t.sort_by("vector_idx")
    idx = t.column("vector_idx").to_pylist()
    place = {v: i for i, v in enumerate(idx)}
    g = Graph(metric, p, matrix(t.column("v")))
    g.levels = t.column("level").to_pylist()
    g.links = [{} for _ in range(max(g.levels, default=-1) + 1)]
    for i, layers in enumerate(t.column("neighbors").to_pylist()):
        for layer, ns in enumerate(layers):
            g.links[layer][i] = [place[n] for n in ns if n in place]
    entries = [i for i, e in enumerate(t.column("is_entry").to_pylist()) if e]
    g.entry = entries[0] if entries else -1
    return g, t.column("vec_id").to_pylist()


def search_index(
    index: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 10, ef: int | None = None, metric: str | Metric = Metric.COSINE, p: Parameters | None = None,
    key: str = "vec_id", vector: str = "embedding", ids: DataFrame | None = None,
) -> DataFrame:
    """(query_id, key, score): up to 2k per query from each block of segments, before the global top-k.

    Vectors are joined to the graph's nodes by (segment_id, vector_idx). Deleted rows and rows outside
    ``ids`` lead a search on but aren't found. Queries (query_id, query_vector) are a stated set, broadcast in parts of
    bounded size. Many queries are searched in blocks of segments of about ``ROWS`` places, which keep a query's 2k
    nearest of them all, so that what is shuffled doesn't grow with every small segment.
    """
    m, p = Metric.of(metric), p or Parameters()
    live = rows.where(F.col("status") == ACTIVE) if "status" in rows.columns else rows
    live = allowed(live, ids, key).select(F.col("segment_id").cast("long").alias("segment_id"), F.col("vector_idx").cast("long").alias("vector_idx"), F.lit(True).alias("ok"))
    vectors = rows.select(F.col("segment_id").cast("long").alias("segment_id"), F.col("vector_idx").cast("long").alias("vector_idx"), F.col(vector).alias("v"))
    full = index.join(vectors, ["segment_id", "vector_idx"]).join(live, ["segment_id", "vector_idx"], "left")

    schema = f"query_id long, `{key}` long, score double"
    found = capacity = None
    for part in query_parts(queries):
        per = 1
        if len(part[0]) >= MANY:
            capacity = capacity or (rows.agg(F.max("vector_idx")).first()[0] or 0) + 1
            per = max(1, ROWS // capacity)
        block = full.groupBy(F.floor(F.col("segment_id") / per).alias("block"))
        one = block.applyInArrow(_searcher(index.sparkSession.sparkContext.broadcast(part), k, ef, m, p, key), schema)
        found = one if found is None else found.unionByName(one)
    return index.sparkSession.createDataFrame([], schema) if found is None else found


#: Queries that are searched by blocks of segments, and the places of a block; nodes of a graph that is searched for all
#: queries at once, and numbers of such a table of distances.
MANY, ROWS, DENSE, TABLE = 64, 6_400, 512, 1 << 20


def _searcher(shared, k: int, ef: int | None, m: Metric, p: Parameters, key: str):
    def of_graph(g: Graph, queries: np.ndarray, ok: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if len(g.vectors) <= DENSE:
            step = max(1, TABLE // max(1, len(g.vectors)))
            parts = [g.search_many(queries[lo : lo + step], 2 * k, ef, ok) for lo in range(0, len(queries), step)]
            return np.concatenate([d for d, _ in parts]), np.concatenate([n for _, n in parts])
        d, nodes = np.full((len(queries), 2 * k), np.nan), np.zeros((len(queries), 2 * k), dtype=np.int64)
        for i, q in enumerate(queries):
            for j, (x, n) in enumerate(g.search(q, 2 * k, ef, ok)):
                d[i, j], nodes[i, j] = x, n
        return d, nodes

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("segment_id", "ascending"), ("vector_idx", "ascending")])
        segment = t.column("segment_id").to_numpy()
        cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(segment)]
        ids, queries = shared.value
        best, found = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), dtype=np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            g, keys = restore(t.slice(lo, hi - lo), m, p)
            if g.vectors.shape[1] != queries.shape[1]:  # queries of another length have no neighbours here
                continue
            ok = np.array([x is True for x in t.column("ok").slice(lo, hi - lo).to_pylist()])
            d, nodes = of_graph(g, queries, None if ok.all() else ok)
            rank = np.round(_score(m, d), DIGITS)
            best = np.concatenate([best, -rank if m.descending else rank], axis=1)  # NaN comes last
            found = np.concatenate([found, np.array(keys, dtype=np.int64)[nodes]], axis=1)
            if best.shape[1] > 2 * k:
                order = np.lexsort((found, best), axis=1)[:, : 2 * k]
                best, found = np.take_along_axis(best, order, 1), np.take_along_axis(found, order, 1)
        who, at = np.nonzero(~np.isnan(best))
        s = best[who, at]
        return pa.table({"query_id": pa.array(np.array(ids, dtype=np.int64)[who]), key: pa.array(found[who, at]), "score": pa.array(-s if m.descending else s)})

    return run


def ann_topk(rows: DataFrame, index: DataFrame, query: Sequence[float], k: int = 10, metric: str | Metric = Metric.COSINE, key: str = "vec_id", vector: str = "embedding", ids: DataFrame | None = None, ef: int | None = None, p: Parameters | None = None) -> DataFrame:
    """(key, score): graphs for segments that have one, an exact scan for the others, one global top-k."""
    m = Metric.of(metric)
    queries = rows.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, query_vector array<double>")
    sealed = index.select("segment_id").distinct()
    graph = search_index(index, rows, queries, k, ef, m, p, key, vector, ids).select(key, "score")
    growing = blocked_topk(rows.join(sealed, "segment_id", "left_anti"), query, k, m, key, vector, ids)
    return graph.unionByName(growing).orderBy(*V.ordering(m, "score", key)).limit(k)
