"""Centroid clustering: Lloyd's rounds with a tree over the vectors and a tree over the centroids.

Vectors are cut into blocks of BLOCK within tasks, and each block gets a cover tree once: a node is a centre with the radius
that covers its points, its children cover them at a scale smaller by SCALE with centres apart by more than that. Blocks
are rows of a staged table. In every round a task walks each block's tree together with a tree over the centroids: a pair
of nodes is pruned when its least distance exceeds what another pair assures, a node with one centroid left is assigned as
a whole, and leaf pairs are compared exactly, in integers. A task gives back a count and a sum for each centroid, so a
round moves as many rows as tasks times centroids, and the driver sees one row for each centroid.

Distances that prune are doubles with a margin far above their rounding; ties are never pruned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.staging import drop, map_arrow, stage

SIZE, CENTROIDS, ROUNDS, UNIT = 64, 8, 10, 1024
#: Components are held within this, so that the squared distance of any two vectors fits a long.
MOST = 1 << 27
BLOCK, LEAF, SCALE = 2048, 8, 1.5
MARGIN = 1e-9


class Tree(NamedTuple):
    """Nodes breadth first; a node covers the points ``order[start:end]``, and its children stand in a row."""

    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _away(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    d = points - center
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of ``points`` (rows, as doubles); nodes of ``leaf`` points at most aren't divided."""
    order = np.arange(len(points))
    first = int(np.argmin(_away(points, points.mean(0))))
    order[[0, first]] = order[[first, 0]]
    nodes, k = [(0, len(points))], 0
    center, radius, child, children = [], [], [], []
    while k < len(nodes):
        a, b = nodes[k]
        own = order[a:b]
        d = _away(points[own], points[own[0]])
        far = float(d.max(initial=0))
        center.append(own[0])
        radius.append(far)
        child.append(len(nodes))
        if b - a <= leaf or (not far and leaf > 1):
            children.append(0)
        else:
            before, rest, parts = len(nodes), own, []
            d_rest = d
            while len(rest):
                near = d_rest <= far / SCALE if far else np.arange(len(rest)) == 0
                parts.append(rest[near])
                rest = rest[~near]
                if len(rest):
                    d_rest = _away(points[rest], points[rest[0]])
            order[a:b] = np.concatenate(parts)
            at = a
            for p in parts:
                nodes.append((at, at + len(p)))
                at += len(p)
            children.append(len(nodes) - before)
        k += 1
    start, end = np.array(nodes, np.int32).T
    return Tree(order.astype(np.int32), np.array(center, np.int32), np.array(radius), np.array(child, np.int32), np.array(children, np.int32), start, end)


def _expanded(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (times[0] values), first[1], ..."""
    return np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())


def nearest(points: np.ndarray, tree: Tree, cents: np.ndarray, over: Tree) -> tuple[np.ndarray, int]:
    """The nearest centroid of each point (ties: the smaller number), and how many distances of points were compared.

    ``over``: the tree of the centroids, with leaves of one.
    """
    label = np.full(len(points), -1, np.int32)
    compared = 0
    at = np.zeros(1, np.int64)  # nodes of the points' tree that aren't assigned yet
    least = np.full(1, np.inf)  # no point below the node has its nearest centroid farther away
    of, node = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs: place in ``at``, ascending, and node over centroids
    floats, cents_f = points.astype(np.float64), cents.astype(np.float64)
    while len(at):
        d = _away(floats[tree.center[at[of]]], cents_f[over.center[node]])
        rv, rc = tree.radius[at[of]], over.radius[node]
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        least = np.minimum(least, np.minimum.reduceat(d + rv, cut))
        near = d - rv - rc <= least[of] + MARGIN * (1 + d + rv + rc)
        of, node, rc = of[near], node[near], rc[near]
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        n, divisible = np.diff(np.append(cut, len(of))), over.children[node] > 0
        most, any_ = np.maximum.reduceat(rc, cut), np.logical_or.reduceat(divisible, cut)
        single = (n == 1) & ~any_
        for v, c in zip(at[single], over.center[node[cut[single]]], strict=True):
            label[tree.order[tree.start[v] : tree.end[v]]] = c
        is_leaf = tree.children[at] == 0
        over_first = ~single & any_ & (is_leaf | (most >= tree.radius[at]))
        exact = ~single & ~any_ & is_leaf
        down = ~single & ~over_first & ~is_leaf
        if exact.any():
            sel = exact[of]
            v, c = at[of[sel]], over.center[node[sel]]
            size = (tree.end - tree.start)[v].astype(np.int64)
            p, c = tree.order[_expanded(tree.start[v].astype(np.int64), size)], np.repeat(c, size)
            dist = ((points[p].astype(np.int64) - cents[c]) ** 2).sum(1)
            best = np.lexsort((c, dist, p))
            best = best[np.append(True, p[best][1:] != p[best][:-1])]
            label[p[best]] = c[best]
            compared += len(p)
        # the next front: nodes whose centroids are divided stay, others give way to their children
        new_at, new_least, new_of, new_node = [], [], [], []
        if over_first.any():
            sel = over_first[of]
            times = np.where(divisible[sel], over.children[node[sel]], 1).astype(np.int64)
            first = np.where(divisible[sel], over.child[node[sel]], node[sel]).astype(np.int64)
            new_at.append(at[over_first])
            new_least.append(least[over_first])
            new_of.append(np.repeat((np.cumsum(over_first) - 1)[of[sel]], times))
            new_node.append(_expanded(first, times))
        if down.any():
            kids = tree.children[at[down]].astype(np.int64)
            sel = down[of]
            pairs, rank = np.bincount(of[sel], minlength=len(at))[down], np.repeat(np.arange(down.sum()), kids)
            begin = np.cumsum(pairs) - pairs
            new_of.append(np.repeat(np.arange(len(rank)), pairs[rank]) + sum(map(len, new_at)))
            new_node.append(node[sel][_expanded(begin[rank], pairs[rank])])
            new_at.append(_expanded(tree.child[at[down]].astype(np.int64), kids))
            new_least.append(np.repeat(least[down], kids))
        if not new_at:
            break
        at, least, of, node = (np.concatenate(x) for x in (new_at, new_least, new_of, new_node))
    return label, compared


_BLOCK_SCHEMA = "ids array<bigint>, vectors array<int>, place array<int>, center array<int>, radius array<double>, child array<int>, children array<int>, first array<int>, past array<int>"


def _listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array(arrays, pa.list_(kind))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (vec_id, v) to blocks with their trees."""

    def built(rows: pa.Table) -> pa.RecordBatch:
        v = np.asarray(rows.column("v").combine_chunks().flatten()).reshape(-1, SIZE)
        t = cover_tree(v.astype(np.float64))
        ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column("vec_id").combine_chunks())
        return pa.record_batch([ids, _listed([v.ravel()], pa.int32()), _listed([t.order], pa.int32()), _listed([t.center], pa.int32()), _listed([t.radius], pa.float64()), *[_listed([x], pa.int32()) for x in (t.child, t.children, t.start, t.end)]], [x.split()[0] for x in _BLOCK_SCHEMA.split(", ")])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(BLOCK - sum(x.num_rows for x in held), batch.num_rows - at)
            held.append(batch.slice(at, take))
            at += take
            if sum(x.num_rows for x in held) == BLOCK:
                yield built(pa.Table.from_batches(held))
                held = []
    if held:
        yield built(pa.Table.from_batches(held))


def _each_block(batches: Iterator[pa.RecordBatch], cents: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """ids, vectors and labels of each block."""
    over = cover_tree(cents.astype(np.float64), leaf=1)
    for batch in batches:
        for row in range(batch.num_rows):
            part = {c: batch.column(c)[row].values for c in batch.schema.names}
            own = {c: np.asarray(x) for c, x in part.items() if c != "ids"}
            points = own["vectors"].reshape(-1, SIZE)
            label, _ = nearest(points, Tree(own["place"], own["center"], own["radius"], own["child"], own["children"], own["first"], own["past"]), cents, over)
            yield part["ids"], points, label


def _sums(cents: np.ndarray) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(cents), np.int64), np.zeros((len(cents), SIZE), np.int64)
        for _, points, label in _each_block(batches, cents):
            count += np.bincount(label, minlength=len(cents))
            for c in np.unique(label):
                total[c] += points[label == c].sum(0, dtype=np.int64)
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return rows


def _assigned(cents: np.ndarray) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, label in _each_block(batches, cents):
            dist = ((points.astype(np.int64) - cents[label]) ** 2).sum(1)
            yield pa.record_batch([ids, pa.array(label, pa.int32()), pa.array(dist)], ["vec_id", "cluster", "distance"])

    return rows


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of int) of the rows with SIZE components, none null, NaN or infinite: floor(UNIT * x), held within MOST."""
    x = F.col("embedding")
    fine = (F.size(x) == SIZE) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(F.greatest(F.least(e.cast("double") * UNIT, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    ``embeddings``: vec_id, embedding (others are ignored). Centroids start as the k vectors with the smallest hash of
    ``seed:vec_id``; rows that repeat a vec_id are vectors of their own, in the order of their components; rows without
    vec_id are clustered but start no centroid unless too few others are there. With fewer than k vectors each starts one; an empty table gives
    no rows. Components beyond 2**27 after scaling count as 2**27; a sum of distances that exceeds a long is null.
    """
    vectors = stage(kept_vectors(embeddings), "vectors")
    start = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()  # k rows
    cents = np.array([r.v for r in start], np.int64).reshape(-1, SIZE)
    blocks = stage(map_arrow(vectors, _blocks, _BLOCK_SCHEMA), "blocks")
    drop(vectors)
    for _ in range(rounds if len(cents) else 0):
        parts = map_arrow(blocks, _sums(cents), "cluster int, n bigint, total array<bigint>")
        sums = [F.sum(F.get("total", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(SIZE)]
        for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each centroid
            cents[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(SIZE)]
    if not len(cents):
        return blocks.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    found = stage(map_arrow(blocks, _assigned(cents), "vec_id bigint, cluster int, distance bigint"), "clusters")
    drop(blocks)
    names = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(cents.tolist())]
    total = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # a row for each centroid
    own, every = {r.cluster: int(r.own) for r in total}, sum(int(r.own) for r in total)
    fits = lambda x: x if x < 2**63 else None
    info = found.sparkSession.createDataFrame([(c, fits(own.get(c, 0)), fits(every), name) for c, name in names], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
