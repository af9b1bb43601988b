"""Near duplicates by SimHash with a Gray-order hierarchical index.

Each text gets a 64-bit fingerprint in one pass. Documents with equal fingerprints are one class, and only distinct
fingerprints are searched for links of LINK differing bits at most.

The index is a hierarchy of masked bit patterns. Its uppermost nodes are shuffle keys: two fingerprints that differ in two
bits agree on one of three masks that share out the bits, so every fingerprint goes under its three patterns, and each
pattern is searched by itself. A pattern with more than LIMIT fingerprints is factored further, by three masks that share
out the bits that are still free; that is exact as well, and after four rounds 12 bits are free, so that no pattern can hold
more than 4096. Within a task the fingerprints of a pattern are sorted by Gray rank, which puts those that differ in few
bits beside each other; nodes over FAN neighbours hold the bits that all below them share, less those that their own
parent holds. A search adds up the differences with a node's own bits on the way down and leaves a whole group as soon as
they exceed LINK. Links between fingerprints that a task already knows to be connected aren't given out, so a dense group
gives a tree of links and no square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.bytehash import U64
from quillstream.llm.components import connected_components
from quillstream.llm.staging import drop, map_arrow, stage

SHINGLE, SEED = 3, 42
LINK = 2
#: Fingerprints under one pattern that a task searches; what four rounds of factoring leave at most.
LIMIT = 4096
FAN = 16
#: Fingerprints searched together in a task, and searches that go down the index together.
BATCH, SEARCHES = 1 << 17, 1 << 14
#: Shingle hashes whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: bytes) -> int:
    """Bit k is set if it is set in over half the XXH64 values of the text's word shingles; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.append(0, end[:-1] + 1)
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    count = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, COUNTED):
        pairs = zip(start[k : min(k + COUNTED, n)].tolist(), end[k + size - 1 : min(k + COUNTED, n) + size - 1].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in pairs], U64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint((t.as_py() or "").encode()) for t in batch.column("text")), U64, batch.num_rows)
        yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray code."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> U64(k))
    return fp


def _level(both: np.ndarray, either: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes over runs of FAN neighbours of one group: AND and OR of all below, group, first child, number of children."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    run = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    start = np.flatnonzero((np.arange(len(group)) - first[run]) % FAN == 0)
    return np.bitwise_and.reduceat(both, start), np.bitwise_or.reduceat(either, start), group[start], start, np.diff(np.append(start, len(group)))


def close_pairs(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all fingerprints of one group that differ in LINK bits at most.

    ``fp`` is distinct within a group and sorted by group and Gray rank.
    """
    levels = [(fp, fp, group, np.arange(len(fp)), np.ones(len(fp), np.int64))]
    while len(levels[-1][2]) > len(np.unique(levels[-1][2])):
        levels.append(_level(*levels[-1][:3]))
    masks = [~(both ^ either) for both, either, *_ in levels]
    last = [np.arange(len(fp))]  # the last leaf below each node
    for _, _, _, start, n in levels[1:]:
        last.append(last[-1][start + n - 1])
    root = np.searchsorted(levels[-1][2], group)
    size = np.bincount(root)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    asked = np.flatnonzero(size[root] > 1)
    for k in range(0, len(asked), SEARCHES):
        query = asked[k : k + SEARCHES]
        node, so_far = root[query], np.zeros(len(query), np.int64)
        for at in range(len(levels) - 2, -1, -1):
            _, _, _, start, n = levels[at + 1]
            times = n[node]
            up = np.repeat(node, times)
            child = np.repeat(start[node] - np.cumsum(times) + times, times) + np.arange(times.sum())
            query, so_far = np.repeat(query, times), np.repeat(so_far, times)
            ahead = last[at][child] > query  # each pair once
            up, child, query, so_far = up[ahead], child[ahead], query[ahead], so_far[ahead]
            own = masks[at][child] & ~masks[at + 1][up]
            so_far = so_far + np.bitwise_count((fp[query] ^ levels[at][0][child]) & own)
            near = so_far <= LINK
            node, query, so_far = child[near], query[near], so_far[near]
        out.append((query, node))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def spanning(u: np.ndarray, v: np.ndarray) -> list[int]:
    """Places of links that join what those before don't join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return kept


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, pattern, fp) sorted by mask and pattern to links (u, v)."""

    def found(held: list[np.ndarray]) -> pa.RecordBatch:
        mask, pattern, fp = np.concatenate(held, 1)
        group = np.cumsum(np.append(0, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])))
        fp = fp.view(U64)
        order = np.lexsort((gray_rank(fp), group))
        fp, group = fp[order], group[order]
        u, v = close_pairs(fp, group)
        u, v = fp[u].view(np.int64), fp[v].view(np.int64)
        kept = spanning(u, v)
        return pa.record_batch([pa.array(u[kept]), pa.array(v[kept])], ["u", "v"])

    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "pattern", "fp")])
        while rows.shape[1]:
            if sum(x.shape[1] for x in held) + rows.shape[1] < BATCH:
                held.append(rows)
                break
            # up to where a pattern ends
            whole = np.concatenate([*held, rows], 1)
            ends = np.flatnonzero((whole[:2, 1:] != whole[:2, :-1]).any(0)) + 1
            at = ends[ends <= BATCH].max(initial=0) or ends.min(initial=whole.shape[1])
            held, rows = [], whole[:, at:]
            if at == whole.shape[1]:
                held, rows = [whole], rows
                break
            yield found([whole[:, :at]])
    if held:
        yield found(held)


def _shares(free: int, parts: int = LINK + 1) -> list[int]:
    """Masks that share out the bits of ``free``."""
    bits = [k for k in range(64) if free >> k & 1]
    return [sum(1 << b for b in bits[len(bits) * p // parts : len(bits) * (p + 1) // parts]) for p in range(parts)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _links(fps: DataFrame, limit: int) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints within LINK bits."""
    masks = _shares(2**64 - 1)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    out, held = None, []
    while True:
        rows = rows.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        more = [m | s for m in masks for s in _shares(2**64 - 1 - m)] if (2**64 - 1 - masks[0]).bit_count() > 12 else []
        large = stage(rows.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("mask").alias("_m"), F.col("pattern").alias("_p")), "large-patterns")
        held.append(large)
        here = (F.col("mask") == F.col("_m")) & (F.col("pattern") == F.col("_p"))
        factored = bool(more) and not large.isEmpty()
        small = rows.join(large, here, "left_anti") if factored else rows
        small = small.select("mask", "pattern", "fp").repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
        links = stage(map_arrow(small, _search, "u bigint, v bigint"), "simhash-links")
        out = links if out is None else out.unionByName(links)
        held.append(links)
        if not factored:
            drop(*[h for h in held if h is not links and "large" in h._staged_at])
            return out
        deeper = F.lit(None).cast("array<bigint>")
        for m in masks:
            deeper = F.when(F.col("mask") == F.lit(_signed(m)), F.array(*[F.lit(_signed(m | s)) for s in _shares(2**64 - 1 - m)])).otherwise(deeper)
        rows = stage(rows.join(large, here, "left_semi").select("fp", F.explode(deeper).alias("mask")), "factored")
        masks = more


def simhash_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are lower-cased in A-Z and separated by ASCII white space; shingles of three words count as often as they occur,
    a text of fewer words is one shingle. Null, empty and blank texts have fingerprint zero and are linked like any other.
    component_id is the smallest doc_id reachable over fingerprints that differ in two bits at most. Rows that repeat a
    doc_id, or have none, are documents of their own; a component of rows without doc_id has none. An empty table gives no
    rows. ``limit`` is the size of a pattern from which it is factored; it changes the plan only.
    """
    marks = stage(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _fingerprints, "doc_id bigint, fp bigint"), "fingerprints")
    classes = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    links = _links(classes.select("fp"), limit)
    found = connected_components(links)
    labelled = classes.join(found, F.col("fp") == F.col("v"), "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))
    labelled = stage(labelled, "fingerprint-labels")
    drop(found, classes)
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = stage(labelled.join(least, "label").select(F.col("fp").alias("_fp"), "component_id"), "fingerprint-components")
    drop(labelled)
    out = marks.join(by_fp, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
