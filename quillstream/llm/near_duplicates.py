"""Near duplicates by MinHash with odd sketches.

One pass over the texts makes each document's set of 4-word shingles, 160 MinHash samples, 32 band keys of five samples
and an odd sketch: the samples folded into a bitmap in which a bit holds the parity of the samples that hit it. The
number of differing bits of two sketches estimates high similarities precisely (Mitzenmacher, Pagh and Pham 2014), so
few banded candidates reach the exact check, which compares whole shingle sets.

Documents with equal sets are one class, and only the classes' smallest documents are banded. Within a bucket of a band
all are first compared with one pivot, which closes most buckets: their members are in one component. In the open ones
PIVOTS more are taken, and a member is compared with the one of each other component whose sketch is nearest. In the
buckets that are still open, each member set once, every two members of different components are compared, sketches first, in blocks of
documents within tasks; a task gives back links between components only, so no pair of a large group becomes a row, and
no link that a bucket holds is lost. A pair at the threshold shares no bucket with probability (1 - 0.8**5)**32 < 4e-6,
and its sketch fails the filter with about 1e-6 (tests/llm measures the whole miss rate).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import bytehash
from quillstream.llm.bytehash import U64
from quillstream.llm.components import connected_components, with_links
from quillstream.llm.staging import drop, map_arrow, row_ids, sized, stage
from quillstream.llm.texts import pieces

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 32, 5
SKETCH_BITS = 512
#: Sketch estimates below the threshold by this much are dropped: over five standard deviations of 160 samples.
SLACK = 0.2
#: Documents and shingles of a block at most (a longer document is a block of its own); two blocks are compared in a task's memory.
BLOCK, BLOCK_SHINGLES = 4096, 4 << 20
#: Pairs of a pivot that are joined with it in one task; those of a hot pivot are dealt over more.
HOT = 1024
#: Further pivots of a bucket whose members are not all linked to the first.
PIVOTS = 8

#: Differing bits of two sketches at the threshold less the slack: 2k(1 - J) odd samples spread over n bits.
MOST_BITS = int(SKETCH_BITS / 2 * (1 - np.exp(-4 * BANDS * ROWS * (1 - PERCENT / 100 + SLACK) / SKETCH_BITS)))

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.int64).astype(U64)
_MUL = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; A-Z count as a-z."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, word
    here = np.append(word, False)
    start = np.flatnonzero(here & (~before | edge))
    end = np.flatnonzero(before & (~here | edge))
    pre = bytehash.prefix(low)
    h = bytehash.mix(bytehash.slices(pre, start, end) ^ (end - start).astype(U64))
    at = np.searchsorted(start, offsets)
    out = []
    roll = h * U64(0xD6E8FEB86659FD93)
    for j in range(1, size):
        n = max(0, len(h) - j)
        roll = bytehash.mix(roll[:n]) * U64(0xD6E8FEB86659FD93) + h[j : j + n]
    roll = bytehash.mix(roll)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(roll[a : b - size + 1]))
        elif b > a:
            x = U64(b - a)
            for y in h[a:b]:
                x = bytehash.mix(x * U64(31) + y)
            out.append(np.array([x], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each of the hash functions."""
    out = np.full(len(_XOR), np.iinfo(U64).max, U64)
    for k in range(0, len(s), 4096):
        np.minimum(out, ((s[k : k + 4096, None] ^ _XOR) * _MUL).min(0), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    bit = bytehash.mix(samples + np.arange(len(samples), dtype=U64)) % U64(SKETCH_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=U64)
    for r in range(ROWS):
        key = bytehash.mix(key * U64(0x9FB21C651E98DF25) + samples[r::ROWS])
    return key.view(np.int64)


def _set_hashes(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(np.add.reduce(bytehash.mix(x)).view(np.int64)) for x in (s + U64(1), s ^ U64(0x5851F42D4C957F2D)))


def _signatures(size: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, data, offsets in pieces(batch.column("text")):
                    sets = shingle_sets(data, offsets, size)
                    out = []
                    for s in sets:
                        if len(s):
                            m = minhash(s)
                            out.append((*_set_hashes(s), band_keys(m).tolist(), odd_sketch(m).tolist()))
                        else:
                            out.append((None, None, [], []))
                    h1, h2, bands, sketch = zip(*out, strict=True)
                    yield pa.record_batch([batch.column("doc_id")[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])

    return rows


def _sets(size: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, data, offsets in pieces(batch.column("text")):
                    sets = shingle_sets(data, offsets, size)
                    flat = pa.array(np.concatenate(sets).view(np.int64), pa.int64())
                    at = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.int32())
                    yield pa.record_batch([batch.column("doc_id")[a:b], pa.ListArray.from_arrays(at, flat)], ["doc_id", "shingles"])

    return rows


def _with_pivot(pairs: DataFrame, values: DataFrame, names: dict[str, str]) -> DataFrame:
    """``pairs`` (u, v) with the columns of ``values`` (doc_id, ...) for u, renamed; a hot pivot's pairs are dealt over several tasks."""
    count = stage(pairs.groupBy("u").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts")), "pivots")
    hot = count.where("salts > 1").select(F.col("u").alias("_u"), F.col("salts").alias("_salts"))  # few by what they are
    dealt = pairs.join(hot, F.col("u") == F.col("_u"), "left").withColumn("_salt", F.pmod(F.xxhash64("v"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_u", "_salts")
    pivots = values.join(count, F.col("doc_id") == F.col("u")).select("u", *[F.col(c).alias(n) for c, n in names.items()], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"))
    return dealt.join(pivots, ["u", "_salt"]).drop("_salt")


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v, bits) whose odd sketches and set sizes allow the threshold; bits: by how many the sketches differ."""
    bits = sum((F.bit_count(F.expr(f"su[{i}] ^ sv[{i}]")) for i in range(SKETCH_BITS // 64)), F.lit(0))
    fits = F.expr(f"100 * least(nu, nv) >= {PERCENT} * greatest(nu, nv)")
    both = _with_pivot(pairs, classes, {"sketch": "su", "n_shingles": "nu"})
    both = both.join(classes.select(F.col("doc_id").alias("v"), F.col("sketch").alias("sv"), F.col("n_shingles").alias("nv")), "v")
    return both.where(fits).withColumn("bits", bits).where(F.col("bits") <= MOST_BITS).select("u", "v", "bits")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    now = members.join(labels, F.col("doc_id") == F.col("v"), "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    return stage(now, "labelled-members")


def _pivot_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links of members of open buckets to the bucket's PIVOTS further pivots, the nearest of each component."""
    now = _labelled(members, labels)
    seeds = [F.min(F.struct(F.xxhash64(F.lit(k), "doc_id").alias("h"), F.col("doc_id").alias("u"), F.col("label").alias("of"))).alias(f"p{k}") for k in range(PIVOTS)]
    open_ = now.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), *seeds).where("a <> b")
    pivots = open_.select("band", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("p")).select("band", "p.u", "p.of")
    pairs = now.join(pivots, "band").where("label <> of").select("u", F.col("doc_id").alias("v"), "of").distinct()
    pairs = stage(pairs, "more-pivot-pairs")
    close = _close(pairs.select("u", "v"), classes).join(pairs, ["u", "v"])
    close = stage(close.groupBy("v", "of").agg(F.min_by("u", F.struct("bits", "u")).alias("u")).select("u", "v"), "nearest-pivots")
    links = _confirmed(close, sets)
    drop(now, pairs, close)
    return links


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets reach the threshold."""
    both = _with_pivot(pairs, sets, {"shingles": "a"}).join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")
    both = both.select("u", "v", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("common"))
    return stage(both.where(f"100 * common >= {PERCENT} * (na + nb - common)").select("u", "v"), "confirmed")


def _links_between(doc: np.ndarray, label: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links that join different labels, as few as join the same ones; side 0 is compared with side 1, side 2 with itself."""
    size = np.array([len(s) for s in sets])
    one, two = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side < 2).any() else (np.arange(len(doc)),) * 2
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    out = []
    for k in range(0, len(one), 128):
        a = one[k : k + 128]
        bits = np.bitwise_count(sketch[a][:, None, :] ^ sketch[two][None, :, :]).sum(2, dtype=np.int64)
        low, high = np.minimum(size[a][:, None], size[two]), np.maximum(size[a][:, None], size[two])
        ok = (bits <= MOST_BITS) & (100 * low >= PERCENT * high) & (label[a][:, None] != label[two])
        if one is two:
            ok &= a[:, None] < two
        rows, columns = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        if not len(rows):
            continue
        a, b, ok = a[rows], two[columns], ok[np.ix_(rows, columns)]
        common = np.zeros(ok.shape, np.int64)
        flat, owner = np.concatenate([sets[x] for x in a]), np.repeat(np.arange(len(a)), size[a])
        words, at = np.unique(flat, return_inverse=True)
        for v in range(0, len(words), 16384):  # shingles of the rows, some at a time
            m = np.zeros((len(a), min(16384, len(words) - v)), np.float32)
            own = (at >= v) & (at < v + 16384)
            m[owner[own], at[own] - v] = 1
            for c in range(0, len(b), 256):
                part = np.zeros((min(256, len(b) - c), m.shape[1]), np.float32)
                for r, x in enumerate(b[c : c + 256]):
                    f = np.minimum(np.searchsorted(words, sets[x]), len(words) - 1)
                    f = f[(words[f] == sets[x]) & (f >= v) & (f < v + 16384)]
                    part[r, f - v] = 1
                common[:, c : c + 256] += np.rint(m @ part.T).astype(np.int64)
        both = size[a][:, None] + size[b]
        for i, j in zip(*np.nonzero(ok & (100 * common >= PERCENT * (both - common))), strict=True):
            x, y = root(int(label[a[i]])), root(int(label[b[j]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(doc[a[i]]), int(doc[b[j]])))
    return out


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by comparison (key, i, j)."""

    def done(rows: pa.Table) -> list[tuple[int, int]]:
        sets = [np.asarray(x.values.to_numpy()) for x in rows.column("shingles").combine_chunks()]
        sketch = np.array(rows.column("sketch").to_pylist(), np.int64).view(U64)  # bitwise_count takes absolute values of signed ones
        return _links_between(rows.column("doc_id").to_numpy(), rows.column("label").to_numpy(), sketch, sets, rows.column("side").to_numpy())

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        found = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and tuple(keys[a]) != now:
                found += done(pa.Table.from_batches(held))
                held = []
            now = tuple(keys[a])
            held.append(batch.slice(a, b - a))
        if found:
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])
    if held and (found := done(pa.Table.from_batches(held))):
        yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])


def _open_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Confirmed links between different components of ``labels``, from the buckets that hold more than one."""
    now = _labelled(members, labels)
    # buckets of the same members, in different bands, are one
    same = [F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64(F.lit(7), "doc_id").cast("decimal(38,0)")).alias("y"), F.count("*").alias("n")]
    open_ = now.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), *same).where("a <> b")
    open_ = stage(open_.groupBy("x", "y", "n").agg(F.min("band").alias("key")).select("key"), "open-buckets")
    rows = now.join(open_, F.col("band") == F.col("key"), "left_semi").select(F.col("band").alias("key"), "doc_id", "label")
    rows = stage(rows.join(classes.select("doc_id", "n_shingles", "sketch"), "doc_id"), "compared")
    drop(now, open_)
    if rows.isEmpty():
        drop(rows)
        return None
    parts = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    rows = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    rows = rows.join(sets, "doc_id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), side.alias("side"), "doc_id", "label", "sketch", "shingles")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return stage(map_arrow(rows, _compare_blocks, "u bigint, v bigint"), "open-links")


def _components(links: DataFrame) -> DataFrame:
    found = connected_components(links)
    labels = stage(found, "components")
    drop(found)
    return labels


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for each row of ``docs``; ``size`` is the words of a shingle.

    ``docs``: doc_id, text; other columns are ignored. Null and wordless texts have no shingles and are alone. Rows that
    repeat a doc_id, or have none, are each a document of their own that comes after all others: of equal rows one is
    kept. Where the smallest of a component or class is such a row, component_id or class_id is that row's doc_id, so
    null for rows without one. ``class_id`` is the smallest document with an equal shingle set. An empty table gives no
    rows.
    """
    docs, row, names = row_ids(docs.select("doc_id", "text"))
    docs = docs.select(F.col(row).alias("doc_id"), "text")
    marks = stage(map_arrow(docs, _signatures(size), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, sketch array<bigint>"), "signatures")
    small = stage(marks.select("doc_id", "n_shingles", "h1", "h2"), "sets")
    groups = stage(small.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("class_id")), "classes")
    classes = stage(marks.join(groups.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi"), "class-signatures")
    drop(marks)

    members = classes.select("doc_id", F.explode("bands").alias("band"))
    full = stage(members.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("pivot")).where("n > 1"), "buckets")
    members = stage(members.join(full.select("band", "pivot"), "band"), "members")
    # whole sets, made again, once and only of the documents that share a bucket
    ids = stage(members.select(F.col("doc_id").alias("_id")).distinct(), "sharing")
    sets = stage(map_arrow(docs.join(sized(ids), F.col("doc_id") == F.col("_id"), "left_semi"), _sets(size), "doc_id bigint, shingles array<bigint>"), "shingle-sets")
    drop(ids)
    pairs = stage(members.where("doc_id <> pivot").select(F.col("pivot").alias("u"), F.col("doc_id").alias("v")).distinct(), "pivot-pairs")
    close = stage(_close(pairs, classes).select("u", "v"), "pairs")
    links = _confirmed(close, sets)
    drop(full, pairs, close)
    labels = _components(links)
    old, labels = labels, with_links(labels, _pivot_links(members.select("band", "doc_id"), labels, classes, sets))
    drop(old)
    more = _open_links(members.select("band", "doc_id"), labels, classes, sets)
    drop(members, classes, sets)
    if more is not None and not more.isEmpty():
        old, labels = labels, with_links(labels, more)
        drop(old)
    by_class = groups.join(labels, F.col("class_id") == F.col("v"), "left").select("n_shingles", "h1", "h2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    by_class = stage(by_class, "class-components")
    drop(groups, labels)
    out = small.join(by_class, ["n_shingles", "h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if names is not None:
        for c in ("doc_id", "component_id", "class_id"):
            out = out.join(names.select(F.col("row").alias("_row"), F.col("doc_id").alias("_was")), F.col(c) == F.col("_row"), "left")
            out = out.withColumn(c, F.when(F.col("_row").isNull(), F.col(c)).otherwise(F.col("_was").cast("long"))).drop("_row", "_was")
    return out.select("doc_id", "n_shingles", "component_id", "kept", "class_id")
