"""Exact removal of repeated 400-byte strings by a hash-compared suffix sort.

Every 400-byte window has one anchor: its 32-byte gram with the smallest hash (the leftmost of equals). Equal windows have
equal anchors at the same place, so only windows of one anchor's text need to be compared with each other:

1. Each text's anchors are listed; anchors whose gram occurs at one place only are done.
2. For the others the segment of the text that their windows cover goes to the group of the gram. Equal segments are one
   (all their windows are repeated), so a passage in a third of the corpus is compared once; equal segments of one text
   that overlap are one row, so a long run of one character is as short as any other.
3. In a group the segments are sorted by what follows the anchor and by what stands before it: a mergesort whose
   comparisons find the common extension with prefix polynomial hashes and binary search. Runs of neighbours with a common
   extension of v bytes after the anchor, and neighbours among them with l bytes in common before it, share a string of
   l + v bytes; from 400 on it is repeated. Bytes are compared before that counts, and another hash base is taken if a
   collision shows.
4. A group of more than ``GROUP`` different segments, which would strain a task, is split by longer anchors first: its
   windows go by the place of the gram in them into ``CLASSES`` classes, and a class is split by the bytes that all its
   windows have in common. Segments become shorter with each round, so that they fall apart or become equal. Then the
   same sort follows; so results are the same for any ``GROUP``.
5. The covered intervals of a text are merged, and the bytes outside are hashed.

Texts that are equal are one text in all of this; a text that occurs twice is covered whole.

Beside the removal, ``holds_passage`` tells of passages of more than 50 words, whatever their bytes: windows of 51 words
have anchors in the same way, and the hashes of those windows whose anchor occurs more than once are counted.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import bytehash
from quillstream.llm.bytehash import U64
from quillstream.llm.staging import drop, map_arrow, stage

WIDTH, GRAM = 400, 32
#: Different segments of a group sorted in one task, classes that a larger one is split into, and segments worked on at once.
GROUP, CLASSES, BLOCK = 1000, 8, 2000
#: Words of a passage, and of its anchor; windows looked at together.
PASSAGE, WORDS, WORD_PIECE = 51, 16, 1 << 15
#: Window starts of a text looked at together.
PIECE = 1 << 20
_PLACE = 24


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first window start, last window start) of the anchors of a text, in order."""
    n = len(data) - WIDTH + 1
    out = []
    for a in range(0, max(n, 0), PIECE):
        m = min(PIECE, n - a)
        part = data[a : a + m + WIDTH - 1]
        pre = bytehash.prefix(part)
        at = np.arange(len(part) - GRAM + 1)
        h = bytehash.mix(bytehash.slices(pre, at, at + GRAM))
        packed = (h >> U64(_PLACE)) << U64(_PLACE) | at.astype(U64)
        w = WIDTH - GRAM + 1
        pad = np.full(-len(packed) % w, np.iinfo(U64).max, U64)
        grid = np.concatenate([packed, pad]).reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & U64((1 << _PLACE) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [m]]) - 1
        out.append((h[place[first]], place[first] + a, first + a, last + a))
    if not out:
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    return np.lib.stride_tricks.sliding_window_view(values, width).argmin(1) + np.arange(n) if n > 0 else np.zeros(0, np.int64)


def word_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor's words, its place, hash of the window) of each window of PASSAGE words of a text."""
    word = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if len(start) < PASSAGE:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64)
    pre = bytehash.prefix(data)
    h = bytehash.mix(bytehash.slices(pre, start, end) ^ (end - start).astype(U64))
    power = bytehash.powers(len(h))
    sums = np.concatenate([[U64(0)], np.cumsum(h * power[0][: len(h)])])
    of = lambda n: bytehash.mix((sums[n:] - sums[:-n]) * power[1][: len(h) - n + 1])
    gram = of(WORDS)
    least = np.concatenate([_sliding_least(gram[k : k + WORD_PIECE + PASSAGE - WORDS], PASSAGE - WORDS + 1) + k for k in range(0, len(h) - PASSAGE + 1, WORD_PIECE)])
    return gram[least], least, of(PASSAGE)


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer((x.as_py() or "").encode("utf-8", "replace"), np.uint8)


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))


def _list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different grams of each text's anchors, and those that it has at several places; the same of its words."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                found: tuple[list, ...] = ([], [], [], [])
                for data in _bytes(part.column("text")):
                    gram, place, _ = word_anchors(data)
                    for side, grams in enumerate((anchors(data)[0], gram[np.unique(place, return_index=True)[1]])):
                        own, n = np.unique(grams, return_counts=True)
                        found[2 * side].append(own.view(np.int64))
                        found[2 * side + 1].append(own[n > 1].view(np.int64))
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", "h1", "h2", "n_bytes")), *(_list(x, pa.int64()) for x in found)], ["doc_id", "h1", "h2", "n_bytes", "grams", "grams_again", "words", "words_again"])


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of a text's anchors whose gram is one of ``grams``; equal ones that overlap are one, from start to last."""
    names = ["gram", "s1", "s2", "h1", "h2", "start", "last", "back", "segment"]
    with np.errstate(over="ignore"):
        for batch in batches:
            for k in range(len(batch)):
                data = np.frombuffer(batch.column("text")[k].as_py().encode("utf-8", "replace"), np.uint8)
                h, place, first, last = anchors(data)
                own = np.flatnonzero(np.isin(h.view(np.int64), batch.column("grams")[k].values.to_numpy()))
                raw, rows, at = data.tobytes(), [], {}
                for a, b, p, g in zip(first[own].tolist(), last[own].tolist(), place[own].tolist(), h[own].view(np.int64).tolist(), strict=True):
                    part = raw[a : b + WIDTH]
                    key = (g, hashlib.blake2b(part, digest_size=16).digest(), p - a)
                    if (n := at.get(key)) is not None and a - rows[n][1] <= WIDTH:
                        rows[n][1] = a
                    else:
                        at[key] = len(rows)
                        rows.append([a, a, part, key])
                for c in range(0, len(rows), 4096):
                    some = rows[c : c + 4096]
                    keys = np.frombuffer(b"".join(key[1] for *_, key in some), np.int64).reshape(-1, 2)
                    one = lambda c, n=len(some): pa.array([batch.column(c)[k].as_py()] * n, pa.int64())  # noqa: E731, B023
                    yield pa.record_batch([pa.array([x[3][0] for x in some], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), one("h1"), one("h2"), pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[3][2] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.binary())], names)


def _passage_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, window): the hashes of a text's windows of PASSAGE words whose anchor is one of ``words``, each once or twice."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for k in range(len(batch)):
                data = np.frombuffer(batch.column("text")[k].as_py().encode("utf-8", "replace"), np.uint8)
                gram, _, window = word_anchors(data)
                own, n = np.unique(window[np.isin(gram.view(np.int64), batch.column("words")[k].values.to_numpy())], return_counts=True)
                own = np.concatenate([own, own[n > 1]]).view(np.int64)
                for c in range(0, len(own), 1 << 16):
                    part = own[c : c + (1 << 16)]
                    one = lambda c, n=len(part): pa.array(np.full(n, batch.column(c)[k].as_py(), np.int64))  # noqa: E731, B023
                    yield pa.record_batch([one("h1"), one("h2"), pa.array(part)], ["h1", "h2", "window"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of large groups by class: what the windows of a class cover, under the hash of the bytes that all have.

    ``low`` and ``high``: the least and greatest place of the gram in the windows that the segment stands for.
    """
    names = ["gram", "s1", "s2", "new_gram", "t1", "t2", "shift", "low", "high", "back", "segment"]
    for batch in batches:
        out = []
        for g, s1, s2, low, high, back, segment in zip(*(batch.column(c).to_pylist() for c in ("gram", "s1", "s2", "low", "high", "back", "segment")), strict=True):
            width = -(-(high - low + 1) // CLASSES)
            for a in range(low, high + 1, width):
                b = min(high, a + width - 1)
                first, last = max(0, back - b), min(len(segment) - WIDTH, back - a)
                if first <= last:
                    part = segment[first : last + WIDTH]
                    core = segment[back - a : back - b + WIDTH]
                    key = hashlib.blake2b(struct.pack("<qqq", g, a, b) + core, digest_size=8).digest()
                    t = hashlib.blake2b(part, digest_size=16).digest()
                    out.append((g, s1, s2, *struct.unpack("<q", key), *struct.unpack("<qq", t), first, a, b, back - first, part))
            if len(out) >= 4096:
                yield pa.record_batch([pa.array(x, pa.binary() if n == "segment" else pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)], names)
                out = []
        if out:
            yield pa.record_batch([pa.array(x, pa.binary() if n == "segment" else pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)], names)


class Text:
    """Bytes with prefix hashes; extensions that two places have in common are found by binary search."""

    def __init__(self, data: np.ndarray, base: int):
        self.data, self.base = data, base
        self.pre = bytehash.prefix(data, base=base)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension from a and from b, at most ``most``."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (go := low < high).any():
            mid = (low + high + 1) // 2
            same = bytehash.slices(self.pre, a, a + mid, self.base) == bytehash.slices(self.pre, b, b + mid, self.base)
            low, high = np.where(go & same, mid, low), np.where(go & ~same, mid - 1, high)
        return low

    def before(self, a: np.ndarray, left_a: np.ndarray, b: np.ndarray, left_b: np.ndarray) -> np.ndarray:
        """Whether the suffix at a (of left_a bytes) sorts before or equals that at b."""
        most = np.minimum(left_a, left_b)
        n = self.common(a, b, most)
        end = n == most
        last = len(self.data) - 1
        return np.where(end, left_a <= left_b, self.data[np.minimum(a + n, last)] <= self.data[np.minimum(b + n, last)])


def mergesort(text: Text, start: np.ndarray, left: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``start`` (of ``left`` bytes) by group, then bytes; ``group`` ascends. Runs that double
    in length are merged by ranks: an element's place is its own plus its rank in the other run, found by binary search."""
    n = len(start)
    order, width = np.arange(n), 1
    while width < n:
        i = np.arange(n)
        own = i // width * width
        other = np.where(i // width % 2 == 0, own + width, own - width)
        first = i // width % 2 == 0
        low, high = np.minimum(other, n), np.minimum(other + width, n)
        begin = low.copy()
        me = order
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            x, y = me[live], order[mid]
            same = group[x] == group[y]
            y_first = group[y] < group[x]
            k = np.flatnonzero(same)
            if len(k):
                # for the first run equal ones of the other come after, for the second before
                x_before = text.before(start[x[k]], left[x[k]], start[y[k]], left[y[k]])
                y_before = text.before(start[y[k]], left[y[k]], start[x[k]], left[x[k]])
                y_first[k] = np.where(first[live[k]], ~x_before, y_before)
            low[live] = np.where(y_first, mid + 1, low[live])
            high[live] = np.where(y_first, high[live], mid)
            live = live[low[live] < high[live]]
        place = np.minimum(own, np.where(first, own, other)) + (i - own) + (low - begin)
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, width = merged, width * 2
    return order


def repeated(segments: list[bytes], back: np.ndarray, group: np.ndarray, base: int = bytehash.BASE) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end byte) of what is repeated in each segment, within the windows of its anchor; end 0: nothing.

    ``back``: bytes before the anchor; ``group`` ascends; segments of a group differ. Segments of other groups are not
    compared.
    """
    lengths = np.array([len(s) for s in segments], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    data = np.frombuffer(b"".join(segments), np.uint8)
    text, mirror = Text(data, base), Text(data[::-1], base)
    place, ahead = begin + back, lengths - back
    turned = len(data) - place  # the place in the mirrored text where what stands before the anchor begins
    order = mergesort(text, place, ahead, group)
    follow = text.common(place[order[:-1]], place[order[1:]], np.minimum(ahead[order[:-1]], ahead[order[1:]]))
    follow = np.where(group[order[:-1]] == group[order[1:]], follow, 0)
    rank = np.empty(len(order), np.int64)
    rank[mergesort(mirror, turned, back, group)] = np.arange(len(order))
    left, right = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    found = np.zeros(len(order), bool)
    for v in np.unique(follow[follow >= GRAM])[::-1]:
        joined = follow >= v
        run = np.concatenate([[0], np.cumsum(~joined)])
        touched = np.unique(run[1:][follow == v])
        rows = np.flatnonzero(np.isin(run, touched))
        rows = rows[np.lexsort((rank[order[rows]], run[rows]))]
        x, y = order[rows[:-1]], order[rows[1:]]
        near = run[rows[:-1]] == run[rows[1:]]
        x, y = x[near], y[near]
        l = mirror.common(turned[x], turned[y], np.minimum(back[x], back[y]))  # noqa: E741
        hit = l + v >= WIDTH
        x, y, l = x[hit], y[hit], l[hit]  # noqa: E741
        for a, b, n in zip(x.tolist(), y.tolist(), l.tolist(), strict=True):  # the bytes decide
            if data[place[a] - n : place[a] + v].tobytes() != data[place[b] - n : place[b] + v].tobytes():
                return repeated(segments, back, group, base * 6364136223846793005 + 2 & (2**64 - 1) | 1)
        for z in (x, y):
            np.maximum.at(left, z, l)
            np.maximum.at(right, z, v)
            found[z] = True
    return np.where(found, back - left, 0), np.where(found, back + right, 0)


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by gram; groups are gathered to blocks of about BLOCK segments."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        gram = rows.column("gram").to_numpy()
        lo, hi = repeated(rows.column("segment").to_pylist(), rows.column("back").to_numpy().astype(np.int64), np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]])))
        own = np.flatnonzero(hi > 0)
        take = pa.array(own)
        return pa.record_batch([*(rows.column(c).take(take).combine_chunks() for c in ("gram", "s1", "s2")), pa.array(lo[own]), pa.array(hi[own])], ["gram", "s1", "s2", "lo", "hi"])

    held, n = [], 0
    with np.errstate(over="ignore"):
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK:
                rows = pa.Table.from_batches(held).combine_chunks()
                gram = rows.column("gram").to_numpy()
                cut = np.flatnonzero(gram[1:] != gram[:-1])
                cut = int(cut[-1]) + 1 if len(cut) else 0
                if cut:
                    yield done(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), len(rows) - cut
        if n:
            yield done(pa.Table.from_batches(held).combine_chunks())


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the intervals of each text and hash what is left."""
    for batch in batches:
        removed, spans, kept = [], [], []
        for k in range(len(batch)):
            data = (batch.column("text")[k].as_py() or "").encode("utf-8", "replace")
            cuts = sorted((x["lo"], x["hi"]) for x in batch.column("cuts")[k].as_py())
            merged: list[list[int]] = []
            for lo, hi in cuts:
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            at, h = 0, hashlib.sha256()
            for lo, hi in merged:
                h.update(data[at:lo])
                at = hi
            h.update(data[at:])
            removed.append(sum(hi - lo for lo, hi in merged))
            spans.append(len(merged))
            kept.append(h.hexdigest())
        yield pa.record_batch([batch.column("h1"), batch.column("h2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["h1", "h2", "removed", "spans", "kept"])


def _repeated_parts(segments: DataFrame) -> DataFrame:
    """(h1, h2, lo, hi): the repeated intervals of each text, from its segments (gram, s1, s2, h1, h2, start, last, back, segment)."""
    places = segments.select("gram", "s1", "s2", "h1", "h2", "start", "last")
    spot = F.xxhash64("h1", "h2", "start")
    keys = ["gram", "s1", "s2"]
    distinct = segments.groupBy(keys).agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.max(F.col("last") - F.col("start")).alias("apart"), F.min("back").alias("back"), F.min("segment").alias("segment"))
    distinct = distinct.select(*keys, ((F.col("a") != F.col("b")) | (F.col("apart") > 0)).alias("twice"), "back", "segment", F.lit(0).cast("long").alias("low"), F.lit(WIDTH - GRAM).cast("long").alias("high"))
    out = None
    while True:
        distinct = stage(distinct, "segments-distinct")
        sizes = stage(distinct.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "groups")
        large = stage(sizes.where(f"n > {GROUP}").select("gram"), "large-groups")
        small = distinct.join(sizes.where(f"n <= {GROUP}").select("gram"), "gram", "left_semi").select(*keys, "back", "segment").repartition("gram").sortWithinPartitions("gram", "s1", "s2")
        found = map_arrow(small, _sort_groups, "gram bigint, s1 bigint, s2 bigint, lo bigint, hi bigint")
        found = found.union(distinct.where("twice").select(*keys, F.lit(0).cast("long").alias("lo"), F.octet_length("segment").cast("long").alias("hi")))
        found = stage(found, "repeated")
        cuts = stage(places.join(found, keys).select("h1", "h2", (F.col("start") + F.col("lo")).alias("lo"), (F.col("last") + F.col("hi")).alias("hi")), "intervals")
        out = cuts if out is None else out.union(cuts)
        drop(found, sizes)
        if large.isEmpty():
            drop(distinct, large)
            return out
        parts = stage(map_arrow(distinct.join(large, "gram", "left_semi"), _split, "gram bigint, s1 bigint, s2 bigint, new_gram bigint, t1 bigint, t2 bigint, shift bigint, low bigint, high bigint, back bigint, segment binary"), "split-segments")
        moved = parts.select(*keys, "new_gram", "t1", "t2", "shift")
        before = places
        places = stage(places.join(moved, keys).select(F.col("new_gram").alias("gram"), F.col("t1").alias("s1"), F.col("t2").alias("s2"), "h1", "h2", (F.col("start") + F.col("shift")).alias("start"), (F.col("last") + F.col("shift")).alias("last")), "places")
        spots = stage(places.groupBy(keys).agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.max(F.col("last") - F.col("start")).alias("apart")), "spots")
        old = (distinct, large)
        distinct = parts.groupBy(F.col("new_gram").alias("gram"), F.col("t1").alias("s1"), F.col("t2").alias("s2")).agg(*[F.min(c).alias(c) for c in ("low", "high", "back", "segment")])
        distinct = stage(distinct.join(spots, keys).select(*keys, ((F.col("a") != F.col("b")) | (F.col("apart") > 0)).alias("twice"), "back", "segment", "low", "high"), "split-distinct")
        drop(*old, parts, spots, before)


def _wanted(listed: DataFrame, column: str) -> DataFrame:
    """(h1, h2, column): the grams of each text that another text has, or that it has at several places."""
    each = listed.where(F.size(column) > 0).select("h1", "h2", F.explode(column).alias("gram"))
    key = F.xxhash64("h1", "h2")
    twice = each.groupBy("gram").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("gram")
    twice = stage(twice.union(listed.select(F.explode(f"{column}_again").alias("gram"))).distinct(), "grams")
    wanted = stage(each.join(twice, "gram", "left_semi").groupBy("h1", "h2").agg(F.collect_set("gram").alias(column)), "wanted-grams")
    drop(twice)
    return wanted


def _with_passage(texts: DataFrame) -> DataFrame:
    """(h1, h2) of the texts that hold a passage of PASSAGE words that starts at two places, in one text or in several."""
    windows = stage(map_arrow(texts.where("words is not null").select("h1", "h2", "text", "words"), _passage_windows, "h1 bigint, h2 bigint, window bigint"), "passage-windows")
    repeated = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    out = stage(windows.join(repeated, "window", "left_semi").select("h1", "h2").distinct(), "passages")
    drop(windows)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, holds_passage of each row of ``docs`` (doc_id, text).

    ``n_kept``: bytes that are left. ``holds_passage``: whether the text loses bytes or holds a passage of more than 50
    words that also starts elsewhere (in a text with equal words in another place, or a copy). Other columns are ignored.
    Null and empty texts have 0 bytes (kept_sha256 is that of no bytes). Texts shorter than 400 bytes lose nothing. Rows
    that repeat, with the same doc_id or not, are copies of each other. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes"))
    listed = stage(map_arrow(rows, _list_anchors, f"doc_id {dict(docs.dtypes)['doc_id']}, h1 bigint, h2 bigint, n_bytes bigint, grams array<bigint>, grams_again array<bigint>, words array<bigint>, words_again array<bigint>"), "anchors")
    classes = stage(listed.groupBy("h1", "h2", "n_bytes").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")), "texts")
    grams, words = _wanted(listed, "grams"), _wanted(listed, "words")
    wanted = stage(grams.join(words, ["h1", "h2"], "full").join(classes, ["h1", "h2"]).select(F.col("first").alias("_d"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "grams", "words"), "wanted")
    drop(grams, words)
    at = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    texts = stage(rows.join(wanted, at).select("h1", "h2", "text", "grams", "words"), "wanted-texts")
    drop(wanted)
    passages = _with_passage(texts).withColumn("passage", F.lit(True))
    texts_cut = texts.where("grams is not null").select("h1", "h2", "text", "grams")
    segments = stage(map_arrow(texts_cut, _cut_segments, "gram bigint, s1 bigint, s2 bigint, h1 bigint, h2 bigint, start bigint, last bigint, back bigint, segment binary"), "segments")
    cuts = _repeated_parts(segments).groupBy("h1", "h2").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts"))
    kept = texts.select("h1", "h2", "text").join(cuts, ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    kept = stage(map_arrow(kept, _keep, "h1 bigint, h2 bigint, removed bigint, spans bigint, kept string"), "kept")
    drop(texts, segments)
    plain = classes.join(kept, ["h1", "h2"], "left").join(passages, ["h1", "h2"], "left").join(listed.groupBy("h1", "h2").agg(F.max(F.size("words") > 0).alias("long")), ["h1", "h2"])
    plain = stage(plain, "texts-kept")
    drop(listed, classes, kept, passages)

    whole_text = F.expr(f"copies > 1 and n_bytes >= {WIDTH}")
    plain = plain.select(
        "h1", "h2", "n_bytes",
        F.when(whole_text, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole_text, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole_text, F.sha2(F.lit(""), 256)).otherwise(F.col("kept")).alias("kept_sha256"),
        (F.coalesce("passage", F.lit(False)) | (F.expr("copies > 1") & F.col("long"))).alias("passage"),
    )
    own = rows.select("doc_id", "h1", "h2", "n_bytes", F.sha2("text", 256).alias("_own"))
    out = own.join(plain, ["h1", "h2", "n_bytes"]).withColumn("holds_passage", F.col("passage") | (F.col("n_removed") > 0))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce("kept_sha256", "_own").alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "holds_passage")
