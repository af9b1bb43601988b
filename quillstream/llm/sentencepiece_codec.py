"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Texts are cut wherever no piece holds the two characters side by side, as before a space or between a letter and a comma: no
piece goes over such a place, so what lies between two of them, a word, is encoded by itself, and texts have far fewer
different words than runs between spaces. Words of equal length advance together: for each end position the hashes of all
substrings that may end there probe the sorted hashes of the pieces, and the best piece of each word is stored as a
back-pointer. For a unigram model the best is the largest sum of scores. In a BPE model scores are merge ranks whose sum
means nothing; there the last piece of a prefix is the one that merging would have left, which is the only one that is
compatible with the best piece before it (no merge across their boundary comes before their own). Both give the ids of
the reference library; characters outside the vocabulary become byte pieces.

Words are encoded and decoded once per worker and kept in a bounded table. The vocabulary is read on the driver and broadcast; its
size is that of the model file, whatever the corpus.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillstream.llm.bytehash import U64, mix, powers
from quillstream.llm.staging import map_arrow

SPACE = "▁"
#: Longer words are walked one at a time, unless many have one length.
LONG = 48
#: Words kept by a worker, and characters of text worked on at once.
KEPT, CHUNK = 800_000, 1 << 22
#: Characters of a long word whose pieces are looked up at once.
STRETCH = 1 << 16
#: Bits of the table of characters that stand side by side in a piece. Two that share an entry are cut less often, which changes no ids.
SIDE_BITS = 22
NEVER = np.iinfo(np.int64).max


@dataclasses.dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray  # bool: piece may match text
    bytes_: np.ndarray  # id of each byte's piece
    unk: int
    bpe: bool
    keys: np.ndarray = None  # sorted hashes of pieces
    ids: np.ndarray = None  # ids in that order
    lengths: np.ndarray = None
    longest: int = 1
    rank: np.ndarray = None  # time of a piece's merge; -1 for single characters
    left: np.ndarray = None  # its two parts, or -1
    right: np.ndarray = None
    pairs: np.ndarray = None  # sorted left * n + right of pieces that a merge may give
    merged: np.ndarray = None  # the piece of each pair
    beside: np.ndarray = None  # bool at _side(a, b): a piece may hold b behind a
    codec: Codec = None  # of this worker, kept from one task to the next


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of the code points' values along the last axis, with a leading zero."""
    p = powers(codes.shape[-1] + 1)[0][: codes.shape[-1]]
    out = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), U64)
    np.cumsum(mix(codes.astype(U64) + U64(1)) * p, axis=-1, out=out[..., 1:])
    return out


def _side(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(2654435761) + b) & np.uint32((1 << SIDE_BITS) - 1)


def _merge_tree(v: Vocabulary, table: dict[str, int]) -> None:
    """rank, left, right, pairs: how merging builds each piece."""
    n = len(v.pieces)
    order = np.argsort(-v.scores, kind="stable")
    time = np.empty(n, np.int64)
    time[order] = np.arange(n)
    v.rank, v.left, v.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    pairs = {}
    for s, i in table.items():
        if len(s) > 1:
            v.rank[i] = time[i]
            for k in range(1, len(s)):
                a, b = table.get(s[:k]), table.get(s[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
    for s, i in table.items():
        parts = list(s)
        while len(parts) > 2:
            best = min(((time[t], k) for k in range(len(parts) - 1) if (t := table.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2 and parts[0] in table and parts[1] in table:
            v.left[i], v.right[i] = table[parts[0]], table[parts[1]]
    v.pairs = np.array(sorted(pairs), np.int64)
    v.merged = np.array([pairs[k] for k in v.pairs.tolist()], np.int64)


def load(path: str, bpe: bool = True) -> Vocabulary:
    """The vocabulary of a SentencePiece model file; ``bpe`` says which kind of model it is."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte = np.full(256, sp.unk_id(), np.int64)
    normal = np.ones(n, bool)
    for i in range(n):
        if sp.is_byte(i):
            byte[int(pieces[i][1:-1], 16)] = i
        if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            normal[i] = False
    v = Vocabulary(pieces, np.array([sp.get_score(i) for i in range(n)]), normal, byte, sp.unk_id(), bpe)
    table = {p: i for i, p in enumerate(pieces) if normal[i]}
    v.lengths = np.array([len(p) for p in pieces], np.int64)
    v.longest = max(map(len, table))
    hashes = np.array([_hash(np.array([ord(c) for c in p], np.uint32))[-1] for p in table], U64)
    order = np.argsort(hashes)
    v.keys, v.ids = hashes[order], np.array(list(table.values()), np.int64)[order]
    v.beside = np.zeros(1 << SIDE_BITS, bool)
    sides = np.array(sorted({(ord(a), ord(b)) for p in table for a, b in zip(p, p[1:], strict=False)}), np.uint32).reshape(-1, 2)
    v.beside[_side(sides[:, 0], sides[:, 1])] = True
    if bpe:
        _merge_tree(v, table)
    return v


def _compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging a's and b's text leaves exactly a, b. Ids of n and over are characters outside the vocabulary."""
    n = len(v.pieces)
    good = np.ones(len(a), bool)
    row = np.flatnonzero((a < n) & (b < n))
    a, b = a[row], b[row]
    ends_a, ends_b = np.full(len(row), NEVER), np.full(len(row), NEVER)  # when a and b are merged into what they are part of
    while len(row):
        at = np.minimum(np.searchsorted(v.pairs, key := a * n + b), len(v.pairs) - 1)
        time = np.where(v.pairs[at] == key, v.rank[v.merged[at]], NEVER)
        bad = (time < ends_a) & (time <= ends_b) & (time < NEVER)
        good[row[bad]] = False
        # back in time: the later made of the two is taken apart
        step_b = v.rank[b] >= v.rank[a]
        ends_b, ends_a = np.where(step_b, v.rank[b], ends_b), np.where(step_b, ends_a, v.rank[a])
        b, a = np.where(step_b, v.left[b], b), np.where(step_b, a, v.right[a])
        go = ~bad & (a >= 0) & (b >= 0)
        row, a, b, ends_a, ends_b = row[go], a[go], b[go], ends_a[go], ends_b[go]
    return good


def viterbi(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last piece, its start) of the best split of each prefix of each row; rows are words of one length."""
    rows, length = codes.shape
    n = len(v.pieces)
    pre = _hash(codes)
    inverse = powers(length + 1)[1]
    last, start = np.full((rows, length + 1), -1, np.int64), np.zeros((rows, length + 1), np.int64)
    total = np.full((rows, length + 1), -np.inf)
    total[:, 0] = 0
    floor = v.scores[v.normal].min() - 10
    for j in range(1, length + 1):
        todo = np.arange(rows)
        for i in range(max(0, j - v.longest), j):
            if not len(todo):
                break
            h = (pre[todo, j] - pre[todo, i]) * inverse[i]
            at = np.minimum(np.searchsorted(v.keys, h), len(v.keys) - 1)
            piece = np.where((v.keys[at] == h) & (v.lengths[v.ids[at]] == j - i), v.ids[at], -1)
            if j - i == 1:
                piece = np.where(piece < 0, n + codes[todo, i].astype(np.int64), piece)
            hit = np.flatnonzero(piece >= 0)
            r, piece = todo[hit], piece[hit]
            if v.bpe:
                if i:
                    ok = _compatible(v, last[r, i], piece)
                    r, piece, hit = r[ok], piece[ok], hit[ok]
                todo = np.delete(todo, hit)
            else:
                value = total[r, i] + np.where(piece < n, v.scores[np.minimum(piece, n - 1)], floor)
                ok = value > total[r, j]
                r, piece = r[ok], piece[ok]
                total[r, j] = value[ok]
            last[r, j], start[r, j] = piece, i
    return last, start


def _back(last: np.ndarray, start: np.ndarray, out: np.ndarray, v: Vocabulary) -> list[np.ndarray]:
    """Follow the back-pointers of all rows together."""
    rows = len(last)
    at, k = np.full(rows, last.shape[1] - 1), 0
    while (live := np.flatnonzero(at > 0)).size:
        out[live, k] = last[live, at[live]]
        at[live] = start[live, at[live]]
        k += 1
    foreign = (out >= len(v.pieces)).any(1).tolist()
    result = []
    for r, m, f in zip(out.astype(np.int32), (out >= 0).sum(1).tolist(), foreign, strict=True):
        ids = r[:m][::-1]
        result.append(_with_bytes(ids, v).astype(np.int32) if f else ids)
    return result


def _with_bytes(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Characters outside the vocabulary as the ids of their bytes."""
    n = len(v.pieces)
    if (ids >= n).any():
        return np.array([y for x in ids.tolist() for y in ([x] if x < n else v.bytes_[list(chr(x - n).encode("utf-8", "replace"))].tolist())], np.int64)
    return ids


def _spans(v: Vocabulary, pre: np.ndarray, first: int, past: int) -> tuple[list[int], list[int], list[int]]:
    """Pieces that end at a place from ``first`` to before ``past`` of one word with the prefix hashes ``pre``: how many end at each
    place, and their starts and ids, the longest first. One probe of the keys for each length of a piece."""
    inverse = powers(len(pre))[1]
    ends, starts, ids = [], [], []
    for d in range(min(v.longest, past - 1), 0, -1):
        j = np.arange(max(first, d), past)
        h = (pre[j] - pre[j - d]) * inverse[j - d]
        at = np.minimum(np.searchsorted(v.keys, h), len(v.keys) - 1)
        hit = (v.keys[at] == h) & (v.lengths[v.ids[at]] == d)
        ends.append(j[hit])
        starts.append(j[hit] - d)
        ids.append(v.ids[at[hit]])
    e = np.concatenate(ends)
    order = np.argsort(e, kind="stable")
    return np.bincount(e - first, minlength=past - first).tolist(), np.concatenate(starts)[order].tolist(), np.concatenate(ids)[order].tolist()


class _Scalar:
    """The tests of ``viterbi`` for one pair of pieces at a time."""

    def __init__(self, v: Vocabulary):
        self.n = len(v.pieces)
        if v.bpe:
            self.time = dict(zip(v.pairs.tolist(), v.rank[v.merged].tolist(), strict=True))
            self.rank, self.left, self.right = v.rank.tolist(), v.left.tolist(), v.right.tolist()
            self.known: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """As ``_compatible``; pairs are kept, as a long word has few different ones."""
        n = self.n
        if a >= n or b >= n:
            return True
        key = a * n + b
        good = self.known.get(key)
        if good is None:
            good, ends_a, ends_b = True, NEVER, NEVER
            while a >= 0 and b >= 0:
                time = self.time.get(a * n + b, NEVER)
                if time < ends_a and time <= ends_b and time < NEVER:
                    good = False
                    break
                if self.rank[b] >= self.rank[a]:
                    ends_b, b = self.rank[b], self.left[b]
                else:
                    ends_a, a = self.rank[a], self.right[a]
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[key] = good
        return good


def long_word(v: Vocabulary, codes: np.ndarray, scalar: _Scalar) -> np.ndarray:
    """ids of one long word: the pieces of each stretch of it are looked up at once, and one walk over its characters follows."""
    length, n = len(codes), len(v.pieces)
    pre = _hash(codes[None])[0]
    last, start = [-1] * (length + 1), [0] * (length + 1)
    total = [0.0] + [-np.inf] * length
    scores, floor = v.scores.tolist(), float(v.scores[v.normal].min() - 10)
    for first in range(1, length + 1, STRETCH):
        past = min(first + STRETCH, length + 1)
        counts, starts, ids = _spans(v, pre, first, past)
        own, k = codes[first - 1 : past - 1].tolist(), 0
        for j, count in zip(range(first, past), counts, strict=True):
            found = list(zip(starts[k : k + count], ids[k : k + count], strict=True))
            k += count
            if not found or found[-1][0] != j - 1:
                found.append((j - 1, n + own[j - first]))  # a character outside the vocabulary
            if v.bpe:
                for i, piece in found:
                    if not i or scalar.compatible(last[i], piece):
                        last[j], start[j] = piece, i
                        break
            else:
                for i, piece in found:
                    value = total[i] + (scores[piece] if piece < n else floor)
                    if value > total[j]:
                        total[j], last[j], start[j] = value, piece, i
    out, j = [], length
    while j > 0:
        out.append(last[j])
        j = start[j]
    ids_ = np.array(out[::-1], np.int64)
    return _with_bytes(ids_, v).astype(np.int32)


def encode_words(v: Vocabulary, words: list[str], scalar: _Scalar | None = None) -> list[np.ndarray]:
    """ids of each word; equal-length words advance together, those over LONG one at a time where they are few."""
    out: list = [None] * len(words)
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        group = np.flatnonzero(lengths == length)
        # a step of the batch is a probe for each length of a piece; a walk probes once for each, and then takes each character
        if length > LONG and len(group) * (v.longest + length / 5) < length * v.longest:
            scalar = scalar or _Scalar(v)
            for k in group:
                out[k] = long_word(v, np.frombuffer(words[k].encode("utf-32-le", "surrogatepass"), np.uint32), scalar)
            continue
        for part in np.array_split(group, max(1, len(group) * int(length) // 200_000)):
            codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
            last, start = viterbi(v, codes)
            for k, ids in zip(part, _back(last, start, np.full((len(part), length + 1), -1, np.int64), v), strict=True):
                out[k] = ids
    return out


class Codec:
    """Encodes and decodes texts; keeps the ids of words that it has seen, up to KEPT of them."""

    def __init__(self, v: Vocabulary):
        self.v, self.scalar = v, _Scalar(v)
        byte = {int(i): bytes([b]) for b, i in enumerate(v.bytes_) if i != v.unk}
        self.text = [byte.get(i, b"" if not v.normal[i] else p.replace(SPACE, " ").encode()) for i, p in enumerate(v.pieces)]
        self._forget()

    def _forget(self) -> None:
        self.kept: dict[bytes, int] = {}  # a word's code points: its place in sizes, starts and back
        self.ids, self.sizes, self.starts, self.back = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, words: list[bytes]) -> None:
        """Encodes and decodes words that aren't kept yet."""
        new = [w for w in words if w not in self.kept]
        if self.kept and len(self.kept) + len(new) > KEPT:
            self._forget()
            new = words
        if not new:
            return
        texts = [w.decode("utf-32-le", "surrogatepass") for w in new]
        ids, text = encode_words(self.v, texts, self.scalar), self.text
        back = [b"".join([text[i] for i in x.tolist()]) == t.replace(SPACE, " ").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
        sizes = np.array([len(x) for x in ids], np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes, self.back = np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, sizes]), np.concatenate([self.back, np.array(back, bool)])
        self.kept |= zip(new, range(len(self.kept), len(self.kept) + len(new)), strict=True)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin and the last one's end, whether the words of a text all give
        themselves back)."""
        codes = "".join([SPACE + t for t in texts if t]).replace(" ", SPACE).encode("utf-32-le", "surrogatepass")
        first = np.cumsum([0, *[len(t) + 1 if t else 0 for t in texts]])
        if not first[-1]:
            return np.zeros(0, np.int32), first, np.ones(len(texts), bool)
        c = np.frombuffer(codes, np.uint32)
        cut = np.ones(len(c) + 1, bool)
        cut[1:-1] = ~self.v.beside[_side(c[:-1], c[1:])]
        cut[first] = True
        at = np.flatnonzero(cut)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(codes)]).dictionary_encode()
        own = words.dictionary.to_pylist()
        self._learn(own)
        kept = self.kept
        slot = np.array([kept[w] for w in own], np.int64)[words.indices.to_numpy()]
        sizes = self.sizes[slot]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[slot] - (ends - sizes), sizes) + np.arange(ends[-1])]
        word = np.searchsorted(at, first)  # each text's first word
        astray = np.append(0, np.cumsum(~self.back[slot]))[word]
        return flat, np.append(0, ends)[word], astray[1:] == astray[:-1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, at, _ = self.encode_flat(texts)
        return np.split(flat, at[1:-1]) if texts else []

    def decode(self, ids: list[int]) -> str:
        text = self.text
        out = b"".join([text[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of CHUNK characters together, a longer one by itself."""
    first = size = 0
    for k, n in enumerate(sizes):
        if k > first and size + n > CHUNK:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def tokens(docs: DataFrame, model: str, bpe: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens, token_ids and round_trip (decoding gives the text back) of each row.

    ``docs``: text and ``keep``; other columns are ignored. Null and empty texts have no tokens and count as given back.
    A text that holds the space mark U+2581 itself isn't given back. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(model, bpe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            v = shared.value
            codec = v.codec = v.codec or Codec(v)
            for batch in batches:
                column = batch.column("text")
                for a, b in _chunks(pc.fill_null(pc.utf8_length(column), 0).to_pylist()):
                    # a chunk at a time, so that a batch's texts aren't all held twice
                    texts = [t or "" for t in column[a:b].to_pylist()]
                    flat, at, back = codec.encode_flat(texts)
                    # a text of words that give themselves back is given back, unless it has space marks of its own
                    same = [bool(k) and SPACE not in t or codec.decode(flat[at[i] : at[i + 1]].tolist()) == t for i, (k, t) in enumerate(zip(back, texts, strict=True))]
                    yield pa.record_batch([*(batch.column(c)[a:b] for c in keep), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat)), pa.array(same)], [*keep, "n_tokens", "token_ids", "round_trip"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return map_arrow(docs.select(*keep, "text"), run, f"{kinds}, n_tokens bigint, token_ids array<int>, round_trip boolean")
