"""The prefix trie, SimHash near duplicates and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quillstream.llm import dual_tree, prefix_trie, queries, simhash

DATA = "/root/testdata/sf0.001"


def turns_of(rows):
    """Brute force: role and text of each conversation, in order."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in own.items()}


def trie_by_force(rows, fork=True):
    own = turns_of(rows)
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]) if fork else tuple(t)
    nodes = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    children, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int)
    for seq, members in nodes.items():
        if seq:
            children[seq[:-1]].add(seq)
    for seq, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not children[seq]
            saved[seq[:d]] += (len(members) - 1) * words
    out = []
    for seq, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(built[c]) == len(seq))
        out.append((members[0], len(seq), nodes[seq[:-1]][0] if seq else None, len(members), len(children[seq]), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def some_conversations():
    """Shared beginnings, null turns, roles and texts, ties, repeated rows, negative ids, an absent base, a long conversation."""
    rnd = random.Random(5)
    rows = []
    for c in [*range(-45, 90), 1000, 1001, 5003]:
        if c == 60:
            continue
        for t in range(rnd.randint(1, 6)):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b c", "é x \t y", "", None])))
    rows += [(7, 2, "user", "again")] * 3 + [(None, 1, "user", "lost")] + [(77, t, "user", f"{t % 3}") for t in range(300)] + [(78, t, "user", f"{t % 3}") for t in range(200)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_trie_by_force_even_where_hashes_collide(spark, bits):
    rows = some_conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(7)
    got = prefix_trie.prefix_trie(prefix_trie.forked(prefix_trie.numbered_turns(df)), bits)
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_force(rows)


def test_trie_of_conversations_as_they_are(spark):
    rows = some_conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(3)
    got = prefix_trie.prefix_trie(prefix_trie.unforked(prefix_trie.numbered_turns(df)))
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_force(rows, fork=False)


def test_trie_one_conversation_over_all_partitions_and_many_equal_ones(spark):
    """A conversation of all rows but few, and 9000 that end at one node (more than a piece of ids)."""
    rows = [(3, t, "user", str(t % 2)) for t in range(3000)] + [(20 * c, 0, "user", "hi") for c in range(1, 9001)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_trie(prefix_trie.unforked(prefix_trie.numbered_turns(spark.createDataFrame(rows, CONVERSATIONS)))).collect()}
    assert got[3, 3000].n_leaves == 1 and got[3, 0].n_convs == 9001 and got[3, 0].n_leaves == 2 and len(got) == 3002
    assert got[20, 1].saved_tokens == 8999 and got[20, 1].ends_sha256 == hashlib.sha256(",".join(str(20 * c) for c in range(1, 9001)).encode()).hexdigest()


def test_trie_empty_and_clashing(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.prefix_trie(prefix_trie.forked(prefix_trie.numbered_turns(empty))).count() == 0
    # conversation 21 takes its only turn from 20, which is absent: turnless, at the root
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(21, 40)}
    c = next(c for c, x in h.items() if x)
    df = spark.createDataFrame([(c, 0, "user", "x", 1, 2, 3)], CONVERSATIONS + ", n long, _part int, depth long")
    got = prefix_trie.prefix_trie(prefix_trie.forked(prefix_trie.numbered_turns(df))).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [(c, 0, None, 1, 0, 1, 0)]


def test_op11_on_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_prefix_trie(spark, DATA)
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_force(rows)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_by_force(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 2 and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted([(d, f"{fp[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows)], key=str)


def test_simhash_by_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(3, 60))) for _ in range(40)]
    rows = [(i, t if i % 3 else t + " Ä end") for i, t in enumerate(base)] + [(100 + i, t.upper() if i % 2 else t + " x") for i, t in enumerate(base)]
    rows += [(7, "seven again"), (None, "no id"), (None, "no id"), (None, base[0]), (300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "ONE  \x0b"), (305, "one two"), (306, "a b \x85 c d"), (307, "w " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as _fp", "3 as first", "4 as mask")
    got = sorted(map(tuple, simhash.simhash_duplicates(df).collect()), key=str)
    assert got == simhash_by_force(rows)
    assert simhash.simhash_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("limit", [4096, 40, 5])
def test_links_join_what_brute_force_joins(spark, limit):
    """Dense balls of fingerprints and a chain, whatever the size from which patterns are factored."""
    rnd = random.Random(11)
    centers = [rnd.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    fps = {c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for c in centers for _ in range(60)} | {rnd.getrandbits(64) for _ in range(100)}
    x = centers[0]
    for k in range(0, 60, 2):
        x ^= 3 << k
        fps.add(x)
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2 and root(a) != root(b):
            parent[root(b)] = root(a)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = [(u % 2**64, v % 2**64) for u, v in simhash._links(df, limit).collect()]
    assert all((u ^ v).bit_count() <= 2 for u, v in links)
    found = {f: f for f in fps}

    def top(f):
        while found[f] != f:
            f = found[f]
        return f

    for u, v in links:
        if top(u) != top(v):
            found[top(v)] = top(u)
    groups = lambda of: sorted(sorted(g) for g in (lambda d: [d[of(f)].append(f) for f in fps] and d.values())(defaultdict(list)))
    assert groups(top) == groups(root)


def test_close_pairs_are_all_pairs():
    rng = np.random.default_rng(2)
    fp = np.unique(np.concatenate([np.uint64(c) ^ np.array([(1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))], np.uint64) for c in (0, 2**63 + 12345, 99)]))
    for groups in (1, 5):
        group = np.sort(rng.integers(0, groups, len(fp)))
        order = np.lexsort((simhash.gray_rank(fp), group))
        f = fp[order]
        u, v = simhash.close_pairs(f, group)
        want = {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if group[i] == group[j] and int(f[i] ^ f[j]).bit_count() <= 2}
        assert set(zip(u.tolist(), v.tolist(), strict=True)) == want and len(u) == len(want)


def test_op12_on_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_simhash_near_dedup(spark, DATA).collect()), key=str) == simhash_by_force(rows)


def clusters_by_force(rows, k=8, rounds=10):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(e is not None and math.isfinite(e) for e in x):
            kept.append((i, [math.floor(max(-(2**27), min(2**27, 1024 * float(e)))) for e in x]))
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, hashlib.sha256(f"3:{kept[n][0]}".encode()).hexdigest() if kept[n][0] is not None else "", kept[n][1]))
    cents = [list(kept[n][1]) for n in order[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), n) for n, c in enumerate(cents))[1]
    for _ in range(rounds):
        got = [near(v) for _, v in kept]
        for n in range(len(cents)):
            own = [v for (_, v), g in zip(kept, got, strict=True) if g == n]
            if own:
                cents[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = [near(v) for _, v in kept]
    each = [dist(v, cents[g]) for (_, v), g in zip(kept, got, strict=True)]
    own = [sum(d for d, g in zip(each, got, strict=True) if g == n) for n in range(len(cents))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, g, d, own[g], sum(each), names[g]) for (i, _), g, d in zip(kept, got, each, strict=True)], key=str)


EMBEDDINGS = "vec_id long, embedding array<float>"


def as_float(rows):
    return [(i, None if x is None else [None if e is None else float(np.float32(e)) for e in x]) for i, x in rows]


def test_clusters_by_force(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "BLOCK", 64)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(9, 64))
    rows = [(i, (centers[i % 9] + 0.2 * rng.normal(size=64)).tolist()) for i in range(300)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (501, rows[1][1]), (None, rows[2][1]), (None, None), (502, None), (503, [1.0] * 63), (504, [1.0] * 65), (505, [None] + [0.0] * 63), (506, [float("nan")] * 64), (507, [float("inf")] + [0.0] * 63), (508, [3e38] * 64), (509, [])]
    rows += [(600 + i, [0.25 * (i % 2)] * 64) for i in range(150)]
    rows = as_float(rows)
    df = spark.createDataFrame(rows, EMBEDDINGS).selectExpr("*", "1 as cluster", "2 as v", "3 as ids").repartition(3)
    assert sorted(map(tuple, dual_tree.clustered(df).collect()), key=str) == clusters_by_force(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = as_float([(i, [float(i // 2)] * 64) for i in range(n)])
    got = dual_tree.clustered(spark.createDataFrame(rows, EMBEDDINGS))
    assert sorted(map(tuple, got.collect()), key=str) == clusters_by_force(rows)


def test_dual_tree_is_exact_and_prunes():
    rng = np.random.default_rng(4)
    centers = rng.integers(-900, 900, (12, 64))
    points = (centers[rng.integers(0, 12, 2048)] + rng.integers(-40, 40, (2048, 64))).astype(np.int32)
    points[:300] = points[0]
    cents = np.concatenate([centers[:10], centers[:2], points[:1]]).astype(np.int64)
    tree, over = dual_tree.cover_tree(points.astype(float)), dual_tree.cover_tree(cents.astype(float), leaf=1)
    assert sorted(tree.order.tolist()) == list(range(2048))
    for v in range(len(tree.center)):  # every node covers its points, children share out their parent's
        own = tree.order[tree.start[v] : tree.end[v]]
        assert np.sqrt(((points[own] - points[tree.center[v]]) ** 2.0).sum(1)).max() <= tree.radius[v] + 1e-6
        kids = range(tree.child[v], tree.child[v] + tree.children[v])
        assert not kids or (tree.start[kids[0]], tree.end[kids[-1]]) == (tree.start[v], tree.end[v])
    label, compared = dual_tree.nearest(points, tree, cents, over)
    assert (label == ((points[:, None].astype(np.int64) - cents) ** 2).sum(2).argmin(1)).all()
    assert compared < 0.2 * len(points) * len(cents)


def test_op13_on_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_centroid_clustering(spark, DATA).collect()), key=str) == clusters_by_force(rows)
