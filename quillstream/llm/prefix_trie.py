"""Conversations as a trie of shared prefixes.

Turns become digests (SHA-256 of role and text) once, and no text is moved after that. Numpy scans along each conversation
give polynomial rolling fingerprints of all its prefixes; a prefix of depth d has the sum of hash(turn i) * B**i, so that
equal turns after equal fingerprints mean equal fingerprints before. Rows with one depth and fingerprint are a candidate
node. Each is verified turn by turn against its representative, the smallest conversation: all its rows must have the
representative's last turn and the representative's fingerprint one turn earlier; by induction the whole prefixes are
equal. Rows that differ get another hash for that turn, and the scan is made again until no group is mixed.

Roll-up: the smallest member owns a node, and what a conversation owns is the tail of its path. So the sum over a node's
subtree is the sum of its own tail from the node on, and of the whole tails of its other members. That takes one scan and
one aggregation that combines before the shuffle, at any depth, without a step per level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.bytehash import BASE, U64, mix
from quillstream.llm.scans import running_sums
from quillstream.llm.staging import drop, map_arrow, stage

#: Members' ids in a piece of the text that is hashed.
PIECE = 4096


def _powers(exponent: np.ndarray) -> np.ndarray:
    """BASE ** exponent modulo 2**64, by the exponent's bits."""
    out, square = np.ones(len(exponent), U64), BASE
    for k in range(int(exponent.max(initial=0)).bit_length()):
        out[(exponent >> k) & 1 == 1] *= U64(square)
        square = square * square % 2**64
    return out


def _ones(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {"n": np.ones(batch.num_rows, np.int64)}


def _prefix_terms(bits: int) -> Callable:
    def terms(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        digest = batch.column("digest")
        start = np.frombuffer(digest.buffers()[1], np.int32, len(digest), digest.offset * 4)[0]
        words = np.frombuffer(digest.buffers()[2], np.uint8, 32 * len(digest), start).view("<u8").reshape(-1, 4)
        depth, again = (batch.column(c).to_numpy() for c in ("depth", "again"))
        h = np.where(again == 0, words[:, 0] & U64(2**bits - 1), mix(words[:, 1] + again.astype(U64) * U64(BASE)))
        return {"fp": np.where(depth > 0, h * _powers(depth), U64(0))}

    return terms


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (from 0), digest, words of each row of ``conversations`` (conv_id, turn, role, text; others are ignored).

    Ordered by turn, null first; rows with one turn number by digest, repeated rows each a turn. Null role or text is empty.
    Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    rows = running_sums(turns, "conv_id", order, _ones, ["n"])
    out = rows.select("conv_id", F.col("n_before").alias("n"), "digest", "words")
    out._staged_at = rows._staged_at
    return out


def forked(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Numbered turns with the first h turns of conversation c replaced by those of c - c % every; h = crc32(decimal c) % heads.

    All of that conversation's turns if it has fewer, none if it is absent; c's own turns after its first h follow. Gives
    conv_id, depth (from 1), length, digest, words, and a row of depth 0 for each conversation.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    bases = convs.where("conv_id = base").select(F.col("base").alias("_base"), F.col("own").alias("_own"))
    convs = convs.join(bases, F.col("base") == F.col("_base"), "left").withColumn("taken", F.least("h", F.coalesce("_own", F.lit(0))))
    convs = stage(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "forks")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(bytearray(32)).alias("digest"), F.lit(0).cast("long").alias("words"))
    heads_ = turns.where(f"conv_id % {every} = 0 and n < {heads - 1}").select(F.col("conv_id").alias("base"), "n", "digest", "words")
    head = convs.where("taken > 0").select("conv_id", "base", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("n")).join(heads_, ["base", "n"])
    own = turns.join(convs, "conv_id").where("n >= h")
    rows = root.unionByName(head.select("conv_id", (F.col("n") + 1).alias("depth"), "length", "digest", "words"))
    rows = stage(rows.unionByName(own.select("conv_id", (F.col("taken") + F.col("n") - F.col("h") + 1).alias("depth"), "length", "digest", "words")), "forked")
    drop(convs)
    return rows


def unforked(turns: DataFrame) -> DataFrame:
    """Numbered turns in the form of ``forked``, as they are."""
    convs = stage(turns.groupBy("conv_id").agg(F.count("*").alias("length")), "lengths")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(bytearray(32)).alias("digest"), F.lit(0).cast("long").alias("words"))
    return root.unionByName(turns.join(convs, "conv_id").select("conv_id", (F.col("n") + 1).alias("depth"), "length", "digest", "words"))


def _prefixes(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints ``fp`` and ``fp_before``, and the verified nodes."""
    rows = rows.withColumn("again", F.lit(0).cast("long"))
    while True:
        done = running_sums(rows, "conv_id", [F.col("conv_id").asc(), F.col("depth").asc()], _prefix_terms(bits), ["fp"])
        same = F.struct("digest", "fp_before")
        nodes = done.groupBy("depth", "fp").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends"), F.max("words").alias("words"), F.min(same).alias("least"), F.max(same).alias("most"))
        nodes = nodes.select("depth", "fp", "conv_id", "n_convs", "n_ends", "words", F.col("least.fp_before").alias("above"), (F.col("least") != F.col("most")).alias("mixed"))
        nodes = stage(nodes, "nodes")
        mixed = nodes.where("mixed")
        if mixed.isEmpty():
            return done, nodes
        members = done.join(mixed.select("depth", "fp", F.col("conv_id").alias("first")), ["depth", "fp"])
        first = members.where("conv_id = first").select("depth", "fp", F.col("digest").alias("_digest"), F.col("fp_before").alias("_before"))
        wrong = members.join(first, ["depth", "fp"]).where("digest <> _digest or fp_before <> _before").select("conv_id", "depth", F.lit(1).alias("_wrong"))
        old, old_nodes = done, nodes
        kept = done.drop("fp", "fp_before").join(wrong, ["conv_id", "depth"], "left")
        rows = stage(kept.withColumn("again", F.col("again") + F.coalesce("_wrong", F.lit(0))).drop("_wrong"), "split")
        drop(old, old_nodes)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, fp, conv_id) to (depth, fp, first, ids): up to PIECE ids of a node joined by commas."""
    for batch in batches:
        depth, fp, conv = (batch.column(c).to_numpy() for c in ("depth", "fp", "conv_id"))
        if not len(depth):
            continue
        cuts = np.append(0, np.flatnonzero((depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1])) + 1)
        cuts = [*np.unique(np.concatenate([cuts, *[np.arange(a, b, PIECE) for a, b in zip(cuts, np.append(cuts[1:], len(depth)), strict=True) if b - a > PIECE]])).tolist(), len(depth)]
        text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.record_batch([pa.array(depth[cuts[:-1]]), pa.array(fp[cuts[:-1]]), pa.array(conv[cuts[:-1]]), pa.array(text, pa.string())], ["depth", "fp", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (depth, fp, ends_sha256), one piece at a time in memory."""
    now, sha = None, None
    for batch in batches:
        out = []
        for depth, fp, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "fp", "ids")), strict=True):
            if now == (depth, fp):
                sha.update(b",")
            else:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (depth, fp), hashlib.sha256()
            sha.update(ids.encode())
        if out:
            yield _hash_rows(out)
    if now is not None:
        yield _hash_rows([(*now, sha.hexdigest())])


def _hash_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, fp, sha = zip(*rows, strict=True)
    return pa.record_batch([pa.array(depth, pa.int64()), pa.array(fp, pa.int64()), pa.array(sha, pa.string())], ["depth", "fp", "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """Hash of the ids, ascending, of the conversations that end at a node. A hash is one sequence, so a node with very many
    ends has one task for it in the end, which reads their joined ids in pieces."""
    ends = rows.where("depth = length").select("depth", "fp", "conv_id")
    ends = ends.repartitionByRange("depth", "fp", "conv_id").sortWithinPartitions("depth", "fp", "conv_id")
    pieces = map_arrow(ends, _pieces, "depth bigint, fp bigint, first bigint, ids string")
    pieces = pieces.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "first")
    return map_arrow(pieces, _hashed, "depth bigint, fp bigint, ends_sha256 string")


def _tail_terms(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(f"own_{c}").to_numpy() for c in ("leaves", "saved")}


def prefix_trie(rows: DataFrame, bits: int = 64) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` comes from ``forked`` or ``unforked``. A node is a sequence of first turns, the root the empty one; conv_id is
    its smallest member. Without conversations there are no rows. ``bits``: bits of a turn's hash; fewer only cause
    collisions, which are split.
    """
    rows, nodes = _prefixes(rows, bits)
    owned = nodes.withColumn("own_leaves", (F.col("n_ends") == F.col("n_convs")).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("words"))
    # each owner's tail from the node on
    tails = running_sums(owned.drop("mixed"), "conv_id", [F.col("conv_id").asc(), F.col("depth").desc()], _tail_terms, ["leaves", "saved"])
    whole = owned.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    others = rows.select("conv_id", "depth", "fp").join(whole, "conv_id").where("depth < top").select("depth", "fp", F.lit(0).cast("long").alias("children"), "leaves", "saved")
    zero = F.lit(0).cast("long")
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("above").alias("fp"), F.lit(1).cast("long").alias("children"), zero.alias("leaves"), zero.alias("saved"))
    below = others.unionByName(children).groupBy("depth", "fp").agg(F.sum("children").alias("_children"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    ends = stage(_ends(rows), "ends")
    got = tails.join(below, ["depth", "fp"], "left").join(ends, ["depth", "fp"], "left")
    sums = {n: F.coalesce(c, zero) for n, c in (("n_children", F.col("_children")), ("n_leaves", F.col("leaves") + F.coalesce("_leaves", zero)), ("saved_tokens", F.col("saved") + F.coalesce("_saved", zero)))}
    got = stage(got.select("depth", "above", "conv_id", "n_convs", *[c.alias(n) for n, c in sums.items()], F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return got.join(above, ["depth", "above"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
