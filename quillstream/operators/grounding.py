"""Grounding: which text block of the same document a value was read from."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import grounding_form
from quillstream.functions.windows import windows_of_sizes
from quillstream.sources.shared import sized, written

ACCEPT, GROUNDED = 0.65, 0.70
#: Characters that are counted one by one for the bound of a likeness; the others count together.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Texts of these characters alone, with single spaces, need no more than lower case. Each is named: a range takes longer to test.
_PLAIN = "^[ " + "".join(c if c.isalnum() else "\\" + c for c in map(chr, range(0x21, 0x7F)) if c != "*") + "]+\\z"
#: Words that count for a share.
WORD = re.compile("[a-zA-Z0-9]{3,}")
#: Words by whose hash a quote is looked up.
LEAD = 5


def exact_score(value: Column, block: Column) -> Column:
    """1.0, 0.98, 0.95 or 0.92 by the way in which a block's form holds the quote or the value of a ``_value``; null if it doesn't.

    What is too short to count is null there, and so never held.
    """
    held = lambda c: block.contains(value[c]) | (value[c + "_long"].contains(block) & (F.length(block) >= 15))
    return F.when(held("quote"), 1.0).when(block.contains(value["quote_begins"]), 0.98).when(held("value"), 0.95).when(block.contains(value["value_begins"]), 0.92)


def _form(text: Column) -> Column:
    plain = F.rlike(text, F.lit(_PLAIN)) & ~F.contains(text, F.lit("  ")) & ~F.startswith(text, F.lit(" ")) & ~F.endswith(text, F.lit(" "))
    return F.when(plain, F.lower(text)).otherwise(grounding_form(F.translate(text, "*�−", "  -")))


def _counts(text: Column) -> Column:
    """How often each of COUNTED is in the text, and how many other characters."""
    each = F.transform(F.array(*[F.lit(c) for c in COUNTED]), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    return F.concat(each, F.array(F.length(text) - F.aggregate(each, F.lit(0), lambda a, n: a + n)))


def _overlap(words: Column, block: Column) -> Column:
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(block, w))) / F.size(words)).otherwise(0.0)


def _target_words(target: Column) -> Column:
    return F.filter(F.regexp_extract_all(target, F.lit("([a-zA-Z0-9]+)"), 1), lambda w: F.length(w) >= 3)


def _bound(target: Column, counts: Column, block: Column, block_counts: Column) -> Column:
    common = F.aggregate(F.zip_with(counts, block_counts, lambda x, y: F.least(x, y)), F.lit(0), lambda a, n: a + n)
    return 2 * common / (F.length(target) + F.length(block))


def candidate_pairs(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of a value without an exact hit and a block of its document, with ``overlap`` and ``bound``.

    ``values``: doc_id, field, page, _t; ``blocks``: doc_id, _page, pos, _b and more. ``overlap``: the share of the target's
    words of three letters and more that the block holds. ``bound``: no ratio of common runs can exceed it, as the runs share
    no more of any character than both texts have. Only where the bound reaches ACCEPT, and what the best overlap of the
    value gives already, can the ratio decide; only those pairs have ``likely``.
    """
    v = values.withColumn("_words", _target_words(F.col("_t"))).withColumn("_vc", _counts(F.col("_t")))
    b = blocks.where("_b <> ''").withColumn("_bc", _counts(F.col("_b")))
    pairs = v.join(b.hint("merge"), "doc_id").withColumn("overlap", _overlap(F.col("_words"), F.col("_b"))).withColumn("bound", _bound(F.col("_t"), F.col("_vc"), F.col("_b"), F.col("_bc")))
    best = F.max("overlap").over(Window.partitionBy("doc_id", "field"))
    return pairs.withColumn("likely", (F.length("_t") <= 3 * F.length("_b")) & (F.col("bound") >= F.greatest(F.lit(ACCEPT), best))).drop("_words", "_vc", "_bc")


def ground(values: DataFrame, blocks: DataFrame, fuzzy: bool = True, parts: int | None = None) -> DataFrame:
    """values (doc_id, field, value, quote, page) with block_id, match_score, grounded, bbox.

    ``blocks``: doc_id, block_id, page, pos, text, x0, y0, x1, y1. Blocks of the hinted page come first, then by position;
    the first block with an exact hit wins. Values without one are compared with the blocks of their document by words, and
    by the ratio of common runs where its bound (as in ``candidate_pairs``) allows that to decide; the first best from 0.65
    on counts, and 0.70 grounds it. A document's blocks are one row, which meets its values once, in ``parts`` tasks.
    """
    b = blocks.select("doc_id", _block(F.col).alias("b"))
    v = values.withColumn("_vs", F.array(_value(F.col)))
    if parts:
        b, v = b.repartition(parts, "doc_id"), v.repartition(parts, "doc_id")
    docs = b.groupBy("doc_id").agg(F.collect_list("b").alias("_bs"))
    rows = _hits(v.join(docs.hint("merge"), "doc_id", "left"), fuzzy)
    return _told(rows.select(*values.columns, F.get("_hs", F.lit(0)).alias("_h")))


def ground_in_rows(docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The same as ``ground`` for documents that bring their values and blocks along, without a shuffle.

    ``docs``: keys, ``values`` (array of field, value, quote, page and more) and ``blocks`` (array of block_id, page, pos, text,
    x0, y0, x1, y1). A row for each value: the keys, the value's columns and what ``ground`` adds.
    """
    keys = [c for c in docs.columns if c not in ("values", "blocks")]
    names = docs.schema["values"].dataType.elementType.names
    rows = docs.select(*keys, "values", F.transform("values", lambda v: _value(lambda c: v[c])).alias("_vs"), F.transform("blocks", lambda b: _block(lambda c: b[c])).alias("_bs"))
    rows = _hits(rows, fuzzy).select(*keys, F.zip_with("values", "_hs", lambda v, h: F.struct(v.alias("v"), h.alias("h"))).alias("_x"))
    # not explode: for it the planner makes all of this once more, to tell documents without values
    return _told(rows.select(*keys, F.explode_outer("_x").alias("_x")).where("_x is not null").select(*keys, *[F.col("_x.v")[c].alias(c) for c in names], F.col("_x.h").alias("_h")))


def _block(of) -> Column:
    """In the order in which blocks are looked at."""
    return F.struct(of("page").alias("_page"), of("pos").alias("pos"), of("block_id").alias("block_id"), *[of(c).alias(c) for c in ("x0", "y0", "x1", "y1")], _form(of("text")).alias("_b"))


def _value(of) -> Column:
    return F.struct(F.coalesce(_form(of("quote")), F.lit("")).alias("_q"), F.coalesce(_form(of("value")), F.lit("")).alias("_v"), of("page").alias("page"))


def _sought(v: Column) -> Column:
    """A ``_value`` with what ``exact_score`` looks for, made once for all blocks."""
    long = lambda x: F.when(F.length(x) >= 15, x)
    begins = lambda x, least: F.when(F.length(x) >= least, F.trim(F.left(x, F.lit(35))))
    q, x = v["_q"], v["_v"]
    return F.struct(q.alias("_q"), x.alias("_v"), v["page"].alias("page"), F.when(q != "", q).alias("quote"), long(q).alias("quote_long"), begins(q, 20).alias("quote_begins"), F.when(F.length(x) >= 2, x).alias("value"), long(x).alias("value_long"), begins(x, 25).alias("value_begins"))


def _hits(rows: DataFrame, fuzzy: bool) -> DataFrame:
    """``rows`` with ``_hs``: for each of ``_vs`` (``_value``) the best of ``_bs`` (``_block``), null where none counts."""
    rows = rows.withColumn("_bs", F.array_sort(F.filter("_bs", lambda b: b["_b"] != ""))).withColumn("_vs", F.transform("_vs", _sought))
    place = lambda v, b: F.struct((b["_page"] != F.coalesce(v["page"], F.lit(1))).alias("far"), b["_page"].alias("_page"), b["pos"].alias("pos"))
    hit = lambda v, b, score: F.struct(place(v, b).alias("place"), b["block_id"].alias("block_id"), score.alias("score"), *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])
    # array_min passes over nulls, so that only hits are built
    exact = lambda v: F.array_min(F.zip_with("_bs", F.transform("_bs", lambda b: exact_score(v, b["_b"])), lambda b, s: F.when(s.isNotNull(), hit(v, b, s))))
    rows = rows.withColumn("_hs", F.transform("_vs", exact))
    if not fuzzy:
        return rows
    kept = rows.columns
    target = lambda v, h: F.when(h.isNull(), F.when(v["_q"] != "", v["_q"]).otherwise(v["_v"]))
    # a step of its own, as no Python function may take or stand in what looks into an array
    passed = F.struct(F.zip_with("_vs", "_hs", target).alias("ts"), F.transform("_vs", lambda v: F.coalesce(v["page"], F.lit(1)).cast("long")).alias("pages"), F.transform("_bs", lambda b: b["_b"]).alias("bs"), F.transform("_bs", lambda b: b["_page"].cast("long")).alias("on"))
    rows = rows.select(*kept, F.explode(F.array(passed)).alias("_p")).withColumn("_ls", F.explode(F.array(_likest()("_p.ts", "_p.pages", "_p.bs", "_p.on"))))
    like = lambda v, l: F.when(l["at"] >= 0, hit(v, F.get("_bs", l["at"]), l["score"]))  # noqa: E731, E741
    return rows.withColumn("_hs", F.transform("_vs", lambda v, i: F.coalesce(F.get("_hs", i), like(v, F.get("_ls", i)))))


def _told(rows: DataFrame) -> DataFrame:
    """block_id, match_score, grounded and bbox in place of ``_h``."""
    columns = rows.columns[:-1]
    out = rows.select(*columns, "_h.block_id", "_h.score", *[f"_h.{c}" for c in ("x0", "y0", "x1", "y1")])
    score = F.round(F.coalesce(F.col("score"), F.lit(0.0)), 2)
    sure = F.coalesce(F.col("score") >= GROUNDED, F.lit(False))
    box = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("x0", "y0", "x1", "y1")])
    return out.select(*columns, "block_id", score.alias("match_score"), sure.alias("grounded"), F.when(sure, box).otherwise(F.array(*[F.lit(0.0)] * 4)).alias("bbox"))


def _likest():
    """For each row's targets the place of the first likest of its blocks, -1 where none reaches ACCEPT, and its score.

    The score is the share of the target's words that the block holds, or the ratio where that is greater. A ratio is asked for only
    where bounds by lengths and by letters let it reach ACCEPT and the target's best share.
    """

    def common(a: str, b: str) -> int:
        """Characters in the common runs that SequenceMatcher finds: the longest, first in a, then in b, and so on before and after it."""
        total, todo = 0, [(a, b)]
        while todo:
            a, b = todo.pop()
            most = at = i = 0
            while i + most < len(a):
                while i + most < len(a) and a[i : i + most + 1] in b:
                    most, at = most + 1, i
                i += 1
            if most:
                j = b.find(a[at : at + most])
                total += most
                todo += [(x, y) for x, y in ((a[:at], b[:j]), (a[at + most :], b[j + most :])) if x and y]
        return total

    def ratio(a: str, b: str) -> float:
        # from 200 characters on SequenceMatcher passes over frequent ones
        return difflib.SequenceMatcher(None, a, b).ratio() if len(b) >= 200 else 2.0 * common(a, b) / (len(a) + len(b))

    def shares(target: str | None, blocks: list[str]) -> list[float]:
        words = WORD.findall(target) if target else ()
        if words:
            whole = "\n".join(blocks)
            known = [w for w in words if w in whole]
            if len(known) >= ACCEPT * len(words):  # else no block holds enough
                return [sum([w in x for w in known]) / len(words) for x in blocks]
        return [0.0] * len(blocks)

    kinds = np.full(128, len(COUNTED), np.int64)
    kinds[[ord(c) for c in COUNTED]] = np.arange(len(COUNTED))

    def letters(texts: list[str]) -> np.ndarray:
        """How often each of COUNTED is in a text, and how many other characters."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(COUNTED) + 1
        return np.bincount(np.repeat(np.arange(len(texts)) * n, [len(t) for t in texts]) + kinds[np.minimum(codes, 127)], minlength=len(texts) * n).reshape(-1, n).astype(np.int32)

    def runs(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Where a row's elements begin among all, and their number."""
        n = np.array(lists.value_lengths().fill_null(0), np.int64)
        return np.concatenate(([0], np.cumsum(n))), n

    @F.arrow_udf("array<struct<at:int,score:double>>")
    def likest(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for targets, pages, blocks, on in parts:
            t, b = (x.flatten().to_numpy(zero_copy_only=False).tolist() for x in (targets, blocks))
            (first_t, n_t), (first_b, n_b) = runs(targets), runs(blocks)
            t_size, b_size = np.array([len(x or "") for x in t], np.int64), np.array([len(x) for x in b], np.int64)
            row = np.repeat(np.arange(len(n_t)), n_t)  # of a target
            first = np.concatenate(([0], np.cumsum(n_b[row])))  # its first pair
            page, of_page, no_page = np.array(pages.flatten(), np.int64), np.array(on.flatten().fill_null(0), np.int64), np.array(on.flatten().is_null(), bool)
            at, score, k, starts = np.full(len(t), -1, np.int32), np.zeros(len(t)), 0, first_b.tolist()
            while k < len(t):  # so many targets at a time that their pairs are few
                end = max(k + 1, int(np.searchsorted(first, first[k] + (1 << 16), "right")) - 1)
                one = np.repeat(np.arange(k, end), n_b[row[k:end]])
                other = np.arange(first[k], first[end]) - first[one] + first_b[row[one]]
                scores = np.array([s for v, d in enumerate(row[k:end].tolist(), k) for s in shares(t[v], b[starts[d] : starts[d + 1]])], np.float64)
                least = np.full(end - k, ACCEPT)
                np.maximum.at(least, one - k, scores)
                x, y, z = t_size[one], b_size[other], least[one - k]
                asked = np.flatnonzero((x > 0) & (x <= 3 * y) & (2 * np.minimum(x, y) / np.maximum(x + y, 1) >= z))
                for likely in np.array_split(asked, len(asked) // 4096 + 1):
                    if len(likely):
                        (ts, i), (bs, j) = (np.unique(of[likely], return_inverse=True) for of in (one, other))
                        same = np.minimum(letters([t[v] for v in ts])[i], letters([b[v] for v in bs])[j]).sum(1)
                        for p in likely[2.0 * same / (x + y)[likely] >= z[likely]]:
                            scores[p] = max(scores[p], ratio(t[one[p]], b[other[p]]))
                good = np.flatnonzero(scores >= ACCEPT)
                far = np.where(no_page[other[good]], 0, np.where(of_page[other[good]] == page[one[good]], 1, 2))
                # of each target the greatest score first, near before far, then by place
                good = good[np.lexsort((other[good], far, -scores[good], one[good]))]
                lead, i = np.unique(one[good], return_index=True)
                at[lead], score[lead] = other[good[i]] - first_b[row[lead]], scores[good[i]]
                k = end
            yield pa.ListArray.from_arrays(first_t.astype(np.int32), pa.StructArray.from_arrays([pa.array(at), pa.array(score)], ["at", "score"]))

    return likest


def passages(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, block_no and the columns of ``quotes`` (quote and more): blocks of ``docs`` (doc_id, text) that hold a quote as whole
    words; a document's blocks are its lines.

    A quote is looked up by the hash of its first LEAD words (of all words of a shorter one). Each block gives the hashes of its windows
    of one to LEAD words, without its text; what meets a quote's hash is written as the blocks' places, and only those blocks are read
    again and searched for the quote itself.
    """
    quotes = quotes.where("quote <> ''").withColumn("_w", F.split("quote", " ")).withColumn("_n", F.least(F.size("_w"), F.lit(LEAD)))
    quotes = windows_of_sizes(quotes, "_w", list(range(1, LEAD + 1)), "_h")
    quotes = quotes.withColumn("_lead", F.get(F.element_at(F.array(*[f"_h{n}" for n in range(1, LEAD + 1)]), F.col("_n")), 0)).drop("_w", *[f"_h{n}" for n in range(1, LEAD + 1)])
    quotes = written(quotes, "quotes")
    blocks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "_block")).select("doc_id", "block_no", grounding_form(F.col("_block")).alias("_block")).where("_block <> ''")
    sizes = [r._n for r in quotes.select("_n").distinct().collect()]  # LEAD numbers at most
    keyed = blocks.withColumn("_w", F.split("_block", " "))
    keyed = windows_of_sizes(keyed, "_w", sizes, "_h")
    keys = F.array_distinct(F.flatten(F.array(*[f"_h{n}" for n in sizes]))) if sizes else F.array().cast("array<bigint>")
    leads = sized(written(quotes.select("_lead").distinct(), "leads"))
    places = keyed.select("doc_id", "block_no", F.explode(keys).alias("_lead")).join(leads, "_lead").withColumnsRenamed({"doc_id": "_doc", "block_no": "_no"})
    places = written(places, "places")
    found = blocks.join(sized(places), (F.col("doc_id") == F.col("_doc")) & (F.col("block_no") == F.col("_no"))).drop("_doc", "_no").join(sized(quotes), "_lead")
    whole = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return found.where(whole("_block").contains(whole("quote"))).drop("_block", "_lead", "_n")
