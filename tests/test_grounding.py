"""Grounding against a plain loop over all values and blocks."""

from __future__ import annotations

import difflib
import random
import re

from pyspark.sql import functions as F

from quillstream.catalog import QUERIES
from quillstream.operators import grounding

VALUES = "doc_id long, field string, value string, quote string, page int"
BLOCKS = "doc_id long, block_id string, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double"


def form(text):
    text = re.sub("[•●▪◦*�\x00-\x1f]", " ", text or "").translate(str.maketrans("“”‘’–—−", "\"\"''---"))
    return re.sub(r"\s+", " ", text.lower()).strip()


def by_force(value, quote, page, blocks):
    q, v = form(quote), form(value)
    order = sorted(blocks, key=lambda b: (b[2] != (page or 1), b[2], b[3]))
    for b in order:
        t = form(b[4])
        if not t:
            continue
        if q and (q in t or (len(t) >= 15 and t in q)):
            return b[1], 1.0, True
        if len(q) >= 20 and q[:35].strip() in t:
            return b[1], 0.98, True
        if len(v) >= 2 and (v in t or (len(t) >= 15 and t in v)):
            return b[1], 0.95, True
        if len(v) >= 25 and v[:35].strip() in t:
            return b[1], 0.92, True
    target = q or v
    best, where = 0.0, None
    words = [w for w in re.findall("[a-zA-Z0-9]+", target) if len(w) >= 3]
    for b in order:
        t = form(b[4])
        if not t or not target:
            continue
        score = sum(w in t for w in words) / len(words) if words else 0.0
        if len(target) <= 3 * len(t):
            score = max(score, difflib.SequenceMatcher(None, target, t).ratio())
        if score > best:
            best, where = score, b[1]
    return (where, round(best, 2), best >= 0.70) if best >= 0.65 else (None, 0.0, False)


def sample(seed):
    rnd = random.Random(seed)
    words = ["acme", "Total", "due", "invoice", "number", "12.50", "2024-01-02", "Grünwald", "a", "ltd", "net", "•", "x*y"]
    blocks = [(d, f"b{p}-{k}", p, k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 8))), 1.0, 2.0, 3.0, 4.0) for d in range(12) for p in (1, 2) for k in range(6)]
    values = []
    for d in range(12):
        own = [b[4] for b in blocks if b[0] == d and b[4]]
        for f in range(10):
            text = list(rnd.choice(own))
            for _ in range(rnd.randint(0, 4)):
                text[rnd.randrange(len(text))] = rnd.choice("abco1 ")
            values.append((d, f"f{f}", rnd.choice([None, "", "".join(text)]), rnd.choice(["", None, "".join(text), "zzz qqq"]), rnd.choice([None, 1, 2])))
    return values, blocks


def test_ground_by_force(spark):
    values, blocks = sample(7)
    got = grounding.ground(spark.createDataFrame(values, VALUES), spark.createDataFrame(blocks, BLOCKS)).collect()
    want = {(d, f): by_force(v, q, p, [b for b in blocks if b[0] == d]) for d, f, v, q, p in values}
    assert {(r.doc_id, r.field): (r.block_id, r.match_score, r.grounded) for r in got} == want
    assert sum(0.65 <= s < 0.92 for _, s, _ in want.values()) > 5


def test_few_pairs_reach_the_ratio(spark):
    """No pair whose ratio counts is filtered, and most pairs are."""
    values, blocks = sample(8)
    v = spark.createDataFrame([(d, f, p, form(q or v)) for d, f, v, q, p in values if form(q or v)], "doc_id long, field string, page int, _t string")
    b = spark.createDataFrame([(*x[:1], x[2], x[3], form(x[4])) for x in blocks], "doc_id long, _page int, pos int, _b string")
    pairs = grounding.candidate_pairs(v, b).collect()
    likely = [p for p in pairs if p.likely]
    for p in pairs:
        ratio = difflib.SequenceMatcher(None, p["_t"], p["_b"]).ratio()
        assert ratio <= p.bound + 1e-9
    assert len(likely) < 0.5 * len(pairs)


def grouped(spark, values, blocks):
    """A row for each document: its values and its blocks."""
    v = spark.createDataFrame(values, VALUES).groupBy("doc_id").agg(F.collect_list(F.struct("field", "value", "quote", "page")).alias("values"))
    b = spark.createDataFrame(blocks, BLOCKS).groupBy("doc_id").agg(F.collect_list(F.struct("block_id", "page", "pos", "text", "x0", "y0", "x1", "y1")).alias("blocks"))
    return v.join(b, "doc_id", "left")


def test_ground_in_rows_by_force(spark):
    """Runs of few letters, as they are found one after the other, blocks from 200 characters on, and documents without blocks or values."""
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choices("aab Bé😀", k=n))
    blocks, values = [], []
    for d in range(60):
        blocks += [(d, f"b{p}-{k}", p, k, text(rnd.choice([0, 3, 9, 20, 205])), 1.0, 2.0, 3.0, 4.0) for p in (1, 2) for k in range(5)]
        for f in range(6):
            t = list(rnd.choice(blocks[-10:])[4] or "ab")
            for _ in range(rnd.randint(0, 1 + len(t) // 4)):
                t.insert(rnd.randrange(len(t) + 1), rnd.choice("abz1é"))
            values.append((d, f"f{f}", None, "".join(t), rnd.choice([None, 1, 2])))
    values.append((99, "alone", "some value", "", 1))
    got = grounding.ground_in_rows(grouped(spark, values, blocks))
    want = {(d, f): by_force(v, q, p, [b for b in blocks if b[0] == d]) for d, f, v, q, p in values}
    assert {(r.doc_id, r.field): (r.block_id, r.match_score, r.grounded) for r in got.collect()} == want
    assert sum(0.65 <= s < 0.92 for _, s, _ in want.values()) > 50
    schema = "doc_id long, values array<struct<field: string, value: string, quote: string, page: int>>, blocks array<struct<block_id: string, page: int, pos: int, text: string, x0: double, y0: double, x1: double, y1: double>>"
    for row in ((1, [], []), (1, None, None)):
        assert grounding.ground_in_rows(spark.createDataFrame([row], schema)).count() == 0


def test_orders_meet_their_lines_without_join_or_shuffle(spark):
    for name in ("ground_likeness", "ground_values"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        assert [x for x in plan.splitlines() if "Exchange" in x and "REPARTITION_BY_NUM" not in x] == []


def test_form_of_odd_texts(spark):
    rnd = random.Random(10)
    texts = ["".join(rnd.choices("aB1-*  •“”–−\ufffd\t\n\u00a0é.$~_", k=rnd.randint(0, 8))) for _ in range(3000)] + ["", " ", "a\n", "Plain text.", "two  spaces", " lead", "trail ", "!\"#$%&'()+,-./:;<=>?@[\\]^_`{|}~ x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t").rlike(r"^[\x20-\x7e]*$")
    known = grounding.grounding_form(F.translate("t", "*\ufffd−", "  -"))
    got = rows.select("t", plain.alias("plain"), grounding._form(F.col("t")).alias("form"), known.alias("known")).collect()
    assert all(r.form == r.known for r in got) and sum(r.plain for r in got) > 20


def test_passages(spark):
    quotes = spark.createDataFrame([(1, "one two three four five six"), (2, "nine"), (3, ""), (4, "two three"), (5, "six")], "item_id int, quote string")
    docs = spark.createDataFrame([(1, "zero One two, three\nNINE nines"), (2, "x one two three four five six y"), (3, None), (4, ""), (5, "one two three four five sixty")], "doc_id long, text string")
    got = grounding.passages(quotes, docs).select("doc_id", "block_no", "item_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (2, 0, 1), (2, 0, 4), (2, 0, 5), (5, 0, 4)]
    assert grounding.passages(quotes.where("false"), docs).count() == 0
    assert grounding.passages(quotes.withColumn("x", F.lit(1)), docs.where("false")).columns == ["doc_id", "block_no", "item_id", "quote", "x"]
