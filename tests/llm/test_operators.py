"""Each operator against brute force, round trips and edge cases on small tables."""

from __future__ import annotations

import collections
import hashlib
import io
import random
import re
import time
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import html_text, near_duplicates, pii, queries, secrets, sentencepiece_codec, sharding, suffix_dedup, warc_zip
from quillstream.llm.components import connected_components
from quillstream.llm.decontamination import contaminated, template_words
from quillstream.llm.oracles import ORACLES
from quillstream.llm.quality_rules import RATIOS, limits, quality_filter, quality_rules, sketches, text_counts

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")
#: Null, empty and blank texts, ties, repeated rows, a very long word and a very long text; extra columns that clash.
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (5, "One  TWO"), (None, "nobody has this"), (6, "x" * 100_000), (7, "long text of words " * 3000), (8, "long text of words " * 3000)]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if i == 4 else "s", 7, "clash", True, "x") for i, t in EDGE], "doc_id bigint, text string, lang string, source string, n_words int, component_id string, kept boolean, slot_x string")
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()))


def test_quality_edges(spark, edge):
    got = quality_rules(edge).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[7].n_repeat_words == 12000 and by[7].base_failed
    assert quality_filter(edge).columns == edge.columns
    assert quality_rules(edge.limit(0)).count() == 0


def test_quality_adapts_to_its_group(spark):
    words = [" ".join(f"w{(i * 7 + k * k) % 977}" for k in range(80)) for i in range(300)]
    rows = [(i, t, "en", "code", ) for i, t in enumerate(x.replace(" ", " # ") for x in words)] + [(1000 + i, t, "en", "prose") for i, t in enumerate(words)] + [(5000, words[0].replace(" ", " ### "), "en", "prose")]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and all(got[1000 + i] for i in range(300)) and not got[5000]


def test_quality_of_a_source_with_much_junk(spark):
    """Nearly half of a source is junk; its limits are those of the rest."""
    words = [" ".join(f"w{(i * 7 + k * k) % 977}" for k in range(80)) for i in range(300)]
    rows = [(i, t.replace(" ", " ### ") if i < 130 else t, "en", "s") for i, t in enumerate(words)]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] == (i >= 130) for i in got)


def test_quality_limits_come_from_the_sketches(spark):
    """Sources of longer and shorter texts get other limits; a rare ratio is no reason for a limit of 0; 30 % junk moves none."""
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choice(["ab", "abcd", "abcdef", "abcdefgh"]) + str(rnd.randint(0, 999)) for _ in range(n))
    rows = [(i, text(rnd.randint(60, 90)), "en", "short") for i in range(250)] + [(1000 + i, text(rnd.randint(400, 600)), "en", "long") for i in range(250)]
    junk = {i for i in range(0, 250, 3)}
    rows = [(i, t.replace(" ", " ## ") if i in junk else t + " # &" if i % 50 == 1 else t, lang, s) for i, t, lang, s in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_rules(df).collect()}
    assert {i for i, kept in got.items() if not kept} == junk
    by = {r.source: r for r in limits(sketches(text_counts(df))).collect()}
    assert all(by["short"][c] != by["long"][c] for c in ("hi_symbols", "hi_repeats", "lo_word_length", "hi_word_length"))
    clean = {r.source: r for r in limits(sketches(text_counts(df.where(~F.col("doc_id").isin(*junk))))).collect()}
    assert abs(clean["short"].hi_symbols - by["short"].hi_symbols) <= 0.1 * by["short"].hi_symbols


def test_quality_limits_of_the_given_table_differ(spark):
    found = limits(sketches(text_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))), min_docs=20)
    counts = found.agg(*[F.count_distinct(f"hi_{k}").alias(k) for k in RATIOS]).first()
    assert all(counts[k] > 1 for k in RATIOS)


def brute_near(rows, size=4):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    common, held = collections.Counter(), collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            for j in held[x]:
                common[j, i] += 1
            held[x].append(i)
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, docs, texts, size):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, size).collect()}
    assert got == brute_near(texts, size)


@pytest.mark.parametrize("block", [4096, 50])
def test_near_duplicates_around_the_threshold(spark, monkeypatch, block):
    """A large group of copies with edits: some are linked, others nearly; the pivot alone wouldn't find every link."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    r = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in r.choice(120, r.integers(0, 7), replace=False):
            w[k] = f"e{r.integers(1000)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_edges(spark, edge):
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(edge).collect()}
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[3].component_id == 3
    assert got[5].component_id == 4 and not got[5].kept and got[8].component_id == 7
    assert near_duplicates.near_duplicates(edge.limit(0)).count() == 0


def test_near_duplicates_without_ids(spark):
    text = lambda a: " ".join(f"{a}{k}" for k in range(60))
    rows = [(-5, text("a")), (None, text("b")), (None, text("a")), (None, text("c")), (None, text("c")), (None, None), (2**63 - 9, text("d"))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept, str(r.class_id)) for r in got) == sorted([("-5", 57, "-5", True, "-5"), ("None", 57, "None", True, "None"), ("None", 57, "-5", False, "-5"), ("None", 57, "None", True, "None"), ("None", 57, "None", False, "None"), ("None", 0, "None", True, "None"), (str(2**63 - 9), 57, str(2**63 - 9), True, str(2**63 - 9))])


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share a doc_id are told apart: each keeps its links."""
    text = lambda a, n=60: " ".join(f"{a}{k}" for k in range(n))
    rows = [(1, text("a")), (2, text("b")), (3, text("a") + " x"), (3, text("b") + " y"), (4, text("c")), (4, text("c")), (4, text("d"))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 57, 1, True), (2, 57, 2, True), (3, 58, 1, False), (3, 58, 2, False), (4, 57, 4, False), (4, 57, 4, True), (4, 57, 4, True)]


def test_miss_rate_at_the_threshold():
    """Pairs at a similarity of 0.8 exactly that share a bucket and pass the sketch filter."""
    r = np.random.default_rng(11)
    sketches, bands = 0, 0
    with np.errstate(over="ignore"):
        for _ in range(1500):
            both = r.integers(0, 2**63, 250).astype(np.uint64)
            a, b = both[:225], both[25:]  # 200 of 250
            x, y = near_duplicates.minhash(a), near_duplicates.minhash(b)
            bits = int(np.bitwise_count((near_duplicates.odd_sketch(x) ^ near_duplicates.odd_sketch(y)).view(np.uint64)).sum())
            sketches += bits > near_duplicates.MOST_BITS
            bands += not (near_duplicates.band_keys(x) == near_duplicates.band_keys(y)).any()
    assert sketches == bands == 0


def test_odd_sketch_estimates():
    r = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for share in (0.95, 0.8, 0.65):
            n = 4000
            common = int(2 * n * share / (1 + share))
            a, b = r.integers(0, 2**63, 2 * n - common).astype(np.uint64)[: n], None
            rest = r.integers(0, 2**63, n - common).astype(np.uint64)
            b = np.concatenate([a[:common], rest])
            x, y = (near_duplicates.odd_sketch(near_duplicates.minhash(s)) for s in (a, b))
            bits = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            k, m = len(near_duplicates._XOR), near_duplicates.SKETCH_BITS
            assert abs(1 + m / (4 * k) * np.log(1 - 2 * bits / m) - share) < 0.12


def test_components(spark):
    path = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(path, "u bigint, v bigint")).collect()))
    assert got == {i: 1 for i in range(2, 61)} | {101: 100}


def test_sentencepiece_equals_the_library(spark, docs, texts, edge):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    more = [(10**6 + i, t) for i, t in enumerate(["  two  spaces ", "日本語テキスト 😀\n\tx", "aaaa aaaaaaaaaaaa", "x" * 500, "naïve ﬁ Ⅷ", "def f(x):\n    return x"])]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    for r in sentencepiece_codec.tokens(df, queries.TOKENIZER).collect():
        text = dict(texts + more)[r.doc_id]
        assert r.token_ids == sp.encode(text) and r.round_trip and r.n_tokens == len(r.token_ids)
    got = sentencepiece_codec.tokens(edge, queries.TOKENIZER).collect()
    assert len(got) == len(EDGE) and all(r.round_trip for r in got)
    assert sentencepiece_codec.tokens(edge.limit(0), queries.TOKENIZER).count() == 0


def test_viterbi_of_a_unigram_model():
    v = sentencepiece_codec.load(queries.TOKENIZER, bpe=False)
    rng = np.random.default_rng(0)
    v.scores = np.where(v.normal, -rng.random(len(v.pieces)) * 10 - 1, 0)
    score = {p: v.scores[i] for i, p in enumerate(v.pieces) if v.normal[i]}
    with np.errstate(over="ignore"):
        for word, ids in zip(words := ["▁hello", "▁there", "▁world", "abcabc"], sentencepiece_codec.encode_words(v, words), strict=True):
            best = {0: 0.0}
            for j in range(1, len(word) + 1):
                best[j] = max(best[i] + score[word[i:j]] for i in range(j) if word[i:j] in score)
            assert abs(sum(v.scores[i] for i in ids) - best[len(word)]) < 1e-9 and "".join(v.pieces[i] for i in ids) == word


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_warc_packages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc_zip, "BROADCAST", broadcast)
    same, small = "<p>é" * 400, "tiny"
    rows = [(1, "http://a/1", same), (2, "http://a/2", same), (9, "http://a/9 x", same), (3, "u", small), (4, "u", small), (5, None, None), (6, "u", ""), (7, "u", "z" * 300_000), (None, "u", same)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    twice = warc_zip.archived(pages.union(pages.where("page_id = 1"))).collect()
    assert len(twice) == len(rows) + 1 and all(r.refers_to == 9 for r in twice if r.page_id in (1, None))
    got = {r.page_id: r for r in warc_zip.archived(pages).collect()}
    assert len(got) == len(rows) and all(r.intact for r in got.values())
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 9, 3, 4)] == [("revisit", 9), ("revisit", 9), ("response", None), ("response", None), ("response", None)]
    assert warc_zip.archived(pages.limit(0)).count() == 0


def test_warc_packages_are_read_in_blocks_by_many_tasks(spark, tmp_path):
    pages = spark.range(100).selectExpr("id as page_id", "concat('u', id) as url", "repeat(cast(id as string), 40) as html").repartition(3)
    packages = warc_zip.write_packages(pages, package_bytes=3000)
    assert packages.count() > 3 and packages.agg(F.sum("records")).first()[0] == 100
    records = warc_zip.read_packages(packages, block_records=7)
    assert records.rdd.getNumPartitions() > 10 and sorted(r.page_id for r in records.collect()) == list(range(100))
    # what a lost attempt wrote lies beside the package, and isn't read
    path = packages.first().path.removeprefix("file://")
    (again := tmp_path.with_name("x")).write_bytes(open(path, "rb").read())
    import shutil

    shutil.copy(again, path.replace(".wacz", "9.wacz"))
    assert warc_zip.read_packages(packages).count() == 100


def test_zip_directory_agrees_with_the_standard_library():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/b.txt", b"hello")
        with z.open("big", "w", force_zip64=True) as m:
            m.write(b"x" * 1000)
        z.comment = b"a comment"
    size = raw.seek(0, 2)
    got = warc_zip.directory(raw, size)
    assert {n: raw.getvalue()[a : a + k] for n, (a, k) in got.items()} == {"a/b.txt": b"hello", "big": b"x" * 1000}
    with zipfile.ZipFile(raw2 := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("c", b"x" * 100)
    with pytest.raises(ValueError):
        warc_zip.directory(raw2, raw2.seek(0, 2))


def brute_repeats(rows, width=400):
    n, passages = collections.Counter(), collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    words = [re.findall(rb"[^\x20\x09-\x0d]+", b) for _, b in raw]
    for w in words:
        passages.update(tuple(w[k : k + 51]) for k in range(len(w) - 50))
    for _, b in raw:
        n.update(b[s : s + width] for s in range(len(b) - width + 1))
    out = []
    for (i, b), w in zip(raw, words, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - width + 1):
            if n[b[s : s + width]] > 1:
                gone[s : s + width] = True
        gone = gone[: len(b)]
        holds = bool(gone.any()) or any(passages[tuple(w[k : k + 51])] > 1 for k in range(len(w) - 50))
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), int((~gone).sum()), holds))
    return sorted(out, key=str)


def repeats_fixture():
    r = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(120), prose(90)
    rows = [(i, prose(40) + " " + passage[r.integers(0, 60) :] + " " + prose(30)) for i in range(40)]
    rows += [(100 + i, prose(10) + other[i : len(other) - 3 * i]) for i in range(20)]
    rows += [(200, other + "é" + other), (201, "ab" * 900), (202, "x" * 399), (203, "x" * 399), (204, "y" * 400), (205, "y" * 400), (206, None), (207, ""), (208, prose(300)), (208, rows[0][1])]
    short = " ".join("ab" for _ in range(20)) + " " + " ".join(f"w{k}" for k in range(31))  # 51 words in under 400 bytes
    rows += [(300, "Begin. " + short + " end."), (301, short[:-1] + "z"), (302, "again " + short), (303, " ".join(f"v{k}" for k in range(60)) + " x " + " ".join(f"v{k}" for k in range(60)))]
    rows += [(310, "   " * 9000 + "q" * 3000), (311, "abc " * 400 + "the end"), (312, "x" * 500 + "y" * 500)]
    return rows


@pytest.mark.parametrize("group", [1000, 8, 1])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = repeats_fixture()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, segment string, copies int")
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=str) == brute_repeats(rows)


def test_repeats_edges(spark, edge):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(edge).collect()}
    assert got[1].n_bytes == 0 and got[7].n_removed == got[7].n_bytes == 57000 and got[6].n_removed == 100_000
    assert suffix_dedup.remove_repeats(edge.limit(0)).count() == 0


@pytest.mark.parametrize("group", [1000, 1])
def test_repeats_without_ids(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = [(None, t) for _, t in repeats_fixture()[:45]] + [(7, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)


def test_low_complexity_takes_little_room():
    """A long run is a few rows of a segment each, not one for each of its bytes."""
    import pyarrow as pa

    for text in ("x" * 200_000, "ab" * 100_000, "abcdefg" * 30_000):
        data = np.frombuffer(text.encode(), np.uint8)
        grams = np.unique(suffix_dedup.anchors(data)[0]).view(np.int64)
        batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([text]), pa.array([grams.tolist()], pa.list_(pa.int64()))], ["h1", "h2", "text", "grams"])
        with np.errstate(over="ignore"):
            assert sum(len(b) for b in suffix_dedup._cut_segments(iter([batch]))) <= 1000


def test_suffix_mergesort():
    data = np.frombuffer(b"banana$bandana$ban", np.uint8)
    with np.errstate(over="ignore"):
        text = suffix_dedup.Text(data, suffix_dedup.bytehash.BASE)
        start = np.arange(len(data))
        order = suffix_dedup.mergesort(text, start, len(data) - start, np.zeros(len(data), int))
    assert order.tolist() == sorted(start, key=lambda k: data[k:].tobytes())


def test_secrets(spark, edge):
    key, copied = "Qx7" + "a1B2" * 6, "EXAMPLEkey" + "0" * 10
    rows = [(1, f'password = "{key}" and ghp_{"A1b2" * 9}', "s1"), (2, f"api_key: {copied}", "s2"), (3, f"API-KEY {copied} token={copied}", "s3"), (4, f"secret: {copied}", "s4"), (5, "AKIA" + "Z9" * 8 + " deadbeef" + "0" * 12, "s1"), (6, "password=short", "s1"), (7, "ſecret=abcdefghijklm", "s1")]
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in secrets.secret_spans(df).collect()}
    assert (got[1].n_assign, got[1].n_live) == (1, 2) and "vendor:" in got[1].spans
    assert got[2].n_live == got[4].n_live == 0 and got[2].n_example == 1
    assert (got[5].n_access, got[5].n_hex) == (1, 1) and got[6].n_assign == got[7].n_assign == 0
    for i, t, _ in rows:
        base = sorted((s, k, e) for k, s, e, _ in secrets.find(t) if k < 3)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
    clean = {r.doc_id: r for r in secrets.redact_live(df.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert key not in clean[1].text and clean[1].text.count("[SECRET]") == 2 and copied in clean[2].text and clean[1].n_chars == len(clean[1].text)
    assert len(secrets.secret_spans(edge).collect()) == len(EDGE) and secrets.secret_spans(edge.limit(0)).count() == 0


def test_secrets_of_repeated_ids(spark):
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3)]
    rows = [(i, t) for i in (1, None) for t in ("short " + keys[0] + " end", "a longer way to " + keys[1] + " and on", "nothing here, but text that is long enough to be cut")] + [(1, "short " + keys[0] + " end"), (2, keys[2])]
    got = secrets.redact_live(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id bigint, text string, lang string, source string")).collect()
    want = [(i, re.sub("|".join(keys), "[SECRET]", t)) for i, t in rows]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_html(spark):
    body = "<p>First sentence, with words &amp; more.<br>Second line, still one block; see it.</p><p>Another <b>bold</b> paragraph, as long as it takes, to count.</p>"
    page = f'<html><head><title>T</title><script>var t="</p>";</script></head><body><header class="site-header">Brand</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>Head</h1>{body}<aside>Related</aside><form>Mail <input></form></article><section id="comments"><p>Nice one, thanks.</p></section><footer>&copy; x</footer></body></html>'
    want = "Head First sentence, with words & more. Second line, still one block; see it. Another bold paragraph, as long as it takes, to count."
    assert html_text.main_text(page) == want
    bare = f'<body><div id="menu"><a>One</a> <a>Two</a></div><div><h1>Head</h1>{body}</div><div class="footer">x</div>'
    assert html_text.main_text(bare) == want
    assert html_text.main_text("<p>a<p>b</p></b></div>c") == "a b c" and html_text.main_text("") == ""
    rows = [(1, "u", page), (2, None, None), (2, None, ""), (None, "u", "<b>x" * 3000)]
    got = html_text.extract(spark.createDataFrame([(*r, 3) for r in rows], "page_id bigint, url string, html string, n_chars int")).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got) == sorted([0, 0, 3000, len(want)])


def test_pages_have_their_articles(spark):
    for r in queries.op7_html_extraction(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r.text == article_of(r.html)


def test_html_of_articles_with_odd_parts():
    body = "".join(f"<p>Paragraph {k} is a sentence of some length, with commas, and it goes on for a while.</p>" for k in range(6))
    want = " ".join(f"Paragraph {k} is a sentence of some length, with commas, and it goes on for a while." for k in range(6))
    table = "<table>" + "".join(f"<tr><th>{k}</th><td>cell {k}</td><td>x{k}</td></tr>" for k in range(40)) + "</table>"
    cells = " ".join(f"{k} cell {k} x{k}" for k in range(40))
    assert html_text.main_text(f'<body><article><header class="entry-header"><h1>Head</h1></header>{body}{table}</article></body>') == f"Head {want} {cells}"
    assert html_text.main_text(f'<body><div class="content-sidebar-wrap"><div class="post"><h1>Head</h1>{body}</div></div></body>') == f"Head {want}"
    notes = "".join(f"<p>Reader {k} says that this is a sentence of some length, with commas, and that it goes on.</p>" for k in range(4))
    assert html_text.main_text(f'<body><article><h1>Head</h1>{body}<div class="comments">{notes}</div></article></body>') == f"Head {want}"
    links = "".join(f'<li><a href="/{k}">A link to page {k}</a></li>' for k in range(8))
    assert html_text.main_text(f"<body><ul>{links}</ul><div><h1>Head</h1>{body}<ul>{links}</ul></div></body>") == f"Head {want}"


def test_broken_markup_takes_linear_time():
    for junk in ('<b x="', "<b>x", "<div>x", "<div></p>", "< ", "<a \"> <b '>", "<!--", '<p class="', "<b x=' y=\"", "<td><b>", "<![CDATA[", "&lt;<"):
        page = junk * (1_000_000 // len(junk))
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 30, junk
    half = "<b>" + "<div>" * 60_000
    for page in (half + "</b>" * 60_000, half + "</p>" * 60_000, half + "<p>x" * 60_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 30


def overlap(a, b):
    a, b = collections.Counter(a.split()), collections.Counter(b.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())) if a or b else 1.0


def article_of(html):
    inner = re.search("<article>(.*?)</article>", html, re.S)[1]
    blocks = [re.sub(r"\s+", " ", html_text.entities.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x))).strip() for x in re.split("</?(?:p|h1)>", inner)]
    return " ".join(b for b in blocks if b)


def test_ratios_alone_find_the_articles(spark):
    """With articles, class words and HTML's own parts hidden from it, the method still selects the articles' paths."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    scores = [overlap(html_text.main_text(h, hints=False), article_of(h)) for h in pages]
    assert np.mean(scores) > 0.95 and np.mean(np.array(scores) >= 0.9) > 0.9


def plain_scores(page, own):
    """The method again, path by path and block by block."""
    key = lambda b: (page.elements[b.element].path, page.elements[b.element].named, page.elements[b.element].inside)

    def tags(path):
        out = []
        while path:
            out.append(path)
            path = page.paths[path]
        return out[::-1]

    by = collections.defaultdict(list)
    for b in own:
        by[key(b)].append(b)
    chars = {k: (1 + sum(len(b.text) - b.linked for b in v)) / len(v) for k, v in by.items()}
    marks = {k: (1 + sum(len(re.findall("[.,;:!?。、，！？]", b.text)) for b in v if b.linked < len(b.text))) / len(v) for k, v in by.items()}
    out = collections.defaultdict(list)
    for i, b in enumerate(own):
        c = m = w = 0.0
        for j in range(max(0, i - 2), min(len(own), i + 3)):
            p, q = tags(key(b)[0]), tags(key(own[j])[0])
            same = next((k for k, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q)))
            steps, both = len(p) + len(q) - 2 * same, len(p) + len(q)
            like = ((1 - steps / both) if both else 1.0) ** 4 * np.exp(-((i - j) ** 2) / 2) if i != j else 1.0
            c, m, w = c + like * chars[key(own[j])], m + like * marks[key(own[j])], w + like
        out[key(b)].append(np.sqrt(c / w * m / w))
    return {k: np.mean(v) * (1 / 8 if k[1] else 1) * (8 if k[2] else 1) for k, v in out.items()}


@pytest.mark.parametrize("hints", [True, False])
def test_path_scores_against_a_plain_version(spark, hints):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        page = html_text.Page(r.html, hints)
        own = [b for b in page.blocks if not page.elements[b.element].apart]
        got, want = html_text.path_scores(page, own), plain_scores(page, own)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * want[k] for k in want)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def plain_features(k, t, before):
    """The features of a proposal in plain Python."""
    b = before[-32:].lower().rsplit(";", 1)[-1]
    has = lambda pattern, x: float(bool(re.search(pattern, x)))
    return {
        "kind": float(k), "n_digits": len(re.sub("[^0-9]", "", t)), "n_letters": len(re.sub("[^A-Za-z]", "", t)), "n_breaks": len(re.sub(r"[^ ./()-]", "", t)),
        "round_bracket": float(t.startswith("(")), "dotted": float("." in t), "slashed": float("/" in t), "groups_334": has(r"^[(]?[0-9]{3}[)]?[ ./-]?[0-9]{3}[ ./-][0-9]{4}$", t),
        "like_date": has(r"^(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[./ -][01]?[0-9]([./ -][0-3]?[0-9])?)$", t),
        "says_phone": has("phone|tel|call|mobile|cell|fax|number is|reach|dial|whatsapp", b), "says_identity": has("ssn|social|security|tax|identity|national", b), "says_bank": has("iban|account|bank|wire|transfer", b),
        "says_contact": has("mail|contact|write|reach|address", b), "says_home": has("lives|lived|address|home|moved|send", b), "says_other": has("order|invoice|item|isbn|version|ref|part|page|serial|price|score|no[.]|ticket|model|between|ratio", b), "after_sign": has("[#$%=*&|/€£_]$", b),
        "n_chars": len(t), "n_upper": len(re.sub("[^A-Z]", "", t)), "n_distinct": len(set(t)), "quoted": has("[\"']", t), "spaced": t.count(" "),
        "placeholder": has("example|your|here|xxxx|changeme|required|placeholder|sample|none|null|test|dummy|12345", t.lower()), "area_bad": has("^(?:000|666|9[0-9][0-9])-", t),
    }


def plain_spans(t):
    """Base spans, and proposals off them that the trees of the model score at their kind's threshold or more."""

    def value(node, f):
        while isinstance(node, list):
            node = node[2] if f[node[0]] <= node[1] else node[3]
        return node

    base, model = base_pii(t), pii.model()
    out = list(base)
    for kind, (pattern, _) in pii.PROPOSED.items():
        python = pattern.replace(r"\p{Lu}", "[^\\W\\d_a-zß-öø-ÿ]").replace(r"[\p{L}-]", r"(?:[^\W\d_]|-)")
        for m in re.finditer(python, t):
            if not any(s < m.end() and m.start() < e for s, _, e in base):
                f = plain_features(k := pii.KINDS.index(kind), m[0], t[: m.start()])
                if 1 / (1 + np.exp(-2 * sum(w * value(tree, f) for w, tree in model["trees"]))) >= model["thresholds"][kind]:
                    out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_personal_data(spark, texts, edge):
    corpus = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    more = [(10**6, "a@b.c_d@e.fg x@y @z.com  1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567."), (10**6 + 1, "é 4111-1111-1111-1111 5 0.0.0.0256 +12345678 "), (10**6 + 2, "call me on (555) 123-4567 or ssn 123-45-6789; order 123-45-6789; mail: bob.x (at) mail (dot) com"), (10**6 + 6, "ask for Dr. Anna Keller, born on 3.12.1971, who lives at 12 Oak Street; password: changeme, token = 'Zx81pQ7rT5kLm2Nv', account 482913370415590, iban DE44 5001 0517 5407 3249 31"), (10**6 + 3, "1 " * 30000), (10**6 + 4, "a" * 50000 + "@" + "b." * 20000), (10**6 + 5, "+1" + "(" * 30000), (10**6 + 7, "token=" * 9000 + "Mr. " * 9000)]
    df = spark.createDataFrame(corpus + more, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in corpus + more[:4]:
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base_pii(t))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), i
        assert got[i].spans == plain_spans(t), i
    kinds = lambda i: {x.split(":")[0] for x in got[i].spans.split(",") if x}
    at = more[2][1].index("bob.x")
    assert got[10**6 + 2].spans == f"national:11:25,ssn:33:44,address:{at}:{len(more[2][1])}"
    assert {"person", "birth", "street", "credential", "account", "iban"} <= kinds(10**6 + 6) and "changeme" not in [more[3][1][int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[10**6 + 6].spans.split(",")]
    added = [i for i, t in corpus if got[i].n_more]
    assert len(added) >= 10 and all(re.search("(?i)(password|token|secret)|AKIA", dict(corpus)[i]) for i in added)
    assert len(pii.personal_data(edge).collect()) == len(EDGE) and pii.personal_data(edge.limit(0)).count() == 0


def test_trees_are_what_training_gives(spark):
    from quillstream.llm import pii_training

    model = pii_training.train(spark, spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for figures in model["held_out"].values():
        assert figures["precision"] >= 0.97 and figures["recall"] >= 0.95 and figures["personal"] >= 20
    assert model["thresholds"] == pii.model()["thresholds"]


@pytest.mark.parametrize("bucket", [1 << 24, 20_000])
def test_sharding(spark, docs, texts, bucket):
    got = sharding.sharded(docs, bucket_bytes=bucket).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len(t.encode()) + 1, __import__("zlib").crc32(t.encode())) for i, t in texts)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order) and [r.doc_id for r in sorted(sharding.sharded(docs, bucket_bytes=bucket).collect(), key=lambda r: (r.shard, r.slot))] == order


def test_sharding_edges(spark, edge):
    got = sharding.sharded(edge).collect()
    assert len(got) == len(EDGE) and {r.size for r in got if r.doc_id in (1, 2)} == {1}
    assert sharding.sharded(edge.limit(0)).count() == 0
    clash = edge.select("*", *[F.lit(1).alias(c) for c in ("shard", "slot", "_slot", "doc", "key", "bucket", "rank", "place")])
    got = sharding.sharded(clash.union(clash).repartition(3), bucket_bytes=20_000).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 2 * len(EDGE) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_decontamination(spark, edge):
    item = "If Maria buys 12 apples and 7 pears for 3 dollars each, how many dollars does Maria pay for all fruit in the end?"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id bigint, text string")
    rows = [(1, "Intro words here. " + item + " More."), (2, item.replace("Maria", "Paula").replace("12", "15").replace("7", "9")), (3, item.replace("Maria buys", "Paula buys")), (4, "If you buy apples and pears, nothing is said of it at all."), (5, item.upper().lower()), (6, None), (7, ""), (2, item)]
    got = {(r.doc_id, r.item_id): r for r in contaminated(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, item_id int"), bench).collect()}
    assert (1, 1) in got and (2, 1) in got and not {k for k in got if k[0] in (4, 6, 7)}
    assert (3, 1) not in got  # one slot, two values
    assert contaminated(edge, bench).count() == 0 and contaminated(edge.limit(0), bench).count() == 0 and contaminated(edge, bench.limit(0)).count() == 0


def test_decontamination_tells_numbers_apart_by_place(spark):
    item = "If a farmer has 3 apples and 3 pears in a basket, how many pieces of fruit are in the basket in the end?"
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, text string")
    got = contaminated(frame([(1, item.replace("3 apples", "5 apples").replace("3 pears", "7 pears"))], "doc_id"), frame([(1, item)], "item_id")).collect()
    assert len(got) == 1 and got[0].n_changed_slots == 2 and got[0].words_covered == got[0].item_words


def test_decontamination_of_loose_and_short_items(spark):
    items = {1: "Compute 12 + 30 * 7 - 4", 2: "Solve 3x + 5 = 20", 3: "中文句子没有空格", 4: "Capital of Peru?", 5: "Solve 8", 6: "Add 7 kg to 9 kg, then say how many kg of rice Maria has with 4 kg 5 g 6 g 7 g more", 7: "", 8: "?!", 9: "who wrote this famous book"}
    docs = {i: "Before it. " + t + " After it." for i, t in items.items()} | {101: "Compute 13 + 30 * 7 - 4", 102: "Solve 3x + 5 = 21", 103: "中文句子没有空格吗", 104: "Capital in Peru?", 105: "Solve 9", 106: "1 2 3 4 5 6 7 8 9", 107: "", 108: None}
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert sorted(got) == [(i, i) for i in (1, 2, 3, 4, 5, 6, 9)] + [(101, 1)]
    assert all(r.words_covered == r.item_words and r.n_changed_slots == (d == 101) for (d, _), r in got.items()) and got[4, 4].item_words == 3


def test_decontamination_finds_dense_items_with_other_numbers(spark):
    """Items made mostly of numbers and names, re-numbered: found whole; their pieces in another order, and texts that only share
    their numbers, aren't."""
    items = {1: "Compute 12 + 30 * 7 - 4", 2: "Solve 12 + 7 x 3 - 4 = 9 and then 15 + 6 x 2 for Maria and Paul now", 3: "Take 3 4 5 6 7 from 9 8 7 6 5 and add 1 2 3 4", 4: "Order Anna, Ben, Carl, Dora and Emil by 12 13 14 15 points"}
    change = lambda t: re.sub(r"\d+", lambda m: str(int(m[0]) * 7 + 1), t)
    docs = {i: "It says so. " + change(t) + " That is all." for i, t in items.items()}
    docs |= {11: "compute it with 1 2 3 4 of them", 12: "and add 5 6 7 8 or from 1 1 1 1 1 or take 2 2 2 2 2 here", 13: "1 2 3 4 5 6 7 8 9", 15: change(items[2]).replace("Maria", "Olga").replace("Paul", "Nina")}
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} bigint, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (15, 2)}


def test_decontamination_recall_of_renumbered_benchmark(spark):
    """Every item of the given table with other numbers in a text of its own: nearly all are found, in their own text only."""
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select("item_id", "text")
    change = lambda t: re.sub(r"\d+", lambda m: str(int(m[0]) * 3 + 2), t)
    rows = [(r.item_id, "Once there was this. " + change(r.text) + " So it goes.") for r in bench.collect() if r.text]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert len({d for d, i in got if d == i}) >= 0.9 * len(rows)
    same = {i: re.sub(r"\d+", "#", t) for i, t in rows}
    assert not {(d, i) for d, i in got if d != i and same[d] != same[i]}


def test_decontamination_copies_no_words_for_each_window(spark):
    """A generator with a higher-order function in it leaves the generated code and copies a text's words for each window."""
    sf = "/root/testdata/sf0.001"
    plan = contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    generators = [x for x in plan.splitlines() if "Generate " in x]
    assert generators and not [x for x in generators if "lambda" in x]


def test_long_text_with_many_windows_of_the_benchmark(spark):
    """Rows of one text that Spark holds together after the join have a window's words, not the text's."""
    rnd = random.Random(4)
    some = ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(5000)]
    passage = " ".join(rnd.choices(some, k=40))
    docs = spark.createDataFrame([(1, " ".join(rnd.choices(some, k=20_000)) + " " + passage)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, passage) for i in range(100)], "item_id bigint, text string")
    found = contaminated(docs, bench)
    (pairs,) = {x.strip() for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "zip_with(_is" in x}
    assert "_dw" not in pairs
    assert sorted((r.item_id, r.words_covered) for r in found.collect()) == [(i, 40) for i in range(100)]


def test_texts_without_a_crowd_have_no_loose_or_dense_windows(spark):
    rnd = random.Random(3)
    some = ["word", "other", "naïve", "Maria", "Paul", "12", "7 kg", "3.5", "x2", "4th", "中文", "-", ", ", "\n", "İA", "5,000 miles"]
    rows = [(i, "so " + rnd.choice([" ", " ", ", ", ". "]).join(rnd.choices(some, [6, 6, 4, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], k=rnd.randint(0, 14)))) for i in range(4000)]
    seen = {True: 0, False: 0}
    for r in template_words(spark.createDataFrame(rows, "i int, text string"), "text", "w").collect():
        mark = [w[0] < "\x04" for w in r.w]
        crowd = any(sum(mark[k : k + 5]) > 2 for k in range(len(mark) - 2))
        assert r.w_m or not crowd, r.text  # a few more may be taken for crowded
        seen[r.w_m] += 1
    assert min(seen.values()) > 500


def test_units_follow_numbers_only(spark):
    text = "at 12 kg and 1,000.5 km/h, 7 miles x9 m a 5  s " + "1" * 40 + " g " + "1" * 41 + " g 3 minutesa 4 mm5 m"
    (r,) = template_words(spark.createDataFrame([(text,)], "text string"), "text", "w").collect()
    assert [w[1:] for w in r.w if w[0] == "\x03"] == ["kg", "km", "miles", "g"]
    assert r.w_k[:4] == ["at", "\x01", "\x03", "and"]


def test_hostile_texts_take_seconds(spark):
    """A megabyte of each pattern's worst case, and of text without blanks."""
    worst = ["-eyJ" * 250_000, "eyJaaaaaaaa." * 90_000, ".eyJaaaaaaaa" * 90_000, "token " * 170_000, "token" + " " * 10**6, "-----BEGIN PRIVATE KEY-----" * 40_000, "://a" * 250_000, "://a:" + "b" * 10**6, "sk-" * 330_000, "xoxb-" * 200_000, "AKIA" * 250_000]
    began = time.time()
    for t in worst:
        secrets.find(t)
    assert time.time() - began < 15
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load(queries.TOKENIZER, True))
    began = time.time()
    with np.errstate(over="ignore"):
        for t in ("中文句子没有空格" * 41_000, "x" * 10**6):
            ids = codec.encode([t])[0]
            assert codec.decode(ids.tolist()) == t
    assert time.time() - began < 60


def test_web_tokens_are_those_of_the_plain_pattern():
    plain = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    rnd, some = random.Random(1), 0
    for _ in range(20_000):
        t = "".join(rnd.choice(["eyJ", "eyJ", "a", "-", ".", ".eyJ", "b" * 8, "c" * 9, " ", "_", "eyJdddddddd"]) for _ in range(rnd.randint(1, 16)))
        want = [(m.start(), m.end()) for m in plain.finditer(t)]
        some += bool(want)
        assert list(secrets._tokens(t)) == want
    assert some > 100


def test_long_words_are_those_of_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    codec, rnd = sentencepiece_codec.Codec(sentencepiece_codec.load(queries.TOKENIZER, True)), random.Random(2)
    with np.errstate(over="ignore"):
        for t in ("abcabcthequickbrown" * 200, "中文句子没有空格" * 300, "".join(rnd.choice("aeioutnrshé中") for _ in range(5000)), "x" * 3000, "http://" + "a/b?c=d&" * 500):
            assert codec.encode([t])[0].tolist() == sp.encode(t)


def test_texts_are_cut_where_no_piece_goes_on():
    """Words joined by marks that no piece holds beside a letter are learnt once each, and their ids are those of the library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load(queries.TOKENIZER, True))
    some = ["alpha", "Beta", "gamma", "naïve", "中文", "délta", "x", "stone", "river", "😀"]
    texts = [f"{a},{b}\n{c}" for a in some for b in some for c in some] + ["", " ", "  two  spaces ", "a \u2581 b", "\u2581", "3.14,15;(x)'s--y", "a\r\n\tb\x00c"]
    with np.errstate(over="ignore"):
        ids, at, back = codec.encode_flat(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == sp.encode(t)
        assert "\u2581" in t or back[i] == (codec.decode(ids[at[i] : at[i + 1]].tolist()) == t)
    assert len(codec.kept) < 100


def test_marks_of_space_are_not_given_back(spark):
    rows = [(1, "a b"), (2, "a \u2581 b"), (3, "\u2581"), (4, None), (5, ""), (6, " "), (7, "a\n😀b ")]
    got = sentencepiece_codec.tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), queries.TOKENIZER).collect()
    assert {r.doc_id: r.round_trip for r in got} == {i: i not in (2, 3) for i, _ in rows}


def test_html_keeps_parts_of_the_article_and_drops_threads():
    para = ["The first part, written at length, says what was found; it goes on for a while, and then it stops.", "The second, which is no shorter, adds what was left out, and weighs both, one against the other."]
    body = "".join(f"<p>{p}</p>" for p in para)
    comment = lambda who, when, what: f'<div class="c-item"><p>{who}</p><p>{when}</p><p>{what}</p></div>'
    thread = '<div class="c-thread">' + comment("Anna Berg", "2 May 2024", "I liked it, but the end, to me, was rather weak, and far too long for what it says.") + comment("ben", "3 hours ago", "So did I, and more than once, though I can't say why it was so.") + comment("Cy", "2024-05-03 10:20", "No.") + "</div>"
    refs = "".join(f'<li><a href="/r{i}">Writer {i}, a book on things, part {i}</a></li>' for i in range(4))
    want = " ".join(["Head", *para])
    assert html_text.main_text(f'<body><nav><a href="/">x</a></nav><article><h1>Head</h1><p>{para[0]}</p><div class="related-work"><p>{para[1]}</p></div></article></body>') == want
    assert html_text.main_text(f"<body><article><h1>Head</h1>{body}<ul>{refs}</ul></article></body>") == want + " " + " ".join(f"Writer {i}, a book on things, part {i}" for i in range(4))
    for page in (f"<body><article><h1>Head</h1>{body}</article>{thread}</body>", f"<body><article><h1>Head</h1>{body}{thread}</article></body>", f'<body><div class="post"><h1>Head</h1>{body}</div>{thread}</body>'):
        assert html_text.main_text(page) == want
    # entries with headings, rows of a table and short boxes aren't threads
    log = "".join(f"<div><h3>Version {i}</h3><p>2024-01-0{i}</p><p>It was changed in part, and in part it wasn't.</p></div>" for i in range(1, 4))
    assert "Version 2" in html_text.main_text(f"<body><article><h1>Head</h1>{body}{log}</article></body>")
    table = "".join(f"<tr><td>Anna {i}</td><td>2024-01-0{i}</td><td>a value, and more</td></tr>" for i in range(1, 4))
    assert "Anna 2" in html_text.main_text(f"<body><article><h1>Head</h1>{body}<table>{table}</table></article></body>")
    box = '<div class="related"><p>More</p></div><div class="newsletter"><p>Sign up, it is free.</p></div>'
    assert html_text.main_text(f"<body><article><h1>Head</h1>{body}{box}</article></body>") == want
