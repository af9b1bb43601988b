"""The pipeline against brute force of its stages."""

from __future__ import annotations

import collections

import duckdb
import pandas as pd
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import oracles, queries, secrets

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from tests.llm.test_operators import brute_near

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in queries.op1_quality_rules(spark, DATA).collect() if r.kept}
    rows = {r.doc_id: r.text for r in docs.collect()}
    near = brute_near([(i, rows[i]) for i in sorted(kept)], corpus_pipeline.SHINGLE)
    alone = {i for i, (_, c) in near.items() if c == i}
    step = docs
    seen = []
    for name, f in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.stage(f(spark, step, DATA), name)
        assert step.columns == columns
        seen.append({r.doc_id: r.text for r in step.collect()})
    assert set(seen[0]) == kept and set(seen[1]) == alone
    # the items that are left in a document, by the SQL of the operator on what the stage before kept
    c = duckdb.connect()
    c.register("documents", pd.DataFrame([(i, rows[i]) for i in sorted(alone)], columns=["doc_id", "text"]))
    c.execute(f"create view benchmark as select * from '{DATA}/benchmark.parquet'")
    holds = {i for (i,) in c.sql(f"select distinct doc_id from ({oracles.ORACLES['op10_benchmark_decontamination']})").fetchall()}
    assert set(seen[2]) == alone - holds and holds
    assert seen[3] == redacted_by_force({r.doc_id: r for r in docs.collect()}, seen[2]) and seen[3] != seen[2]
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(seen[3]) and all(r.token_ids == sp.encode(seen[3][r.doc_id]) for r in got)


def redacted_by_force(rows, texts):
    """The texts with values that few owners hold replaced; equal ones elsewhere, and examples, stay."""
    owners, repositories = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in texts.items():
        for _, _, _, value in secrets.find(t):
            owners[value].add(rows[i].source or "")
            repositories[value].add(((rows[i].source or ""), (rows[i].lang or "")))
    out = {}
    for i, t in texts.items():
        live = sorted((a, b) for _, a, b, value in secrets.find(t) if len(owners[value]) < secrets.OWNERS and len(repositories[value]) < secrets.REPOSITORIES)
        done, at = "", 0
        for a, b in live:
            if a > at or not done and not at:
                done += t[at:a] + "[SECRET]"
            at = max(at, b)
        out[i] = done + t[at:]
    return out


def test_names_and_ids_that_clash(spark):
    """Columns with the names that the stages use come through, and ids leave no room above them."""
    key = "0123456789abcdef0123"
    top = 2**63 - 1
    prose = lambda a: " ".join(f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70))
    rows = [(top, prose("q")), (top, prose("w") + " " + key), (None, prose("q")), (top - 1, prose("z")), (7, prose("v"))]
    extra = ["_copy", "_again", "_first", "_found", "_gone", "_row", "_n", "_p", "_size", "_before", "_text", "_d", "_m", "_i", "_h1", "row", "kept", "component_id", "_Row"]
    step = spark.createDataFrame([(*r, "en", "s", len(r[1]), *range(len(extra))) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in extra if c != "_Row") + ", last int")
    columns = step.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.stage(f(spark, step, DATA), name)
        assert step.columns == columns
    got = step.select("doc_id", "text", "_copy", "_again").collect()
    assert sorted((r.text for r in got)) == sorted([prose("q"), prose("w") + " [SECRET]", prose("z"), prose("v")]) and {(r["_copy"], r["_again"]) for r in got} == {(0, 1)}
    assert corpus_pipeline.STAGES[-1][1](spark, step, DATA).count() == 4


def test_rows_without_ids(spark):
    """Rows with null ids are judged each by itself, and clean ones come through."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    prose = lambda a: " ".join(f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70))
    key = "0123456789abcdef0123"
    rows = [(None, prose("q")), (None, prose("r") + " " + key), (None, prose("r") + " " + key), (None, prose("s") + "\n" + item), (1, prose("t")), (None, prose("t"))]
    step = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    columns = step.columns
    for name, f in corpus_pipeline.STAGES[1:-1]:
        step = corpus_pipeline.stage(f(spark, step, DATA), name)
        assert step.columns == columns
    want = [(None, prose("q")), (None, prose("r") + " [SECRET]"), (1, prose("t"))]
    assert sorted(((r.doc_id, r.text) for r in step.collect()), key=str) == sorted(want, key=str)
