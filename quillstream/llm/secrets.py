"""Secret scans with corpus-wide ownership frequency.

One pass finds candidate spans. The values' hashes are counted over distinct owners and repositories of the whole corpus:
a value that many owners hold is a copied example; one that few hold looks like a live credential. The base kinds
(assign, access, hex) always stay; spans of the further kinds stay where their value looks live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.staging import map_arrow, stage

#: kind -> (pattern, group that holds the value, its least length). The order is the order of kinds at one start.
BASE = {
    "assign": (re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 1, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
MORE = {
    "vendor": (re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{24,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{30,})"), 0, 20),
    "jwt": (re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"), 0, 28),  # its second and third part, see _tokens
    "pem": (re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----"), 0, 60),
    "login": (re.compile(r"://[A-Za-z0-9._-]+:([A-Za-z0-9._~!$*+=-]+)@"), 1, 6),
}
KINDS = [*BASE, *MORE]
#: A value held by so many owners, or so many repositories, is a copied example.
OWNERS, REPOSITORIES = 3, 6
#: A text without any of this holds no span of any kind (Java syntax).
HINTS = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|gh[pousr]_|sk-|xox|AIza|eyJ|-----BEGIN|://[A-Za-z0-9._-]+:"
#: Holders of a value are dealt over this many tasks.
SALT = 32
SPANS = "array<struct<k: int, s: int, e: int, value: string>>"


_NO_PART = re.compile(r"[^A-Za-z0-9_-]")
_FIRST = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8}")


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of web tokens, ``eyJ….eyJ….…`` with eight characters or more in each part, leftmost first.

    Parts hold no dots, so the last two are looked for, and then the first part's leftmost start in the run of characters
    before them. Each character is looked at a few times at most, whatever the text.
    """
    second, done = MORE["jwt"][0], 0
    m = second.search(text)
    before = 0  # no run of characters goes on before here
    while m:
        dot = m.start()
        for stop in _NO_PART.finditer(text, max(before, done), dot):
            before = stop.end()
        at = max(before, done)
        first = _FIRST.search(text, at, dot)
        # a run that begins where the last token ended goes on, and has no start there
        if first:
            yield first.start(), m.end()
            done = m.end()
        before = max(before, dot + 1)
        m = second.search(text, max(dot + 1, done))


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, SHA-256 of the value) of the spans of a text."""
    out = []
    for k, (kind, (pattern, group, least)) in enumerate((BASE | MORE).items()):
        if kind == "jwt":
            out += [(k, a, b, hashlib.sha256(text[a:b].encode("utf-8", "replace")).hexdigest()) for a, b in _tokens(text) if b - a >= least]
            continue
        out += [(k, m.start(), m.end(), hashlib.sha256(m[group].encode("utf-8", "replace")).hexdigest()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("value", pa.string())]))
    for batch in batches:
        found = [[dict(zip(("k", "s", "e", "value"), x, strict=True)) for x in find(t or "")] for t in batch.column("text").to_pylist()]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(found, kind)], [*rest, "spans"])


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, *carry: Column) -> DataFrame:
    """row, doc_id, the columns ``carry`` and judged spans (s, k, e, value, live) of each row of ``docs`` (doc_id, text, lang, source).

    The owner of a document is its source and its repository the source and language, unless other columns are given;
    null owners count as one owner. ``row`` numbers the rows. Null and empty texts have no spans.
    """
    owner = F.coalesce(F.col("source"), F.lit("")) if owner is None else owner
    repository = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if repository is None else repository
    rows = docs.select("doc_id", "text", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), *carry)
    rest = [(c, kind) for c, kind in rows.dtypes if c != "text"]
    rows = map_arrow(rows, _scan, ", ".join(f"{c} {kind}" for c, kind in rest) + f", spans {SPANS}")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    each = rows.where("size(spans) > 0").select("row", "owner", "repository", F.explode("spans").alias("m"))
    held = each.select(F.col("m.value").alias("value"), "owner", "repository").distinct()
    freq = held.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repositories"))
    verdict = stage(freq.where(f"owners < {OWNERS} and repositories < {REPOSITORIES}").select("value"), "secret-live-values")
    live = verdict.select("value", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.lit(True).alias("live"))
    marked = each.select("row", "m.*", F.pmod("row", F.lit(SALT)).cast("int").alias("salt")).join(live, ["value", "salt"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
    judged = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "value", "live"))).alias("judged"))
    return rows.drop("owner", "repository", "spans").join(judged, "row", "left")


def secret_spans(docs: DataFrame, **columns: Column) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of each row.

    Other columns are ignored. Null and empty texts have no spans (base_sha256 is that of the empty string). Rows that
    repeat a doc_id are judged each by itself. An empty table gives no rows. Offsets count code points, ends are
    exclusive.
    """
    df = scan(docs, **columns).withColumn("judged", F.expr("coalesce(judged, cast(array() as array<struct<s: int, k: int, e: int, value: string, live: boolean>>))"))
    names = ", ".join(repr(k) for k in KINDS)
    text = lambda keep: F.expr(f"array_join(transform(filter(judged, m -> {keep}), m -> concat(element_at(array({names}), m.k + 1), ':', m.s, ':', m.e)), ',')")
    counts = [F.expr(f"cast(size(filter(judged, m -> m.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    live = [F.expr(f"cast(size(filter(judged, m -> {c})) as bigint)").alias(n) for n, c in (("n_live", "m.live"), ("n_example", "not m.live"))]
    base = f"m.k < {len(BASE)}"
    return df.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(f"{base} or m.live").alias("spans"), *live)


def redact_live(docs: DataFrame, mark: str = "[SECRET]", **columns: Column) -> DataFrame:
    """``docs`` with ``mark`` in place of each stretch that spans of live-looking values cover, and n_chars to match.

    All rows and columns stay. Rows that repeat a doc_id, null ones too, are redacted each by its own text. Examples stay
    in the text.
    """
    # a text's live spans depend on the text alone, so they are joined to rows of that very text, once per doc_id and text
    h1, h2 = F.xxhash64("text"), F.xxhash64(F.lit(7), "text")
    owner, repository = columns.get("owner"), columns.get("repository")
    found = scan(docs, owner, repository, h1.alias("h1"), h2.alias("h2")).where("exists(judged, m -> m.live)")
    found = found.select(F.col("doc_id").alias("_d"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.expr("filter(judged, m -> m.live)").alias("_m"))
    found = stage(found.dropDuplicates(["_d", "_h1", "_h2"]), "secret-live")
    # a piece of text before each span, from where the spans before it end
    pieces = "transform(_m, (m, i) -> struct(if(i = 0, 0, array_max(transform(slice(_m, 1, i), x -> x.e))) as p, m.s as s))"
    text = f"concat(array_join(transform({pieces}, (x, i) -> if(x.s > x.p or i = 0, concat(substring(_row.text, x.p + 1, x.s - x.p), '{mark}'), '')), ''), substring(_row.text, array_max(transform(_m, x -> x.e)) + 1))"
    # only texts that may hold a secret are joined, so the others aren't shuffled
    maybe = F.coalesce(F.col("text").rlike(HINTS), F.lit(False))
    held = docs.where(maybe).select(F.struct("*").alias("_row"), F.col("doc_id").alias("_i"), h1.alias("_t1"), h2.alias("_t2")).hint("merge")
    held = held.join(found, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_t1") == F.col("_h1")) & (F.col("_t2") == F.col("_h2")), "left")
    held = held.withColumn("_text", F.expr(f"if(_m is null, _row.text, {text})"))
    own = {"text": F.col("_text"), "n_chars": F.expr("if(_m is null, _row.n_chars, cast(length(_text) as bigint))") if "n_chars" in docs.columns else None}
    return docs.where(~maybe).union(held.select(*[own[c].alias(c) if c in own else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))
