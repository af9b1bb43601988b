"""Personal data: high-recall span generators scored by gradient boosted trees.

The base kinds (email, ip, card, phone) are exact patterns with a check; their spans always stay. Further generators
propose spans that may overlap: spelled-out addresses, national numbers without a plus sign, social security, bank and
other account numbers, credentials, persons with a title, streets and dates of birth. Boosted trees score each proposal
by its format and the words around it, and a calibrated threshold of its kind decides. The trees are trained by
``pii_training`` on proposals of a bounded sample of documents and on made-up sentences for what those lack, and kept in
``pii_model.json``; scoring is one SQL expression.

Native: DataFrame functions only; everything happens in the row, nothing is shuffled. Patterns are possessive and start
at the edge of a run, so a long text takes linear time and no deep recursion.
"""

from __future__ import annotations

import functools
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, cheap test that a text may hold it). The order is the order of kinds at one start.
BASE = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(_x, '@')"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", "_num"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11,}+", "_num"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "_num and contains(_x, '+')"),
}
VALID = {
    "email": "true",
    "ip": "forall(split(m.t, '[.]'), x -> coalesce(try_cast(x as bigint), 999) <= 255)",
    "card": "length(translate(m.t, ' -', '')) <= 19 and aggregate(transform(sequence(1, length(translate(m.t, ' -', ''))), i -> cast(substring(reverse(translate(m.t, ' -', '')), i, 1) as int) * if(i % 2 = 0, 2, 1)), 0, (a, d) -> a + if(d > 9, d - 9, d)) % 10 = 0",
    "phone": "length(regexp_replace(m.t, '[^0-9]', '')) between 9 and 15",
}
PROPOSED = {
    "address": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}+[ ]?(?:\(at\)|\[at\]|[ ]at[ ])[ ]?[A-Za-z0-9-]{2,40}+(?:[ ]?(?:\(dot\)|\[dot\]|[ ]dot[ ])[ ]?[A-Za-z]{2,12}+)+", "contains(_x, 'at') and contains(_x, 'dot')"),
    "national": (r"(?<![A-Za-z0-9.+-])\(?[0-9]{2,5}+\)?[ ./-]?[0-9]{2,4}+[ ./-][0-9]{2,5}+(?:[ ./-][0-9]{1,4}+)?(?![A-Za-z0-9.-])", "_num"),
    "ssn": (r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", "_num and contains(_x, '-')"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "_num"),
    "account": (r"(?<![A-Za-z0-9.+-])[0-9]{12,19}+(?![A-Za-z0-9])", "_num"),
    "credential": (r"(?i:password|passwd|secret|token|api_?key)[\"\x27]?[ ]{0,3}[:=][ ]{0,3}[\"\x27]?[A-Za-z0-9+/_.=-]{8,}+", "(contains(_x, '=') or contains(_x, ':'))"),
    "access": (r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{8,}+", "contains(_x, 'AKIA')"),
    "person": (r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)[.]?[ ]\p{Lu}[\p{L}-]{1,30}+(?:[ ]\p{Lu}[\p{L}-]{1,30}+)?", "_x rlike '(?:Mr|Ms|Dr|Prof|Herr|Frau|Mme|Sra)'"),
    "street": (r"(?<![A-Za-z0-9])[0-9]{1,5}+[ ]\p{Lu}[\p{L}-]{1,30}+(?:[ ]\p{Lu}[\p{L}-]{1,30}+)?[ ](?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard)(?![A-Za-z])", "_num"),
    "birth": (r"(?i:born|birth|dob|geboren|nacid[oa])[^0-9\n]{0,20}[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}(?![0-9])", "_num"),
}
KINDS = [*BASE, *PROPOSED]
#: Features of a proposal; t: its text, b: 32 characters before it in lower case, from the last semicolon on (what an
#: earlier item of a list is called says nothing of this one), a: the character after it.
FEATURES = {
    "kind": "m.k",
    "n_digits": "length(regexp_replace(m.t, '[^0-9]', ''))",
    "n_letters": "length(regexp_replace(m.t, '[^A-Za-z]', ''))",
    "n_breaks": "length(regexp_replace(m.t, '[^ ./()-]', ''))",
    "round_bracket": "cast(startswith(m.t, '(') as int)",
    "dotted": "cast(contains(m.t, '.') as int)",
    "slashed": "cast(contains(m.t, '/') as int)",
    "groups_334": "cast(m.t rlike '^[(]?[0-9]{3}[)]?[ ./-]?[0-9]{3}[ ./-][0-9]{4}$' as int)",
    "like_date": r"cast(m.t rlike '^(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[./ -][01]?[0-9]([./ -][0-3]?[0-9])?)$' as int)",
    "says_phone": "cast(m.b rlike '(?:phone|tel|call|mobile|cell|fax|number is|reach|dial|whatsapp)' as int)",
    "says_identity": "cast(m.b rlike '(?:ssn|social|security|tax|identity|national)' as int)",
    "says_bank": "cast(m.b rlike '(?:iban|account|bank|wire|transfer)' as int)",
    "says_contact": "cast(m.b rlike '(?:mail|contact|write|reach|address)' as int)",
    "says_home": "cast(m.b rlike '(?:lives|lived|address|home|moved|send)' as int)",
    "says_other": "cast(m.b rlike '(?:order|invoice|item|isbn|version|ref|part|page|serial|price|score|no[.]|ticket|model|between|ratio)' as int)",
    "after_sign": "cast(m.b rlike '[#$%=*&|/€£_]$' as int)",
    "n_chars": "length(m.t)",
    "n_upper": "length(regexp_replace(m.t, '[^A-Z]', ''))",
    "n_distinct": "size(array_distinct(split(m.t, '')))",
    "quoted": r"cast(m.t rlike '[\x22\x27]' as int)",
    "spaced": "length(m.t) - length(replace(m.t, ' ', ''))",
    "placeholder": "cast(lower(m.t) rlike '(?:example|your|here|xxxx|changeme|required|placeholder|sample|none|null|test|dummy|12345)' as int)",
    "area_bad": "cast(m.t rlike '^(?:000|666|9[0-9][0-9])-' as int)",
}
MODEL = Path(__file__).with_name("pii_model.json")


def _found(kind: str, valid: str = "true") -> Column:
    """Array of spans of one kind: (k, s, e, t), from the matches and the text between them."""
    pattern, test = (BASE | PROPOSED)[kind]
    quoted = "r'" + pattern + "'"
    k = KINDS.index(kind)
    spans = f"""
      if({test}, aggregate(
        zip_with(regexp_extract_all(_x, {quoted}, 0), split(_x, {quoted}, -1), (t, p) -> struct(t, p)),
        struct(0 as at, cast(array() as array<struct<k: int, s: int, e: int, t: string>>) as out),
        (acc, m) -> struct(cast(acc.at + length(m.p) + coalesce(length(m.t), 0) as int) as at,
          if(m.t is null, acc.out, array_append(acc.out, struct({k} as k, cast(acc.at + length(m.p) as int) as s, cast(acc.at + length(m.p) + length(m.t) as int) as e, m.t as t))) as out),
        acc -> acc.out), cast(array() as array<struct<k: int, s: int, e: int, t: string>>))"""
    return F.expr(f"filter({spans}, m -> {valid})" if valid != "true" else spans)


def candidates(docs: DataFrame) -> DataFrame:
    """docs with _base, the checked spans of the base kinds, and _more, the proposals off them with their surroundings."""
    df = docs.withColumn("_x", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("_num", F.col("_x").rlike("[0-9]"))
    df = df.withColumn("_base", F.concat(*[_found(k, VALID[k]) for k in BASE]))
    df = df.withColumn("_all", F.concat(*[_found(k) for k in PROPOSED]))
    free = "filter(_all, m -> not exists(_base, o -> o.s < m.e and m.s < o.e))"
    return df.withColumn("_more", F.expr(f"transform({free}, m -> struct(m.k as k, m.s as s, m.e as e, m.t as t, substring_index(lower(substring(_x, greatest(m.s - 31, 1), least(m.s, 32))), ';', -1) as b, substring(_x, m.e + 1, 1) as a))"))


def _tree(node: list) -> str:
    """[feature, threshold, left, right] or a leaf's value, as an expression over the features f."""
    if not isinstance(node, list):
        return repr(float(node)) + "D"
    name, at, low, high = node
    return f"if(f.{name} <= {float(at)!r}D, {_tree(low)}, {_tree(high)})"


@functools.cache
def model() -> dict:
    return json.loads(MODEL.read_text())


def score(trees: list) -> str:
    """Probability that a proposal with features f is personal data."""
    total = " + ".join(f"{float(w)!r}D * {_tree(t)}" for w, t in trees)
    return f"1 / (1 + exp(-2 * ({total})))"


def features() -> str:
    return "struct(" + ", ".join(f"cast({e} as double) as {n}" for n, e in FEATURES.items()) + ")"


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_spans for each row.

    ``n_more`` counts the spans that the trees add, ``n_spans`` all.

    ``docs``: doc_id, text; other columns are ignored. Null and empty texts have no spans (base_sha256 is that of the
    empty string). Rows that repeat a doc_id are judged each by itself. An empty table gives no rows. Offsets count code
    points, ends are exclusive.
    """
    m = model()
    df = candidates(docs.select("doc_id", "text"))
    least = "element_at(map(" + ", ".join(f"{KINDS.index(k)}, {float(v)!r}D" for k, v in m["thresholds"].items()) + "), m.k)"
    df = df.withColumn("_scored", F.expr(f"transform(_more, m -> struct(m, {features()} as f))"))
    df = df.withColumn("_kept", F.expr(f"transform(filter(_scored, c -> {score(m['trees']).replace('f.', 'c.f.')} >= {least.replace('m.k', 'c.m.k')}), c -> c.m)"))
    text = lambda spans: f"array_join(transform(array_sort(transform({spans}, m -> struct(m.s as s, m.k as k, m.e as e))), m -> concat(element_at(array({', '.join(repr(k) for k in KINDS)}), m.k + 1), ':', m.s, ':', m.e)), ',')"
    counts = [F.expr(f"cast(size(filter(_base, m -> m.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    every = "concat(transform(_base, m -> struct(m.k as k, m.s as s, m.e as e)), transform(_kept, m -> struct(m.k as k, m.s as s, m.e as e)))"
    return df.select("doc_id", *counts, F.sha2(F.expr(text("_base")), 256).alias("base_sha256"), F.expr(text(every)).alias("spans"), F.size("_kept").cast("long").alias("n_more"), (F.size("_base") + F.size("_kept")).cast("long").alias("n_spans"))
