"""Types that a user names, a ladder of words for documents without a type, and a registry that lacks its seeds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.seeds import TYPE_NAMES
from quillstream.operators.classify import ORDER

#: Words, type and family, the first rung first.
LADDER = (
    (("resume", "cv", "curriculum vitae", "work experience", "skills", "projects"), "Resume / CV", "employment"),
    (("invoice", "tax invoice", "bill to"), "Commercial Invoice", "financial"),
    (("receipt", "subtotal", "cashier"), "Store / Retail Receipt", "financial"),
    (("bank statement", "account balance", "withdrawal"), "Bank Statement", "financial"),
    (("certificate", "diploma", "certify that"), "Certificate", "academic"),
)
FOUND, UNKNOWN = 0.95, ("Unknown Document", "general", 0.5)


def named_type(hint: Column) -> Column:
    """The type that a user's word names, itself or by an alias; null for auto, none, and words that name no type."""
    word = F.trim(F.lower(hint))
    known = F.create_map(*[F.lit(x) for t in ORDER for x in (t, t)], *[F.lit(x) for pair in TYPE_NAMES for x in pair])
    return F.when(word != "auto", F.try_element_at(known, word))


def hinted(classified: DataFrame, hint: str) -> DataFrame:
    """``classified`` (doc_type, doc_confidence) with the user's type, at confidence 1, where the column ``hint`` names one."""
    named = named_type(F.col(hint))
    return classified.withColumns({"doc_type": F.coalesce(named, "doc_type"), "doc_confidence": F.when(named.isNotNull(), 1.0).otherwise(F.col("doc_confidence"))})


def ladder(file_name: Column, text: Column) -> Column:
    """struct(type, family, confidence) by the first rung with a word in the name or the text, in any case.

    All words are one pattern that is tried once at each place, the longer ones first; it takes no letters, so that words
    which overlap are all seen.
    """
    words = {w: rung for rung, (words, *_) in enumerate(LADDER) for w in words}
    pattern = "(?=(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + "))"
    rung_of = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    both = F.lower(F.concat_ws("\n", F.coalesce(file_name, F.lit("")), F.coalesce(text, F.lit(""))))
    best = F.array_min(F.transform(F.array_distinct(F.regexp_extract_all(both, F.lit(pattern), 1)), lambda w: rung_of[w]))
    rows = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(family).alias("family"), F.lit(FOUND).alias("confidence")) for _, kind, family in LADDER])
    unknown = F.struct(*[F.lit(v).alias(n) for n, v in zip(("type", "family", "confidence"), UNKNOWN, strict=True)])
    return F.coalesce(F.get(rows, best), unknown)


def seeded(existing: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those rows of ``seeds`` whose keys it lacks; what is there stays as it is, missing columns are null."""
    absent = seeds.join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(absent.select([c for c in seeds.columns if c in existing.columns]), allowMissingColumns=True)
