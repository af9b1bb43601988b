"""Quality rules with adaptive limits: mergeable quantile sketches per language and source.

Each document gets counts over its whole text. The ratios made of them, and the counts that they are taken of, go into
log-linear histogram sketches (a bucket keeps the eight highest bits of the value, so its relative error is at most 1/128).
Sketches merge by adding counts, so one scan builds them per (lang, source) and the coarser ones (lang; everything) are
sums of the finer ones. Documents that fail the base rule take no part. The limits of a ratio are its median plus or minus
``reach`` times its spread, and are joined back to the documents. The spread is twice the distance from the first
quartile to the median: junk lies above, so up to half of a group may be junk without moving its limits. A ratio that is
the same in a quarter of a group, like the share of repeats in clean prose, has no such distance; there the spread is the
step that one more event makes in a short document of the group (one in SHORT is shorter). A mean
scatters more in short documents, so its spread is scaled by the root of their shortness. All of it comes from the
sketches, and differs between groups.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.windows import window_hashes
from quillstream.llm.staging import stage

#: White space that parts words.
SPACE = r"[\x20\x09-\x0D]+"
#: ratio -> (numerator, denominator, what one event adds to the numerator); ratios are whole thousandths. A repeated window is
#: two windows of three words; a word's length is no event.
RATIOS = {
    "symbols": ("n_symbols", "n_words", 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1),
    "repeats": ("n_repeat_words", "n_words", 6),
    "word_length": ("word_chars", "n_words", 0),
}
#: Counts that ratios are taken of, with sketches of their own.
SIZES = ("n_words", "n_lines")
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
REACH, MIN_DOCS = 4, 200
#: One document in so many is shorter than a short one.
SHORT = 32


def text_counts(docs: DataFrame, *carry: Column) -> DataFrame:
    """doc_id, lang, source, the columns ``carry`` and the counts of each document; null or empty texts count 0.

    Repeated 3-word windows are found in the row itself: hashes of the windows are sorted with their positions, so
    equal windows are neighbours; nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", "lang", "source", *carry, text.alias("_text"), F.array_remove(F.split(text, SPACE), "").alias("_w"), lines.alias("_l"))
    carried = [c for c in df.columns if c not in ("_text", "_w", "_l")]
    df = df.select(
        *carried, "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    df = window_hashes(df, "_w", 3, "_h")
    df = df.withColumn("_s", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (h, i) -> struct(h, i))), cast(array() as array<struct<h: bigint, i: int>>))"))
    df = df.withColumn("_p", F.expr("array_sort(transform(filter(transform(_s, (e, k) -> struct(e.i as i, coalesce(e.h = get(_s, k - 1).h, false) or coalesce(e.h = get(_s, k + 1).h, false) as twice)), e -> e.twice), e -> e.i))"))
    df = df.withColumn("n_repeat_words", F.expr("aggregate(transform(_p, (v, k) -> least(3, coalesce(get(_p, k + 1) - v, 3))), 0L, (a, x) -> a + x)"))
    # a generator keeps filters on the counts above it; below, they would be repeated for each element of the arrays
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in carried if c != "_w"]
    return df.select(*kept, F.explode_outer(F.array(F.struct(*counts))).alias("_c")).select(*kept, "_c.*")


def _ratio(name: str):
    top, below, _ = RATIOS[name]
    return F.when(F.col(below) > 0, F.floor(F.lit(1000) * F.col(top) / F.col(below)).cast("long"))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the histogram sketch of each ratio and size; merge by adding n."""
    each = [F.struct(F.lit(k).alias("ratio"), _ratio(k).alias("v")) for k in RATIOS] + [F.struct(F.lit(k).alias("ratio"), F.col(k).alias("v")) for k in SIZES]
    rows = counts.where(f"not ({BASE_FAILED})").select("lang", "source", F.explode(F.array(*each)).alias("_e")).select("lang", "source", "_e.*")
    shift = F.greatest(F.length(F.bin("v")) - 8, F.lit(0)).cast("int")
    bucket = F.expr("shiftleft(shiftright(v, _k), _k)")
    return rows.withColumn("_k", shift).withColumn("bucket", bucket).groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))


def limits(sketch: DataFrame, reach: int = REACH, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source) with lo_<ratio> and hi_<ratio>.

    A group of fewer than ``min_docs`` documents takes the limits of its language, and if that is small too, of all. Where all
    are fewer, nothing can be told of them: limits are null, and only the base rule holds.
    """
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
        whole = "partition by " + ", ".join([*keys, "ratio"])
        merged = merged.selectExpr("*", f"sum(n) over ({whole}) as total", f"sum(n) over ({whole} order by bucket) as upto")
        at = lambda parts: F.min(F.when(F.expr(f"upto * {parts} >= total"), F.col("bucket")))
        quart = merged.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), at(SHORT).alias("q0"), at(4).alias("q1"), at(2).alias("q2"))
        of = lambda name, q: F.max(F.when(F.col("ratio") == name, F.col(q)))
        wide = quart.groupBy(*keys).agg(F.max("total").alias(f"n{level}"), *[of(k, q).alias(f"{q}_{k}") for k in (*RATIOS, *SIZES) for q in ("q0", "q1", "q2")])
        parts = []
        for k, (_, below, event) in RATIOS.items():
            q1, q2, s2, short = F.col(f"q1_{k}"), F.col(f"q2_{k}"), F.col(f"q2_{below}"), F.greatest(F.col(f"q0_{below}"), F.lit(1))
            # one event in a short document; for a mean, its scatter there; and no finer than a bucket
            step = F.floor(F.lit(1000 * event) / short) if event else F.floor(2 * (q2 - q1) * F.sqrt(s2 / short))
            spread = F.greatest(2 * (q2 - q1), step, F.floor(q2 / 128)).cast("long")
            parts += [(q2 - reach * spread).alias(f"lo_{k}"), (q2 + reach * spread).alias(f"hi_{k}")]
        levels.append(wide.select(*keys, f"n{level}", F.struct(*parts).alias(f"f{level}")))
    fine, by_lang, every = levels
    out = fine.alias("a").join(by_lang.alias("b"), F.expr("a.lang <=> b.lang"), "left").select("a.*", "n1", "f1").join(every, F.lit(True), "left")
    pick = F.when(F.col("n0") >= min_docs, F.col("f0")).when(F.col("n1") >= min_docs, F.col("f1")).when(F.col("n2") >= min_docs, F.col("f2"))
    return out.select("lang", "source", pick.alias("_f")).select("lang", "source", "_f.*")


def quality_rules(docs: DataFrame, reach: int = REACH, min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document.

    ``docs``: doc_id, text, lang, source; other columns are ignored. Null text: no words, so base_failed. Null lang or
    source is a group of its own. Repeated rows are judged each by itself. An empty table gives no rows.
    """
    counts = stage(text_counts(docs), "quality-counts")
    fences = stage(limits(sketches(counts), reach, min_docs), "quality-limits")
    judged = _judged(counts, fences)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def _judged(counts: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds base_failed and kept, joined by language and source."""
    fences = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    base = F.expr(BASE_FAILED)
    inside = F.lit(True)
    for k in RATIOS:
        inside = inside & F.coalesce(_ratio(k).between(F.col(f"lo_{k}"), F.col(f"hi_{k}")), F.lit(True))
    joined = counts.join(fences, F.expr("lang <=> _lang and source <=> _source"), "left")
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & inside)


def quality_filter(docs: DataFrame, reach: int = REACH, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their own columns.

    The counts are made again beside each row instead of being joined to it, which would shuffle the texts.
    """
    fences = stage(limits(sketches(text_counts(docs)), reach, min_docs), "quality-limits")
    counts = text_counts(docs, F.struct("*").alias("_row"))
    return _judged(counts, fences).where("kept").select("_row.*")
