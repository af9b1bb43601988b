"""Benchmark decontamination by template canonicalisation.

A text becomes template words: lower case without punctuation, where numbers, units behind numbers, and names
(capitalised words inside a sentence) are typed placeholders that remember their value. Windows of five template words
are joined by hash with the windows of the benchmark items. The matched windows of a document and an item that lie on
one alignment must fill the slots consistently: a name of the item always stands for the same name of the document.
Numbers and units are slots by their place, as equal ones ("3 apples and 3 pears") needn't stay equal. So a question with
other numbers or names is still found, and a chance match of loose placeholders is not: windows of fewer than three plain
words are loose, and match only where their placeholders' values are equal too. Where five words are loose, wider windows
take their place, whatever the values: from a plain word to the second one after it, and from a plain word to the end of the
placeholders that follow it, if they are four at least ("compute 12 + 30 * 7 - 4"). Such dense windows count only together
with others of the same alignment, so that an item can't be put together from pieces. Items of fewer than five template
words are one window of their whole length, with equal values.

Native: DataFrame functions only.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.windows import window_counts, window_hashes
from quillstream.llm.staging import stage

#: Units that may follow a number.
UNITS = ("mm", "cm", "m", "km", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "miles", "feet", "inches", "meters", "metres", "dollars", "euros", "cents", "percent", "degrees", "km/h", "mph")
WINDOW, LEAST_COVER, LEAST_WORDS = 5, 0.8, 3
#: Windows of the benchmark are broadcast up to this many (24 bytes and five words each); beyond it they are shuffled.
BROADCAST_WINDOWS = 1_000_000
NUM, NAME, UNIT = "\x01", "\x02", "\x03"
_MARK, _WORD, _GAP = r"[\x01-\x03]", r"[\p{L}\p{N}\x01-\x03]", r"[^\p{L}\p{N}\x01-\x03]"
#: Placeholders with so few words between them as in a loose window; without such a place a text has neither loose nor dense windows.
_CROWD = f"{_MARK}(?:{_WORD}*+(?:{_GAP}++{_WORD}++){{0,{LEAST_WORDS - 1}}}{_GAP}++{_MARK}){{{WINDOW - LEAST_WORDS}}}"


def template_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the template words, ``out``_k, the same with only their marks left of placeholders, and ``out``_m, whether
    placeholders crowd so that windows may be loose.

    Placeholders begin with a mark (number 1, name 2, unit 3) before their value. A word is a run of letters and digits;
    points and commas inside a number are dropped.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    t = F.when(t.rlike("[\x01-\x03]"), F.translate(t, "\x01\x02\x03", "   ")).otherwise(t)
    t = F.regexp_replace(t, r" (?=\p{Lu})(?<=[\p{Ll}\p{N}] |[\p{Ll}\p{N}][,;:] )", " " + NAME)
    df = df.withColumn("_t", F.lower(t))
    n = F.regexp_replace("_t", r"(?<=[0-9])[.,](?=[0-9])", "")
    n = F.regexp_replace(n, r"(?=[0-9])(?<![\p{L}\p{N}])", NUM)
    # the number is part of the match: looking back for it at each place costs ten times as much
    n = F.regexp_replace(n, "(" + NUM + r"[0-9]{1,40} )(?=(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}]))", "$1" + UNIT)
    df = df.withColumn("_t", F.when(F.col("_t").rlike("[0-9]"), n).otherwise(F.col("_t")))
    df = df.withColumn(out, F.array_remove(F.split("_t", _GAP + "+"), "")).withColumn(out + "_m", F.col("_t").rlike(_CROWD))
    return df.withColumn(out + "_k", F.when(F.col("_t").rlike("[\x01-\x03]"), F.transform(out, lambda w: F.when(F.ascii(w) < 4, F.substring(w, 1, 1)).otherwise(w))).otherwise(F.col(out))).drop("_t")


def _window_keys(df: DataFrame, words: str, size: int, out: str) -> DataFrame:
    """Adds ``out``: a key of each window of ``size`` words; it holds the placeholders' values where the window is loose."""
    loose = f"xxhash64(slice({words}, i + 1, {size}))"
    maybe = f"{words}_m" if size == WINDOW else "true"
    df = window_hashes(df, words + "_k", size, "_t")
    df = window_counts(df, f"if({maybe}, {words}_k, null)", "ascii(x) > 3", size, "_n")
    # not get(_n, i): the planner would count all windows again for each of them
    both = "zip_with(_t, _n, (t, n) -> struct(t, n))"
    return df.withColumn(out, F.expr(f"if({maybe}, transform({both}, (e, i) -> if(e.n < {LEAST_WORDS}, {loose}, e.t)), _t)")).drop("_t", "_n")


def _dense_windows(df: DataFrame, words: str, out: str, runs: list[int] | None = None) -> DataFrame:
    """Adds ``out``: (pos, len, h) of the windows that take the place of loose ones; most texts have none.

    A window of placeholders behind a plain word ends with them; with ``runs`` it has each of these lengths that they reach, as a
    text may go on with another number.
    """
    k = words + "_k"
    plain = f"if({words}_m, filter(transform({k}, (x, i) -> if(ascii(x) > 3, i, -1)), i -> i >= 0), cast(array() as array<int>))"
    df = df.withColumn("_p", F.expr(plain))
    df = df.withColumn("_p", F.expr(f"transform(_p, (p, j) -> struct(p as pos, coalesce(get(_p, j + 2), -1) - p + 1 as three, coalesce(get(_p, j + 1), size({k})) - p as run))"))
    spans = f"transform(filter(_p, p -> p.three > {WINDOW}), p -> struct(p.pos as pos, p.three as len))"
    if runs is None:
        spans = f"concat({spans}, transform(filter(_p, p -> p.run >= {WINDOW}), p -> struct(p.pos as pos, p.run as len)))"
    elif runs:
        spans = f"concat({spans}, flatten(transform(filter(_p, p -> p.run >= {WINDOW}), p -> transform(filter(array({', '.join(map(str, runs))}), n -> n <= p.run), n -> struct(p.pos as pos, n as len)))))"
    return df.withColumn(out, F.expr(f"transform({spans}, w -> struct(w.pos as pos, w.len as len, xxhash64('dense', slice({k}, w.pos + 1, w.len)) as h))")).drop("_p")


#: Words of an item that the windows ``at`` (ipos, wlen, dense) cover.
_COVER = "size(array_distinct(flatten(transform({at}, x -> sequence(x.ipos, x.ipos + x.wlen - 1)))))"


def contaminated(docs: DataFrame, benchmark: DataFrame, least_cover: float = LEAST_COVER) -> DataFrame:
    """One row per document and benchmark item that it holds.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored. An item counts as held when matched
    windows cover at least ``least_cover`` of its template words. Null and empty texts, and items without any word, match
    nothing. Rows that repeat a doc_id are each matched by themselves, and the row that covers most of an item counts.
    Empty tables give no rows.
    """
    words = template_words(benchmark.select("item_id", "text"), "text", "_iw").withColumn("item_words", F.size("_iw"))
    short = sorted(r.item_words for r in words.where(f"item_words between 1 and {WINDOW - 1}").select("item_words").distinct().collect())
    each = []
    for size in (WINDOW, *short):
        part = _window_keys(words.where(f"item_words {'>=' if size == WINDOW else '='} {size}"), "_iw", size, "_h")
        each.append(part.select("item_id", "item_words", "_iw", F.posexplode("_h").alias("ipos", "_ih"), F.lit(size).alias("wlen"), F.lit(False).alias("dense")))
    dense = _dense_windows(words.where(f"item_words >= {WINDOW}"), "_iw", "_w").select("item_id", "item_words", "_iw", F.explode("_w").alias("w"))
    each.append(dense.select("item_id", "item_words", "_iw", F.col("w.pos").alias("ipos"), F.col("w.h").alias("_ih"), F.col("w.len").alias("wlen"), F.lit(True).alias("dense")))
    # written once: its sizes, its count and the join read the same rows
    items = stage(functools.reduce(DataFrame.unionByName, each).select("item_id", "item_words", "ipos", "_ih", "wlen", "dense", F.expr("slice(_iw, ipos + 1, wlen)").alias("_is")), "benchmark-windows")
    small = items.count() <= BROADCAST_WINDOWS
    found = _window_keys(template_words(docs.select("doc_id", "text", F.xxhash64("text").alias("_row")), "text", "_dw"), "_dw", WINDOW, "_h")
    runs = sorted(r.wlen for r in items.where("dense and size(filter(slice(_is, 2, wlen), t -> ascii(t) > 3)) = 0").select("wlen").distinct().collect())  # no more than an item has words
    found = _dense_windows(found, "_dw", "_dense", runs)
    for size in short:
        found = _window_keys(found, "_dw", size, f"_h{size}of")
    hashes = ["_h", *(f"_h{n}of" for n in short)]
    # only the hashes are dealt to the join, by a generator of a plain column: with a higher-order function in it Spark
    # copies a text's words for each
    found = found.withColumn("_all", F.expr(f"concat({', '.join(hashes)}, transform(_dense, w -> w.h))")).withColumn("_sizes", F.expr(f"array({', '.join(f'size({h})' for h in hashes)})"))
    found = found.select("doc_id", "_row", "_dw", "_sizes", "_dense", F.posexplode_outer("_all").alias("_i", "_dh")).where("_dh is not null")
    pos = length = ""
    left = "_i"
    for k, n in enumerate((WINDOW, *short)):
        pos, length, left = f"{pos} when {left} < _sizes[{k}] then {left}", f"{length} when {left} < _sizes[{k}] then {n}", f"{left} - _sizes[{k}]"
    place = (f"case{pos} else get(_dense, {left}).pos end as dpos", f"case{length} else get(_dense, {left}).len end as dlen")
    # a window's words alone go on: rows of one text are held together where Spark joins them, and must not hold the text. A
    # generator is a step that the planner doesn't move them into
    own = "explode(array(slice(_dw, dpos + 1, dlen))) as _ds"
    if not small:
        found = found.selectExpr("*", *place).select("doc_id", "_row", "dpos", "_dh", F.expr("slice(_dw, dpos + 1, dlen)").alias("_ds"))
    else:
        items = F.broadcast(items)
    found = found.join(items, F.col("_dh") == F.col("_ih"))
    if small:
        found = found.selectExpr("*", *place).selectExpr("doc_id", "_row", "dpos", "item_id", "item_words", "ipos", "wlen", "dense", "_is", own)
    # a loose window's values are equal already, and take no part in the slots' consistency
    pairs = f"filter(zip_with(_is, _ds, (i, d) -> struct(i, d)), p -> ascii(p.i) < 4 and (dense or size(filter(_is, t -> ascii(t) > 3)) >= {LEAST_WORDS})) as pairs"
    hits = found.selectExpr("doc_id", "_row", "item_id", "item_words", "struct(ipos, wlen, dense) as w", "dpos - ipos as diagonal", pairs)
    aligned = hits.groupBy("doc_id", "_row", "item_id", "item_words", "diagonal").agg(F.collect_set("w").alias("at"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    steady = aligned.where("size(array_distinct(transform(filter(pairs, p -> ascii(p.i) = 2), p -> p.i))) = size(filter(pairs, p -> ascii(p.i) = 2))")
    steady = steady.withColumn("near", F.expr(_COVER.format(at="at")))
    whole = steady.groupBy("doc_id", "_row", "item_id", "item_words").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.max("near").alias("near"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    covered = F.greatest("near", F.expr(_COVER.format(at="filter(at, x -> not x.dense)"))).cast("long")
    out = whole.select("doc_id", "item_id", F.size("at").cast("long").alias("n_windows"), covered.alias("words_covered"), F.col("item_words").cast("long").alias("item_words"), F.expr("cast(size(filter(pairs, p -> p.i <> p.d)) as bigint)").alias("n_changed_slots"))
    out = out.where(F.col("words_covered") >= least_cover * F.col("item_words"))
    best = out.groupBy("doc_id", "item_id", "item_words").agg(F.max(F.struct("words_covered", "n_windows", (-F.col("n_changed_slots")).alias("same"))).alias("_b"))
    return best.select("doc_id", "item_id", "_b.n_windows", "_b.words_covered", "item_words", (-F.col("_b.same")).alias("n_changed_slots"))
