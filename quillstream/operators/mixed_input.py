"""Documents given as text, a list of words, or an object with either, in one column, as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOX = ("left", "top", "width", "height", "x2", "y2")


def _number(v: Column, path: str) -> Column:
    """A number or a text that is one; anything else gives null."""
    return F.trim(F.try_variant_get(v, path, "string")).try_cast("double")


def _given(v: Column, path: str) -> Column:
    """Something stands there, and it isn't null, empty, 0 or false."""
    return ~F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")).isin("", "0", "0.0", "false", "{}", "[]")


def _page_words(v: Column) -> Column:
    """Array of (page, words): a list is page 1, so are an object's own words; then its pages that aren't there yet."""
    page_type = "array<struct<page:long,words:array<variant>>>"
    shape = F.schema_of_variant(v)
    listed = F.when(shape.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.try_variant_get(v, "$.words", "array<variant>"))
    first = F.when(listed.isNotNull(), F.array(F.struct(F.lit(1).cast("long").alias("page"), listed.alias("words")))).otherwise(F.array().cast(page_type))
    raw = F.coalesce(F.try_variant_get(v, "$.pages", "array<variant>"), F.array().cast("array<variant>"))
    pages = F.transform(raw, lambda p, i: F.struct(F.coalesce(_number(p, "$.page_number"), i + 1).cast("long").alias("page"), F.try_variant_get(p, "$.words", "array<variant>").alias("words")))
    pages = F.filter(pages, lambda p: F.size(p["words"]) > 0)
    every = F.concat(first, pages)
    return F.filter(every, lambda p, i: ~F.exists(F.slice(every, 1, i), lambda q: q["page"] == p["page"]))


def _word(w: Column) -> Column:
    """struct(text, conf, x0, y0, x1, y1, block, paragraph, line, word_no, fine) of one word as it is given."""
    text = F.trim(F.try_variant_get(w, "$.text", "string"))
    in_box = F.try_variant_get(w, "$.bbox", "variant").isNotNull() & F.schema_of_variant(F.try_variant_get(w, "$.bbox", "variant")).startswith("OBJECT<") & _given(w, "$.bbox")
    at = lambda n: F.when(in_box, _number(w, f"$.bbox.{n}")).otherwise(_number(w, f"$.bounding_box.{n}"))
    told = lambda n: F.when(in_box, _given(w, f"$.bbox.{n}")).otherwise(_given(w, f"$.bounding_box.{n}"))
    # one value that is no number makes the whole box unknown
    broken = F.exists(F.array(*[told(n) & (at(n).isNull() | F.isnan(at(n)) | (F.abs(at(n)) == float("inf"))) for n in _BOX]), lambda b: b)
    whole = lambda n: F.when(told(n) & ~broken, at(n).cast("long").cast("double")).otherwise(0.0)
    left, top, width, height = (F.greatest(whole(n), F.lit(0.0)) for n in _BOX[:4])
    edge = lambda n, other: F.when(broken, 0.0).when(told(n), whole(n)).otherwise(other)
    conf = _number(w, "$.confidence")
    sure = F.when(conf.isNull() | F.isnan(conf) | (F.abs(conf) == float("inf")), 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), conf)))
    place = {a: _number(w, f"$.{b}") for a, b in (("block", "block_num"), ("paragraph", "paragraph_num"), ("line", "line_num"), ("word_no", "word_num"))}
    least_one = [F.when(x.isNull() | F.isnan(x) | (F.abs(x) >= 2**31), 1).otherwise(F.greatest(F.lit(1), x.cast("int"))).alias(n) for n, x in place.items()]
    return F.struct(text.alias("text"), sure.alias("conf"), left.alias("x0"), top.alias("y0"), edge("x2", left + width).alias("x1"), edge("y2", top + height).alias("y1"), *least_one)


def mixed_words(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """doc_id, page, pos, text, conf, x0, y0, x1, y1, block, paragraph, line, word_no of the words in ``payload`` (text).

    What isn't a word (no object, no text) is passed over. A confidence that is missing, no number or infinite is 100, and
    is held within 0 and 100; a box with a value that is no number is 0; numbers of block, paragraph, line and word are 1 at
    least. Text that is no JSON has no words.
    """
    parsed = docs.select("doc_id", F.explode(_page_words(F.try_parse_json(payload))).alias("p"))
    each = parsed.select("doc_id", F.col("p.page").alias("page"), F.posexplode("p.words").alias("pos", "w"))
    each = each.where(F.schema_of_variant("w").startswith("OBJECT"))
    return each.select("doc_id", "page", "pos", _word(F.col("w")).alias("x")).select("doc_id", "page", "pos", "x.*").where("text <> ''")


def mixed_texts(docs: DataFrame, payload: str = "payload", text: str = "text") -> DataFrame:
    """doc_id, text of every document: the column ``text`` where it is given, else the payload's text, else its words by page
    and line, joined."""
    v = F.try_parse_json(payload)
    shape = F.schema_of_variant(v)
    own = F.when(_given(v, "$.combined_text"), F.try_variant_get(v, "$.combined_text", "string")).otherwise(F.try_variant_get(v, "$.text", "string"))
    given = F.coalesce(F.col(text), F.when(v.isNull() | shape.isin("STRING"), F.coalesce(F.try_variant_get(v, "$", "string"), F.col(payload))).when(shape.startswith("OBJECT"), own))
    line = mixed_words(docs, payload).groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("t"))
    rebuilt = line.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "t"))), lambda x: x["t"]), "\n").alias("_rebuilt"))
    out = docs.select("doc_id", given.alias("_given")).join(rebuilt, "doc_id", "left")
    return out.select("doc_id", F.trim(F.when(F.coalesce(F.trim("_given"), F.lit("")) != "", F.col("_given")).otherwise(F.coalesce("_rebuilt", F.lit("")))).alias("text"))
