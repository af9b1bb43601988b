"""Names of vendors from a document's first lines, by what stands in the lines after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.extract import KEYWORDS
from quillstream.operators.spatial import scored

#: Lines that may name the vendor, lines after one that may hold its address, and words that a name has at most.
HEAD, AFTER, WORDS = 10, 3, 8
#: Endings of company names.
ENDINGS = (
    r"pvt\.?\s*ltd\.?", r"private\s+limited", r"ltd\.?", "limited", "llp", r"inc\.?", "incorporated", "corporation", r"corp\.?", "industries", "enterprises", "technologies", "solutions", "services", "traders", "stores", "store", "company",
    r"co\.?", "gmbh", "tech", "systems", "consulting", "consultancy", "agency", "pharmacy", "media", "labs", "group",
)
#: What a line with a vendor's name doesn't hold; the first ones only where they are the whole line.
WHOLE = ("invoice", "bill", "quotation", "receipt")
NEVER = (
    r"tax\s+invoice", r"commercial\s+invoice", r"proforma\s+invoice", "quotation", "quote", "estimate", r"purchase\s+order", r"po\s+number", r"invoice\s*number", r"invoice\s*no\.?", r"invoice\s*#", r"invoice\s*date", r"bill\s*number", r"bill\s*no\.?", r"bill\s*date",
    r"bill\s+to", r"ship\s+to", r"invoice\s+to", "customer", "client", "consignee", r"original\s+for\s+recipient", "gstin", r"gst\s*no", r"pan\s*no", "phone", "tel", "mobile", "email", "website", "http", "address", r"p\.?o\.?\s*box", "road", "street", "floor",
    r"grand\s*total", "subtotal", "total", "amount", "balance",
)
#: What an address or a contact line holds.
ADDRESS = r"\b(gstin|gst\s*no|pan|phone|tel|email|road|street|nagar|park|floor|box|suite|bangalore|mumbai|delhi)\b"
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
_DATE = rf"\b(\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}|\d{{1,2}}[-\s]{_MONTH}[-\s]\d{{2,4}}|{_MONTH}\s+\d{{1,2}},?\s+\d{{2,4}})\b"


def _any(words: tuple[str, ...]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def header_vendors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, value, confidence, company, address): the lines among the first HEAD that may name the vendor.

    A line counts only with a company's ending or with an address, a tax number or a contact in one of the three lines after
    it. The lines are one array of the document, so what follows a line is a slice of it, without a window or a shuffle.
    """
    tidy = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    lines = docs.select(key, F.slice(F.filter(tidy, lambda x: x != ""), 1, HEAD).alias("lines"))
    each = F.transform("lines", lambda x, i: F.struct(i.cast("int").alias("line_no"), x.alias("raw"), F.exists(F.slice(F.col("lines"), i + 2, AFTER), lambda y: y.rlike(f"(?i){ADDRESS}")).alias("address")))
    rows = lines.select(key, F.explode(each).alias("l")).select(key, "l.*")
    value = F.trim(F.regexp_replace("raw", r"(?U)^[^\w]+|[^\w.,()&-]+$", ""))
    rows = rows.withColumn("value", value).withColumn("company", F.col("value").rlike(_any(ENDINGS)))
    labelled = F.col("raw").rlike(r"(?i)^\s*(" + "|".join(KEYWORDS["vendor_name"]).replace(" ", r"\s*") + r")\s*[:\-]")
    number = F.col("value").rlike(r"(?i)\b(invoice|inv|bill|ref(erence)?)\s*(number|no|num|id|ref|#)\b")
    never = F.col("value").rlike(_any(NEVER)) | F.col("value").rlike(r"(?i)^\s*(" + "|".join(WHOLE) + r")\s*$")
    fits = ~F.col("raw").rlike("[.!?]$") & ~labelled & F.length("value").between(3, 100) & ~never & ~F.col("value").rlike(f"(?i){_DATE}") & ~number & (F.size(F.split("value", r"\s+")) <= WORDS)
    rows = rows.where(fits & (F.col("company") | F.col("address")))
    capitals = F.col("value").rlike(r"\p{Lu}") & ~F.col("value").rlike(r"\p{Ll}")
    title = F.col("value").rlike(r"\p{Lu}") & ~F.col("value").rlike(r"\p{L}\p{Lu}|(^|\P{L})\p{Ll}")
    signals = {"keyword": F.lit(0.25), "pattern": F.when(F.col("company"), 1.0).when(capitals | title, 0.85).otherwise(0.65), "ocr": F.lit(1.0), "position": F.greatest(F.lit(0.60), 1 - F.col("line_no") * 0.05), "context": F.when(F.col("address"), 0.95).otherwise(0.60)}
    return rows.select(key, "line_no", "value", scored(signals, F.when(F.col("value").rlike(r"\d{4,}"), 0.30).otherwise(0.0)).alias("confidence"), "company", "address")
