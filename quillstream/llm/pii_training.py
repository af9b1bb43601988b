"""Trains the trees of ``pii``: python -m quillstream.llm.pii_training [documents.parquet]

There are two sources of labelled proposals, both bounded. DOCUMENTS documents (those of the smallest hashes of their
doc_id) give their proposals: a credential that at most OWNERS sources of the sample hold is personal; a copied one, and a
proposal of any other kind, isn't (the corpus has no such data but what the base kinds find). For the kinds that the
corpus lacks SENTENCES made-up sentences are added. Of each source three fifths train the trees, one fifth calibrates the
thresholds (the lowest at which precision reaches PRECISION), and one fifth is held out; the figures are kept by source.
"""

from __future__ import annotations

import json
import random
import sys

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import pii

DOCUMENTS, SENTENCES, SEED, PRECISION, OWNERS = 10_000, 9000, 7, 0.99, 2
TREES, DEPTH, STEP = 32, 4, 0.3


def _digits(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(n - 1))


def _letters(r: random.Random, n: int, of: str) -> str:
    return "".join(r.choice(of) for _ in range(n))


def _date(r: random.Random) -> str:
    return r.choice([f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1930, 2010)}", f"{r.randint(1930, 2010)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1930, 2010)}"])


HEX, MIXED = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
NAMES = ["Miller", "Schulz", "Garcia", "Dubois", "Novak", "Rossi", "Keller", "Marsh", "Lopez", "Weber"]


def _positive(r: random.Random) -> tuple[str, str, str]:
    """(words before, span, kind)"""
    kind = r.choice(list(pii.PROPOSED))
    d = _digits
    if kind == "address":
        at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot ")])
        return r.choice(["mail me: ", "mail: ", "e-mail ", "contact ", "write to ", "reach us via ", "", "ask "]), r.choice(["jo", "ann", "kim", "lee.s", "rob_k", "maria-t"]) + r.choice(["", d(r, 2)]) + at + r.choice(["mail", "post", "inbox"]) + dot + r.choice(["com", "org", "net"]), kind
    if kind == "national":
        a, b, c = d(r, 3), d(r, 3), d(r, 4)
        return r.choice(["phone ", "call me on ", "tel. ", "mobile: ", "fax ", "you can reach me at "]), r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"0{a}/{b} {c}", f"0{d(r, 2)} {c} {d(r, 4)}"]), kind
    if kind == "ssn":
        return r.choice(["ssn ", "social security number: ", "tax identity ", "national id: "]), f"{r.randint(100, 665)}-{d(r, 2)}-{d(r, 4)}", kind
    if kind == "account":
        return r.choice(["account ", "from account ", "bank account no. ", "transfer to account ", "my bank number is "]), d(r, r.randint(12, 19)), kind
    if kind == "credential":
        value = r.choice([_letters(r, r.randint(16, 40), HEX), _letters(r, r.randint(12, 32), MIXED)])
        return r.choice(["", "set ", "with "]), r.choice(["password", "passwd", "secret", "token", "api_key", "apikey"]) + r.choice(["=", ": ", " = "]) + r.choice(["", '"']) + value, kind
    if kind == "access":
        return r.choice(["key ", "use ", ""]), "AKIA" + _letters(r, 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), kind
    if kind == "person":
        return r.choice(["patient ", "contact ", "signed by ", "ask for ", "treated "]), r.choice(["Mr. ", "Mrs. ", "Ms ", "Dr. ", "Herr ", "Frau "]) + r.choice(["", "Anna ", "John ", "Peter "]) + r.choice(NAMES), kind
    if kind == "street":
        return r.choice(["lives at ", "who lived at ", "address: ", "send it to ", "home at ", "moved to "]), f"{r.randint(1, 9999)} {r.choice(['Oak', 'Maple', 'King', 'High', 'Long Hill'])} {r.choice(['Street', 'St', 'Avenue', 'Road', 'Lane'])}", kind
    if kind == "birth":
        return r.choice(["she was ", "patient ", "", "he is "]), r.choice(["born on ", "born ", "date of birth: ", "DOB ", "geboren am "]).replace("date of ", "") + _date(r), kind
    code = r.choice(["DE", "FR", "ES", "GB"]) + d(r, 2)
    return r.choice(["iban ", "bank account ", "wire it to ", "transfer to "]), r.choice([code + d(r, r.choice([14, 16, 18, 20])), code + " " + " ".join(d(r, 4) for _ in range(r.choice([4, 5]))) + r.choice(["", " " + d(r, 2)])]), kind


def _negative(r: random.Random) -> tuple[str, str, str]:
    before = r.choice(["order ", "invoice no. ", "item ", "isbn ", "version ", "ref ", "part #", "page ", "serial ", "price $", "score ", "on ", "between ", "in ", "the ", "about ", "and ", "=", "*** "])
    d = _digits
    word = lambda: r.choice(["password", "secret", "token", "api_key"])
    span = r.choice([
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1950, 2030)}", lambda: f"{r.randint(1950, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{d(r, 3)}-{d(r, 2)}-{d(r, 4)}",
        lambda: f"{d(r, 3)} {d(r, 3)} {d(r, 3)}", lambda: f"{d(r, 3)}-{d(r, 3)}-{d(r, 4)}", lambda: f"{d(r, 4)} {d(r, 4)}", lambda: f"978-{d(r, 3)}-{d(r, 4)}", lambda: f"{d(r, 2)}.{d(r, 3)}.{d(r, 3)}",
        lambda: r.choice(["AB", "XK"]) + d(r, 2) + d(r, 12), lambda: f"meet at {r.choice(['noon', 'home', 'work'])} dot com", lambda: f"look at page{d(r, 2)} dot net", lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
        lambda: d(r, r.randint(12, 19)), lambda: f"{word()}: {r.choice(['required', 'changeme', 'placeholder', 'not-applicable', 'authentication', 'example-value', 'your_key_here'])}", lambda: f"{word()} = {r.choice(['xxxxxxxxxxxx', 'EXAMPLE_TOKEN', 'get_password', 'os.environ', 'config.value', 'None.default'])}",
        lambda: "AKIA" + r.choice(["EXAMPLEKEY", "XXXXXXXXXXXX", "YOURKEYHERE"]), lambda: r.choice(["Dr. Pepper", "Mr. Clean", "Ms Pac-Man", "Dr. Seuss"]), lambda: f"{r.randint(2, 40)} {r.choice(['Miles', 'Best'])} {r.choice(['Road', 'Drive'])}", lambda: f"birth rate {d(r, 2)}.{d(r, 1)}.{d(r, 1)}",
    ])()
    return before, span, ""


def sentences() -> list[tuple[int, str, int, int, str]]:
    r = random.Random(SEED)
    words = ["the", "report", "of", "and", "was", "then", "from", "house", "ser", "die", "les", "mit"]
    out = []
    for i in range(SENTENCES):
        before, span, kind = (_positive if i % 2 else _negative)(r)
        head = " ".join(r.choices(words, k=r.randint(2, 8))) + " " + before
        out.append((i, head + span + " " + " ".join(r.choices(words, k=r.randint(1, 6))) + ".", len(head), len(head) + len(span), kind))
    return out


def _node(node, names: list[str]):
    if node.getClass().getSimpleName() == "LeafNode":
        return round(node.prediction(), 5)
    split = node.split()
    return [names[split.featureIndex()], round(split.threshold(), 5), _node(node.leftChild(), names), _node(node.rightChild(), names)]


def _proposals(texts: DataFrame, *carry: str) -> DataFrame:
    rows = pii.candidates(texts).select("doc_id", *carry, F.explode("_more").alias("m"))
    return rows.select("doc_id", *carry, "m", F.expr(pii.features()).alias("f"), F.element_at(F.array(*[F.lit(k) for k in pii.KINDS]), F.col("m.k") + 1).alias("named"))


def made_up(spark: SparkSession) -> DataFrame:
    """(source, part, named, label, features) of the proposals in the made-up sentences."""
    rows = _proposals(spark.createDataFrame(sentences(), "doc_id bigint, text string, s0 int, e0 int, kind0 string"), "s0", "e0", "kind0")
    hit = F.expr("m.s < e0 and m.e > s0 and named = kind0").cast("double")
    return rows.select(F.lit("made_up").alias("source"), (F.floor(F.col("doc_id") / 2) % 5).alias("part"), "named", hit.alias("label"), "f.*")


def of_documents(docs: DataFrame) -> DataFrame:
    """(source, part, named, label, features) of the proposals in a sample of ``docs`` (doc_id, text, source)."""
    sample = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("owner")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCUMENTS)
    rows = _proposals(sample, "owner").withColumn("value", F.regexp_extract("m.t", r"[A-Za-z0-9+/_.=-]{8,}$", 0))
    held = rows.groupBy("named", "value").agg(F.countDistinct("owner").alias("owners"))
    rows = rows.join(held, ["named", "value"])
    label = (F.col("named").isin("credential", "access") & (F.col("owners") <= OWNERS)).cast("double")
    return rows.select(F.lit("documents").alias("source"), F.pmod(F.xxhash64("value"), F.lit(5)).alias("part"), "named", label.alias("label"), "f.*")


def train(spark: SparkSession, docs: DataFrame) -> dict:
    """The model: weighted trees, thresholds by kind, precision and recall on the held-out fifth of each source."""
    names = list(pii.FEATURES)
    rows = made_up(spark).unionByName(of_documents(docs)).repartition(1).sortWithinPartitions("source", "part", "named", "label", *names).cache()
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(rows)
    fitted = GBTClassifier(featuresCol="v", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(vectors.where("part < 3"))
    trees = [[float(w), _node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"), names)] for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)]
    scored = [(r.source, r.part, r.named, r.label, r.p) for r in fitted.transform(vectors.where("part >= 3")).select("source", "part", "named", "label", vector_to_array("probability")[1].alias("p")).collect()]
    rows.unpersist()
    thresholds = {}
    for kind in pii.PROPOSED:
        own = sorted(((p, y) for _, part, k, y, p in scored if part == 3 and k == kind), reverse=True)
        best, right = 1.0, 0
        for n, (p, y) in enumerate(own, 1):
            right += y
            if right / n >= PRECISION and (n == len(own) or own[n][0] < p):
                best = p
        thresholds[kind] = round(max(0.5, best - 1e-4), 4)
    held_out = {}
    for source in ("documents", "made_up"):
        held = [(y, p >= thresholds[k]) for s, part, k, y, p in scored if part == 4 and s == source]
        hits = sum(y for y, got in held if got)
        held_out[source] = {"precision": round(hits / max(1, sum(got for _, got in held)), 4), "recall": round(hits / max(1, sum(y for y, _ in held)), 4), "proposals": len(held), "personal": int(sum(y for y, _ in held))}
    return {"trees": trees, "thresholds": thresholds, "held_out": held_out}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    result = train(session, session.read.parquet(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1/documents.parquet"))
    pii.MODEL.write_text(json.dumps(result, indent=1))
    print(result["thresholds"], result["held_out"])
