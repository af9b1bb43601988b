"""Schema registry: versions, resolution of documents to schemas, canonical keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(schemas: DataFrame) -> DataFrame:
    """The last version of each active schema (schema_id, name, family, version, fingerprint, is_active)."""
    rest = [c for c in schemas.columns if c not in ("schema_id", "version")]
    last = schemas.groupBy("schema_id").agg(F.max(F.struct("version", *rest)).alias("s")).select("schema_id", "s.*")
    return last.where("is_active")


def revised(schemas: DataFrame, changes: DataFrame) -> DataFrame:
    """schemas with a new version for each row of ``changes`` (schema_id and the columns that change)."""
    last = schemas.groupBy("schema_id").agg(F.max("version").alias("version"))
    old = schemas.join(last, ["schema_id", "version"])
    changed = [c for c in changes.columns if c != "schema_id"]
    new = old.join(changes.select("schema_id", *[F.col(c).alias(f"_{c}") for c in changed]), "schema_id")
    new = new.withColumns({c: F.coalesce(f"_{c}", c) for c in changed}).withColumn("version", F.col("version") + 1)
    return schemas.unionByName(new.select(*schemas.columns))


def resolve(docs: DataFrame, schemas: DataFrame) -> DataFrame:
    """docs (doc_id, doc_type, fingerprint) with schema_id and how: fingerprint, name, or none.

    Names match when one holds the other, in lower case; the shortest name wins, then the smallest id. Types are few, so
    names are compared by distinct type, not by document.
    """
    live = current(schemas)
    by_print = live.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("schema_id").alias("by_print"))
    kinds = docs.select("doc_type").distinct()
    names = live.select("schema_id", F.lower("name").alias("name"))
    kind = F.lower("doc_type")
    close = kinds.join(names, F.contains(kind, F.col("name")) | F.contains(F.col("name"), kind))
    by_name = close.groupBy("doc_type").agg(F.min(F.struct(F.length("name").alias("n"), "schema_id")).alias("m")).select("doc_type", F.col("m.schema_id").alias("by_name"))
    out = docs.join(by_print, "fingerprint", "left").join(by_name, "doc_type", "left")
    how = F.when(F.col("by_print").isNotNull(), "fingerprint").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return out.select("doc_id", "doc_type", F.coalesce("by_print", "by_name").alias("schema_id"), how.alias("how"))


def canonical(fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """fields (field_key, family) with canonical_key by alias of the same family, else of any, else the key itself."""
    a = aliases.select(F.lower("alias").alias("_alias"), F.col("family").alias("_family"), F.col("canonical_key").alias("_key"))
    own = a.where("_family is not null").withColumnRenamed("_key", "_own")
    every = a.groupBy("_alias").agg(F.min("_key").alias("_any"))
    key = F.lower("field_key")
    out = fields.join(own, (key == F.col("_alias")) & (F.col("family") == F.col("_family")), "left").drop("_alias", "_family")
    out = out.join(every, key == F.col("_alias"), "left")
    return out.withColumn("canonical_key", F.coalesce("_own", "_any", key)).drop("_alias", "_own", "_any")
