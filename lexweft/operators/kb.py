"""Knowledge-base operators: enrichment with synonyms, identifiers by concept, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(entities: DataFrame, names: DataFrame) -> DataFrame:
    """``entities`` with the names (entity_id, name) that they lack, whatever the case; unknown ids are left out.

    Names are compared with what an entity had before: case variants inside ``names`` all enter.
    """
    new = names.filter(F.trim("name") != "").groupBy("entity_id").agg(F.array_sort(F.collect_set("name")).alias("__new"))
    have = F.transform("synonyms", F.lower)
    out = entities.join(new, "entity_id", "left")
    more = F.filter(F.coalesce("__new", F.array().cast("array<string>")), lambda n: ~F.array_contains(have, F.lower(n)))
    return out.withColumn("synonyms", F.concat("synonyms", more)).drop("__new")


def enrich_in_order(entities: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """One source after the other, each compared with the result of those before."""
    for names in sources:
        entities = enrich(entities, names)
    return entities


def concept_entities(rows: DataFrame) -> DataFrame:
    """Entities by concept from (cui, label, preferred, sab, code, ord): first preferred label by ord (else the first
    label in order of names), labels, vocabularies and codes as sorted arrays."""
    p = F.min(F.when(F.col("preferred"), F.struct("ord", "label")))
    return rows.filter(F.trim("label") != "").groupBy("cui").agg(
        F.coalesce(p["label"], F.min("label")).alias("preferred_label"),
        F.array_sort(F.collect_set("label")).alias("synonyms"),
        F.array_sort(F.collect_set("sab")).alias("vocabularies"),
        F.array_sort(F.collect_set(F.when(F.col("sab") == "MSH", F.col("code")))).alias("mesh_ids"),
    )


def public_id(ids: str = "mesh_ids", concept: str = "cui", always_concept: bool = False):
    """The first mapped id, else the concept."""
    return F.col(concept) if always_concept else F.coalesce(F.try_element_at(F.col(ids), F.lit(1)), F.col(concept))


def statistics(entities: DataFrame, mapped: str = "mesh_ids") -> DataFrame:
    """(concepts, labels, mapped, mapped_percent, average_synonyms)."""
    row = entities.agg(F.count("*").alias("concepts"), F.coalesce(F.sum(F.size("synonyms")), F.lit(0)).alias("labels"), F.count_if(F.size(mapped) > 0).alias("mapped"))
    n = F.when(F.col("concepts") > 0, F.col("concepts"))
    return row.withColumn("mapped_percent", F.round(100.0 * F.col("mapped") / n, 6)).withColumn("average_synonyms", F.round(F.col("labels") / n, 6))


def top_vocabularies(entities: DataFrame, k: int = 10) -> DataFrame:
    return entities.select(F.explode("vocabularies").alias("vocabulary")).groupBy("vocabulary").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vocabulary").limit(k)


def bridge_labels(bridge: DataFrame, entities: DataFrame) -> DataFrame:
    """Bridge names (name, entity_id) of known entities as further rows of a label table."""
    return bridge.join(entities.select("entity_id"), "entity_id").select("entity_id", F.col("name").alias("label"), F.lower("name").alias("label_norm"))


def lookup(rows: DataFrame, table: DataFrame, key: str = "entity_id", how: str = "left_semi") -> DataFrame:
    """Rows whose key the table has (left_semi), lacks (left_anti), or with the table's columns (inner, left)."""
    return rows.join(table, key, how)
