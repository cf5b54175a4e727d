"""PubTator text: documents, annotations and relations; CSV tables of them; relation mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "metadata": "pmid string, title string, abstract string",
    "annotations": "pmid string, start long, end long, mention string, entity_type string, mesh_id string, ann_ord long",
    "relations": "pmid string, relation_type string, id_1 string, id_2 string, novelty string",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of text files; ord follows the files by name, then the lines of each.

    Spark reads files in an order of its own, so the file's number stands above the place in it: where the line's block
    starts, plus the line's number in its partition, which has no more lines than bytes.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("n"), "value")
    names = lines.select("f").distinct().withColumn("file", F.row_number().over(Window.orderBy("f")) - 1)  # a row for each file
    return lines.join(F.broadcast(names), "f").select((F.shiftleft(F.col("file").cast("long"), 44) + F.col("b") + F.col("n")).alias("ord"), "value")


def _whole(x: Column) -> Column:
    return F.trim(x).rlike(r"^[+-]?\d+$")


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, annotations, relations) of (ord, value) lines in one pass and three projections.

    Lines are cut at the right before the tabs count, so an annotation with an empty id has five columns and goes.
    Four or five columns whose second is no number are a relation; six with two numbers are an annotation; anything
    else is left out. A pmid makes one row of metadata; of repeated title or abstract lines the last one counts.
    """
    t = lines.select("ord", F.regexp_replace("value", r"(?U)\s+$", "").alias("v"))
    meta = t.select("ord", F.regexp_extract("v", r"^(\d+)\|([ta])\|(.*)$", 1).alias("pmid"), F.regexp_extract("v", r"^(\d+)\|([ta])\|(.*)$", 2).alias("kind"), F.trim(F.regexp_extract("v", r"^(\d+)\|([ta])\|(.*)$", 3)).alias("text")).filter("pmid <> ''")
    last = lambda k: F.coalesce(F.max_by(F.when(F.col("kind") == k, F.col("text")), F.when(F.col("kind") == k, F.col("ord"))), F.lit(""))
    metadata = meta.groupBy("pmid").agg(last("t").alias("title"), last("a").alias("abstract"))
    c = t.filter(~F.col("v").rlike(r"^\d+\|[ta]\|")).select("ord", F.split("v", "\t").alias("c")).filter(F.size("c").between(4, 6))
    g = lambda i: F.get("c", F.lit(i))
    rel = c.filter((F.size("c") < 6) & ~_whole(g(1))).select(g(0).alias("pmid"), g(1).alias("relation_type"), g(2).alias("id_1"), g(3).alias("id_2"), g(4).alias("novelty"))
    ann = c.filter((F.size("c") == 6) & _whole(g(1)) & _whole(g(2))).select(g(0).alias("pmid"), F.trim(g(1)).cast("long").alias("start"), F.trim(g(2)).cast("long").alias("end"), g(3).alias("mention"), g(4).alias("entity_type"), g(5).alias("mesh_id"), F.col("ord").alias("ann_ord"))
    return metadata, ann, rel


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse(read_lines(spark, path))


def enrich_relations(relations: DataFrame, annotations: DataFrame) -> DataFrame:
    """Relations with the mentions of both ids in their document, distinct, sorted, joined by ' / '."""
    names = annotations.filter("mesh_id IS NOT NULL").groupBy("pmid", "mesh_id").agg(F.array_join(F.array_sort(F.collect_set("mention")), " / ").alias("m"))
    for i in ("1", "2"):
        relations = relations.join(names.select("pmid", F.col("mesh_id").alias(f"id_{i}"), F.col("m").alias(f"mention_{i}")), ["pmid", f"id_{i}"], "left")
    return relations


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Write metadata, annotations and relations as CSV with a header under ``path``."""
    for name, df in tables.items():
        df.write.option("header", True).option("escape", '"').mode("overwrite").csv(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``save``; types are given, and no text is read as missing."""
    return {name: spark.read.schema(s).option("header", True).option("escape", '"').csv(f"{path}/{name}") for name, s in SCHEMAS.items()}


def contexts(metadata: DataFrame) -> DataFrame:
    """(pmid, title, context): title and abstract as one text."""
    return metadata.select("pmid", "title", F.trim(F.concat_ws(" ", "title", "abstract")).alias("context"))


def in_file_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows numbered from 0 within ``key``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
