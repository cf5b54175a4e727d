"""The driver's tables, and stand-ins for the domain's inputs that are built from them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, label, label_norm, label_ord): part names; an entity is the smallest key of a name."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("entity_id"))
    return p.select("entity_id", F.col("p_name").alias("label"), F.lower("p_name").alias("label_norm"), F.col("entity_id").alias("label_ord"))


#: The same in SQL.
KB = "kb AS (SELECT min(p_partkey) AS entity_id, p_name AS label FROM part GROUP BY p_name)"


def part_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention_id, gold, mention): each name with its words swapped and the first one cut short."""
    words = F.split("label", " ")
    return part_labels(spark, sf_dir).select(F.col("entity_id").alias("mention_id"), F.col("entity_id").alias("gold"), F.concat(words[1], F.lit(" "), F.substr(words[0], F.lit(1), F.length(words[0]) - 1)).alias("mention"))


MENTIONS = "m AS (SELECT entity_id AS mention_id, entity_id AS gold, split_part(label, ' ', 2) || ' ' || left(split_part(label, ' ', 1), -1) AS mention FROM kb)"


def lcs_sql(a: str, b: str) -> str:
    """LCS length of two SQL strings."""
    return (
        f"list_reduce(string_split({a}, ''), lambda acc, c: list_reduce(range(1, length({b}) + 1), lambda r, j: "
        f"list_append(r, CASE WHEN substr({b}, j, 1) = c THEN acc[j] + 1 ELSE greatest(acc[j + 1], r[-1]) END), [0::BIGINT]), "
        f"list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT))[-1]"
    )


def sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


#: A candidate list of each size: block 0 from two types, block 1 from the others; entities repeat.
CANDIDATES = """
raw AS (SELECT p_size AS mention_id, p_partkey % 97 AS entity_id, round(p_retailprice / 20, 4) AS score, p_partkey, CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 0 ELSE 1 END AS block FROM part),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id, block, entity_id ORDER BY p_partkey) AS r FROM raw) WHERE r = 1),
cand AS (SELECT mention_id, entity_id, score, block, row_number() OVER (PARTITION BY mention_id, block ORDER BY p_partkey) - 1 AS ord FROM firsts)
"""


def candidate_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("mention_id"), (F.col("p_partkey") % 97).alias("entity_id"), F.round(F.col("p_retailprice") / 20, 4).alias("score"), "p_partkey", F.when(F.col("p_type").isin("ECONOMY", "LARGE"), 0).otherwise(1).alias("b"))
    once = raw.withColumn("r", F.row_number().over(Window.partitionBy("mention_id", "b", "entity_id").orderBy("p_partkey"))).filter("r = 1")
    c = once.withColumn("ord", F.row_number().over(Window.partitionBy("mention_id", "b").orderBy("p_partkey")) - 1)
    c = c.select("mention_id", "entity_id", "score", "ord", F.format_string("b%d", "b").alias("origin"), "b")
    return c.filter("b = 0").drop("b"), c.filter("b = 1").drop("b")
