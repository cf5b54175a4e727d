"""Unions of candidate lists. ``candidate`` rows are (mention_id, entity_id, score, ord, origin)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_blocks(*blocks: DataFrame) -> DataFrame:
    """Candidate lists one after the other, with their block number."""
    out = blocks[0].withColumn("block", F.lit(0))
    for i, b in enumerate(blocks[1:], 1):
        out = out.unionByName(b.withColumn("block", F.lit(i)))
    return out


def append_if_absent(*blocks: DataFrame) -> DataFrame:
    """Each entity once a mention, where it comes first; the order is by block, then by place; ord is renumbered."""
    w = Window.partitionBy("mention_id", "entity_id").orderBy("block", "ord")
    once = in_blocks(*blocks).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    place = Window.partitionBy("mention_id").orderBy("block", "ord", "entity_id")
    return once.withColumn("ord", F.row_number().over(place) - 1).drop("block")


def keep_best(*blocks: DataFrame) -> DataFrame:
    """Each entity once a mention with its best score, then by score; ties keep the first block's row."""
    best = F.max(F.struct("score", (-F.col("block")).alias("b"), (-F.col("ord")).alias("o"), "origin")).alias("m")
    one = in_blocks(*blocks).groupBy("mention_id", "entity_id").agg(best).select("mention_id", "entity_id", F.col("m.score").alias("score"), F.col("m.origin").alias("origin"), (-F.col("m.b")).alias("block"), (-F.col("m.o")).alias("o"))
    place = Window.partitionBy("mention_id").orderBy(F.desc("score"), "block", "o", "entity_id")
    return one.withColumn("ord", F.row_number().over(place) - 1).select("mention_id", "entity_id", "score", "ord", "origin")


def merge_candidates(how: str, *blocks: DataFrame) -> DataFrame:
    """``how`` is max (best score, sorted) or append (first place, unsorted)."""
    return {"max": keep_best, "append": append_if_absent}[how](*blocks)


def cut(candidates: DataFrame, base: DataFrame, k: int, extra: int = 10) -> DataFrame:
    """The first max(k, base list's length + ``extra``) candidates of each mention."""
    n = base.groupBy("mention_id").agg(F.count("*").alias("__n"))
    kept = candidates.join(n, "mention_id", "left").filter(F.col("ord") < F.greatest(F.lit(k), F.coalesce("__n", F.lit(0)) + extra))
    return kept.drop("__n")
