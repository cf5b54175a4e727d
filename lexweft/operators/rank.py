"""Re-scoring of candidates: knowledge-graph presence, semantic type, definition overlap, topic, embeddings."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import content_tokens


def source_count(sources: DataFrame, names: tuple[str, ...] = ("wikidata", "dbpedia", "umls")) -> DataFrame:
    """(entity_id, n_sources) of (entity_id, source): how many of the counted graphs hold the entity."""
    return sources.filter(F.col("source").isin(list(names))).groupBy("entity_id").agg(F.count_distinct("source").alias("n_sources"))


def type_fits(trees: Column, entity_type: Column) -> Column:
    """Whether the rule has nothing against: no type, an unknown type, a type or a candidate without trees, or a fit."""
    table = F.create_map(*[x for k, v in fixed.TYPE_TREES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])
    want = F.element_at(table, entity_type)
    mine = F.flatten(F.transform(trees, lambda t: F.array(F.substring(t, 1, 1), F.substring(t, 1, 3))))
    return F.coalesce(entity_type.isNull() | want.isNull() | (F.size(want) == 0) | (F.coalesce(F.size(trees), F.lit(0)) == 0) | F.arrays_overlap(mine, want), F.lit(True))


def overlap_score(definition: Column, mention: Column, context: Column, boost: float) -> Column:
    """boost for each token, two at most, that mention and definition share, and 0.3 boost for context and definition."""
    d = content_tokens(F.coalesce(definition, F.lit("")))
    shared = lambda x: F.least(F.size(F.array_intersect(content_tokens(F.coalesce(x, F.lit(""))), d)), F.lit(2))
    return F.least(shared(mention) * F.lit(boost) + shared(context) * F.lit(0.3 * boost), F.lit(3 * boost))


def rerank(candidates: DataFrame, kg_boost: float = 2.0, type_penalty: float = -30.0, overlap_boost: float = 3.0, protect_from: float = 90.0, protection: float = 15.0) -> DataFrame:
    """Adds r5, r6, r7, protected, new_score and new_rank.

    ``candidates`` has mention_id, entity_id, score, ord, mention, entity_type, context, definition, tree_numbers and
    n_sources. The incoming first candidate is protected if its score is ``protect_from`` or more. Ties keep the
    incoming order.
    """
    first = F.first("score").over(Window.partitionBy("mention_id").orderBy("ord"))
    out = candidates.withColumns(
        {
            "r5": F.lit(kg_boost) * F.coalesce("n_sources", F.lit(0)),
            "r6": F.when(type_fits(F.col("tree_numbers"), F.col("entity_type")), F.lit(0.0)).otherwise(F.lit(type_penalty)),
            "r7": overlap_score(F.col("definition"), F.col("mention"), F.col("context"), overlap_boost),
            "protected": F.when((F.col("ord") == 0) & (first >= protect_from), F.lit(protection)).otherwise(F.lit(0.0)),
        }
    )
    out = out.withColumn("new_score", F.col("score") + F.col("r5") + F.col("r6") + F.col("r7") + F.col("protected"))
    w = Window.partitionBy("mention_id").orderBy(F.desc("new_score"), "ord")
    return out.withColumn("new_rank", F.row_number().over(w))


def hybrid(score: Column, dense: Column, alpha: float = 0.7) -> Column:
    """alpha * score + (1 - alpha) * 100 cosine."""
    return F.lit(alpha) * score + F.lit(1 - alpha) * dense


def topic_weights(docs: DataFrame, key: str, text: str, keywords: list[tuple[str, str, int]] | None = None, least: int = 4, cap: int = 3) -> DataFrame:
    """(key, prefix, weight): keyword counts, ``cap`` each at most, times weight, summed by prefix; ``least`` or more.

    One pass over the texts: the counts of all keywords are columns of one array; only hits are exploded.
    """
    keywords = keywords or fixed.TOPIC_KEYWORDS
    low = F.lower(F.coalesce(text, F.lit("")))
    prefixes = list(dict.fromkeys(p for _, p, _ in keywords))
    count = lambda k: F.least(F.floor((F.length("__t") - F.length(F.replace(F.col("__t"), F.lit(k), F.lit("")))) / len(k)), F.lit(cap))
    sums = {p: functools.reduce(lambda a, b: a + b, [count(k) * w for k, q, w in keywords if q == p]) for p in prefixes}
    rows = docs.select(key, low.alias("__t")).select(key, F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), s.cast("long").alias("weight")) for p, s in sums.items()])).alias("w"))
    return rows.select(key, "w.prefix", "w.weight").filter(F.col("weight") >= least)


def topic_adjustment(trees: Column, topics: Column, boost: float = 3.0, penalty: float = -3.0) -> Column:
    """boost if a tree number of the candidate lies under a topic prefix of two characters and more; else the
    penalty if there is a disease topic and the candidate is another disease. ``topics`` is an array of prefixes."""
    fine = F.filter(topics, lambda p: F.length(p) > 1)
    subs = F.transform(F.filter(trees, lambda t: F.length(t) >= 3), lambda t: F.substring(t, 1, 3))
    disease = F.exists(trees, lambda t: F.substring(t, 1, 1) == "C") & (F.size(subs) > 0) & F.exists(fine, lambda p: p.startswith("C"))
    known = (F.coalesce(F.size(trees), F.lit(0)) > 0) & (F.coalesce(F.size(topics), F.lit(0)) > 0)
    return F.coalesce(F.when(known & F.arrays_overlap(subs, fine), F.lit(boost)).when(known & disease, F.lit(penalty)), F.lit(0.0))
