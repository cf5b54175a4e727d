"""Candidate expansion: relation bridge, sub-words, tree parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import significant_words
from ..sources.settle import settled, small
from .evaluate import _by_concept, _once
from .merge import keep_best

BRIDGE_SCORE = 60.0
MOST_BRIDGED = 15


def both_ways(relations: DataFrame) -> DataFrame:
    """(cui, kind, other) of (cui1, rel, cui2): PAR, CHD, RB and RN, each with its inverse; other relations are left out."""
    kinds = {"PAR": "parent", "CHD": "child", "RB": "broader", "RN": "narrower"}
    inverse = {"PAR": "child", "CHD": "parent", "RB": "narrower", "RN": "broader"}
    name = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("rel"))
    known = relations.filter(F.col("rel").isin(list(kinds)))
    return known.select(F.col("cui1").alias("cui"), name(kinds).alias("kind"), F.col("cui2").alias("other")).union(known.select("cui2", name(inverse), "cui1")).distinct()


def reachable(relations: DataFrame, mapped: DataFrame, most: int = MOST_BRIDGED) -> DataFrame:
    """(cui, ids) for concepts that occur in relations but have no id in ``mapped`` (cui, entity_id).

    One hop over all four kinds; two hops (parent or broader twice) only where one hop finds nothing. The smallest
    ``most`` ids are kept.
    """
    known = relations.filter(F.col("rel").isin("PAR", "CHD", "RB", "RN") & F.col("cui1").isNotNull() & F.col("cui2").isNotNull())
    # only sets of concepts and ids are made distinct, never the relations themselves
    edges = known.select(F.explode(F.array(F.struct(F.col("cui1").alias("cui"), F.col("cui2").alias("other")), F.struct(F.col("cui2").alias("cui"), F.col("cui1").alias("other")))).alias("e")).select("e.cui", "e.other")
    forth = F.col("rel").isin("PAR", "RB")
    up = known.select(F.when(forth, F.col("cui1")).otherwise(F.col("cui2")).alias("cui"), F.when(forth, F.col("cui2")).otherwise(F.col("cui1")).alias("other"))
    ids = small(mapped.select(F.col("cui").alias("other"), "entity_id").distinct())
    has = small(mapped.select("cui").distinct())
    one = settled(edges.join(ids, "other").select("cui", "entity_id").distinct().join(has, "cui", "left_anti"))
    # ids of the middle concepts first: few concepts have one, and a hub passes on no more than are kept
    mid = up.join(ids, "other").select(F.col("cui").alias("other"), "entity_id").distinct()
    mid = mid.withColumn("r", F.row_number().over(Window.partitionBy("other").orderBy("entity_id"))).filter(F.col("r") <= most)
    mid = small(settled(mid.groupBy("other").agg(F.collect_list("entity_id").alias("ids"))))
    rest = up.join(has, "cui", "left_anti").join(small(one.select("cui").distinct()), "cui", "left_anti")
    two = rest.join(mid, "other").select("cui", F.explode("ids").alias("entity_id")).distinct()
    w = Window.partitionBy("cui").orderBy("entity_id")
    some = one.union(two).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return some.groupBy("cui").agg(F.sort_array(F.collect_list("entity_id")).alias("ids"))


def name_bridge(names: DataFrame, reached: DataFrame) -> DataFrame:
    """(name, entity_id): English names (cui, name) of reached concepts, lower-cased, of three characters and more."""
    n = names.select("cui", F.lower(F.trim("name")).alias("name")).filter(F.length("name") >= 3)
    return n.join(reached, "cui").select("name", F.explode("ids").alias("entity_id")).distinct()


def _placed(found: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("mention_id").orderBy("entity_id")) - 1
    return found.select("mention_id", "entity_id", F.lit(BRIDGE_SCORE).alias("score"), place.alias("ord"), F.format_string("[UMLS bridge: %s]", "mention").alias("origin"))


def bridge_expansion(mentions: DataFrame, bridge: DataFrame, have: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose bridge name is the mention; entities that the mention has already, or that are not in
    ``known`` (entity_id), are left out."""
    m = mentions.select("mention_id", F.lower(F.trim("mention")).alias("name"), "mention")
    return _placed(m.join(bridge, "name").join(have.select("mention_id", "entity_id"), ["mention_id", "entity_id"], "left_anti").join(known.select("entity_id").distinct(), "entity_id", "left_semi"))


def bridge_by_concept(mentions: DataFrame, names: DataFrame, reached: DataFrame, have: DataFrame, known: DataFrame) -> DataFrame:
    """``bridge_expansion`` with the ``name_bridge`` of ``names`` and ``reached``, without a table of it: mentions meet the
    known entities of their names' concepts in blocks, so that no task holds or dedupes what a large concept reaches."""
    n = names.select(F.col("cui").alias("concept"), F.lower(F.trim("name")).alias("id")).filter(F.length("id") >= 3).distinct()
    e = reached.select("cui", F.explode("ids").alias("entity_id")).repartition("entity_id").join(known.select("entity_id").distinct(), "entity_id", "left_semi").distinct()
    own = have.groupBy("mention_id").agg(F.collect_set("entity_id").alias("own"))
    left = mentions.join(own, "mention_id", "left").select(F.struct("mention_id", "mention").alias("of"), F.coalesce("own", F.array().cast(own.schema["own"].dataType)).alias("own"), F.lower(F.trim("mention")).alias("__of"))
    right = e.select("entity_id", F.col("entity_id").alias("__of")).distinct()
    none = mentions.join(e.select("entity_id"), F.lit(False)).select(F.struct("mention_id", "mention").alias("of"), "entity_id")
    found = _once(_by_concept(left, n, "of", "own"), _by_concept(right, e.select(F.col("cui").alias("concept"), F.col("entity_id").alias("id")), "entity_id"), ~F.array_contains("l.own", F.col("r.entity_id")), ("of", "entity_id"), none)
    return _placed(found.select("of.mention_id", "of.mention", "entity_id"))


def subword_queries(mentions: DataFrame) -> DataFrame:
    """(mention_id, place, word) of mentions of two words and more; a repeated word counts at each place."""
    w = mentions.select("mention_id", significant_words("mention").alias("w")).filter(F.size("w") >= 2)
    return w.select("mention_id", F.posexplode("w").alias("place", "word"))


def subword_expansion(words: DataFrame, hits: DataFrame, have: DataFrame, per_word: int = 5, most: int = 5) -> DataFrame:
    """Entities found by single words: 0.6 * best score * (1 + 0.3 (n - 1)) for n >= 2 words.

    ``words`` is ``subword_queries``; ``hits`` has word, entity_id, score and rank.
    """
    found = words.join(hits.filter(F.col("rank") <= per_word), "word").groupBy("mention_id", "entity_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    found = found.filter("n >= 2").join(have.select("mention_id", "entity_id"), ["mention_id", "entity_id"], "left_anti")
    score = F.lit(0.6) * F.col("best") * (F.lit(1.0) + F.lit(0.3) * (F.col("n") - 1))
    place = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    out = found.withColumn("score", score).withColumn("ord", F.row_number().over(place) - 1).filter(F.col("ord") < most)
    return out.select("mention_id", "entity_id", "score", "ord", F.format_string("[sub-word: %d words matched]", "n").alias("origin"))


def tree_prefixes(tree: Column) -> Column:
    """Proper prefixes of a tree number: C04.588.614 has C04 and C04.588."""
    parts = F.split(tree, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda d: F.array_join(F.slice(parts, 1, d), "."))).otherwise(F.array().cast("array<string>"))


def parent_expansion(candidates: DataFrame, entities: DataFrame, first: int = 10, least: int = 2, most: int = 3) -> DataFrame:
    """Entities that own a tree prefix which the first candidates share: 55 + count.

    Counts are of tree numbers. Prefixes of depth 2 and more that occur twice and more are taken by depth, then by
    count; a prefix whose owner the mention has already is skipped.
    """
    trees = entities.select("entity_id", F.posexplode_outer("tree_numbers").alias("i", "tree"))
    owner = trees.filter("tree IS NOT NULL").groupBy(F.col("tree").alias("prefix")).agg(F.min("entity_id").alias("owner"))
    c = candidates.filter(F.col("ord") < first).join(trees.filter("tree IS NOT NULL"), "entity_id")
    counts = c.select("mention_id", F.explode(tree_prefixes(F.col("tree"))).alias("prefix")).groupBy("mention_id", "prefix").agg(F.count("*").alias("n"))
    counts = counts.withColumn("depth", F.size(F.split("prefix", r"\."))).filter((F.col("n") >= least) & (F.col("depth") >= 2))
    found = counts.join(owner, "prefix").join(candidates.select("mention_id", F.col("entity_id").alias("owner")), ["mention_id", "owner"], "left_anti")
    once = found.withColumn("r", F.row_number().over(Window.partitionBy("mention_id", "owner").orderBy(F.desc("depth"), F.desc("n"), "prefix"))).filter("r = 1")
    place = Window.partitionBy("mention_id").orderBy(F.desc("depth"), F.desc("n"), "prefix")
    out = once.withColumn("ord", F.row_number().over(place) - 1).filter(F.col("ord") < most)
    return out.select("mention_id", F.col("owner").alias("entity_id"), (F.lit(55.0) + F.col("n")).alias("score"), "ord", F.format_string("[parent of %d candidates: %s]", "n", "prefix").alias("origin"))


def expand(candidates: DataFrame, *more: DataFrame) -> DataFrame:
    """The candidates and their expansions, best score per entity, sorted."""
    return keep_best(candidates, *more)
