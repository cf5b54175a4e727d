"""Evaluation against gold ids: deduplication, aliases, accuracy at k, transitions, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settle import settled

#: Items of a concept that meet another block of them in one row.
ALIAS_BLOCK = 1_000
#: Pairs that are left to one task, up to ``MOST_TASKS`` tasks.
PAIRS_PER_TASK = 5_000_000
MOST_TASKS = 10_000


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``; it supplies the context."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def _by_concept(of: DataFrame, concepts: DataFrame, *names: str) -> DataFrame:
    """(concept, item): each row of ``of`` once a concept; the item has ``names`` and ``only``, that there is no other concept."""
    one = of.join(concepts.filter("concept IS NOT NULL").select("concept", F.col("id").alias("__id")), F.col("__id") == F.col("__of"))
    sets = one.groupBy(*names).agg(F.collect_set("concept").alias("__c"))
    return sets.select(F.explode("__c").alias("concept"), F.struct(*names, (F.size("__c") == 1).alias("only")).alias("item"))


def _in_blocks(items: DataFrame) -> DataFrame:
    """(concept, only, items): lists of about ``ALIAS_BLOCK`` items of a concept, by a hash."""
    blocks = items.groupBy("concept").agg(F.ceil(F.count("*") / ALIAS_BLOCK).alias("__n"))
    return settled(items.join(blocks, "concept").groupBy("concept", F.col("item.only").alias("only"), F.pmod(F.xxhash64("item"), "__n").alias("__b")).agg(F.collect_list("item").alias("items")).select("concept", "only", "items"))


def _meet(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """(l, r): the items of both sides that share a concept, once for each concept they share; none for no pairs.

    Blocks of items meet, spread over tasks by the number of pairs, so that a large concept is no task of its own and
    pairs are neither shuffled nor held.
    """
    n = lambda b, c: b.groupBy("concept").agg(F.sum(F.size("items")).alias(c))
    pairs = n(left, "a").join(n(right, "b"), "concept").agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0]
    if not pairs:
        return None
    parts = min(int(pairs // PAIRS_PER_TASK) + 1, MOST_TASKS)
    met = left.select("concept", F.col("items").alias("__l")).join(right.select("concept", F.col("items").alias("__r")), "concept").repartition(parts)
    return met.select(F.explode("__l").alias("l"), "__r").select("l", F.explode("__r").alias("r"))


def _once(left: DataFrame, right: DataFrame, keep: Column, names: tuple[str, str], rows: DataFrame) -> DataFrame:
    """``rows`` and the pairs of ``names`` that share a concept and that ``keep`` holds for, each once.

    Where a side has one concept only, a pair occurs once as it is, so only pairs of items with several are shuffled.
    """
    lb = _in_blocks(left)
    rb = lb if left is right else _in_blocks(right)
    for l, r, several in ((lb, rb.filter("only"), False), (lb.filter("only"), rb.filter("NOT only"), False), (lb.filter("NOT only"), rb.filter("NOT only"), True)):  # noqa: E741
        met = _meet(l, r)
        if met is not None:
            new = met.filter(keep).select(F.col(f"l.{names[0]}"), F.col(f"r.{names[1]}"))
            rows = rows.union(new.distinct() if several else new)
    return rows


def aliases(concepts: DataFrame) -> DataFrame:
    """(id, alias_id) of ids that share a concept, from (concept, id); the id itself is left out."""
    items = _by_concept(concepts.select(F.col("id").alias("__of"), "id", F.col("id").alias("alias_id")).distinct(), concepts, "id", "alias_id")
    none = concepts.filter("false").select("id", F.col("id").alias("alias_id"))
    return _once(items, items, F.col("l.id") != F.col("r.alias_id"), ("id", "alias_id"), none)


def _parts(mentions: DataFrame, split_commas: bool) -> DataFrame:
    return mentions.select("mention_id", F.explode(F.split("gold_id", r"[|,]" if split_commas else r"\|")).alias("gold")).filter("gold <> ''")


def expanded_gold(mentions: DataFrame, alias: DataFrame, split_commas: bool = False) -> DataFrame:
    """(mention_id, gold): the parts of composite ids (split at bars, and at commas if asked) and their aliases."""
    parts = _parts(mentions, split_commas)
    more = parts.join(alias.select(F.col("id").alias("gold"), "alias_id"), "gold").select("mention_id", F.col("alias_id").alias("gold"))
    return parts.union(more).distinct()


def gold_by_concept(mentions: DataFrame, concepts: DataFrame, split_commas: bool = False) -> DataFrame:
    """``expanded_gold`` with the ``aliases`` of (concept, id), without a table of them: mentions meet the ids of their
    concepts. Rows grow with the square of a concept's ids; nothing that is shuffled or held does."""
    own = _parts(mentions, split_commas).groupBy("mention_id").agg(F.collect_set("gold").alias("own"))
    left = _by_concept(own.select("mention_id", "own", F.explode("own").alias("__of")), concepts, "mention_id", "own")
    right = _by_concept(concepts.select(F.col("id").alias("__of"), F.col("id").alias("gold")).distinct(), concepts, "gold")
    return _once(left, right, ~F.array_contains("l.own", F.col("r.gold")), ("mention_id", "gold"), own.select("mention_id", F.explode("own").alias("gold")))


def gold_rank(mentions: DataFrame, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """(mention_id, gold_rank, n_candidates): place of the first right candidate from 1, null for none.

    Mentions without candidates stay.
    """
    hit = candidates.join(gold.withColumnRenamed("gold", "entity_id"), ["mention_id", "entity_id"]).groupBy("mention_id").agg((F.min("ord") + 1).alias("gold_rank"))
    n = candidates.groupBy("mention_id").agg(F.count("*").alias("n_candidates"))
    return mentions.select("mention_id").distinct().join(hit, "mention_id", "left").join(n, "mention_id", "left").select("mention_id", "gold_rank", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def accuracy_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20, 30)) -> DataFrame:
    """(k, hits, total, accuracy in percent) in one pass."""
    row = ranks.agg(F.count("*").alias("total"), *[F.coalesce(F.sum(F.when(F.col("gold_rank") <= k, 1).otherwise(0)), F.lit(0)).alias(f"h{k}") for k in ks])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks]))
    return row.select("total", pairs.alias("p")).select("p.k", "p.hits", "total", F.round(100.0 * F.col("p.hits") / F.when(F.col("total") > 0, F.col("total")), 6).alias("accuracy"))


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(improved, degraded, net, both, neither) of the first place between two ``gold_rank`` tables."""
    b, a = (F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("b", "a"))
    both = before.select("mention_id", F.col("gold_rank").alias("b")).join(after.select("mention_id", F.col("gold_rank").alias("a")), "mention_id")
    return both.agg(F.count_if(a & ~b).alias("improved"), F.count_if(b & ~a).alias("degraded"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither")).withColumn("net", F.col("improved") - F.col("degraded"))


def accuracy_by_type(ranks: DataFrame, types: DataFrame) -> DataFrame:
    """(entity_type, n, hits, accuracy) of mentions with candidates, by support."""
    r = ranks.filter("n_candidates > 0").join(types.select("mention_id", F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type")), "mention_id")
    out = r.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("gold_rank") == 1, F.lit(False))).alias("hits"))
    return out.withColumn("accuracy", F.round(100.0 * F.col("hits") / F.col("n"), 6)).orderBy(F.desc("n"), "entity_type")


def expansion_gain(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    """(mentions, added, average, gold_mentions): what an expansion added and how often that was right."""
    new = after.select("mention_id", "entity_id").join(before.select("mention_id", "entity_id"), ["mention_id", "entity_id"], "left_anti")
    right = new.join(gold.withColumnRenamed("gold", "entity_id"), ["mention_id", "entity_id"], "left_semi").select(F.count_distinct("mention_id").alias("gold_mentions"))
    n = new.agg(F.count_distinct("mention_id").alias("mentions"), F.count("*").alias("added"))
    return n.join(F.broadcast(right)).select("mentions", "added", F.round(F.col("added") / F.when(F.col("mentions") > 0, F.col("mentions")), 6).alias("average"), "gold_mentions")  # one row each


def abbreviation_counts(mentions: DataFrame) -> DataFrame:
    """(mentions, likely, expanded, by_document, by_dictionary, by_model) of rows with likely, expansion and source."""
    n = lambda s: F.count_if(F.col("expansion").isNotNull() & (F.col("source") == s)).alias(f"by_{s}")
    return mentions.agg(F.count("*").alias("mentions"), F.count_if("likely").alias("likely"), F.count("expansion").alias("expanded"), *[n(s) for s in ("document", "dictionary", "model")])


def rule_counts(ranked: DataFrame) -> DataFrame:
    """(rule, mentions): mentions in which a rule changed some candidate."""
    per = ranked.groupBy("mention_id").agg(*[F.bool_or(F.col(r) != 0).alias(r) for r in ("r5", "r6", "r7", "protected")])
    row = per.agg(*[F.count_if(r).alias(r) for r in ("r5", "r6", "r7", "protected")])
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("mentions")) for r in ("r5", "r6", "r7", "protected")])).alias("x")).select("x.rule", "x.mentions")


def linkable(annotations: DataFrame, dataset: str, cui_map: DataFrame | None = None) -> DataFrame:
    """Annotations that an evaluation counts: no -1; in biored only ids of MeSH form; in medmentions CUIs, and with
    a map (cui, entity_id) only mapped ones, their ids joined by bars."""
    a = annotations.filter("mesh_id <> '-1'")
    if dataset == "biored":
        return a.filter(F.coalesce(F.col("mesh_id").rlike(r"^[DC]\d+"), F.lit(False)))
    if dataset == "medmentions":
        a = a.withColumn("cui", F.regexp_replace("mesh_id", "^UMLS:", ""))
        if cui_map is not None:
            ids = cui_map.groupBy("cui").agg(F.array_join(F.sort_array(F.collect_set("entity_id")), "|").alias("__ids"))
            a = a.join(ids, "cui").withColumn("mesh_id", F.col("__ids")).drop("__ids")
    return a
