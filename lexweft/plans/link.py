"""The whole linking job as one batch plan: documents and mentions in, one row per mention out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.abbrev import expand_mentions, extract_abbreviations
from ..functions.similarity import token_sort_ratio
from ..functions.text import variants
from ..operators import dense, disambiguate, evaluate, expand, extract, merge, rank, retrieve
from ..sources.settle import settled
from .config import LinkConfig


def search(queries: DataFrame, entities: DataFrame, config: LinkConfig) -> DataFrame:
    """(query, entity_id, score, rank) by the configured backend; ``queries`` has mention."""
    labels = retrieve.labels_of(entities)
    if config.backend == "search":
        return retrieve.boosted_search(queries, entities, config.top_k)
    if config.backend == "token":
        return retrieve.token_blocked_topk(queries, labels, lambda a, b: token_sort_ratio(a, b), config.top_k)
    find = {"fuzzy": retrieve.fuzzy_topk, "difflib": retrieve.difflib_topk}[config.backend]
    return find(queries, labels, config.top_k)


def query_blocks(mentions: DataFrame, docs: DataFrame, config: LinkConfig) -> DataFrame:
    """(mention_id, block, query): the mention, its variants, and the long form of an abbreviation, lower-cased."""
    forms = variants("mention") if config.use_variants else F.array("mention")
    q = mentions.select("mention_id", F.posexplode(F.array_distinct(F.concat(F.array("mention"), forms))).alias("block", "query"))
    if config.use_abbreviations:
        long_forms = expand_mentions(mentions.select("mention_id", "doc_id", "mention"), extract_abbreviations(docs.select("doc_id", F.concat_ws(" ", "title", "text").alias("text"))))
        q = q.union(long_forms.filter("expansion IS NOT NULL").select("mention_id", F.lit(100).alias("block"), F.col("expansion").alias("query")))
    return q.withColumn("query", F.lower("query"))


def candidates(mentions: DataFrame, docs: DataFrame, entities: DataFrame, config: LinkConfig) -> DataFrame:
    """Merged candidate list of every mention; each distinct query is searched once."""
    q = query_blocks(mentions, docs, config)
    found = search(q.select(F.col("query").alias("mention")).distinct(), entities, config)
    rows = q.join(found, "query").select("mention_id", "entity_id", "score", "block", (F.col("rank") - 1).alias("ord"), F.lit("search").alias("origin"))
    w = Window.partitionBy("mention_id").orderBy("block", "ord")
    rows = rows.withColumn("ord", F.row_number().over(w) - 1).drop("block")
    return merge.merge_candidates(config.merge, rows)


def with_dense(now: DataFrame, mentions: DataFrame, entities: DataFrame, load: Callable, config: LinkConfig) -> DataFrame:
    """Candidates ``now`` and those that the encoder finds besides, all with the weighted score of both, best first.

    Entities and mentions go through the search by 64-bit hashes of their ids and texts.
    """
    number = lambda c: F.xxhash64(F.col(c).cast("string"))
    index = dense.build_index(entities.select(number("entity_id").alias("entity_id"), "preferred_label", "synonyms"), load)
    found = dense.retrieve(mentions.select(number("mention").alias("query"), "mention").distinct(), index, load, config.top_k).withColumnRenamed("entity_id", "__n")
    rows = mentions.select("mention_id", number("mention").alias("query")).join(found, "query").join(entities.select("entity_id", number("entity_id").alias("__n")), "__n")
    rows = rows.select("mention_id", "entity_id", (100.0 * F.col("score")).alias("score"), (F.col("rank") - 1).alias("ord"), F.lit("dense").alias("origin"))
    every = merge.append_if_absent(now.select("mention_id", "entity_id", "score", "ord", "origin"), rows)
    named = every.join(mentions.select("mention_id", "mention"), "mention_id").join(entities.select("entity_id", "preferred_label"), "entity_id")
    scored = dense.score_candidates(named, load).withColumn("score", rank.hybrid(F.col("score"), F.col("dense"), config.hybrid_alpha))
    w = Window.partitionBy("mention_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("ord", F.row_number().over(w) - 1).select("mention_id", "entity_id", "score", "ord", "origin")


def link(mentions: DataFrame, docs: DataFrame, entities: DataFrame, config: LinkConfig = LinkConfig(), sources: DataFrame | None = None, bridge: DataFrame | None = None, client: Callable | None = None, encoder: Callable | None = None) -> dict[str, DataFrame]:
    """Candidate lists by phase and the final choice.

    ``mentions`` has mention_id, doc_id, mention, entity_type; ``docs`` doc_id, title, text; ``entities`` the
    kb_entity columns; ``sources`` entity_id, source; ``bridge`` name, entity_id; ``encoder`` loads an encoder for the
    dense search that ``use_dense`` asks for. Each phase is computed once, into the checkpoint folder. Mentions without candidates get
    the id NONE and the confidence no_candidates.
    """
    if config.use_dense and encoder is None:
        raise ValueError("use_dense needs an encoder")
    phases = {"search": settled(candidates(mentions, docs, entities, config))}
    now = phases["search"]
    if config.use_expansion:
        more = []
        if bridge is not None:
            more.append(expand.bridge_expansion(mentions, bridge, now, entities))
        words = expand.subword_queries(mentions)
        hits = search(words.select(F.col("word").alias("mention")).distinct(), entities, config).withColumnRenamed("query", "word")
        more += [expand.subword_expansion(words, hits, now), expand.parent_expansion(now, entities)]
        now = phases["expanded"] = settled(merge.cut(expand.expand(now, *more), now, config.expansion_top_k))
    if config.use_dense:
        now = phases["dense"] = settled(with_dense(now, mentions, entities, encoder, config))
    payload = entities.select("entity_id", "preferred_label", "definition", "tree_numbers", "synonyms")
    context = mentions.select("mention_id", "doc_id", "mention", "entity_type").join(docs.select("doc_id", "title", F.concat_ws(" ", "title", "text").alias("context")), "doc_id", "left")
    full = now.join(payload, "entity_id").join(context, "mention_id")
    full = full.join(rank.source_count(sources), "entity_id", "left") if sources is not None else full.withColumn("n_sources", F.lit(0))
    order = [F.col("ord")]
    if config.use_rules:
        full = rank.rerank(full, config.kg_boost, config.type_penalty, config.overlap_boost, config.protect_from).withColumn("score", F.col("new_score"))
        order = [F.desc("score"), F.col("ord")]
    if config.use_topics:
        topics = rank.topic_weights(docs.select("doc_id", F.concat_ws(" ", "title", "text").alias("t")), "doc_id", "t", least=config.topic_least).groupBy("doc_id").agg(F.collect_list("prefix").alias("topics"))
        full = full.join(topics, "doc_id", "left").withColumn("score", F.col("score") + rank.topic_adjustment(F.col("tree_numbers"), F.col("topics"), config.topic_boost, config.topic_penalty))
        order = [F.desc("score"), F.col("ord")]
    full = full.withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(*order)))
    ranked = phases["ranked"] = settled(full.withColumn("ord", F.col("rank") - 1))
    chosen = ranked.filter("rank = 1").select("mention_id", "entity_id", F.lit(1).alias("chosen_rank"), F.lit("rules").alias("confidence"))
    if config.use_model and client is not None:
        prompts = disambiguate.prompts(ranked, context, config.model_top_k)
        chosen = disambiguate.decide(disambiguate.ask(prompts, client), ranked)
    top = lambda df, name: df.filter("ord = 0").select("mention_id", F.col("entity_id").cast("string").alias(name))
    out = mentions.select("mention_id", "mention", "entity_type").join(chosen.join(payload.select("entity_id", "preferred_label"), "entity_id"), "mention_id", "left")
    out = out.join(top(phases["search"], "phase2_top1"), "mention_id", "left").join(top(ranked, "phase3_top1"), "mention_id", "left")
    phases["result"] = out.select("mention_id", "mention", "entity_type", F.coalesce(F.col("entity_id").cast("string"), F.lit("NONE")).alias("entity_id"), F.coalesce("preferred_label", F.lit("")).alias("preferred_label"), "phase2_top1", "phase3_top1", "chosen_rank", F.coalesce("confidence", F.lit("no_candidates")).alias("confidence"))
    return phases


def link_text(docs: DataFrame, entities: DataFrame, config: LinkConfig = LinkConfig(), **more) -> dict[str, DataFrame]:
    """Extraction by rules, then ``link``; mention ids follow document and place."""
    body = docs.select("doc_id", "text")
    found = extract.extract(body)
    placed = found.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "start")
    m = settled(placed.select(F.monotonically_increasing_id().alias("mention_id"), "doc_id", "mention", F.lit(None).cast("string").alias("entity_type")))
    return link(m, docs, entities, config, **more)


def report(phases: dict[str, DataFrame], mentions: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20, 30)) -> dict[str, DataFrame]:
    """Accuracy at k of each phase, transitions between phases, and accuracy by type."""
    lists = {p: phases[p].select("mention_id", "entity_id", "ord") for p in ("search", "expanded", "dense", "ranked") if p in phases}
    ranks = {p: evaluate.gold_rank(mentions, c, gold) for p, c in lists.items()}
    out = {f"accuracy_{p}": evaluate.accuracy_at(r, ks) for p, r in ranks.items()}
    names = list(ranks)
    out |= {f"{a}_to_{b}": evaluate.transitions(ranks[a], ranks[b]) for a, b in zip(names, names[1:], strict=False)}
    out["by_type"] = evaluate.accuracy_by_type(ranks[names[-1]], mentions)
    return out


def evaluate_job(docs: DataFrame, annotations: DataFrame, entities: DataFrame, dataset: str, config: LinkConfig = LinkConfig(), concepts: DataFrame | None = None, cui_map: DataFrame | None = None, by_concept: bool = False, alias: DataFrame | None = None, limit: int | None = None, log: str | None = None, **more) -> dict[str, DataFrame]:
    """The evaluation of a corpus: annotations that count, distinct mentions, linking, and the tables of ``report``.

    ``annotations`` has doc_id, mention, entity_type, mesh_id and ann_ord. In medmentions, ``by_concept`` links to
    concepts (the entities' ids are CUIs) instead of mapped ids; with ``cui_map`` (cui, entity_id) it keeps to mapped
    concepts, so that both kinds of index are compared on the same mentions. ``alias`` has id, alias_id; ``concepts``
    (concept, id) gives the aliases instead. ``limit`` takes the first mentions. ``log`` is a folder for the tables as JSON,
    with the mentions whose first place changed between search and ranking.
    """
    spark = docs.sparkSession
    a = evaluate.linkable(annotations, dataset, cui_map)
    if dataset == "medmentions" and (by_concept or cui_map is None):
        a = a.withColumn("mesh_id", F.col("cui"))
    a = evaluate.keep_first(a, ["mention", "mesh_id"], "ann_ord")
    a = a.orderBy("ann_ord").limit(limit) if limit else a
    m = settled(a.select(F.monotonically_increasing_id().alias("mention_id"), "doc_id", "mention", "entity_type", F.col("mesh_id").alias("gold_id")))
    if alias is None and concepts is not None:
        gold = evaluate.gold_by_concept(m, concepts, config.split_commas)
    else:
        gold = evaluate.expanded_gold(m, spark.createDataFrame([], "id string, alias_id string") if alias is None else alias, config.split_commas)
    phases = link(m.drop("gold_id"), docs, entities, config, **more)
    out = report(phases, m, gold)
    first = lambda p: evaluate.gold_rank(m, phases[p].select("mention_id", "entity_id", "ord"), gold).select("mention_id", F.coalesce(F.col("gold_rank") == 1, F.lit(False)).alias(f"{p}_correct"))
    out["changes"] = m.join(first("search"), "mention_id").join(first("ranked"), "mention_id").filter("search_correct <> ranked_correct").join(phases["result"].select("mention_id", "phase2_top1", "phase3_top1"), "mention_id")
    if log:
        for name, df in out.items():
            df.write.mode("overwrite").json(f"{log}/{name}")
    return out
