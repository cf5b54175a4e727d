"""Queries of re-ranking, topics and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evaluate as E
from ..operators import rank as R
from . import tables as T


def _sources(spark, d) -> DataFrame:
    one = lambda t, c, s: T.table(spark, d, t).select(F.col(c).alias("entity_id"), F.lit(s).alias("source"))
    return one("orders", "o_custkey", "wikidata").union(one("events", "user_id", "dbpedia")).union(one("lineitem", "l_suppkey", "umls")).union(one("part", "p_partkey", "mondo"))


_SOURCES = "src AS (SELECT entity_id, count(DISTINCT source) AS n_sources FROM (SELECT o_custkey AS entity_id, 'w' AS source FROM orders UNION ALL SELECT user_id, 'd' FROM events UNION ALL SELECT l_suppkey, 'u' FROM lineitem) GROUP BY 1)"


def rule5_multi_source(spark, d) -> DataFrame:
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    return c.join(R.source_count(_sources(spark, d)), "entity_id", "left").select("entity_id", (2.0 * F.coalesce("n_sources", F.lit(0))).alias("boost"))


def _candidates(spark, d) -> DataFrame:
    """Candidates with everything that the rules read: customers as entities, orders as mentions."""
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 2000).alias("mention_id"), F.col("o_orderpriority"))
    o = o.withColumn("ord", F.row_number().over(Window.partitionBy("mention_id").orderBy("o_orderkey")) - 1)
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    j = o.join(c, "o_custkey")
    letter = F.element_at(F.array(*[F.lit(x) for x in ("C04", "D12", "B01", "F03", "F01")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Disease", "Chemical", "OrganismTaxon", "GeneOrGeneProduct", "CellLine", "Unknown")]), (F.col("mention_id") % 6 + 1).cast("int"))
    return j.select(
        "mention_id", F.col("o_custkey").alias("entity_id"), "ord", F.round(60 + F.col("c_acctbal") / 250, 4).alias("score"), F.col("o_orderpriority").alias("mention"),
        F.when(F.col("mention_id") % 7 != 0, kind).alias("entity_type"), F.concat(F.lit("the "), "c_mktsegment", F.lit(" urgent medium specified goods")).alias("context"),
        F.concat("c_mktsegment", F.lit(" goods that are urgent or medium and specified")).alias("definition"), F.when(F.col("o_custkey") % 11 != 0, F.array(F.concat(letter, F.lit(".100")))).otherwise(F.array().cast("array<string>")).alias("tree_numbers"),
    )


_CAND = """cnd AS (SELECT o_orderkey % 2000 AS mention_id, o_custkey AS entity_id, row_number() OVER (PARTITION BY o_orderkey % 2000 ORDER BY o_orderkey) - 1 AS ord, round(60 + c_acctbal / 250, 4) AS score, o_orderpriority AS mention,
  CASE WHEN o_orderkey % 2000 % 7 <> 0 THEN ['Disease', 'Chemical', 'OrganismTaxon', 'GeneOrGeneProduct', 'CellLine', 'Unknown'][o_orderkey % 2000 % 6 + 1] END AS entity_type, c_mktsegment AS seg,
  CASE WHEN o_custkey % 11 <> 0 THEN ['C04', 'D12', 'B01', 'F03', 'F01'][o_custkey % 5 + 1] END AS tree FROM orders JOIN customer ON c_custkey = o_custkey),
r6 AS (SELECT *, CASE WHEN entity_type IS NULL OR entity_type IN ('CellLine', 'Unknown') OR tree IS NULL OR (entity_type = 'Disease' AND tree IN ('C04', 'F03')) OR (entity_type IN ('Chemical', 'GeneOrGeneProduct') AND tree = 'D12') OR (entity_type = 'OrganismTaxon' AND tree = 'B01') THEN 0.0::DOUBLE ELSE -30.0::DOUBLE END AS r6 FROM cnd),
tk AS (SELECT *, list_distinct([x FOR x IN regexp_extract_all(lower(mention), '[a-z0-9]+') IF length(x) > 2 AND x <> 'not']) AS mt, [lower(seg), 'goods', 'urgent', 'medium', 'specified'] AS dt FROM r6)"""


def rule6_type_penalty(spark, d) -> DataFrame:
    c = _candidates(spark, d)
    return c.select("mention_id", "ord", "entity_id", F.when(R.type_fits(F.col("tree_numbers"), F.col("entity_type")), F.lit(0.0)).otherwise(F.lit(-30.0)).alias("penalty"))


def rule7_overlap(spark, d) -> DataFrame:
    n = T.table(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("definition"))
    docs = T.table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    # each document meets the item whose place among the items is its id's remainder
    n = n.join(F.broadcast(n.agg(F.max("item_id").alias("last"))))  # one row
    pairs = docs.join(n, F.col("item_id") == F.pmod(F.col("k"), F.col("last") + 1))
    mention = F.col("text")
    return pairs.select("doc_id", "item_id", F.round(R.overlap_score(F.col("definition"), mention, F.col("text"), 3.0), 6).alias("overlap"))


def rerank_full(spark, d) -> DataFrame:
    c = _candidates(spark, d).join(R.source_count(_sources(spark, d)), "entity_id", "left")
    return R.rerank(c).select("mention_id", "ord", "entity_id", F.round("new_score", 6).alias("new_score"), "new_rank", F.col("protected"))


def rule_triggers(spark, d) -> DataFrame:
    c = _candidates(spark, d).join(R.source_count(_sources(spark, d)), "entity_id", "left")
    return E.rule_counts(R.rerank(c))


LEXICON = [("the", "C04", 1), ("of", "C04", 1), ("tion", "C14", 1), ("edth", "C14", 2), ("der", "D", 1), ("eau", "F03", 2), ("ción", "C10", 2), ("ing", "C10", 1)]


def topic_detect(spark, d) -> DataFrame:
    return R.topic_weights(T.table(spark, d, "documents"), "doc_id", "text", LEXICON)


def topic_rescore(spark, d) -> DataFrame:
    topics = topic_detect(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list("prefix")).alias("topics"))
    tree = F.element_at(F.array(*[F.lit(x) for x in ("C04.1", "C08", "D12.5", "F03.2", "C", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = T.table(spark, d, "documents").select("doc_id").distinct().join(topics, "doc_id", "left").withColumn("trees", F.when(tree == "", F.array().cast("array<string>")).otherwise(F.array(tree)))
    return docs.select("doc_id", R.topic_adjustment(F.col("trees"), F.col("topics")).alias("adjustment"))


#: A text for each prefix, made of its keywords.
KEYWORD_TEXTS = [" ".join(k for k, q, _ in fixed.TOPIC_KEYWORDS if q == p) for p in dict.fromkeys(p for _, p, _ in fixed.TOPIC_KEYWORDS)]


def topic_known(spark, d) -> DataFrame:
    """The built-in keywords over the concatenated names of keywords, one text for each prefix."""
    docs = spark.sql("SELECT inline(array(" + ", ".join(f"named_struct('doc_id', {i}L, 'text', '{t}')" for i, t in enumerate(KEYWORD_TEXTS)) + "))")
    return R.topic_weights(docs, "doc_id", "text")


def _ranks(spark, d, first: str = "ord"):
    """Gold is the customer whose key ends like the mention's number."""
    c = _candidates(spark, d).withColumn("ord", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id") if first == "score" else Window.partitionBy("mention_id").orderBy("ord")) - 1)
    m = spark.range(2000).select(F.col("id").alias("mention_id"))
    gold = c.filter("entity_id % 10 = mention_id % 10").select("mention_id", F.col("entity_id").alias("gold")).distinct()
    return m, c, gold, E.gold_rank(m, c.select("mention_id", "entity_id", "ord"), gold)


def _rank_sql(name: str, order: str) -> str:
    return f"""{name} AS (SELECT m.mention_id, min(CASE WHEN x.entity_id % 10 = m.mention_id % 10 THEN x.o END) AS gold_rank, count(x.o) AS n_candidates
 FROM (SELECT unnest(range(2000)) AS mention_id) m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY {order}) AS o FROM cnd) x ON x.mention_id = m.mention_id GROUP BY 1)"""


def accuracy_at_k(spark, d) -> DataFrame:
    return E.accuracy_at(_ranks(spark, d)[3])


def phase_transitions(spark, d) -> DataFrame:
    return E.transitions(_ranks(spark, d)[3], _ranks(spark, d, "score")[3])


def accuracy_by_type(spark, d) -> DataFrame:
    m, c, _, ranks = _ranks(spark, d)
    return E.accuracy_by_type(ranks, c.select("mention_id", "entity_type").distinct())


def expansion_diagnostics(spark, d) -> DataFrame:
    _, c, gold, _ = _ranks(spark, d)
    return E.expansion_gain(c.filter("ord < 3"), c, gold)


def gold_alias_expand(spark, d) -> DataFrame:
    p = T.table(spark, d, "part")
    concepts = p.filter("p_size <= 3").select(F.col("p_name").alias("concept"), F.col("p_partkey").cast("string").alias("id"))
    m = p.select(F.col("p_partkey").alias("mention_id"), F.concat(F.col("p_partkey").cast("string"), F.lit("|X"), F.col("p_size").cast("string")).alias("gold_id"))
    return E.gold_by_concept(m, concepts)


def dedupe_keep_first(spark, d) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return E.keep_first(e, ["user_id", "event_type"], "event_id")


def abbreviation_diagnostics(spark, d) -> DataFrame:
    p = T.table(spark, d, "part").select((F.length("p_brand") <= 7).alias("likely"), F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("expansion"), F.element_at(F.array(*[F.lit(x) for x in ("document", "dictionary", "model")]), (F.col("p_size") % 3 + 1).cast("int")).alias("source"))
    return E.abbreviation_counts(p)


def fair_subset(spark, d) -> DataFrame:
    o = T.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("cui"), F.col("o_orderpriority").alias("entity_id"))
    c = T.table(spark, d, "customer").select(F.concat(F.lit("UMLS:"), "c_custkey").alias("mesh_id"), "c_name")
    return E.linkable(c, "medmentions", o).select(F.col("cui").cast("long").alias("cui"), "c_name", F.col("mesh_id").alias("ids"))


QUERIES = {f.__name__: f for f in (rule5_multi_source, rule6_type_penalty, rule7_overlap, rerank_full, rule_triggers, topic_detect, topic_rescore, topic_known, accuracy_at_k, phase_transitions, accuracy_by_type, expansion_diagnostics, gold_alias_expand, dedupe_keep_first, abbreviation_diagnostics, fair_subset)}

_STOP = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)
_TOK = lambda x: f"list_distinct([x FOR x IN regexp_extract_all(lower({x}), '[a-z0-9]+') IF length(x) >= 3 AND x NOT IN ({_STOP})])"
_RERANK = f"""WITH {_SOURCES}, {_CAND},
sc AS (SELECT tk.*, 2.0::DOUBLE * coalesce(n_sources, 0) AS r5, least(len(list_intersect(mt, dt)), 2) * 3.0::DOUBLE + 2 * 0.9::DOUBLE AS r7, first_value(score) OVER (PARTITION BY mention_id ORDER BY ord) AS f FROM tk LEFT JOIN src USING (entity_id)),
fin AS (SELECT *, CASE WHEN ord = 0 AND f >= 90 THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END AS protected FROM sc)"""
_TOPIC = "tw AS (SELECT doc_id, p AS prefix, w AS weight FROM (SELECT doc_id, unnest(['C04', 'C14', 'D', 'F03', 'C10']) AS p, unnest([{}]) AS w FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)) WHERE w >= 4)"
_N = lambda k: f"least((length(t) - length(replace(t, '{k}', ''))) // {len(k)}, 3)"
_TW = _TOPIC.format(", ".join(" + ".join(f"{w} * {_N(k)}" for k, q, w in LEXICON if q == p) for p in ("C04", "C14", "D", "F03", "C10")))

ORACLES = {
    "rule5_multi_source": f"WITH {_SOURCES} SELECT c_custkey AS entity_id, 2.0::DOUBLE * coalesce(n_sources, 0) AS boost FROM customer LEFT JOIN src ON entity_id = c_custkey",
    "rule6_type_penalty": f"WITH {_CAND} SELECT mention_id, CAST(ord AS INTEGER) AS ord, entity_id, r6 AS penalty FROM r6",
    "rule7_overlap": f"""WITH p AS (SELECT doc_id, item_id, {_TOK('b.text')} AS d, {_TOK("coalesce(a.text, '')")} AS c FROM documents a JOIN benchmark b ON b.item_id = a.doc_id % (SELECT max(item_id) + 1 FROM benchmark))
SELECT doc_id, item_id, round(least(len(list_intersect(c, d)), 2) * 3.0::DOUBLE + least(len(list_intersect(c, d)), 2) * (0.3::DOUBLE * 3), 6) AS overlap FROM p""",
    "rerank_full": f"{_RERANK} SELECT mention_id, CAST(ord AS INTEGER) AS ord, entity_id, round(score + r5 + r6 + r7 + protected, 6) AS new_score, CAST(row_number() OVER (PARTITION BY mention_id ORDER BY score + r5 + r6 + r7 + protected DESC, ord) AS INTEGER) AS new_rank, protected FROM fin",
    "rule_triggers": f"{_RERANK}, t AS (SELECT mention_id, bool_or(r5 <> 0) AS a, bool_or(r6 <> 0) AS b, bool_or(r7 <> 0) AS c, bool_or(protected <> 0) AS p FROM fin GROUP BY 1) SELECT unnest(['r5', 'r6', 'r7', 'protected']) AS rule, unnest([count(*) FILTER (a), count(*) FILTER (b), count(*) FILTER (c), count(*) FILTER (p)]) AS mentions FROM t",
    "topic_detect": f"WITH {_TW} SELECT doc_id, prefix, weight FROM tw",
    "topic_rescore": f"""WITH {_TW}, g AS (SELECT doc_id, list(prefix) AS p FROM tw GROUP BY 1), c AS (SELECT DISTINCT doc_id, ['C04.1', 'C08', 'D12.5', 'F03.2', 'C', ''][doc_id % 6 + 1] AS tree FROM documents)
SELECT doc_id, CASE WHEN p IS NULL OR tree = '' THEN 0.0::DOUBLE WHEN length(tree) >= 3 AND list_contains(p, left(tree, 3)) THEN 3.0::DOUBLE WHEN length(tree) >= 3 AND left(tree, 1) = 'C' AND len([x FOR x IN p IF length(x) > 1 AND left(x, 1) = 'C']) > 0 THEN -3.0::DOUBLE ELSE 0.0::DOUBLE END AS adjustment FROM c LEFT JOIN g USING (doc_id)""",
    "topic_known": "WITH d(doc_id, t) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(KEYWORD_TEXTS)) + "), k(k, p, w) AS (VALUES " + ", ".join(f"('{k}', '{p}', {w})" for k, p, w in fixed.TOPIC_KEYWORDS) + """)
SELECT doc_id, p AS prefix, CAST(sum(least((length(t) - length(replace(t, k, ''))) // length(k), 3) * w) AS BIGINT) AS weight FROM d, k GROUP BY 1, 2 HAVING weight >= 4""",
    "accuracy_at_k": f"WITH {_CAND}, {_rank_sql('r', 'ord')} SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (gold_rank <= k) AS hits, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (gold_rank <= k) / count(*), 6) AS accuracy FROM r, (SELECT unnest([1, 5, 10, 20, 30]) AS k) GROUP BY k",
    "phase_transitions": f"""WITH {_CAND}, {_rank_sql('r', 'ord')}, {_rank_sql('s', 'score DESC, entity_id')}, j AS (SELECT coalesce(r.gold_rank = 1, false) AS b, coalesce(s.gold_rank = 1, false) AS a FROM r JOIN s USING (mention_id))
SELECT count(*) FILTER (a AND NOT b) AS improved, count(*) FILTER (b AND NOT a) AS degraded, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (a AND NOT b) - count(*) FILTER (b AND NOT a) AS net FROM j""",
    "accuracy_by_type": f"WITH {_CAND}, {_rank_sql('r', 'ord')} SELECT coalesce(entity_type, 'Unknown') AS entity_type, count(*) AS n, count(*) FILTER (gold_rank = 1) AS hits, round(100.0::DOUBLE * count(*) FILTER (gold_rank = 1) / count(*), 6) AS accuracy FROM r JOIN (SELECT DISTINCT mention_id, entity_type FROM cnd) USING (mention_id) WHERE n_candidates > 0 GROUP BY 1",
    "expansion_diagnostics": f"""WITH {_CAND}, c AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY ord) AS o FROM cnd), n AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.o <= 3 AND b.mention_id = c.mention_id AND b.entity_id = c.entity_id))
SELECT count(DISTINCT mention_id) AS mentions, count(*) AS added, round(count(*) / count(DISTINCT mention_id), 6) AS average, count(DISTINCT CASE WHEN entity_id % 10 = mention_id % 10 THEN mention_id END) AS gold_mentions FROM n""",
    "gold_alias_expand": """WITH a AS (SELECT p_name, p_partkey AS id FROM part WHERE p_size <= 3)
SELECT p_partkey AS mention_id, CAST(p_partkey AS VARCHAR) AS gold FROM part UNION SELECT p_partkey, 'X' || p_size FROM part UNION SELECT x.id, CAST(y.id AS VARCHAR) FROM a x JOIN a y ON x.p_name = y.p_name AND x.id <> y.id""",
    "dedupe_keep_first": "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "abbreviation_diagnostics": "SELECT count(*) AS mentions, count(*) FILTER (length(p_brand) <= 7) AS likely, count(*) FILTER (p_size % 3 > 0) AS expanded, 0::BIGINT AS by_document, count(*) FILTER (p_size % 3 = 1) AS by_dictionary, count(*) FILTER (p_size % 3 = 2) AS by_model FROM part",
    "fair_subset": "SELECT c_custkey AS cui, c_name, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS ids FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
}
