"""Queries of retrieval, unions and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import dot, indel_ratio, lcs_length, token_sort_key
from ..functions.text import significant_words
from ..operators import dense as V
from ..operators import expand as X
from ..operators import merge as M
from ..operators import retrieve as R
from ..operators.rank import hybrid
from . import tables as T


def fuzzy_link_topk(spark, d) -> DataFrame:
    return R.fuzzy_topk(T.part_mentions(spark, d), T.part_labels(spark, d), 3).select("query", "entity_id", F.round("score", 6).alias("score"), "matched", "rank")


def fuzzy_token_blocked(spark, d) -> DataFrame:
    w = F.split("label", " ")
    q = T.part_labels(spark, d).select(F.concat(w[0], F.lit(" "), F.substr(w[1], F.lit(1), F.lit(3))).alias("mention"))
    score = lambda a, b: indel_ratio(lcs_length(token_sort_key(a), token_sort_key(b)), token_sort_key(a), token_sort_key(b))
    return R.token_blocked_topk(q, T.part_labels(spark, d), score, 5).select("query", "entity_id", F.round("score", 6).alias("score"), "rank")


def difflib_topk(spark, d) -> DataFrame:
    return R.difflib_topk(T.part_mentions(spark, d), T.part_labels(spark, d), 3)


def bm25_topk(spark, d) -> DataFrame:
    q = T.table(spark, d, "benchmark").select(F.col("text").alias("mention"))
    return R.bm25_topk(q, T.table(spark, d, "documents"), "doc_id", "text", 5)


def boosted_search(spark, d) -> DataFrame:
    e = T.part_labels(spark, d).select("entity_id", F.col("label").alias("preferred_label"), F.array("label", F.concat(F.lit("new "), F.element_at(F.split("label", " "), 2))).alias("synonyms"))
    return R.boosted_search(T.part_mentions(spark, d), e, 3)


def exact_label_lookup(spark, d) -> DataFrame:
    m = T.table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("mention"))
    return m.join(T.part_labels(spark, d), F.lower("mention") == F.col("label_norm")).select("p_partkey", "mention", "entity_id", "label")


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    e = T.table(spark, d, "embeddings")
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding"), e.select(F.col("vec_id").alias("label_ord"), F.col("label").cast("long").alias("entity_id"), "embedding")


def dense_knn_topk(spark, d) -> DataFrame:
    return R.dense_topk(*_vectors(spark, d), 3)


def multi_model_merge(spark, d) -> DataFrame:
    q, i = _vectors(spark, d)
    half = lambda df, at: df.withColumn("embedding", F.slice("embedding", at, 32))
    found = [R.dense_topk(half(q, at), half(i, at), 5).select("query", "entity_id", "score") for at in (1, 33)]
    return R.merge_models(found).withColumn("mean_score", F.round("mean_score", 7))


def dense_index_search(spark, d) -> DataFrame:
    """Index of part names and brands by the built-in encoder; names as queries find themselves first."""
    e = T.table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("entity_id"), F.array_sort(F.collect_set("p_type")).alias("synonyms")).select("entity_id", F.col("p_name").alias("preferred_label"), "synonyms")
    load = V.hashed_trigrams()
    q = e.select(F.col("entity_id").alias("query"), F.upper("preferred_label").alias("mention"))
    found = V.retrieve(q, V.build_index(e, load), load, 3)
    return V.score_candidates(found.join(q, "query").join(e.select("entity_id", "preferred_label"), "entity_id"), load).select("query", "entity_id", "rank", "score", F.round("dense", 3).alias("dense"))


def hybrid_rescore(spark, d) -> DataFrame:
    e = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    zero = T.table(spark, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))
    p = T.table(spark, d, "part").join(e, "p_partkey").join(F.broadcast(zero))  # one row
    dense = F.round(100.0 * dot(F.col("embedding"), F.col("q")), 4)
    return p.select("p_partkey", dense.alias("dense"), F.round(hybrid(F.col("p_size").cast("double"), dense), 6).alias("score"))


def variant_union_first(spark, d) -> DataFrame:
    return M.append_if_absent(*T.candidate_blocks(spark, d)).select("mention_id", "entity_id", "score", F.col("ord").cast("long").alias("ord"))


def abbrev_union_max(spark, d) -> DataFrame:
    return M.keep_best(*T.candidate_blocks(spark, d)).select("mention_id", "entity_id", "score", F.col("ord").cast("long").alias("ord"))


def expand_merge_topk(spark, d) -> DataFrame:
    a, b = T.candidate_blocks(spark, d)
    return M.cut(M.merge_candidates("max", a, b), a, 12, 2).select("mention_id", "entity_id", "score", F.col("ord").cast("long").alias("ord"))


def subword_expand(spark, d) -> DataFrame:
    labels = T.part_labels(spark, d)
    m = labels.select(F.col("entity_id").alias("mention_id"), F.concat("label", F.lit(" of the "), F.element_at(F.split("label", " "), 1)).alias("mention"))
    words = X.subword_queries(m)
    hit = labels.select("entity_id", F.explode(significant_words("label")).alias("word"), F.length("label").alias("n")).withColumn("score", F.round(100.0 * F.length("word") / F.col("n"), 4))
    hit = hit.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "entity_id")))
    have = m.select("mention_id", F.col("mention_id").alias("entity_id"))
    return X.subword_expansion(words, hit, have).select("mention_id", "entity_id", F.round("score", 6).alias("score"), F.col("ord").cast("long").alias("ord"), "origin")


def _trees(spark, d) -> DataFrame:
    n = T.table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("R"), "n_regionkey", F.lit(".N"), "n_nationkey").alias("t"))
    c = T.table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    r = T.table(spark, d, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("entity_id"), F.array(F.concat(F.lit("R"), "r_regionkey")).alias("tree_numbers"))
    return c.select(F.col("c_custkey").alias("entity_id"), F.array(F.concat("t", F.lit(".C"), "c_custkey")).alias("tree_numbers")).union(n.select((-100 - F.col("n_nationkey")).cast("long"), F.array("t"))).union(r)


def tree_prefix_parents(spark, d) -> DataFrame:
    o = T.table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("mention_id"), F.col("o_custkey").alias("entity_id")).distinct()
    c = o.withColumn("ord", F.row_number().over(Window.partitionBy("mention_id").orderBy("entity_id")) - 1)
    return X.parent_expansion(c, _trees(spark, d)).select("mention_id", "entity_id", "score", F.col("ord").cast("long").alias("ord"), "origin")


def bridge_two_hop(spark, d) -> DataFrame:
    rel = F.element_at(F.array(*[F.lit(x) for x in ("PAR", "CHD", "RB", "RN")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    e = T.table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("cui1"), rel.alias("rel"), F.concat(F.lit("P"), "l_partkey").alias("cui2"))
    mapped = T.table(spark, d, "part").filter("p_size = 1").select(F.concat(F.lit("P"), "p_partkey").alias("cui"), F.col("p_partkey").alias("entity_id"))
    return X.reachable(e, mapped, 5).select("cui", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def bridge_lookup(spark, d) -> DataFrame:
    p = T.table(spark, d, "part")
    reached = p.filter("p_size <= 10").groupBy(F.col("p_brand").alias("cui")).agg(F.array_sort(F.collect_set("p_partkey")).alias("ids"))
    names = p.select(F.col("p_brand").alias("cui"), F.upper("p_name").alias("name")).distinct()
    m = T.part_labels(spark, d).select(F.col("entity_id").alias("mention_id"), F.col("label").alias("mention"))
    have = m.select("mention_id", F.col("mention_id").alias("entity_id"))
    known = p.filter("p_size <= 5").select(F.col("p_partkey").alias("entity_id"))
    return X.bridge_by_concept(m, names, reached, have, known).select("mention_id", "entity_id", "score", F.col("ord").cast("long").alias("ord"), "origin")


QUERIES = {f.__name__: f for f in (fuzzy_link_topk, fuzzy_token_blocked, difflib_topk, bm25_topk, boosted_search, exact_label_lookup, dense_knn_topk, dense_index_search, multi_model_merge, hybrid_rescore, variant_union_first, abbrev_union_max, expand_merge_topk, subword_expand, tree_prefix_parents, bridge_two_hop, bridge_lookup)}

_RATIO = f"200.0::DOUBLE * {T.lcs_sql('a', 'b')} / (length(a) + length(b))"
_CLASS = "SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 100 = 0"


def _dense(k: int, over: int, at: int = 1, n: int = 64) -> str:
    part = lambda x: f"CAST({x}[{at}:{at + n - 1}] AS DOUBLE[])"
    return f"""
    s AS (SELECT q.query, e.label AS entity_id, e.vec_id, round(list_dot_product({part('q.embedding')}, {part('e.embedding')}), 6) AS score FROM ({_CLASS}) q, embeddings e),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM s),
    p AS (SELECT query, entity_id, max(score) AS score FROM t WHERE r <= {over * k} GROUP BY 1, 2),
    x AS (SELECT query, CAST(entity_id AS BIGINT) AS entity_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, entity_id) AS INTEGER) AS rank FROM p)
    """


_BM25 = """
q AS (SELECT DISTINCT lower(mention) AS query FROM qs WHERE mention IS NOT NULL),
qt AS (SELECT DISTINCT query, unnest(list_distinct(regexp_extract_all(query, '[a-z0-9]+'))) AS term FROM q),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS avgdl FROM documents WHERE text IS NOT NULL),
s AS (SELECT query, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), n GROUP BY 1, 2)
"""

_TERMS = """
{0}tok AS (SELECT entity_id, unnest(regexp_extract_all(lower({1}), '[a-z0-9]+')) AS term FROM e), {0}tf AS (SELECT entity_id, term, count(*) AS tf FROM {0}tok GROUP BY 1, 2),
{0}dl AS (SELECT entity_id, sum(tf) AS dl FROM {0}tf GROUP BY 1), {0}df AS (SELECT term, count(*) AS df FROM {0}tf GROUP BY 1), {0}n AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower({1}), '[a-z0-9]+'))) AS avgdl FROM e)"""
_WEIGHT = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
_BOOSTED = f"""WITH {T.KB}, {T.MENTIONS}, q AS (SELECT DISTINCT lower(mention) AS query FROM m), e AS (SELECT entity_id, label, 'new ' || split_part(label, ' ', 2) AS syn FROM kb),
{_TERMS.format('a', "label || ' ' || syn")}, {_TERMS.format('p', 'label')},
qt AS (SELECT query, unnest(list_distinct(regexp_extract_all(query, '[a-z0-9]+'))) AS qterm FROM q),
nr AS (SELECT DISTINCT qterm, term FROM qt, adf WHERE levenshtein(qterm, term) <= CASE WHEN length(qterm) <= 2 THEN 0 WHEN length(qterm) <= 5 THEN 1 ELSE 2 END),
s AS (SELECT DISTINCT query, entity_id, 10.0::DOUBLE AS s FROM q JOIN (SELECT entity_id, unnest([lower(label), lower(syn)]) AS query FROM e) USING (query)
 UNION ALL SELECT query, entity_id, sum(2 * {_WEIGHT}) FROM qt JOIN nr USING (qterm) JOIN atf USING (term) JOIN adf USING (term) JOIN adl USING (entity_id), an GROUP BY 1, 2
 UNION ALL SELECT query, entity_id, round(sum({_WEIGHT}), 6) * 1.5 FROM qt JOIN ptf ON qterm = term JOIN pdf USING (term) JOIN pdl USING (entity_id), pn GROUP BY 1, 2),
t AS (SELECT query, entity_id, round(sum(s), 6) AS score FROM s GROUP BY 1, 2)
SELECT query, entity_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, entity_id) AS INTEGER) AS rank FROM t QUALIFY rank <= 3"""

ORACLES = {
    "boosted_search": _BOOSTED,
    "fuzzy_link_topk": f"""WITH {T.KB}, {T.MENTIONS},
p AS (SELECT m.mention AS query, {T.sorted_sql('m.mention')} AS a, {T.sorted_sql('lower(kb.label)')} AS b, entity_id, label FROM (SELECT DISTINCT lower(mention) AS mention FROM m) m, kb),
s AS (SELECT *, {_RATIO} AS score FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entity_id) AS r FROM s)
SELECT query, entity_id, round(score, 6) AS score, label AS matched, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, entity_id) AS INTEGER) AS rank FROM t WHERE r <= 9 QUALIFY rank <= 3""",
    "fuzzy_token_blocked": f"""WITH {T.KB},
q AS (SELECT DISTINCT lower(split_part(label, ' ', 1) || ' ' || left(split_part(label, ' ', 2), 3)) AS query FROM kb),
qt AS (SELECT query, unnest(list_distinct(regexp_extract_all(query, '[a-z0-9]+'))) AS token FROM q),
lt AS (SELECT entity_id, lower(label) AS label, unnest(list_distinct(regexp_extract_all(lower(label), '[a-z0-9]+'))) AS token FROM kb),
p AS (SELECT DISTINCT query, entity_id, {T.sorted_sql('query')} AS a, {T.sorted_sql('label')} AS b FROM qt JOIN lt USING (token) WHERE length(token) >= 2),
s AS (SELECT query, entity_id, {_RATIO} AS score FROM p)
SELECT query, entity_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, entity_id) AS INTEGER) AS rank FROM s WHERE score >= 40 QUALIFY rank <= 5""",
    "bm25_topk": f"""WITH qs AS (SELECT text AS mention FROM benchmark), {_BM25}
SELECT query, doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
    "exact_label_lookup": f"WITH {T.KB} SELECT p_partkey, upper(p_name) AS mention, entity_id, label FROM part JOIN kb ON p_name = label",
    "dense_knn_topk": f"WITH {_dense(3, 3)} SELECT query, entity_id, score, rank FROM x WHERE rank <= 3",
    "multi_model_merge": f"""WITH a AS (WITH {_dense(5, 3, 1, 32)} SELECT * FROM x WHERE rank <= 5), b AS (WITH {_dense(5, 3, 33, 32)} SELECT * FROM x WHERE rank <= 5)
SELECT query, entity_id, max(score) AS max_score, round(sum(score) / 2, 7) AS mean_score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""",
    "hybrid_rescore": """WITH s AS (SELECT p_partkey, p_size, round(100 * list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[])), 4) AS dense
FROM part JOIN embeddings e ON e.vec_id = p_partkey, (SELECT embedding FROM embeddings WHERE vec_id = 0) z)
SELECT p_partkey, dense, round(0.7::DOUBLE * p_size + (1 - 0.7::DOUBLE) * dense, 6) AS score FROM s""",
    "variant_union_first": f"""WITH {T.CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY mention_id, entity_id ORDER BY block, ord) AS r FROM cand)
SELECT CAST(mention_id AS BIGINT) AS mention_id, entity_id, score, row_number() OVER (PARTITION BY mention_id ORDER BY block, ord, entity_id) - 1 AS ord FROM o WHERE r = 1""",
    "abbrev_union_max": f"""WITH {T.CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY mention_id, entity_id ORDER BY score DESC, block, ord) AS r FROM cand)
SELECT CAST(mention_id AS BIGINT) AS mention_id, entity_id, score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, block, ord, entity_id) - 1 AS ord FROM o WHERE r = 1""",
    "expand_merge_topk": f"""WITH {T.CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY mention_id, entity_id ORDER BY score DESC, block, ord) AS r FROM cand),
n AS (SELECT mention_id, count(*) AS n FROM cand WHERE block = 0 GROUP BY 1),
x AS (SELECT mention_id, entity_id, score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, block, ord, entity_id) - 1 AS ord FROM o WHERE r = 1)
SELECT CAST(mention_id AS BIGINT) AS mention_id, entity_id, score, ord FROM x LEFT JOIN n USING (mention_id) WHERE ord < greatest(12, coalesce(n, 0) + 2)""",
    "subword_expand": f"""WITH {T.KB},
m AS (SELECT entity_id AS mention_id, label || ' of the ' || split_part(label, ' ', 1) AS mention FROM kb),
w AS (SELECT mention_id, unnest([x FOR x IN string_split(mention, ' ') IF length(x) >= 3 AND x NOT IN ('the')]) AS word FROM m),
h AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, entity_id) AS rank FROM (SELECT entity_id, word, round(100.0::DOUBLE * length(word) / n, 4) AS score FROM (SELECT entity_id, unnest(string_split(label, ' ')) AS word, length(label) AS n FROM kb) WHERE length(word) >= 3)),
f AS (SELECT mention_id, entity_id, max(score) AS best, count(*) AS n FROM w JOIN h USING (word) WHERE rank <= 5 GROUP BY 1, 2),
s AS (SELECT mention_id, entity_id, n, 0.6::DOUBLE * best * (1 + 0.3::DOUBLE * (n - 1)) AS score FROM f WHERE n >= 2 AND mention_id <> entity_id)
SELECT mention_id, entity_id, round(score, 6) AS score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, entity_id) - 1 AS ord, '[sub-word: ' || n || ' words matched]' AS origin FROM s QUALIFY ord < 5""",
    "tree_prefix_parents": """WITH n AS (SELECT n_nationkey, 'R' || n_regionkey || '.N' || n_nationkey AS t FROM nation),
tr AS (SELECT c_custkey AS entity_id, t || '.C' || c_custkey AS tree FROM customer JOIN n ON c_nationkey = n_nationkey UNION ALL SELECT -100 - n_nationkey, t FROM n UNION ALL SELECT -1 - r_regionkey, 'R' || r_regionkey FROM region),
c AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY entity_id) - 1 AS ord FROM (SELECT DISTINCT o_custkey % 500 AS mention_id, o_custkey AS entity_id FROM orders)),
p AS (SELECT mention_id, regexp_extract(tree, '^(.*)\\.[^.]*$', 1) AS prefix FROM c JOIN tr USING (entity_id) WHERE ord < 10),
k AS (SELECT mention_id, prefix, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
f AS (SELECT mention_id, prefix, n, entity_id FROM k JOIN tr ON tr.tree = prefix WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.mention_id = k.mention_id AND c.entity_id = tr.entity_id))
SELECT mention_id, CAST(entity_id AS BIGINT) AS entity_id, CAST(55 + n AS DOUBLE) AS score, row_number() OVER (PARTITION BY mention_id ORDER BY n DESC, prefix) - 1 AS ord, '[parent of ' || n || ' candidates: ' || prefix || ']' AS origin FROM f QUALIFY ord < 3""",
    "bridge_two_hop": """WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS a, ['PAR', 'CHD', 'RB', 'RN'][l_linenumber % 4 + 1] AS rel, 'P' || l_partkey AS b FROM lineitem),
d AS (SELECT a AS cui, rel IN ('PAR', 'RB') AS up, b AS other FROM e UNION SELECT b, rel IN ('CHD', 'RN'), a FROM e),
ids AS (SELECT 'P' || p_partkey AS other, p_partkey AS entity_id FROM part WHERE p_size = 1),
bare AS (SELECT DISTINCT cui FROM d WHERE cui NOT IN (SELECT other FROM ids)),
one AS (SELECT DISTINCT cui, entity_id FROM d JOIN bare USING (cui) JOIN ids USING (other)),
mid AS (SELECT DISTINCT cui AS mid, entity_id FROM d JOIN ids USING (other) WHERE up),
two AS (SELECT DISTINCT cui, entity_id FROM (SELECT DISTINCT cui, other AS mid FROM d JOIN bare USING (cui) WHERE up AND cui NOT IN (SELECT cui FROM one)) JOIN mid USING (mid)),
r AS (SELECT *, row_number() OVER (PARTITION BY cui ORDER BY entity_id) AS r FROM (SELECT * FROM one UNION ALL SELECT * FROM two))
SELECT cui, string_agg(entity_id, ',' ORDER BY entity_id) AS ids FROM r WHERE r <= 5 GROUP BY 1""",
    "bridge_lookup": f"""WITH {T.KB}, b AS (SELECT DISTINCT n.p_name AS name, i.p_partkey AS entity_id FROM part n JOIN part i ON n.p_brand = i.p_brand WHERE i.p_size <= 10)
SELECT k.entity_id AS mention_id, b.entity_id, 60.0::DOUBLE AS score, row_number() OVER (PARTITION BY k.entity_id ORDER BY b.entity_id) - 1 AS ord, '[UMLS bridge: ' || label || ']' AS origin
FROM kb k JOIN b ON b.name = k.label JOIN part p ON p.p_partkey = b.entity_id WHERE b.entity_id <> k.entity_id AND p.p_size <= 5""",
}
