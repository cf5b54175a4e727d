"""Queries of parsers, enrichment and statistics, over lines and documents made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import kb as K
from ..sources import caches, pubtator, terminology
from . import tables as T


def _lines(spark, d) -> DataFrame:
    """PubTator lines: a title, an abstract, an annotation, a relation and two broken lines for each part."""
    p = T.table(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    tab = lambda *x: F.concat_ws("\t", *x)
    lines = F.array(
        F.concat(k, F.lit("|t|"), "p_name", F.lit(" ")), F.concat(k, F.lit("|a|A "), "p_name", F.lit(" of "), "p_brand", F.lit("\r")),
        tab(k, F.lit("2"), (F.length("p_name") + 2).cast("string"), F.col("p_name"), F.col("p_type"), F.concat(F.lit("D"), F.col("p_size").cast("string"))),
        tab(k, F.lit("0"), F.lit("3"), F.col("p_brand"), F.col("p_type"), F.lit("")), tab(k, F.lit("Assoc"), F.concat(F.lit("D"), F.col("p_size").cast("string")), F.lit("D1"), F.lit("No")),
        tab(k, F.lit("x"), F.lit("3"), F.lit("bad"), F.lit("T"), F.lit("D2")), F.lit(""),
    )
    return p.select("p_partkey", F.posexplode(lines).alias("i", "value")).select((F.col("p_partkey") * 10 + F.col("i")).alias("ord"), "value")


def pubtator_parse(spark, d) -> DataFrame:
    meta, ann, rel = pubtator.parse(_lines(spark, d))
    rows = meta.select("pmid", F.lit("m").alias("kind"), F.concat_ws("|", "title", "abstract").alias("text"))
    rows = rows.union(ann.select("pmid", F.lit("a"), F.concat_ws("|", F.col("start").cast("string"), F.col("end").cast("string"), "mention", "entity_type", "mesh_id")))
    return rows.union(rel.select("pmid", F.lit("r"), F.concat_ws("|", "relation_type", "id_1", "id_2", "novelty")))


def relation_enrich(spark, d) -> DataFrame:
    part = T.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    li = T.table(spark, d, "lineitem").join(part, "l_partkey")
    ann = li.select((F.col("l_orderkey") % 500).cast("string").alias("pmid"), F.col("l_suppkey").cast("string").alias("mesh_id"), F.col("p_name").alias("mention"))
    rel = T.table(spark, d, "orders").select((F.col("o_orderkey") % 500).cast("string").alias("pmid"), (F.col("o_custkey") % 100).cast("string").alias("id_1"), (F.col("o_orderkey") % 97).cast("string").alias("id_2")).distinct()
    return pubtator.enrich_relations(rel, ann).select("pmid", "id_1", "id_2", "mention_1", "mention_2")


def _rrf(spark, d) -> DataFrame:
    p = T.table(spark, d, "part")
    cui = F.concat(F.lit("C"), (F.col("p_partkey") % 300).cast("string"))
    lat, sab = F.when(F.col("p_size") % 5 == 0, "FRE").otherwise("ENG"), F.when(F.col("p_size") % 3 == 0, "MSH").otherwise(F.col("p_type"))
    tty = F.when(F.col("p_partkey") % 4 == 0, "PT").otherwise("SY")
    code = F.concat(F.lit("D"), (F.col("p_partkey") % 450).cast("string"))
    cols = [cui, lat, F.lit("S"), *[F.lit("")] * 7, code, sab, tty, F.lit(""), F.col("p_name"), *[F.lit("")] * 3, F.lit("")]
    return p.select(F.col("p_partkey").alias("ord"), F.concat_ws("|", *cols).alias("value"))


def rrf_parse(spark, d) -> DataFrame:
    e = K.concept_entities(terminology.concept_rows(terminology.split_rrf(_rrf(spark, d))))
    return e.select("cui", "preferred_label", F.array_join("synonyms", "|").alias("synonyms"), F.array_join("mesh_ids", "|").alias("mesh_ids"), K.public_id().alias("public_id"))


def rrf_synonyms(spark, d) -> DataFrame:
    return terminology.synonyms_by_id(terminology.split_rrf(_rrf(spark, d)))


def concept_statistics(spark, d) -> DataFrame:
    return K.statistics(K.concept_entities(terminology.concept_rows(terminology.split_rrf(_rrf(spark, d)))))


def vocabularies(spark, d) -> DataFrame:
    return K.top_vocabularies(K.concept_entities(terminology.concept_rows(terminology.split_rrf(_rrf(spark, d)))), 4)


def relation_lines(spark, d) -> DataFrame:
    rel = F.element_at(F.array(*[F.lit(x) for x in ("PAR", "CHD", "RB", "RN", "SY")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    lines = T.table(spark, d, "lineitem").select(F.concat_ws("|", F.concat(F.lit("C"), "l_suppkey"), F.lit(""), F.lit(""), rel, F.concat(F.lit("C"), "l_partkey"), F.lit("")).alias("value"))
    return terminology.relations(lines).groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("cui1").alias("left_n"), F.count_distinct("cui2").alias("right_n"))


def mondo_nodes(spark, d) -> DataFrame:
    p = T.table(spark, d, "part")
    node = F.struct(
        F.concat(F.lit("M:"), "p_partkey").alias("id"), F.col("p_name").alias("lbl"), F.when(F.col("p_size") % 2 == 0, "CLASS").otherwise("PROPERTY").alias("type"),
        F.struct(F.array(F.struct(F.col("p_type").alias("val"))).alias("synonyms"), F.array(F.struct(F.concat(F.lit("MESH:D"), (F.col("p_partkey") % 50).cast("string")).alias("val")), F.struct(F.lit("OTHER:1").alias("val"))).alias("xrefs"), F.struct(F.lit("text").alias("val"), F.array(F.concat(F.lit("MESH:C"), (F.col("p_size") % 7).cast("string"))).alias("xrefs")).alias("definition")).alias("meta"),
    )
    doc = p.groupBy("p_brand").agg(F.collect_list(node).alias("nodes")).select(F.to_json(F.struct(F.array(F.struct("nodes")).alias("graphs"))).alias("value"))
    return terminology.mondo_names(doc.select(F.from_json("value", terminology.MONDO)["graphs"].alias("graphs")))


def sparql_names(spark, d) -> DataFrame:
    p = T.table(spark, d, "part")
    v = lambda x: F.struct(x.alias("value"))
    b = F.struct(v(F.concat(F.lit("D"), (F.col("p_partkey") % 40).cast("string"))).alias("meshId"), v(F.col("p_name")).alias("label"), F.when(F.col("p_size") % 2 == 0, v(F.concat(F.lit(" "), "p_type"))).alias("alias"), F.when(F.col("p_size") % 3 == 0, v(F.lit(" "))).alias("redirectLabel"))
    doc = p.groupBy("p_brand").agg(F.collect_list(b).alias("bindings")).select(F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("value"))
    return terminology.sparql_names(doc)


def _entities(spark, d) -> DataFrame:
    return T.part_labels(spark, d).select("entity_id", F.col("label").alias("preferred_label"), F.array("label").alias("synonyms"))


def synonym_enrich(spark, d) -> DataFrame:
    p = T.part_labels(spark, d)
    first = p.select("entity_id", F.explode(F.array(F.upper("label"), F.concat("label", F.lit(" x")), F.lit(" "))).alias("name"))
    second = p.select("entity_id", F.explode(F.array(F.concat(F.upper("label"), F.lit(" X")), F.concat("label", F.lit(" y")), F.concat("label", F.lit(" Y")))).alias("name"))
    e = K.enrich_in_order(_entities(spark, d), [first, second])
    return e.select("entity_id", F.array_join("synonyms", "|").alias("synonyms"))


def kb_stats(spark, d) -> DataFrame:
    p = T.table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("entity_id"), F.sort_array(F.collect_set("p_brand")).alias("synonyms"), F.sort_array(F.collect_set(F.when(F.col("p_size") == 7, F.col("p_type")))).alias("mesh_ids"))
    return K.statistics(p)


def type_counts(spark, d) -> DataFrame:
    return T.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_name").alias("n_names"))


def response_json(spark, d) -> DataFrame:
    c = T.table(spark, d, "part").select(F.col("p_size").cast("long").alias("mention_id"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("preferred_label"), F.col("p_retailprice").alias("score"), F.array(F.lit("C01"), F.lit("C02"), F.lit("C03"), F.lit("C04")).alias("tree_numbers"))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")))
    j = caches.response(c, 5)
    return j.select("mention_id", F.get_json_object("json", "$[0].entity_id").cast("long").alias("first_id"), F.get_json_object("json", "$[4].preferred_label").alias("fifth"), F.get_json_object("json", "$[0].tree_numbers[3]").isNull().alias("three_trees"), F.get_json_object("json", "$[0].score").cast("double").alias("score"))


def lookup_missing(spark, d) -> DataFrame:
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), "c_name")
    return K.lookup(c, T.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("entity_id")), how="left_anti")


QUERIES = {f.__name__: f for f in (pubtator_parse, relation_enrich, rrf_parse, rrf_synonyms, concept_statistics, vocabularies, relation_lines, mondo_nodes, sparql_names, synonym_enrich, kb_stats, type_counts, response_json, lookup_missing)}

_RRF = "rrf AS (SELECT p_partkey AS ord, 'C' || (p_partkey % 300) AS cui, p_size % 5 <> 0 AS eng, CASE WHEN p_size % 3 = 0 THEN 'MSH' ELSE p_type END AS sab, p_partkey % 4 = 0 AS pref, 'D' || (p_partkey % 450) AS code, p_name AS label FROM part)"
_CONCEPTS = "con AS (SELECT cui, coalesce(arg_min(label, ord) FILTER (pref), min(label)) AS preferred_label, list_sort(list(DISTINCT label)) AS syn, list_sort(list(DISTINCT code) FILTER (sab = 'MSH')) AS ids, list(DISTINCT sab) AS sabs FROM rrf WHERE eng GROUP BY 1)"

ORACLES = {
    "pubtator_parse": """SELECT CAST(p_partkey AS VARCHAR) AS pmid, 'm' AS kind, p_name || '|A ' || p_name || ' of ' || p_brand AS text FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'a', '2|' || (length(p_name) + 2) || '|' || p_name || '|' || p_type || '|D' || p_size FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'r', 'Assoc|D' || p_size || '|D1|No' FROM part""",
    "relation_enrich": """WITH a AS (SELECT CAST(l_orderkey % 500 AS VARCHAR) AS pmid, CAST(l_suppkey AS VARCHAR) AS id, string_agg(DISTINCT p_name, ' / ' ORDER BY p_name) AS m FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
r AS (SELECT DISTINCT CAST(o_orderkey % 500 AS VARCHAR) AS pmid, CAST(o_custkey % 100 AS VARCHAR) AS id_1, CAST(o_orderkey % 97 AS VARCHAR) AS id_2 FROM orders)
SELECT r.pmid, id_1, id_2, a.m AS mention_1, b.m AS mention_2 FROM r LEFT JOIN a ON a.pmid = r.pmid AND a.id = id_1 LEFT JOIN a b ON b.pmid = r.pmid AND b.id = id_2""",
    "rrf_parse": f"WITH {_RRF}, {_CONCEPTS} SELECT cui, preferred_label, array_to_string(syn, '|') AS synonyms, coalesce(array_to_string(ids, '|'), '') AS mesh_ids, coalesce(ids[1], cui) AS public_id FROM con",
    "rrf_synonyms": f"""WITH {_RRF}, f AS (SELECT code, arg_min(cui, ord) AS cui, min(ord) AS ord FROM rrf WHERE sab = 'MSH' GROUP BY 1), l AS (SELECT cui, arg_max(code, ord) AS entity_id FROM f GROUP BY 1)
SELECT DISTINCT entity_id, label AS name FROM rrf JOIN l USING (cui) WHERE eng""",
    "concept_statistics": f"WITH {_RRF}, {_CONCEPTS} SELECT count(*) AS concepts, CAST(sum(len(syn)) AS BIGINT) AS labels, count(*) FILTER (len(ids) > 0) AS mapped, round(100.0::DOUBLE * count(*) FILTER (len(ids) > 0) / count(*), 6) AS mapped_percent, round(sum(len(syn)) / count(*), 6) AS average_synonyms FROM con",
    "vocabularies": f"WITH {_RRF}, {_CONCEPTS} SELECT vocabulary, count(*) AS n FROM (SELECT unnest(sabs) AS vocabulary FROM con) GROUP BY 1 ORDER BY n DESC, vocabulary LIMIT 4",
    "relation_lines": "SELECT ['PAR', 'CHD', 'RB', 'RN', 'SY'][l_linenumber % 5 + 1] AS rel, count(*) AS n, count(DISTINCT l_suppkey) AS left_n, count(DISTINCT l_partkey) AS right_n FROM lineitem WHERE l_linenumber % 5 < 4 GROUP BY 1",
    "mondo_nodes": "SELECT DISTINCT unnest(['D' || (p_partkey % 50), 'C' || (p_size % 7)]) AS entity_id, n AS name FROM part, (SELECT unnest([0, 1]) AS i) JOIN LATERAL (SELECT CASE WHEN i = 0 THEN p_name ELSE p_type END AS n) ON true WHERE p_size % 2 = 0",
    "sparql_names": "SELECT DISTINCT 'D' || (p_partkey % 40) AS entity_id, p_name AS name FROM part UNION SELECT 'D' || (p_partkey % 40), p_type FROM part WHERE p_size % 2 = 0",
    "synonym_enrich": f"WITH {T.KB} SELECT entity_id, label || '|' || label || ' x|' || label || ' Y|' || label || ' y' AS synonyms FROM kb",
    "kb_stats": "WITH k AS (SELECT p_name, count(DISTINCT p_brand) AS s, count(DISTINCT p_type) FILTER (p_size = 7) AS m FROM part GROUP BY 1) SELECT count(*) AS concepts, CAST(sum(s) AS BIGINT) AS labels, count(*) FILTER (m > 0) AS mapped, round(100.0::DOUBLE * count(*) FILTER (m > 0) / count(*), 6) AS mapped_percent, round(sum(s) / count(*), 6) AS average_synonyms FROM k",
    "type_counts": "SELECT p_type, count(*) AS n, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1",
    "response_json": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) SELECT CAST(p_size AS BIGINT) AS mention_id, max(p_partkey) FILTER (r = 1) AS first_id, max(p_name) FILTER (r = 5) AS fifth, true AS three_trees, max(p_retailprice) FILTER (r = 1) AS score FROM r GROUP BY 1",
    "lookup_missing": "SELECT c_custkey AS entity_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
}
