"""Terminology sources: MeSH XML, MRCONSO and MRREL, SPARQL results, MONDO JSON."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pubtator import read_lines

_TERMS = "ConceptList struct<Concept: array<struct<ScopeNote: string, TermList: struct<Term: array<struct<String: string>>>>>>"
DESCRIPTOR = f"DescriptorUI string, DescriptorName struct<String: string>, {_TERMS}, TreeNumberList struct<TreeNumber: array<string>>"
SUPPLEMENT = f"SupplementalRecordUI string, SupplementalRecordName struct<String: string>, {_TERMS}"
RRF = "CUI LAT TS LUI STT SUI ISPREF AUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF".split()
PREFERRED_TYPES = ("MH", "NM", "PT", "PN")


def _record(df: DataFrame, ui: str, name: str, trees: Column) -> DataFrame:
    terms = F.flatten(F.transform("ConceptList.Concept", lambda c: F.transform(c["TermList"]["Term"], lambda t: t["String"])))
    note = F.try_element_at(F.filter(F.transform("ConceptList.Concept", lambda c: c["ScopeNote"]), lambda s: s.isNotNull()), F.lit(1))
    label = F.col(f"{name}.String")
    known = F.filter(F.concat(F.coalesce(terms, F.array().cast("array<string>")), F.array(label)), lambda s: s.isNotNull())
    return df.filter(F.col(ui).isNotNull()).select(
        F.col(ui).alias("entity_id"),
        label.alias("preferred_label"),
        F.array_sort(F.array_distinct(known)).alias("synonyms"),
        F.coalesce(F.trim(F.regexp_replace(note, r"(?U)^\s+|\s+$", "")), F.lit("")).alias("definition"),
        F.coalesce(trees, F.array().cast("array<string>")).alias("tree_numbers"),
    )


def mesh_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """kb_entity rows of DescriptorRecord elements; the file is split at records."""
    df = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(DESCRIPTOR).load(path)
    return _record(df, "DescriptorUI", "DescriptorName", F.col("TreeNumberList.TreeNumber"))


def mesh_supplements(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", "SupplementalRecord").schema(SUPPLEMENT).load(path)
    return _record(df, "SupplementalRecordUI", "SupplementalRecordName", F.lit(None).cast("array<string>"))


def mesh(spark: SparkSession, descriptors: str | None = None, supplements: str | None = None) -> DataFrame:
    """Both files; a supplementary record replaces a descriptor of its id."""
    parts = [f(spark, p).withColumn("o", F.lit(i)) for i, (f, p) in enumerate(((mesh_descriptors, descriptors), (mesh_supplements, supplements))) if p]
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    w = Window.partitionBy("entity_id").orderBy(F.desc("o"))
    return df.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "o")


def split_rrf(lines: DataFrame) -> DataFrame:
    """MRCONSO columns and ord of (ord, value) lines; lines of fewer than 15 fields go."""
    f = lines.select("ord", F.split("value", r"\|").alias("f")).filter(F.size("f") >= 15)
    return f.select("ord", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(RRF)])


def read_rrf(spark: SparkSession, path: str) -> DataFrame:
    return split_rrf(read_lines(spark, path))


def concept_rows(rrf: DataFrame, vocabularies: list[str] | None = None) -> DataFrame:
    """(cui, label, preferred, sab, code, ord) of English rows with a label; None takes all vocabularies."""
    rows = rrf.filter((F.col("LAT") == "ENG") & (F.trim("STR") != ""))
    if vocabularies is not None:
        rows = rows.filter(F.col("SAB").isin(vocabularies))
    return rows.select(F.col("CUI").alias("cui"), F.trim("STR").alias("label"), ((F.col("TS") == "P") | F.col("TTY").isin(list(PREFERRED_TYPES))).alias("preferred"), F.col("SAB").alias("sab"), F.col("SDUI").alias("code"), "ord")


def synonyms_by_id(rrf: DataFrame) -> DataFrame:
    """(entity_id, name): all English names of the concept of a MeSH id. An id keeps its first concept, and a concept
    its last id."""
    msh = rrf.filter("SAB = 'MSH' AND SDUI <> ''")
    first = msh.groupBy("SDUI").agg(F.min_by("CUI", "ord").alias("cui"), F.min("ord").alias("ord"))
    last = first.groupBy("cui").agg(F.max_by("SDUI", "ord").alias("entity_id"))
    return rrf.filter("LAT = 'ENG'").select(F.col("CUI").alias("cui"), F.trim("STR").alias("name")).filter("name <> ''").join(last, "cui").select("entity_id", "name").distinct()


def cui_map(rrf: DataFrame, prefix: bool = False) -> DataFrame:
    """(cui, entity_id) of MeSH rows; ``prefix`` also takes vocabularies whose name starts with MSH."""
    sab = F.col("SAB").startswith("MSH") if prefix else F.col("SAB") == "MSH"
    return rrf.filter(sab & (F.col("SDUI") != "") & (F.col("CUI") != "")).select(F.col("CUI").alias("cui"), F.col("SDUI").alias("entity_id")).distinct()


def cui_arrays(rrf: DataFrame) -> DataFrame:
    return cui_map(rrf).groupBy("cui").agg(F.array_sort(F.collect_set("entity_id")).alias("mesh_ids"))


def relations(lines: DataFrame) -> DataFrame:
    """(cui1, rel, cui2) of MRREL lines (value)."""
    f = lines.select(F.split("value", r"\|").alias("f")).filter(F.size("f") >= 5)
    return f.select(F.get("f", F.lit(0)).alias("cui1"), F.get("f", F.lit(3)).alias("rel"), F.get("f", F.lit(4)).alias("cui2")).filter(F.col("rel").isin("PAR", "CHD", "RB", "RN"))


_BINDING = "struct<results: struct<bindings: array<struct<meshId: struct<value: string>, label: struct<value: string>, alias: struct<value: string>, redirectLabel: struct<value: string>>>>>"


def sparql_names(payloads: DataFrame) -> DataFrame:
    """(entity_id, name) of SPARQL results in JSON (value): labels, aliases and redirect labels."""
    b = payloads.select(F.inline(F.from_json("value", _BINDING)["results"]["bindings"]))
    names = F.explode(F.array("label.value", "alias.value", "redirectLabel.value"))
    return b.select(F.col("meshId.value").alias("entity_id"), names.alias("n")).select("entity_id", F.trim("n").alias("name")).filter("name <> '' AND entity_id <> ''").distinct()


def fetch_sparql(endpoint: str, query: str, timeout: int = 180) -> str:
    """The endpoint's JSON on the driver; an empty result if it cannot be reached."""
    url = f"{endpoint}?{urllib.parse.urlencode({'query': query, 'format': 'json'})}"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/sparql-results+json"}), timeout=timeout) as r:
            return r.read().decode()
    except OSError:
        return json.dumps({"results": {"bindings": []}})


_XREFS = "array<struct<val: string>>"
MONDO = f"graphs array<struct<nodes: array<struct<id: string, lbl: string, type: string, meta: struct<synonyms: array<struct<pred: string, val: string>>, xrefs: {_XREFS}, definition: struct<val: string, xrefs: array<string>>>>>>>"


def mondo_names(graphs: DataFrame) -> DataFrame:
    """(entity_id, name) of MONDO documents (graphs): classes with a MESH cross reference, label and synonyms."""
    n = graphs.select(F.inline(F.get("graphs", F.lit(0))["nodes"])).filter("type = 'CLASS'")
    none = F.array().cast("array<string>")
    refs = F.concat(F.coalesce(F.transform("meta.xrefs", lambda x: x["val"]), none), F.coalesce(F.col("meta.definition.xrefs"), none))
    ids = F.transform(F.filter(refs, lambda r: r.startswith("MESH:")), lambda r: F.substring(r, 6, 1 << 20))
    names = F.concat(F.array("lbl"), F.coalesce(F.transform("meta.synonyms", lambda s: s["val"]), none))
    pairs = n.select(F.explode(F.array_distinct(ids)).alias("entity_id"), names.alias("n")).select("entity_id", F.explode("n").alias("n"))
    return pairs.select("entity_id", F.trim("n").alias("name")).filter("name <> '' AND entity_id <> ''").distinct()


def read_mondo(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(MONDO).json(path)


def read_synonym_cache(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, name) of a JSON object {id: [name, ..]}."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("entity_id", "names")).select("entity_id", F.explode("names").alias("name"))
