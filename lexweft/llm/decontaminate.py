"""Benchmark decontamination over a distributed positional inverted index.

One pass over the texts stores the postings (document, term, position) of every test term, and each document's length as
the posting of no term. Every window of an item is anchored at its two rarest terms by corpus frequency. Postings of the
rarest term, shifted by its offset in the item, give the diagonal (document position minus item position) that the
item would lie on. They are intersected with the shifted postings of the second-rarest term: where the two stand within
``slop`` words of their distance in the item, the document holds a proximity match; where the distance is the same, the
diagonal is intersected with the postings of all the item's words, and n in a row are an exact phrase match.

DataFrame functions only. Documents are told apart by doc_id and a 64-bit hash of the text. Postings of hot terms meet
anchors in joins that adaptive execution can split; no step pairs up the rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, small, table, written

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Columns that tell documents apart; ``g`` is doc_id, or 0 for none, and ``k`` a hash of doc_id and text.
DOC = ["g", "k"]


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at ASCII other than digits and letters. Null has no words."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWERED))
    return F.array_remove(F.split(low, BETWEEN_WORDS), "")


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (doc_id, g, k, term, pos) of ``terms`` (term) in ``docs`` (doc_id, text), positions from 0.

    Each row of ``docs`` has one posting without a term besides, whose position is the number of words.
    """
    d = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("g"), row_key("doc_id", "text").alias("k"), words(F.col("text")).alias("w"))
    every = d.select("doc_id", "g", "k", F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "term"))
    known = small(terms.withColumn("__known", F.lit(True)))
    return every.join(known, "term", "left").filter("term IS NULL OR __known").select("doc_id", "g", "k", "term", "pos")


def item_windows(items: DataFrame, length: int) -> DataFrame:
    """Windows (i, start, n) of ``items`` (i, words): ``length`` words in a row, or all words of a shorter item."""
    n = F.size("words")
    return items.filter(n > 0).select("i", F.explode(F.sequence(F.lit(0), F.greatest(n - length, F.lit(0)))).alias("start"), F.least(n, F.lit(length)).alias("n"), "words")


def anchors(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """The two rarest places of each window: distinct (i, t1, q1, t2, q2); t2 is null in a window of one word.

    ``frequency`` has term and cf; a term that is missing there is in no document, so its windows are dropped.
    """
    w = windows.select("i", "start", "n", F.posexplode(F.slice("words", F.col("start") + 1, F.col("n"))).alias("o", "term")).join(frequency, "term")
    ranked = w.groupBy("i", "start", "n").agg(F.sort_array(F.collect_list(F.struct("cf", "o", "term"))).alias("r")).filter(F.size("r") == F.col("n"))
    return ranked.select("i", *[x for j in (1, 2) for x in (F.try_element_at("r", F.lit(j))["term"].alias(f"t{j}"), (F.col("start") + F.try_element_at("r", F.lit(j))["o"]).alias(f"q{j}"))]).distinct()


def prepare(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items with i and words, index of all their terms, anchors)."""
    it = items.select("item_id", "text", words(F.col("text")).alias("words")).dropDuplicates(["item_id", "text"])
    it = written(it.select("item_id", F.monotonically_increasing_id().alias("i"), "words"), "items")
    index = written(positional_index(docs, it.select(F.explode("words").alias("term")).distinct()), "postings")
    frequency = index.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("cf"))
    return it, index, written(anchors(item_windows(it, window), frequency), "anchors")


def meetings(index: DataFrame, a: DataFrame, slop: int) -> DataFrame:
    """Distinct (g, k, i, d, exact): both anchors stand within ``slop`` words of their distance; exact: at it, on diagonal d."""
    rare = written(a.select(F.col("t1").alias("term")).union(a.select("t2")).filter("term IS NOT NULL").distinct(), "rare")
    lists = index.join(small(rare), "term", "left_semi")
    first = lists.join(small(a), F.col("term") == F.col("t1")).select(*DOC, "i", (F.col("pos") - F.col("q1")).alias("d"), "t2", (F.col("pos") - F.col("q1") + F.col("q2")).alias("want"))
    # places within slop of one another share a bin, or lie in neighbouring ones
    width = 2 * slop + 1
    bins = F.array_distinct(F.transform(F.array(F.lit(-slop), F.lit(slop)), lambda x: F.floor((F.col("want") + x) / width)))
    second = lists.select(*DOC, F.col("term").alias("t2"), F.col("pos").alias("pos2"), F.floor(F.col("pos") / width).alias("bin"))
    both = first.filter("t2 IS NOT NULL").withColumn("bin", F.explode(bins)).join(second, [*DOC, "t2", "bin"]).filter(F.abs(F.col("want") - F.col("pos2")) <= slop)
    both = both.select(*DOC, "i", "d", (F.col("want") == F.col("pos2")).alias("exact"))
    # of proximity matches, one of an item in a document says it all
    both = both.select(*DOC, "i", F.when(F.col("exact"), F.col("d")).alias("d"), "exact")
    return both.unionByName(first.filter("t2 IS NULL").select(*DOC, "i", "d", F.lit(True).alias("exact"))).distinct()


def phrase_matches(index: DataFrame, it: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Exact matches (g, k, i, item_id, d, n, starts): the starts in the item whose windows of n words lie on diagonal d.

    ``found`` has the diagonals (g, k, i, d). The words of the item are looked up at their places in the document.
    """
    n = F.least(F.size("words"), F.lit(window))
    wanted = found.join(it, "i").select(*DOC, "i", "item_id", "d", n.alias("n"), F.posexplode("words").alias("j", "term")).withColumn("pos", F.col("d") + F.col("j"))
    there = index.filter("term IS NOT NULL").join(small(written(found.select(*DOC).distinct(), "suspects")), DOC, "left_semi").select(*DOC, "term", "pos")
    on = wanted.join(there, [*DOC, "term", "pos"]).groupBy(*DOC, "i", "item_id", "d", "n").agg(F.array_sort(F.collect_set("j")).alias("js"))
    runs = F.filter(F.transform("js", lambda j, x: F.when(F.get("js", (x + F.col("n") - 1).cast("int")) == j + F.col("n") - 1, j)), lambda s: s.isNotNull())
    return on.select(*DOC, "i", "item_id", "d", "n", runs.alias("starts")).filter(F.size("starts") > 0)


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 5) -> DataFrame:
    """Distinct (doc_id, item_id) where the two rarest terms of a window stand within ``slop`` words of the
    distance that they have in the item."""
    it, index, a = prepare(docs, items, window)
    pairs = meetings(index, a, slop).select(*DOC, "i").distinct()
    ids = index.filter("term IS NULL").select("doc_id", *DOC).distinct()
    return pairs.join(ids, DOC).join(it.select("i", "item_id"), "i").select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, k (row_key of doc_id and text), n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A word is hit if it lies in an occurrence of a window; n_items counts the items with such windows. n_near counts the
    items with a proximity match (an exact one is one), which alone contaminates nothing. Null and empty texts have no words;
    items without words never occur. Rows with equal doc_id and text get equal results, one each. Rows that share
    only the doc_id are documents of their own. Other columns are ignored.
    """
    it, index, a = prepare(docs, items, window)
    met = written(meetings(index, a, slop), "meetings")
    near = met.select(*DOC, "i").distinct().join(it.select("i", "item_id"), "i").groupBy(*DOC).agg(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("n_near"))
    m = written(phrase_matches(index, it, met.filter("exact").select(*DOC, "i", "d"), window), "matches")
    places = m.select(*DOC, F.explode(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("n") - 1))))).alias("j"), "d").select(*DOC, (F.col("d") + F.col("j")).alias("p"))
    hit = places.distinct().groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    which = m.select(*DOC, "i", F.col("item_id").cast("string").alias("s")).distinct().groupBy(*DOC).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_set("s")), ","), 256).alias("items_sha256"))
    per_doc = small(written(near.join(hit.join(which, DOC), DOC, "full"), "hits"))
    return (
        index.filter("term IS NULL").select("doc_id", *DOC, F.col("pos").cast("long").alias("n_words"))
        .join(per_doc, DOC, "left")
        .select("doc_id", "k", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")


ORACLE_OP5 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS g FROM (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p + 1 : p + n], ' ') AS g FROM (
  SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1),
t AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM d),
cf AS (SELECT t, count(*) AS cf FROM t GROUP BY 1),
ws AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0),
wo AS (SELECT item_id, s, n, unnest(range(s, s + n)) AS q, unnest(w[s + 1 : s + n]) AS t FROM ws),
wr AS (SELECT item_id, s, n, q, t, row_number() OVER (PARTITION BY item_id, s ORDER BY cf, q, t) AS r, count(*) OVER (PARTITION BY item_id, s) AS c FROM wo JOIN cf USING (t)),
an AS (SELECT DISTINCT x.item_id, x.t AS t1, x.q AS q1, y.t AS t2, y.q AS q2 FROM wr x LEFT JOIN wr y ON y.item_id = x.item_id AND y.s = x.s AND y.r = 2 WHERE x.r = 1 AND x.c = x.n),
nr AS (SELECT DISTINCT x.doc_id, item_id FROM an JOIN t x ON x.t = t1 JOIN t y ON y.doc_id = x.doc_id AND y.t = t2 WHERE abs((y.p - x.p) - (q2 - q1)) <= 5
  UNION SELECT DISTINCT doc_id, item_id FROM an JOIN t ON t.t = t1 WHERE t2 IS NULL),
nn AS (SELECT doc_id, count(*) AS n_near FROM nr GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
