"""Candidate retrieval: top-k labels of each query, then the best label of each entity, then top-k entities.

Queries are a stated set. They are deduplicated and compared with the label table in blocks of ``BLOCK`` queries, so
what a task holds has a fixed size; every task keeps its own best rows of each query, and only those are shuffled.
Ties go to the label that comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from ..functions.similarity import LabelBlock, difflib_ratios, sort_tokens
from ..functions.text import label_tokens
from ..sources.settle import small

#: Queries that are sent to the executors at a time.
BLOCK = 20_000


def labels_of(entities: DataFrame) -> DataFrame:
    """(entity_id, label, label_norm, label_ord) of kb_entity rows; the order is by entity, then by synonym."""
    one = entities.select("entity_id", F.explode(F.array_sort(F.array_distinct("synonyms"))).alias("label"))
    w = Window.partitionBy("entity_id").orderBy("label")
    return one.withColumn("label_norm", F.lower("label")).withColumn("label_ord", F.row_number().over(w).cast("long"))


def top_labels(scored: DataFrame, limit: int, *order: str) -> DataFrame:
    """The best ``limit`` rows of each query by score, then by ``order``."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), *order)
    return scored.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit).drop("__r")


def best_per_entity(scored: DataFrame, k: int) -> DataFrame:
    """(query, entity_id, score, matched, rank): an entity's best label, then the best k entities of each query."""
    best = F.struct(F.col("score"), (-F.col("label_ord")).alias("o"), F.col("label"))
    per = scored.groupBy("query", "entity_id").agg(F.max(best).alias("b"))
    per = per.select("query", "entity_id", F.col("b.score").alias("score"), F.col("b.label").alias("matched"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "entity_id")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _score_block(queries: list[str], batch: pa.RecordBatch, limit: int, score: Callable[[str, list[str], LabelBlock | None], np.ndarray], sort: bool) -> pa.RecordBatch:
    """The best ``limit`` labels of a batch for each query, and all that tie with the last one.

    Without ``sort``, only the best label of each entity counts.
    """
    labels = [sort_tokens(x or "") if sort else x or "" for x in batch.column("label_norm").to_pylist()]
    block = LabelBlock(labels) if sort else None
    ords = np.array(batch.column("label_ord").to_pylist(), np.int64)
    ids = np.array(batch.column("entity_id").cast(pa.string()).to_pylist(), object)
    order = np.lexsort((ids, ords))
    out_q, out_i, out_s = [], [], []
    for q in queries:
        s = score(sort_tokens(q) if sort else q, labels, block)
        take = order[np.argsort(-s[order], kind="stable")]
        if not sort and len(take):
            take = take[np.sort(np.unique(ids[take], return_index=True)[1])]
        if len(take) > limit:
            take = take[: limit + int((s[take[limit:]] == s[take[limit - 1]]).sum())]
        out_q += [q] * len(take)
        out_i.append(take)
        out_s.append(s[take])
    rows = pa.array(np.concatenate(out_i) if out_i else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.string()), *[batch.column(c).take(rows) for c in ("entity_id", "label", "label_ord")], pa.array(np.concatenate(out_s) if out_s else np.zeros(0))], names=["query", "entity_id", "label", "label_ord", "score"])


def _against(queries: list[str], limit: int, score, sort: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _score_block(queries, batch, limit, score, sort)

    return run


def _block_by_block(limit: int, score, sort: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                labels = batch.column("labels")[i].values
                yield _score_block(batch.column("queries")[i].as_py(), pa.RecordBatch.from_struct_array(labels), limit, score, sort)

    return run


def _fuzzy(q: str, labels: list[str], block: LabelBlock | None) -> np.ndarray:
    return block.ratio(q)


def _difflib(q: str, labels: list[str], block: LabelBlock | None) -> np.ndarray:
    return difflib_ratios(q, labels)


def _in_blocks(queries: DataFrame, labels: DataFrame, limit: int, score, sort: bool) -> DataFrame:
    """Scores of the stated queries against every label. One block of queries goes to where the labels are; of more,
    each block meets each block of labels in a task of its own, so that neither side passes through the driver."""
    q = queries.select(F.lower("mention").alias("q")).filter("q IS NOT NULL").distinct()
    rows = labels.select("entity_id", "label", "label_norm", F.col("label_ord").cast("long").alias("label_ord"))
    schema = f"query string, entity_id {labels.schema['entity_id'].dataType.simpleString()}, label string, label_ord long, score double"
    n = q.count()
    if n <= BLOCK:
        return rows.mapInArrow(_against([r[0] for r in q.orderBy("q").collect()], limit, score, sort), schema)
    m = labels.count()
    blocks, parts = -(-n // BLOCK), max(1, -(-m // BLOCK))
    qb = q.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks))).agg(F.collect_list("q").alias("queries")).select("queries")
    lb = rows.groupBy(F.pmod(F.xxhash64("entity_id", "label_ord"), F.lit(parts))).agg(F.collect_list(F.struct("entity_id", "label", "label_norm", "label_ord")).alias("labels")).select("labels")
    return lb.crossJoin(qb).repartition(blocks * parts).mapInArrow(_block_by_block(limit, score, sort), schema)


def fuzzy_topk(queries: DataFrame, labels: DataFrame, k: int = 10, over: int = 3) -> DataFrame:
    """Token-sorted Indel ratio of every label; ``over`` * k labels, then at most k entities a query.

    ``queries`` has mention, ``labels`` the columns of ``labels_of``. An entity with many good labels can leave
    fewer than k entities. Null mentions are left out.
    """
    scored = _in_blocks(queries, labels, over * k, _fuzzy, True)
    return best_per_entity(top_labels(scored, over * k, "label_ord", "entity_id"), k)


def difflib_topk(queries: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """The same with difflib's ratio; an entity's best label is taken over all labels. A task passes on its best k entities."""
    return best_per_entity(_in_blocks(queries, labels, k, _difflib, False), k)


def token_blocked_topk(queries: DataFrame, labels: DataFrame, scorer: Callable[[Column, Column], Column], k: int = 10, threshold: float = 40.0) -> DataFrame:
    """Labels that share a token of two characters with the query, scored, cut at ``threshold``, best per entity.

    The join is on tokens, so a frequent token is a hot key that adaptive execution splits.
    """
    q = queries.select(F.trim(F.lower("mention")).alias("query")).filter("query IS NOT NULL").distinct().withColumn("token", F.explode(F.array_distinct(label_tokens("query"))))
    t = labels.select("entity_id", "label", "label_norm", "label_ord", F.explode(F.array_distinct(label_tokens("label_norm"))).alias("token"))
    pairs = q.join(t, "token").select("query", "entity_id", "label", "label_norm", "label_ord").distinct()
    return best_per_entity(pairs.withColumn("score", scorer(F.col("query"), F.col("label_norm"))).filter(F.col("score") >= threshold), k)


def term_statistics(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, term, tf, dl), (term, df)) of the tokens of a text column; with ``terms`` (term) only of these."""
    t = docs.select(key, label_tokens(text, 1).alias("__t")).select(key, F.size("__t").cast("long").alias("dl"), F.explode("__t").alias("term"))
    if terms is not None:
        t = t.join(small(terms), "term", "left_semi")
    tf = t.groupBy(key, "term", "dl").agg(F.count("*").alias("tf")).select(key, "term", "tf", "dl")
    return tf, tf.groupBy("term").agg(F.count("*").alias("df"))


def _part(k1: float = 1.2, b: float = 0.75) -> Column:
    """A term's share of the BM25 score, from n, df, tf, dl and avgdl."""
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def _totals(docs: DataFrame, text: str) -> DataFrame:
    """(n, avgdl): one row."""
    return docs.filter(F.col(text).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.size(label_tokens(text, 1))).alias("avgdl"))


def bm25_scores(queries: DataFrame, docs: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, key, score) by BM25 over the postings of the queries' terms in ``docs``; a term counts once a query."""
    q = queries.select(F.lower("mention").alias("query")).filter("query IS NOT NULL").distinct()
    qt = q.withColumn("term", F.explode(F.array_distinct(label_tokens("query", 1))))
    # other terms leave before anything is counted or shuffled
    tf, df = term_statistics(docs, key, text, qt.select("term").distinct())
    # what the queries' terms are worth is a table no longer than the queries
    worth = small(qt.join(df, "term"))
    hit = tf.join(worth, "term").join(F.broadcast(_totals(docs, text)))  # one row
    return hit.groupBy("query", key).agg(F.round(F.sum(_part(k1, b)), 6).alias("score"))


#: Cells (documents by queries) and hits (terms of documents by queries) that a task scores at a time.
CELLS, HITS = 2_000_000, 2_000_000
_SPACES = bytes(c if c in b"abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _postings(batch: pa.RecordBatch, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of each document, (document, term, tf) of the numbered terms, by document) of lower-cased texts."""
    ids, lengths = [], np.zeros(batch.num_rows, np.int64)
    for i, text in enumerate(batch.column("text").cast(pa.binary())):
        tokens = text.as_py().translate(_SPACES).split()
        lengths[i] = len(tokens)
        ids.append(np.fromiter((number.get(t, -1) for t in tokens), np.int64, len(tokens)))
    term = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    code = (np.repeat(np.arange(batch.num_rows), lengths) * len(number) + term)[term >= 0]
    code, tf = np.unique(code, return_counts=True)
    return lengths, code // max(len(number), 1), code % max(len(number), 1), tf


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _count_terms(number: dict[bytes, int]):
    """(term, df) by slices; under -1 the documents and under -2 their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(number) + 2, np.int64)
        for batch in _slices(batches, 256):
            lengths, _, term, _ = _postings(batch, number)
            n += np.bincount(term, minlength=len(number) + 2)
            n[-1] += batch.num_rows
            n[-2] += lengths.sum()
        at = np.append(np.arange(len(number)), (-2, -1))
        yield pa.RecordBatch.from_arrays([pa.array(at[n > 0]), pa.array(n[n > 0])], names=["term", "n"])

    return run


def _score_documents(queries: list[str], number: dict[bytes, int], starts: np.ndarray, of: np.ndarray, df: np.ndarray, n: int, avgdl: float, k: int, k1: float, b: float, key: str):
    """The best ``k`` documents of each slice for each query; queries of a term stand in ``of`` from its place in ``starts``."""
    idf, many = np.log(1.0 + (n - df + 0.5) / (df + 0.5)), np.diff(starts)
    names = pa.array(queries, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, max(1, min(256, CELLS // len(queries)))):
            batch = batch.take(pa.compute.sort_indices(batch.column("key")))  # ties go to the smaller key
            lengths, doc, term, tf = _postings(batch, number)
            part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / avgdl))
            score, met = np.zeros(batch.num_rows * len(queries)), np.zeros(batch.num_rows * len(queries), bool)
            ends = np.cumsum(many[term])
            first = 0
            while first < len(term):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HITS, "right")))
                m = many[term[first:last]]
                inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                cell = np.repeat(doc[first:last] * len(queries), m) + of[np.repeat(starts[term[first:last]], m) + inside]
                score += np.bincount(cell, np.repeat(part[first:last], m), len(score))
                met[cell] = True
                first = last
            # a rounded score decides, so that no order of summation does
            s = np.where(met, np.round(score, 6), -1.0).reshape(batch.num_rows, -1)
            cut = np.maximum(np.partition(s, -min(k, len(s)), axis=0)[-min(k, len(s))], 0.0)
            query, row = np.nonzero((s >= cut).T)
            order = np.lexsort((row, -s[row, query], query))
            query, row = query[order], row[order]
            take = np.arange(len(query)) - np.searchsorted(query, query) < k
            query, row = query[take], row[take]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), batch.column("key").take(pa.array(row)), pa.array(s[row, query])], names=["query", key, "score"])

    return run


def bm25_topk(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, key, score, rank): the best ``k`` of ``bm25_scores``.

    Up to ``BLOCK`` queries go to where the documents are: one pass counts their terms, a second one scores slice by
    slice, and only each slice's best rows are shuffled. More queries, or keys that are null or not unique, take the join.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    best = lambda scored: scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    q = queries.select(F.lower("mention").alias("query")).filter("query IS NOT NULL").distinct()
    first = q.limit(BLOCK + 1).select("query", F.array_distinct(label_tokens("query", 1)).alias("terms")).collect()
    of_key = docs.filter(F.col(text).isNotNull()).groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull())
    if len(first) > BLOCK or not isinstance(docs.schema[key].dataType, (LongType, IntegerType, StringType)) or of_key.limit(1).count():
        return best(bm25_scores(queries, docs, key, text, k1, b))
    first.sort(key=lambda r: r["query"])
    number = {t.encode(): i for i, t in enumerate(sorted({t for r in first for t in r["terms"]}))}
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("text"))
    counts = dict(map(tuple, rows.select("text").mapInArrow(_count_terms(number), "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    schema = f"query string, {key} {docs.schema[key].dataType.simpleString()}, score double"
    if not number or not counts.get(-2):
        return best(q.sparkSession.createDataFrame([], schema))
    n, df = counts[-1], np.array([counts.get(i, 0) for i in range(len(number))], np.float64)
    pairs = sorted((number[t.encode()], i) for i, r in enumerate(first) for t in r["terms"])
    starts = np.searchsorted(np.array([t for t, _ in pairs]), np.arange(len(number) + 1))
    run = _score_documents([r["query"] for r in first], number, starts, np.array([i for _, i in pairs]), df, n, counts[-2] / n, k, k1, b, key)
    return best(rows.mapInArrow(run, schema))


def edits_allowed(term: Column) -> Column:
    """Edits that a query term of this length tolerates: 0 up to two characters, 1 up to five, then 2."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def _deletions(term: Column, most: Column) -> Column:
    """The term and what is left of it after up to ``most`` (0 to 2) deletions."""
    less = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    none = F.array().cast("array<string>")
    one = F.when(most >= 1, less(term)).otherwise(none)
    two = F.when(most >= 2, F.flatten(F.transform(less(term), less))).otherwise(none)
    return F.array_distinct(F.concat(F.array(term), one, two))


def near_terms(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qterm, term): the terms of ``vocabulary`` (term) within the edits that each of ``wanted`` (qterm) tolerates.

    Terms n edits apart share a string that n deletions or fewer make of each; so only such pairs are compared.
    """
    q = wanted.select("qterm", F.explode(_deletions(F.col("qterm"), edits_allowed(F.col("qterm")))).alias("__d"))
    v = vocabulary.select("term", F.explode(_deletions(F.col("term"), F.lit(2))).alias("__d"))
    near = q.join(v, "__d").filter(F.levenshtein("qterm", "term") <= edits_allowed(F.col("qterm")))
    return near.select("qterm", "term").distinct()


def boosted_search(queries: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """Exact synonym times 10, BM25 of all labels times 2 with edit tolerance, BM25 of the preferred label times 1.5.

    Query terms meet the vocabulary through shared deletions.
    """
    e = entities.select("entity_id", "preferred_label", "synonyms", F.array_join("synonyms", " ").alias("all_labels"))
    q = queries.select(F.lower("mention").alias("query")).filter("query IS NOT NULL").distinct()
    exact = q.join(e.select("entity_id", F.explode(F.array_distinct(F.transform("synonyms", F.lower))).alias("query")), "query").select("query", "entity_id", F.lit(10.0).alias("score"))
    tf, df = term_statistics(e, "entity_id", "all_labels")
    qt = q.withColumn("qterm", F.explode(F.array_distinct(label_tokens("query", 1))))
    near = near_terms(qt.select("qterm").distinct(), df.select("term"))
    every = qt.join(near, "qterm").join(df, "term").join(tf, "term").join(F.broadcast(_totals(e, "all_labels"))).groupBy("query", "entity_id").agg(F.sum(2.0 * _part()).alias("score"))  # one row
    first = bm25_scores(queries, e, "entity_id", "preferred_label").select("query", "entity_id", (F.col("score") * 1.5).alias("score"))
    total = exact.union(every).union(first).groupBy("query", "entity_id").agg(F.round(F.sum("score"), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "entity_id")
    return total.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Query vectors that a task multiplies with its vectors at a time.
DENSE_BLOCK = 2_000


def _matrix(vectors: pa.Array, n: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def _dense_block(ids: np.ndarray, matrix: np.ndarray, batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The best ``limit`` vectors of a batch for each query, and all that tie with the last one, in tiles of ``CELLS`` scores."""
    if not batch.num_rows or not len(ids):
        return
    vectors, keep, step = _matrix(batch.column("embedding"), batch.num_rows).T, min(limit, batch.num_rows), max(1, CELLS // batch.num_rows)
    for i in range(0, len(ids), step):
        # a rounded score decides, so that no order of summation does
        s = np.round(matrix[i : i + step] @ vectors, 6)
        cut = np.partition(s, batch.num_rows - keep, axis=1)[:, batch.num_rows - keep]
        of, take = np.nonzero(s >= cut[:, None])
        rows = pa.array(take)
        yield pa.RecordBatch.from_arrays([pa.array(ids[i + of]), batch.column("entity_id").take(rows), batch.column("label_ord").take(rows), pa.array(s[of, take])], names=["query", "entity_id", "label_ord", "score"])


def _dense_against(ids: np.ndarray, matrix: np.ndarray, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _dense_block(ids, matrix, batch, limit)

    return run


def _dense_blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = (pa.RecordBatch.from_struct_array(batch.column(c)[i].values) for c in ("queries", "vectors"))
                yield from _dense_block(q.column("query").to_numpy(), _matrix(q.column("embedding"), q.num_rows), v, limit)

    return run


def dense_topk(queries: DataFrame, index: DataFrame, k: int = 10, over: int = 3) -> DataFrame:
    """Exact inner-product search: ``over`` * k vectors, then at most k entities of each query.

    ``queries`` has query (long) and embedding, ``index`` entity_id (long), label_ord (long) and embedding. One block
    of queries goes to where the vectors are; of more, each block meets each block of vectors in a task of its own.
    """
    q, rows = queries.select("query", "embedding"), index.select("entity_id", "label_ord", "embedding")
    schema = "query long, entity_id long, label_ord long, score double"
    first = q.limit(DENSE_BLOCK + 1).collect()  # a block at most
    if len(first) <= DENSE_BLOCK:
        m = np.array([r["embedding"] for r in first], np.float64).reshape(len(first), -1) if first else np.zeros((0, 1))
        scored = rows.mapInArrow(_dense_against(np.array([r["query"] for r in first], np.int64), m, over * k), schema)
    else:
        blocks, parts = -(-q.count() // DENSE_BLOCK), max(1, -(-rows.count() // BLOCK))
        qb = q.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks))).agg(F.collect_list(F.struct("query", "embedding")).alias("queries")).select("queries")
        vb = rows.groupBy(F.pmod(F.xxhash64("entity_id", "label_ord"), F.lit(parts))).agg(F.collect_list(F.struct("entity_id", "label_ord", "embedding")).alias("vectors")).select("vectors")
        scored = vb.crossJoin(qb).repartition(blocks * parts).mapInArrow(_dense_blocks(over * k), schema)  # blocks of a stated set
    top = top_labels(scored, over * k, "label_ord")
    per = top.groupBy("query", "entity_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "entity_id")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_models(found: list[DataFrame]) -> DataFrame:
    """(query, entity_id, max_score, mean_score) of several models; a model that lacks an entity counts 0 in the mean."""
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.groupBy("query", "entity_id").agg(F.max("score").alias("max_score"), (F.sum("score") / len(found)).alias("mean_score"))
