"""Mention extraction by linguistic rules over a token table.

Tokens come from the built-in tagger (regular expressions and closed word classes, column expressions only) or from
a model plugged in as ``tokens_with``. The rules are windows over (doc, sentence): candidates next to each other
make a span; spans with one to three stop-word prepositions or determiners between them are joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

TOKEN = r"\d+(?:\.\d+)?|[\p{L}\p{M}\p{N}]+(?:'[\p{L}]+)?|[^\s]"
SCHEMA = "doc_id long, sent int, i int, start int, text string, is_stop boolean, pos string, like_num boolean, is_punct boolean"
PIECE = rf"(?U)(\s*)({TOKEN})"
STOP = [*fixed.STOPWORDS, *fixed.ADPOSITIONS, *fixed.DETERMINERS, *fixed.OTHER_STOPWORDS]
#: Tokens that ``extract`` works on at a time, of whole documents.
SLICE = 200_000
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def tokens(docs: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """Token rows of (doc_id, text) by the built-in tagger; a sentence ends after . ! or ? before white space."""
    low = F.lower("w")
    stop = stopwords if stopwords is not None else STOP
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    t = docs.select("doc_id", F.posexplode(pieces).alias("i", "raw"))
    w = Window.partitionBy("doc_id").orderBy("i")
    t = t.withColumn("w", F.regexp_replace("raw", r"(?U)^\s+", ""))
    t = t.withColumn("start", (F.sum(F.length("raw")).over(w) - F.length("w")).cast("int"))
    ends = F.lag("w").over(w).isin(".", "!", "?") & (F.length("raw") > F.length("w"))
    t = t.withColumn("sent", F.sum(F.coalesce(ends, F.lit(False)).cast("int")).over(w).cast("int"))
    pos = F.when(low.isin(fixed.ADPOSITIONS), "ADP").when(low.isin(fixed.DETERMINERS), "DET").when(low.isin(fixed.VERBS) | (low.rlike("(ing|ed)$") & (F.length("w") > 4)), "VERB").otherwise("X")
    return t.select("doc_id", "sent", "i", "start", F.col("w").alias("text"), low.isin(stop).alias("is_stop"), pos.alias("pos"), F.col("w").rlike(r"^[\d.,]*\d[\d.,]*$").alias("like_num"), F.col("w").rlike(r"^\p{P}$").alias("is_punct"))


def tokens_with(docs: DataFrame, load: Callable[[], Callable[[str], list[tuple]]]) -> DataFrame:
    """Token rows from a model: ``load`` runs once a worker and gives text -> rows (sent, i, start, text, is_stop, pos, like_num, is_punct)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for frame in frames:
            yield pd.DataFrame([(d, *row) for d, text in zip(frame["doc_id"], frame["text"], strict=True) for row in model(text or "")], columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def mentions(token_rows: DataFrame, docs: DataFrame, most_gap: int = 3) -> DataFrame:
    """(doc_id, start, end, mention) of every span, offsets in characters of the text from 0."""
    w = Window.partitionBy("doc_id", "sent").orderBy("i")
    t = token_rows.withColumn("c", ~F.col("is_punct") & ~F.col("is_stop") & ~F.col("pos").isin("VERB", "AUX"))
    hyphen = (F.col("text") == "-") & F.coalesce(F.lag("c").over(w), F.lit(False)) & F.coalesce(F.lead("c").over(w), F.lit(False))
    t = t.withColumn("c", F.col("c") | hyphen)
    # a run of candidates has one number of non-candidates before it
    t = t.withColumn("run", F.sum((~F.col("c")).cast("int")).over(w))
    link = F.col("is_stop") & F.col("pos").isin("ADP", "DET")
    t = t.withColumn("links", F.sum(link.cast("int")).over(w))
    spans = t.filter("c").groupBy("doc_id", "sent", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("start").alias("start"), F.max(F.col("start") + F.length("text")).alias("end"), F.min("links").alias("links"), F.bool_and(F.col("like_num") | (F.col("text") == "-")).alias("bare"))
    v = Window.partitionBy("doc_id", "sent").orderBy("first")
    gap = F.col("first") - F.lag("last").over(v) - 1
    joined = F.coalesce((gap > 0) & (gap <= most_gap) & (F.col("links") - F.lag("links").over(v) == gap), F.lit(False))
    spans = spans.withColumn("group", F.sum((~joined).cast("int")).over(v))
    out = spans.groupBy("doc_id", "sent", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_and("bare").alias("bare"), F.count("*").alias("n")).filter("NOT bare OR n > 1")
    return out.join(docs.select("doc_id", F.col("text").alias("__t")), "doc_id").select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.substr("__t", F.col("start") + 1, F.col("end") - F.col("start")).alias("mention"))


def _classes(raws: list[str], marks: set[str], stop: set[str]) -> np.ndarray:
    """(length, length of the token, ends a sentence, candidate, hyphen, link, bare) of each piece, as ``tokens`` tells them."""
    out = np.zeros((7, len(raws)), np.int64)
    for i, raw in enumerate(raws):
        w = raw.lstrip(_SPACE)
        low = w.lower()
        link = low in _LINKS
        verb = not link and (low in _VERBS or (low.endswith(("ing", "ed")) and len(w) > 4))
        out[:, i] = len(raw), len(w), w in _ENDS, w not in marks and low not in stop and not verb, w == "-", low in stop and link, w == "-" or _NUMBER.fullmatch(w) is not None
    return out


_LINKS, _VERBS, _ENDS = {*fixed.ADPOSITIONS, *fixed.DETERMINERS}, set(fixed.VERBS), {".", "!", "?"}
_NUMBER = re.compile(r"[0-9.,]*[0-9][0-9.,]*")
_ASCII_MARKS = set("!\"#%&'()*,-./:;?@[\\]_{}")


def _spans(of: np.ndarray, kind: np.ndarray, classes: np.ndarray, most_gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the spans of tokens, given by document ``of`` and the piece's number ``kind``."""
    size, width, ends, c, hyphen, link, bare = classes[:, kind]
    n = len(of)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    new = np.r_[True, of[1:] != of[:-1]]
    total = np.cumsum(size)
    start = total - (total - size)[new][np.cumsum(new) - 1] - width
    # a sentence begins with a document or where white space follows an end
    new[1:] |= (ends[:-1] > 0) & (size[1:] > width[1:])
    sent = np.cumsum(new)
    before, after = np.r_[False, (c[:-1] > 0) & ~new[1:]], np.r_[(c[1:] > 0) & ~new[1:], False]
    c = (c > 0) | ((hyphen > 0) & before & after)
    links = np.cumsum(link)
    first = np.flatnonzero(c & np.r_[True, ~c[:-1] | new[1:]])
    last = np.flatnonzero(c & np.r_[~c[1:] | new[1:], True])
    if not len(first):
        return (np.zeros(0, np.int64),) * 3
    # candidates are no links, so that a span has one number of links before it
    gap = first[1:] - last[:-1] - 1
    joined = (sent[first[1:]] == sent[first[:-1]]) & (gap > 0) & (gap <= most_gap) & (links[first[1:]] - links[first[:-1]] == gap)
    head = np.flatnonzero(np.r_[True, ~joined])
    tail = np.r_[head[1:], len(first)]
    words = np.r_[0, np.cumsum(c & (bare == 0))]
    kept = (words[last + 1] - words[first] > 0)
    kept = (np.add.reduceat(kept, head) > 0) | (tail - head > 1)
    head, tail = first[head[kept]], last[tail[kept] - 1]
    return of[head], start[head], start[tail] + width[tail]


def extract(docs: DataFrame, most_gap: int = 3) -> DataFrame:
    """``mentions`` of the ``tokens`` of the built-in tagger, document by document, so that no token is shuffled.

    Pieces and marks come from Spark's regular expressions; each distinct piece of a slice is classed once.
    """
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{P}&&[^\x00-\x7F]]"), F.lit(0)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = set(STOP)
        for batch in batches:
            # offsets of the lists, since a slice of them keeps its values
            pieces = batch.column("pieces")
            at = pieces.offsets.to_numpy()
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
                coded = pieces.values.slice(at[i], at[j] - at[i]).dictionary_encode()
                special = _ASCII_MARKS.union(*(m.as_py() for m in batch.column("marks").slice(i, j - i)))
                of = np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
                doc, start, end = _spans(of, coded.indices.to_numpy(), _classes(coded.dictionary.to_pylist(), special, stop), most_gap)
                texts = batch.column("text").slice(i, j - i).to_pylist()
                found = [texts[d - i][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(found, pa.string())], names=["doc_id", "start", "end", "mention"])
                i = j

    rows = docs.filter("text IS NOT NULL").select("doc_id", "text", F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)).alias("pieces"), marks.alias("marks"))
    return rows.mapInArrow(run, f"doc_id {kind}, start int, end int, mention string")
