"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's probability is a logistic function of its hashed words; the
document's is 1 - prod(1 - p_sentence), so that one offending sentence makes the document. Only document labels
are known; the gradient of the bag likelihood gives each sentence its share of the blame, which later locates the
offending sentences. The model is fitted on a bounded sample of labelled rows; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, byte_set, labelled_texts, mix64, row_chunks, table, text_bytes

#: Labelled rows that the model is fitted on at most, drawn by a hash of doc_id.
TRAIN_ROWS = 8000
#: Bytes of text that these rows have at most.
TRAIN_BYTES = 64 << 20
#: Probability from which a sentence counts as offending.
OFFENDING = 0.5
#: Bits of the word hash that pick a weight.
BITS = 18
#: Bytes of a word's head.
HEAD = 4
#: Words are runs of ASCII letters, digits and bytes of other scripts.
NOT_WORD = byte_set((0, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Bytes that end a sentence.
SENTENCE_END = byte_set((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F), (0x0A, 0x0A))


class Model(NamedTuple):
    """Weights by hashed word, and the bias of a sentence."""

    weights: np.ndarray
    bias: float


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and row numbers of the sentences of some rows: a sentence runs up to and with its end byte."""
    ends = np.flatnonzero(SENTENCE_END[data]) + 1
    starts = np.unique(np.concatenate([off[:-1][off[:-1] < off[1:]], ends[ends < len(data)]])) if len(data) else np.zeros(0, np.int64)
    return starts, np.searchsorted(off, starts, "right") - 1


def bags(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature indices, sentence of each, row of each sentence, start of each sentence).

    A word is a feature, and so is the head of a longer word, which stands for its inflected forms.
    """
    w = Words(data, off, NOT_WORD)
    s, row = sentences(data, off)
    of = np.searchsorted(s, w.starts, "right") - 1
    long_ = w.ends - w.starts > HEAD
    every = np.concatenate([w.hashes(), mix64(w.hashes(HEAD)[long_] + U64(1))])
    return (every >> U64(64 - BITS)).astype(np.int64), np.concatenate([of, of[long_]]), row, s


def _sentence_logits(words: np.ndarray, of: np.ndarray, n: int, m: Model) -> np.ndarray:
    """One per sentence: the bias plus the weights of its words."""
    return m.bias + np.bincount(of, m.weights[words], n)


def fit(data: np.ndarray, off: np.ndarray, labels: np.ndarray, epochs: int = 150, rate: float = 0.1, l2: float = 1e-4, seen_at_least: int = 3, deviations: float = 4.0) -> Model:
    """Weights from document labels by full-batch Adam on the noisy-or likelihood.

    Only words whose sentences stand in documents labelled 1 more often than chance by ``deviations`` standard deviations get a
    weight; a long text has hundreds of rare words, which would be learnt by heart else. With one class only, the score is the same for every document.
    """
    w = np.zeros(1 << BITS)
    n = len(labels)
    base = (labels.sum() + 0.5) / (n + 1.0)
    if not n or not labels.any() or labels.all():
        return Model(w.astype(np.float32), float(np.log(base / (1 - base))))
    parts, sents = [], 0
    for a, b in row_chunks(off):  # a piece at a time: hashing takes many bytes for each byte of text
        words, of, row, _ = bags(data[off[a] : off[b]], off[a : b + 1] - off[a])
        parts.append((words.astype(np.int32), (of + sents).astype(np.int32), (row + a).astype(np.int32)))
        sents += len(row)
    words, of, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    # A word's evidence is counted over distinct sentences, since copied texts would count again and again.
    sig = np.zeros(len(row), U64)
    np.add.at(sig, of, mix64(words.astype(U64) + U64(1)))
    _, same = np.unique(sig, return_inverse=True)
    toxic_share = np.bincount(same, labels[row]) / np.bincount(same)
    pair = np.unique(same.astype(np.int64)[of] * (1 << BITS) + words)
    df = np.bincount(pair % (1 << BITS), minlength=1 << BITS)
    hot = np.bincount(pair % (1 << BITS), toxic_share[pair // (1 << BITS)], 1 << BITS)
    share = np.clip(toxic_share.mean(), 1e-6, 1 - 1e-6)
    used = (df >= seen_at_least) & (hot - df * share >= deviations * np.sqrt(df * share * (1 - share)))
    keep = used[words]
    words, of = words[keep], of[keep]
    # start: log-odds of the label given the word, if they are high
    odds = np.log((hot + 0.5) / (df - hot + 1.0)) - np.log(share / (1 - share))
    w[used] = np.clip(odds[used], 0, 6)
    per_row = np.maximum(np.bincount(row, minlength=n), 1)
    bias = float(np.log(base / np.median(per_row))) - 2.0
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    y = labels.astype(float)
    for t in range(1, epochs + 1):
        z = _sentence_logits(words, of, len(row), Model(w, bias))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_not = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
        doc = -np.expm1(log_not)
        # d log-likelihood / d z of a sentence: p * (y - P) / P, the share of the blame
        g = p * ((y - doc) / np.maximum(doc, 1e-6))[row]
        gw, gb = -np.bincount(words, g[of], 1 << BITS) / n + l2 * w, -g.sum() / n
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        step = rate / np.sqrt(t / 10 + 1)
        w -= step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6) * used
        bias -= step * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-9)
    return Model(w.astype(np.float32), float(bias))


class Scores(NamedTuple):
    """Score of each row; its best sentence's probability, start and end in bytes; and (row, start, end, probability) of
    the offending sentences, in order."""

    score: np.ndarray
    best: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offending: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def score_rows(data: np.ndarray, off: np.ndarray, model: Model) -> Scores:
    """Scores of some rows. A row without sentences counts as one empty one."""
    n = len(off) - 1
    words, of, row, start = bags(data, off)
    z = _sentence_logits(words, of, len(row), model)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    alone = 1 / (1 + np.exp(-np.clip(model.bias, -30, 30)))
    log_not = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-9)), n).astype(np.float64)
    some = np.bincount(row, minlength=n) > 0
    log_not[~some] = np.log1p(-min(alone, 1 - 1e-9))
    best, at, end = np.full(n, alone), np.zeros(n, np.int64), np.zeros(n, np.int64)
    begin, stop = start - off[row], np.minimum(np.concatenate([start[1:], off[-1:]])[: len(row)], off[row + 1]) - off[row]
    if len(row):
        order = np.lexsort((start, -p, row))
        first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        r = row[first]
        best[r], at[r], end[r] = p[first], begin[first], stop[first]
    bad = np.flatnonzero(p >= OFFENDING)
    return Scores(np.clip(-np.expm1(log_not), 0, 1), best, at, end, (row[bad], begin[bad], stop[bad], p[bad]))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fit on ``most`` labelled documents and ``TRAIN_BYTES`` of text at most, the first by a hash of doc_id; null labels are left out."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    rows = labelled_texts(docs, known, most, TRAIN_BYTES)
    if not rows.num_rows:
        return fit(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0))
    data, off = text_bytes(rows["text"])
    return fit(data, off, rows["y"].to_numpy() > 0)


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            for a, b in row_chunks(off):
                s = score_rows(data[off[a] : off[b]], off[a : b + 1] - off[a], model)
                of, *spans = s.offending
                bad = pa.StructArray.from_arrays([pa.array(x) for x in spans], names=["start", "end", "score"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(b - a + 1)), pa.int32()), bad)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, s[:4]), lists], names=["doc_id", "score", "worst_score", "worst_start", "worst_end", "offending"])

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, score, the probability and byte range of the worst sentence, and the byte ranges and
    probabilities of all offending ones, those of ``OFFENDING`` or more.

    Only the text is read. A null or empty text counts as one empty sentence.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 1 MB at any input
    return docs.select("doc_id", "text").mapInArrow(_scorer(shared), "doc_id long, score double, worst_score double, worst_start long, worst_end long, offending array<struct<start: long, end: long, score: double>>")


def held_out() -> Column:
    """Whether crc32 of doc_id as text is divisible by 5 (a null doc_id is not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end", "offending")
