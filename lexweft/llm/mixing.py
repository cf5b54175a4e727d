"""Mixing to target weights with soft membership: domain posteriors and nonnegative document rates.

A softmax classifier, fitted on a bounded sample of labelled rows, gives every document its posterior over the
domains. Rates x >= 0 then make the expected tokens of each domain, sum of tokens * posterior * x, meet the targets
in the least-squares sense. Projected gradient steps run over the whole table, with lazy projection: steps add up, and their sum is projected
for each document, so that rates move no further from 1 than the targets need. A step is one aggregate of as many
numbers as there are pairs of domains; the direction is scaled by the inverse of the Gram matrix of the documents that
are not at zero and by each document's own length, so that a step without a new bound at zero is exact. A document's rate follows from its posterior and the sum of the
steps, so the table is never rewritten.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, U64, Words, byte_set, labelled_texts, mix64, row_chunks, row_key, table, text_bytes, written

#: Labelled rows that the classifier is fitted on at most, the first by a hash of doc_id.
TRAIN_ROWS = 8000
#: Bytes of text that these rows have at most.
TRAIN_BYTES = 64 << 20
BITS = 18
HEAD = 4
NOT_WORD = byte_set((0, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Target shares of the domains, renormalised over those that occur.
WEIGHTS = {"clean": 0.96, "toxic": 0.02, "low": 0.015, "low_toxic": 0.005}
#: Distance from the targets, as a share of the total, at which the steps end.
TOLERANCE = 1e-6
#: Steps over which the distance must halve; else the targets are out of reach.
PATIENCE = 8
#: Lengths of a step that a pass tries; 1 is exact if no document reaches or leaves zero.
LENGTHS = (4.0, 2.0, 1.0, 0.4, 0.1)


class Classifier(NamedTuple):
    """Domain names, column of a hashed word (or -1), weights (column x domain), and scale of the text statistics."""

    names: list[str]
    column: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


def features(data: np.ndarray, off: np.ndarray, column: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed word or its column, row of each; statistics per row; tokens per row). With ``column``, each once a row."""
    n = len(off) - 1
    w = Words(data, off, NOT_WORD)
    long_ = w.ends - w.starts > HEAD
    idx = (np.concatenate([w.hashes(), mix64(w.hashes(HEAD)[long_] + U64(1))]) >> U64(64 - BITS)).astype(np.int64)
    row = np.concatenate([w.rows, w.rows[long_]])
    if column is not None:
        idx = column[idx]
        idx, row = idx[idx >= 0], row[idx >= 0]
        both = np.unique(row * (1 << BITS) + idx)
        idx, row = both & ((1 << BITS) - 1), both >> BITS
    size = np.maximum(np.diff(off), 1)
    at = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[off[1:]] - c[off[:-1]]
    upper, low, mark = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), NOT_WORD[data] & ~SPACES[data]
    words = np.bincount(w.rows, minlength=n)
    again = np.bincount(w.rows[1:][(w.rows[1:] == w.rows[:-1]) & (w.hashes()[1:] == w.hashes()[:-1])], minlength=n) if len(w.rows) else np.zeros(n)
    space = SPACES[data]
    begin = ~space
    if len(data):
        begin[1:] &= space[:-1]
        begin[off[:-1][off[:-1] < off[1:]]] = ~space[off[:-1][off[:-1] < off[1:]]]
    tokens = at(begin)
    stats = np.column_stack([at(upper) / size, at(low) / size, at(mark) / size, again / np.maximum(words, 1), np.log1p(words) / 10, (np.diff(off) / np.maximum(words, 1)).clip(0, 50) / 50])
    return idx, row, stats, tokens


def fit(data: np.ndarray, off: np.ndarray, y: np.ndarray, names: list[str], epochs: int = 200, rate: float = 0.1, deviations: float = 4.0) -> Classifier:
    """Softmax regression; only words tied to a domain by ``deviations`` standard deviations are columns."""
    d, n = len(names), len(y)
    parts = []
    for a, b in row_chunks(off):
        idx, row, stats, _ = features(data[off[a] : off[b]], off[a : b + 1] - off[a], None)
        both = np.unique((row + a) * (1 << BITS) + idx)
        parts.append((both, stats))
    both = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    stats = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, 6))
    mean, dev = (stats.mean(axis=0), stats.std(axis=0) + 1e-6) if n else (np.zeros(6), np.ones(6))
    idx, row = both & ((1 << BITS) - 1), both >> BITS
    df = np.bincount(idx, minlength=1 << BITS)
    used = np.zeros(1 << BITS, bool)
    for c in range(d):
        share = (y == c).mean() if n else 0
        hot = np.bincount(idx, y[row] == c, 1 << BITS)
        used |= (df >= 3) & (hot - df * share >= deviations * np.sqrt(df * share * (1 - share) + 1e-9)) & (share < 0.5)
    column = np.full(1 << BITS, -1, np.int64)
    column[used] = np.arange(used.sum())
    keep = used[idx]
    idx, row = column[idx[keep]], row[keep]
    m = int(used.sum())
    w = np.zeros((m + 7, d))
    if n:
        dense = np.column_stack([(stats - mean) / dev, np.ones(n)])
        hot = np.eye(d)[y]
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, epochs + 1):
            p = _softmax(_logits(idx, row, dense, w, n))
            g = (p - hot) / n
            grad = np.concatenate([np.column_stack([np.bincount(idx, g[row, c], m) for c in range(d)]) if m else np.zeros((0, d)), dense.T @ g]) + 1e-4 * w
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
            w -= rate / np.sqrt(t / 20 + 1) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Classifier(names, column, w, mean, dev)


def _logits(idx: np.ndarray, row: np.ndarray, dense: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    m = len(w) - dense.shape[1]
    return dense @ w[m:] + (np.column_stack([np.bincount(row, w[idx, c], n) for c in range(w.shape[1])]) if len(idx) else 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(data: np.ndarray, off: np.ndarray, c: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each row over the domains, tokens of each row)."""
    idx, row, stats, tokens = features(data, off, c.column)
    n = len(off) - 1
    dense = np.column_stack([(stats - c.mean) / c.deviation, np.ones(n)])
    return _softmax(_logits(idx, row, dense, c.weights, n)), tokens


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Classifier:
    """Fit on ``most`` labelled documents and ``TRAIN_BYTES`` of text at most; rows with a null label are left out. No labels: one domain, all."""
    known = labels.filter("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    name = F.when((F.col("q") > 0) & (F.col("t") > 0), "toxic").when(F.col("q") > 0, "clean").when(F.col("t") > 0, "low_toxic").otherwise("low")
    rows = labelled_texts(docs, known.select("doc_id", name.alias("y")), most, TRAIN_BYTES)
    found = rows["y"].to_pylist()
    names = sorted(set(found)) or ["all"]
    data, off = text_bytes(rows["text"]) if rows.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return fit(data, off, np.array([names.index(x) for x in found], np.int64), names)


def _labeller(shared):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(*shared.value)
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            for a, b in row_chunks(off):
                p, tokens = posteriors(data[off[a] : off[b]], off[a : b + 1] - off[a], c)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("k").slice(a, b - a), pa.array(tokens.astype(np.int64)), lists], names=["doc_id", "k", "n_tokens", "posterior"])

    return label


def _rate(steps: list[np.ndarray]) -> Column:
    """A document's rate after ``steps``: 1 less its posterior's share of their sum, projected to 0 or more."""
    if not steps:
        return F.lit(1.0)
    way = [float(x) for x in np.sum(steps, axis=0)]
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col("posterior")[i] * x for i, x in enumerate(way)), F.lit(0.0)))


def _sums(members: DataFrame, trials: list[list[np.ndarray]], d: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each of ``trials`` (steps): expected tokens of each domain, the domains' Gram matrix over documents with a rate,
    and half the squared change of the rates, weighted by tokens. One pass."""
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    term = lambda i: F.col("n_tokens") * F.col("posterior")[i]
    rated = members.select("n_tokens", "posterior", *[_rate(steps).alias(f"x{t}") for t, steps in enumerate(trials)])
    sums = []
    for t in range(len(trials)):
        x = F.col(f"x{t}")
        sums += [F.sum(term(i) * x).alias(f"a{t}_{i}") for i in range(d)]
        sums += [F.sum(F.when(x > 0, term(i) * F.col("posterior")[j])).alias(f"g{t}_{i}_{j}") for i, j in pairs]
        sums.append((F.sum(F.col("n_tokens") * (x - 1) * (x - 1)) / 2).alias(f"c{t}"))
    row = rated.agg(*sums).first()
    out = []
    for t in range(len(trials)):
        gram = np.zeros((d, d))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = row[f"g{t}_{i}_{j}"] or 0.0
        out.append((np.array([row[f"a{t}_{i}"] or 0.0 for i in range(d)]), gram, row[f"c{t}"] or 0.0))
    return out


def targets(have: np.ndarray, names: list[str], weights: dict[str, float], total: float | None = None) -> np.ndarray:
    """Tokens that each domain should have, from what there is (``have``).

    ``total`` is their sum; a domain with a weight but without any tokens is an error then. By default the domain of
    the largest weight sets it and stays whole; domains that have less than their share of it fall short with what there
    is of them, instead of cutting the rest.
    """
    share = np.array([weights.get(n, 0.0) for n in names])
    share = share / share.sum() if share.sum() > 0 else np.full(len(names), 1 / len(names))
    if total is not None:
        if missing := [n for n, s, h in zip(names, share, have, strict=True) if s > 0 and h <= 0]:
            raise ValueError(f"no document can supply {', '.join(missing)}")
        return share * total
    leading = max((i for i in range(len(names)) if have[i] > 0), key=lambda i: (share[i], have[i]))
    return np.minimum(share * (have[leading] / share[leading] if share[leading] > 0 else 0.0), have)


def fit_rates(members: DataFrame, names: list[str], weights: dict[str, float], total: float | None = None) -> list[np.ndarray]:
    """Steps whose fold gives the rates of ``members`` (n_tokens, posterior); see ``targets``.

    The gradient is what the domains have too much, scaled by the inverse Gram matrix of the documents that have a rate.
    A pass tries some lengths and takes the one that most raises the dual objective, the change of the rates plus the sum
    of the steps times the gradient; its top are the nonnegative rates nearest to 1 that meet the targets. The steps end
    at ``TOLERANCE``, or where ``PATIENCE`` of them no longer halve the distance, since nonnegative rates cannot meet the
    targets; then those that came closest count, and a warning says how far each domain is off.
    """
    d = len(names)
    now, gram, _ = _sums(members, [[]], d)[0]
    if not now.sum():
        return []
    target = targets(now, names, weights, total)
    size, ridge = max(target.sum(), 1e-12), 1e-9 * np.trace(gram) * np.eye(d)
    steps: list[np.ndarray] = []
    off = [float(np.abs(now - target).max()) / size]
    best = now, 0
    while off[-1] > TOLERANCE and (len(off) <= PATIENCE or min(off[-PATIENCE:]) < 0.5 * min(off[:-PATIENCE])):
        step = np.linalg.pinv(gram + ridge) @ (now - target)
        found = _sums(members, [[*steps, x * step] for x in LENGTHS], d)
        dual = [change + np.sum([*steps, x * step], axis=0) @ (tokens - target) for x, (tokens, _, change) in zip(LENGTHS, found, strict=True)]
        take = int(np.argmax(dual))
        steps.append(LENGTHS[take] * step)
        now, gram, _ = found[take]
        off.append(float(np.abs(now - target).max()) / size)
        best = (now, len(steps)) if off[-1] == min(off) else best
    if min(off) > TOLERANCE:
        warnings.warn(f"targets are out of reach: {dict(zip(names, (best[0] - target).round(1).tolist(), strict=True))} tokens off", stacklevel=2)
    return steps[: best[1]] if min(off) > TOLERANCE else steps


def residuals(members: DataFrame, names: list[str], weights: dict[str, float], steps: list[np.ndarray], total: float | None = None) -> list[tuple[str, float, float, float]]:
    """(domain, tokens there are, target, expected tokens under ``steps``) of each domain."""
    (have, *_), (got, *_) = _sums(members, [[], steps], len(names))
    want = targets(have, names, weights, total) if have.sum() else have
    return list(zip(names, have.tolist(), want.tolist(), got.tolist(), strict=True))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, k (row_key of both), n_tokens, domain (likeliest), posterior, rate, copies.

    copies is the rate rounded up or down by a hash of the row, so that its expectation is the rate; 0 leaves the
    document out. Texts without words weigh nothing and follow the rate of their posterior. Repeated rows get
    equal rates and copies.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # a table of 2**18 columns and a few thousand weights
    rows = docs.select("doc_id", "text", row_key("doc_id", "text").alias("k"))
    members = written(rows.mapInArrow(_labeller(shared), "doc_id long, k long, n_tokens long, posterior array<double>"), "members")
    steps = fit_rates(members, model.names, weights or WEIGHTS, total)
    u = F.pmod(F.xxhash64(F.lit(8), "k"), F.lit(1 << 30)) / float(1 << 30)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return members.withColumn("rate", _rate(steps)).select("doc_id", "k", "n_tokens", F.element_at(F.array(*[F.lit(n) for n in model.names]), best).alias("domain"), "posterior", "rate", F.floor(F.col("rate") + u).cast("int").alias("copies"))


def op8(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("k")
