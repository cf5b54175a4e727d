"""String and vector similarity: token-sorted Indel ratio, difflib ratio, dot product."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def token_sort_key(x: Column) -> Column:
    """White-space tokens sorted and joined by one space."""
    return F.array_join(F.array_sort(F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")), " ")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, as nested folds: exact, for small inputs and cross-checks."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    other = chars(b)

    def row(prev: Column, c: Column) -> Column:
        step = lambda acc, j: F.concat(acc, F.array(F.when(F.element_at(other, j) == c, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(acc, j)))))
        return F.aggregate(F.sequence(F.lit(1), F.size(other)), F.array(F.lit(0)), step)

    start = F.array_repeat(F.lit(0), F.size(other) + 1)
    full = F.element_at(F.aggregate(chars(a), start, row), F.size(other) + 1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(full)


def indel_ratio(lcs: Column, a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (|a| + |b|); two empty strings are equal."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / n)


class LabelBlock:
    """Strings of a batch as a matrix of code points, to compare with one query after the other."""

    def __init__(self, labels: list[str]):
        self.size = np.array([len(x) for x in labels], np.int64)
        width = int(self.size.max(initial=0))
        self.labels = labels
        # columns by position; 0 stands for the end, which no query character equals
        self.codes = np.zeros((width, len(labels)), np.uint32)
        for i, x in enumerate(labels):
            if x:
                self.codes[: len(x), i] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, self.index = np.unique(self.codes, return_inverse=True)
        self.index = self.index.reshape(self.codes.shape)

    def lcs(self, query: str) -> np.ndarray:
        """Bit-parallel LCS of the query with every string: one machine word for each 64 query characters."""
        out = np.zeros(len(self.labels), np.int64)
        m = len(query)
        if m > 63:
            return np.array([_lcs_long(query, x) for x in self.labels], np.int64)
        mask = np.zeros(len(self.alphabet), np.uint64)
        for j, ch in enumerate(query):
            mask[self.alphabet == ord(ch)] |= np.uint64(1 << j)
        v = np.full(len(self.labels), ~np.uint64(0))
        for row in self.index:
            u = v & mask[row]
            v = (v + u) | (v - u)
        out = np.bitwise_count(~v & np.uint64((1 << m) - 1)).astype(np.int64)
        return out

    def ratio(self, query: str) -> np.ndarray:
        n = self.size + len(query)
        return np.where(n == 0, 100.0, 200.0 * self.lcs(query) / np.maximum(n, 1))


def _lcs_long(a: str, b: str) -> int:
    """The same recurrence on Python's integers, for queries of any length."""
    at: dict[str, int] = {}
    for j, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << j
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & at.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return (~v & full).bit_count()


def sort_tokens(x: str) -> str:
    return " ".join(sorted(x.split()))


def difflib_ratios(query: str, labels: list[str]) -> np.ndarray:
    """difflib's ratio times 100; the query is the first sequence, which matters."""
    return np.array([100.0 * difflib.SequenceMatcher(None, query, x).ratio() for x in labels])


@F.pandas_udf(DoubleType())
def token_sort_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of two columns, row by row."""
    for a, b in pairs:
        yield pd.Series([200.0 * _lcs_long(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(map(sort_tokens, a), map(sort_tokens, b), strict=True)], dtype=float)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
