"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Each partition permutes its rows where they are, by a local sort, and numbers them. The driver draws how many rows
each partition sends to each shard: partition by partition, a multivariate hypergeometric draw from the room left in
the shards, so that every row and column total is exact. A partition deals its permuted rows out by its row of the
matrix; the rows are exchanged once, and each shard permutes what it gets, by sorts inside bounded buckets. Everything
that touches rows is DataFrame code; the driver handles the matrix alone.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, table, written

#: Rows of the matrix. More partitions than this are joined into as many, without an exchange; the law is the same.
MAX_BLOCKS = 1 << 16
#: Rows that a bucket of a shard aims at; buckets only bound a sort.
ROWS_PER_BUCKET = 256
#: Urns up to this size are numpy's; it draws from no larger ones.
URN = 10**9
#: Standard deviations around the mode that the draw from a larger urn sums up; what is beyond has less than 1e-30.
REACH = 12


def communication_matrix(counts: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Rows that each block sends to each shard; shard totals differ by one at most."""
    total = int(counts.sum())
    room = np.full(n_shards, total // n_shards, np.int64)
    room[: total % n_shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), n_shards), np.int64)
    left = total
    for i, c in enumerate(counts):
        if c == left:
            out[i] = room
            break
        # column by column: the marginals of a multivariate hypergeometric draw
        rest, want = left, int(c)
        for j in range(n_shards):
            if not want:
                break
            good = int(room[j])
            x = want if rest == good else _hypergeometric(rng, good, rest - good, want)
            out[i, j], want, rest = x, want - x, rest - good
        room -= out[i]
        left -= int(c)
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` balls drawn from the urn are good.

    Larger urns than numpy's are drawn from by inversion: the probabilities around the mode follow from the ratios of
    neighbours, (good - k)(n - k) / ((k + 1)(bad - n + k + 1)).
    """
    if good + bad < URN:
        return int(rng.hypergeometric(good, bad, n))
    ks, weights = _around_mode(good, bad, n)
    upto = np.cumsum(weights)
    return int(ks[min(np.searchsorted(upto, rng.random() * upto[-1], "right"), len(ks) - 1)])


def _around_mode(good: int, bad: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts around the mode, and weights in proportion to their probabilities."""
    total = good + bad
    share = good / total
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = int(REACH * (n * share * (1 - share) * (total - n) / (total - 1)) ** 0.5) + 50
    low, high = max(0, n - bad, mode - reach), min(n, good, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    return np.arange(low, high + 1), np.exp(logs - logs.max())


def hypergeometric_shuffle(df: DataFrame, n_shards: int, seed: int = 20240501) -> DataFrame:
    """``df`` with ``shard`` (0 .. n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Rows are told apart by their place, so repeated rows and nulls are shuffled like any others. An empty table
    gives an empty result. A column of ``df`` named shard or slot is replaced. The permuted partitions are written
    once, so that a lost executor changes nothing; the shuffle is that of the partitions the table came in.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    place = F.monotonically_increasing_id()  # the partition above 33 bits of the row's number in it
    local = df.coalesce(MAX_BLOCKS).sortWithinPartitions(F.rand(seed)).withColumn("__lw_p", place)
    local = written(local, "permuted")
    block, n = F.shiftright("__lw_p", 33).cast("int"), F.col("__lw_p").bitwiseAND((1 << 33) - 1)
    counts = dict(local.groupBy(block.alias("b")).count().collect())  # MAX_BLOCKS rows at most
    blocks = sorted(counts)
    total = sum(counts.values())
    upto = np.cumsum(communication_matrix(np.array([counts[b] for b in blocks], np.int64), n_shards, seed), axis=1)
    matrix = spark.sql("SELECT inline(from_json(:m, 'array<struct<__lw_b int, __lw_upto array<bigint>>>'))", args={"m": json.dumps([{"__lw_b": b, "__lw_upto": row} for b, row in zip(blocks, upto.tolist(), strict=True)])})
    buckets = 1 << max(2, min(16, (total // n_shards // ROWS_PER_BUCKET).bit_length()))
    dealt = (
        local.withColumn("__lw_b", block)
        .join(F.broadcast(matrix), "__lw_b")  # at most MAX_BLOCKS rows
        .withColumn("shard", F.size(F.filter("__lw_upto", lambda c: c <= n)))
        .withColumn("__lw_r", F.xxhash64(F.lit(seed), "__lw_p"))
        .withColumn("__lw_k", F.shiftrightunsigned("__lw_r", 48).bitwiseAND(buckets - 1))
        .drop("__lw_b", "__lw_upto")
    )
    sizes = dealt.groupBy("shard", "__lw_k").agg(F.count("*").alias("__lw_c"))
    before = sizes.select("shard", "__lw_k", (F.sum("__lw_c").over(Window.partitionBy("shard").orderBy("__lw_k")) - F.col("__lw_c")).alias("__lw_o"))
    before = written(before, "offsets")  # n_shards x buckets rows: one for every 256 or so
    again = Window.partitionBy("shard", "__lw_k").orderBy("__lw_r", "__lw_p")
    return (
        dealt.withColumn("__lw_n", F.row_number().over(again))
        .join(small(before), ["shard", "__lw_k"])
        .withColumn("slot", F.col("__lw_o") + F.col("__lw_n") - 1)
        .select(*df.columns, "shard", F.col("slot").cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, payload: bool = False) -> DataFrame:
    """Size, checksum, shard and slot of each document under the law ``rows``: shard counts differ by one at most.

    A null text counts as empty (size 8, checksum 0). ``payload`` keeps the columns of ``docs`` beside them, so
    that the documents themselves are exchanged, and columns of theirs with these names are replaced; else only a
    narrow row per document moves. Rows that share a doc_id are rows of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    added = {
        "size": (F.octet_length(text) + 8).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "law": F.lit("rows"),
        "grown_shard": F.lit(None).cast("int"),
    }
    rows = docs.drop("shard", "slot", *(added if payload else ())).select(*(docs.drop("shard", "slot", *added).columns if payload else ["doc_id"]), *[c.alias(n) for n, c in added.items()])
    out = hypergeometric_shuffle(rows, n_shards)
    first = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def op10(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
