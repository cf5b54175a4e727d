"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text, one per language.

Symbols are UTF-8 bytes and the order is 5, so that every script is covered without a vocabulary. All trusted
documents (label quality 1) but a held-out part train it. Counts are tables sharded by n-gram: highest-order
counts are summed, lower orders count the distinct left extensions, contexts give totals, and the orders meet in
joins on the shared part. The result is a table of log-probabilities of seen n-grams and of backoff weights.

Scoring joins that table with the documents shard by shard. A shard has at most ``SHARD_ROWS`` rows, cut by the two
bytes before the last one, which an n-gram and all that it backs off to have in common (orders 1 and 2, bounded by
the alphabet, go along with each shard). One shard at a time is sent to the documents, and what its positions add to each
document's sum is written before the next one; the sums give the perplexity. One shard or a thousand, the result
is the same, and no more than one is ever on the driver.

A document is rejected if its perplexity is above its language's threshold: a quantile over the held-out trusted
documents of that language, a fifth of them and a few more. Its distance from their mean (of log-perplexities) is
drawn towards that of all languages together, as if ``PRIOR`` documents had shown the latter; so a language with few
trusted documents has a threshold as well. Only a language without a model has none: one with a single trusted
document, or none.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mix64, row_chunks, row_key, small, table, text_bytes, written

ORDER = 5
#: Rows of the model that are sent to executors at once: 16 bytes each in a table twice that size.
SHARD_ROWS = 3_000_000
#: Share of held-out trusted documents that the threshold of a language lets through.
QUANTILE = 0.99
#: Documents that the spread of all languages weighs against a language's own held-out ones.
PRIOR = 100
#: One in this many trusted documents is held out,
FOLDS = 5
#: and besides the first of each language, this many or a third.
LEAST_HELD_OUT = 5
#: Byte that stands before a document's first; the others of a context there are 0.
PAD = ORDER - 1


def language() -> Column:
    """The whole language tag in lower case; und for none."""
    low = F.lower(F.trim(F.coalesce(F.col("lang"), F.lit(""))))
    return F.when(low == "", F.lit("und")).otherwise(low)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the ORDER bytes that end at each position (0 before the start of a row), and each position's row.

    Bytes 0 in a text are read as 1, so that 0 stands for the outside only.
    """
    n, rows = len(data), np.repeat(np.arange(len(off) - 1), np.diff(off))
    b = np.maximum(data, 1).astype(U64)
    code = b.copy()
    since = np.arange(n) - off[:-1][rows] if n else np.zeros(0, np.int64)
    for k in range(1, ORDER):
        code[k:] |= np.where(since[k:] >= k, b[:-k], U64(0)) << U64(8 * k)
    return code, rows


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of trusted documents, summed over chunks as far as memory allows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            if len(parts) > 1:
                parts[:] = [_summed(parts)]
            g, c = parts[0]
            for i in range(0, len(g), 200_000):
                k = len(g[i : i + 200_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array(g[i : i + k].view(np.int64)), pa.array(c[i : i + k])], names=["lang", "g", "c"])
        held.clear()

    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            part = batch.filter(pa.array(langs == lang))
            data, off = text_bytes(part.column("text"))
            for a, b in row_chunks(off, 1 << 20):
                g, _ = grams(data[off[a] : off[b]], off[a : b + 1] - off[a])
                held.setdefault(lang, []).append(np.unique(g, return_counts=True))
                if len(held[lang]) >= 4:
                    held[lang] = [_summed(held[lang])]
        if sum(len(g) for parts in held.values() for g, _ in parts) > 3_000_000:
            yield from flush()
    yield from flush()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of n-grams counted 1 .. 4 times."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))  # type: ignore[return-value]


def _discount_columns(orders: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): ``discounts`` of each language's n-grams ``orders`` (lang, c)."""
    n = orders.groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    seen = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = lambda i, other: F.when(seen, F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(0.05)), F.lit(i - 1 + 0.95))).otherwise(other)
    return n.select("lang", d(1, 0.5).alias("d1"), d(2, 0.75).alias("d2"), d(3, 0.9).alias("d3"))


def model_tables(counts: DataFrame) -> DataFrame:
    """(lang, kind, n, g, v) from ``counts`` (lang, g, c) of order ORDER.

    kind p: the log-probability of the n-gram g of order n given what stands before its last byte; kind b: the log
    of the backoff weight of the context g of n bytes. Nothing is collected.
    """
    orders = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        mask = (1 << 8 * n) - 1
        orders[n] = written(orders[n + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit(mask).cast("long")).alias("g")).agg(F.count("*").alias("c")), f"order{n}")
    lower: DataFrame | None = None
    out = []
    for n in range(1, ORDER + 1):
        ctx = Window.partitionBy("lang", "h")
        disc = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = orders[n].join(small(written(_discount_columns(orders[n]), "discounts")), "lang").withColumn("h", F.shiftright("g", 8)).withColumn("disc", disc)
        t = t.withColumn("total", F.sum("c").over(ctx)).withColumn("gamma", F.sum("disc").over(ctx) / F.col("total"))
        t = t.withColumn("alpha", (F.col("c") - F.col("disc")) / F.col("total"))
        if lower is None:
            p = t.withColumn("p", F.col("alpha") + F.col("gamma") / 256)
        else:
            mask = (1 << 8 * (n - 1)) - 1
            low = lower.select("lang", F.col("g").alias("s"), F.col("p").alias("pl"))
            p = t.withColumn("s", F.col("g").bitwiseAND(F.lit(mask).cast("long"))).join(low, ["lang", "s"]).withColumn("p", F.col("alpha") + F.col("gamma") * F.col("pl"))
        lower = written(p.select("lang", "g", "h", "p", "gamma"), f"probs{n}")
        out.append(lower.select("lang", F.lit("p").alias("kind"), F.lit(n).alias("n"), "g", F.log("p").alias("v")))
        out.append(lower.groupBy("lang", "h").agg(F.first("gamma").alias("v")).select("lang", F.lit("b").alias("kind"), F.lit(n - 1).alias("n"), F.col("h").alias("g"), F.log("v").alias("v")))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


class Lookup:
    """64-bit keys to floats by open addressing: keys in the order of their hashed places, so that a search ends early."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        place = self._place(keys)
        order = np.argsort(place, kind="stable")
        i = np.arange(len(keys))
        at = np.maximum.accumulate(place[order] - i) + i if len(keys) else i
        size = (1 << self.bits) + int((at - place[order]).max(initial=0)) + 2
        self.keys, self.values = np.full(size, ~U64(0)), np.full(size, np.nan, np.float32)
        self.keys[at], self.values[at] = keys[order], values[order]
        self.far = int((at - place[order]).max(initial=0))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, nan where a key is missing."""
        at = self._place(keys)
        found = self.keys[at]
        out = self.values[at]
        bad = np.flatnonzero((found != keys))
        out[bad] = np.nan
        bad = bad[found[bad] != ~U64(0)]
        for step in range(1, self.far + 1):
            if not len(bad):
                break
            found = self.keys[at[bad] + step]
            hit = found == keys[bad]
            out[bad[hit]] = self.values[at[bad[hit]] + step]
            bad = bad[~hit & (found != ~U64(0))]
        return out


def _key(kind: str, n: int, lang: np.ndarray | int, g: np.ndarray) -> np.ndarray:
    """One key space for all tables of a shard: language number, order and kind above the 40 bits of the n-gram."""
    return g | (U64(n * 2 + (kind == "b")) << U64(40)) | (np.asarray(lang, U64) << U64(44))


def score_chunk(data: np.ndarray, off: np.ndarray, lang: np.ndarray, look: Lookup, mine: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log-probabilities and number of positions of each row, over the positions whose middle is ``mine``."""
    n = len(off) - 1
    g, rows = grams(data, off)
    if mine is not None:
        keep = mine[((g >> U64(8)) & U64(0xFFFF)).astype(np.int64)]
        g, rows = g[keep], rows[keep]
    pair, at = np.unique(g + (lang[rows].astype(U64) << U64(44)), return_inverse=True)
    g, of = pair & U64((1 << 40) - 1), pair >> U64(44)
    total = np.zeros(len(g))
    todo = np.arange(len(g))
    for k in range(ORDER, 0, -1):
        x = g[todo] & U64((1 << 8 * k) - 1)
        p = look.get(_key("p", k, of[todo], x))
        hit = ~np.isnan(p)
        total[todo[hit]] += p[hit]
        todo, x = todo[~hit], x[~hit]
        if not len(todo):
            break
        back = look.get(_key("b", k - 1, of[todo], x >> U64(8)))
        total[todo] += np.where(np.isnan(back), 0.0, back)
    total[todo] += np.log(1 / 256)
    return np.bincount(rows, total[at], n).astype(np.float64), np.bincount(rows, minlength=n)


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, mine = shared.value
        look = Lookup(keys, values)
        for batch in batches:
            lang = batch.column("l").to_numpy()
            data, off = text_bytes(batch.column("text"))
            for a, b in row_chunks(off):
                s, c = score_chunk(data[off[a] : off[b]], off[a : b + 1] - off[a], lang[a:b], look, mine)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in ("doc_id", "lang", "k")), pa.array(s), pa.array(c.astype(np.int64))], names=["doc_id", "lang", "k", "s", "c"])

    return score


def perplexities(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, k, s, c) of ``docs`` (doc_id, lang, k, text) in the model's languages: sums of log-probabilities, symbols."""
    spark = docs.sparkSession
    langs = written(model.select("lang").distinct().withColumn("l", F.row_number().over(Window.orderBy("lang")) - 1), "languages")  # a row for each language
    kind = F.col("n") * 2 + (F.col("kind") == "b").cast("int")
    key = F.col("g").bitwiseOR(F.shiftleft(kind.cast("long"), 40)).bitwiseOR(F.shiftleft(F.col("l").cast("long"), 44))
    middle = F.when((F.col("kind") == "p") & (F.col("n") >= 3), F.shiftright("g", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))).when((F.col("kind") == "b") & (F.col("n") >= 2), F.col("g").bitwiseAND(F.lit(0xFFFF).cast("long")))
    model = written(model.join(small(langs), "lang").select(key.alias("key"), F.col("v").cast("float").alias("v"), middle.cast("int").alias("m")), "model")
    shards = max(1, -(-model.count() // SHARD_ROWS))
    deal = (mix64(np.arange(1 << 16).astype(U64)) % U64(shards)).astype(np.int64)
    d = docs.join(small(langs), "lang").select("doc_id", "lang", "k", "l", "text")
    parts = []
    for i in range(shards):
        of_shard = model if shards == 1 else model.join(F.broadcast(spark.createDataFrame([(int(x),) for x in np.flatnonzero(deal == i)], "m int")), "m", "left_semi").unionByName(model.filter("m IS NULL"))  # 65536 numbers at most
        t = of_shard.select("key", "v").toArrow()  # SHARD_ROWS rows, more or less
        shared = spark.sparkContext.broadcast((t["key"].to_numpy().view(U64), t["v"].to_numpy(), None if shards == 1 else deal == i))
        del t
        parts.append(written(d.mapInArrow(_scorer(shared), "doc_id long, lang string, k long, s double, c long"), "sums"))
        shared.destroy()
    if len(parts) == 1:
        return parts[0]
    every = parts[0].withColumn("shard", F.lit(0))
    for i, x in enumerate(parts[1:], 1):
        every = every.unionByName(x.withColumn("shard", F.lit(i)))
    # repeated rows have equal sums: one of each shard, and as many rows as before
    one = every.groupBy("doc_id", "lang", "k", "shard").agg(F.first("s").alias("s"), F.first("c").alias("c"), F.count("*").alias("n")).groupBy("doc_id", "lang", "k").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.max("n").alias("n"))
    return one.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, k (row_key of doc_id and text), lang (as modelled), n_symbols, perplexity, threshold, keep.

    Trusted are the documents that all their labels call quality 1. A fifth of them, by crc32 of doc_id, and of each
    language the first ``LEAST_HELD_OUT`` (a third at most) are held out of the training and set the threshold. A text without symbols
    (null or empty) has no perplexity and is kept; in a language without a model no document has one, and all are kept.
    Repeated rows are scored one by one. Rows that share a doc_id share its labels.
    """
    d = docs.select("doc_id", language().alias("lang"), "text", row_key("doc_id", "text").alias("k"))
    trusted = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    known = written(d.filter("text <> ''").select("doc_id", "lang").join(small(written(trusted, "trusted")), "doc_id").distinct(), "known")
    # of each language the first few; the limit on row_number is applied before rows are shuffled
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = known.withColumn("r", F.row_number().over(order)).filter(f"r <= {LEAST_HELD_OUT}")
    size = known.groupBy("lang").agg(F.count("*").alias("n"))
    first = ranked.join(small(written(size, "sizes")), "lang").filter("n > 1 AND r <= greatest(1, n div 3)").select("doc_id", F.lit(True).alias("first")).distinct()
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    known = written(known.select("doc_id").distinct().join(small(written(first, "firsts")), "doc_id", "left").select("doc_id", (fifth | F.coalesce("first", F.lit(False))).alias("held")), "known")
    train = d.join(small(known.filter("NOT held")), "doc_id", "left_semi").filter("text <> ''").select("lang", "text")
    counts = written(train.mapInArrow(_counter, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")), f"order{ORDER}")
    # log-perplexities are rounded, so that exact quantiles keep a bounded number of values
    scored = perplexities(d, model_tables(counts)).withColumn("level", F.when(F.col("c") > 0, F.round(-F.col("s") / F.col("c"), 4)))
    limit = small(written(_limits(scored.filter("level IS NOT NULL").join(small(known.filter("held")), "doc_id", "left_semi").select("lang", "level"), quantile), "limits"))
    judged = scored.join(limit, "lang", "left").select("doc_id", "k", "lang", F.col("c").alias("n_symbols"), F.when(F.col("c") > 0, F.exp(-F.col("s") / F.col("c"))).alias("perplexity"), F.exp("limit").alias("threshold"), F.coalesce(F.col("level") <= F.col("limit"), F.lit(True)).alias("keep"))
    modelled = small(written(counts.select("lang").distinct(), "modelled"))
    none = F.lit(None).cast("double")
    rest = d.join(modelled, "lang", "left_anti").select("doc_id", "k", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_symbols"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("keep"))
    return judged.unionByName(rest)


def _limits(held: DataFrame, quantile: float) -> DataFrame:
    """(lang, limit) from the log-perplexities of held-out documents, ``held`` (lang, level); null where no two can be compared."""
    own = held.groupBy("lang").agg(F.expr(f"percentile(level, {quantile!r}D)").alias("own"), F.avg("level").alias("mean"), F.count("*").alias("n"))
    # distances from a mean of n documents are too small by sqrt(1 - 1/n), those of new documents larger by sqrt(1 + 1/n)
    away = held.join(small(own), "lang").filter("n > 1").select("lang", F.expr("round((level - mean) / sqrt(1 - 1D / n), 4)").alias("r"))
    every = away.agg(F.expr(f"percentile(r, {quantile!r}D)").alias("far"), (F.count("*") - F.count_distinct("lang")).alias("free"))
    # a quantile of a few distances is too small, as a normal one is against Student's (its expansion)
    z = NormalDist().inv_cdf(quantile)
    far = F.when(F.col("far").isNotNull(), F.greatest("far", F.lit(0.0))) * (1 + (z**2 + 1) / (4 * F.greatest("free", F.lit(1))) + (5 * z**4 + 16 * z**2 + 3) / (96 * F.greatest("free", F.lit(1)) ** 2))
    # n documents place the limit within about 1 / sqrt(n) of itself; clean documents get twice that as a margin
    wide = own.join(F.broadcast(every.select(far.alias("far"))))  # one row
    return wide.select("lang", (F.col("mean") + (F.col("n") * (F.col("own") - F.col("mean")) + PRIOR * F.col("far") * F.sqrt(1 + 1 / F.col("n")) * (1 + 2 / F.sqrt("n"))) / (F.col("n") + PRIOR)).alias("limit"))


def op2(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("k")
