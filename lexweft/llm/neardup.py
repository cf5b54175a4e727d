"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds its distinct shingles of ``k`` words (A-Z lower-cased; words end at space and the controls
9 to 13); fewer words make one shingle of all, no word an empty set, which is linked with nothing. Sets are kept
as 64-bit hashes. Documents with equal sets form a class, and only classes go on.

SuperMinHash: in round j an element draws a number in [j, j + 1) and the j-th place of its own random permutation
of the signature's places, so its values are spread without repetition, which lowers the variance; a document
stops at the first round that can no longer lower any of its places.

Signatures are cut into BANDS bands of ROWS values. Classes that share a band meet in a bucket. No bucket is ever
expanded into all its pairs: each member is compared with the bucket's central member, which is the one that meets
most others in all buckets, and with its first by a hash. Near copies of one text mostly have the same two in all
their buckets, so a member makes a few pairs, however large the group. Classes that end up in one component are
settled. Members of buckets that still hold several components meet once more by their rarest shingles: similar sets
must share one of the first in an order by document frequency, at places that leave room for the overlap
(``prefix_meetings``), so these groups miss nothing, and common passages drop out of them. Before texts
are fetched, pairs must pass a bound: each set has a bitmap of the parities of its hashed elements, and the bits in
which two bitmaps differ are at most the elements in which the sets differ. The bound never rejects a link. At
similarity 0.8 a pair shares none of the 32 bands with probability (1 - 0.8**4)**32, about 5e-8.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, discard, mix64, row_chunks, small, table, text_bytes, words_of, written
from .components import components

ROWS, BANDS = 4, 32
PLACES = ROWS * BANDS
#: Members that are drawn of each bucket, besides its central one.
DRAWS = 3
#: 64-bit words of a set's parity bitmap.
WORDS = 8
_STEP = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5))


def _salt(j: int) -> np.uint64:
    return U64(int(_STEP[j % 4]) * (j + 1) & (1 << 64) - 1)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    h, rows, _, _ = words_of(data, off)
    n = len(off) - 1
    count = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    m = max(0, len(h) - k + 1)
    s = np.zeros(m, U64)
    for j in range(k):
        s += mix64(h[j : j + m] + _salt(j))
    s = mix64(s)
    out = []
    for i in range(n):
        c = int(count[i])
        if c >= k:
            out.append(np.unique(s[at[i] : at[i + 1] - k + 1]))
        elif c:
            one = np.full(1, c, U64)
            for j in range(c):
                one = mix64(one + mix64(h[at[i] + j : at[i] + j + 1] + _salt(j)))
            out.append(one)
        else:
            out.append(np.zeros(0, U64))
    return out


def _draw(e: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """For round j: the fractional part of each element's value, and its place among those not yet used."""
    x = mix64(e + U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (x >> U64(11)).astype(np.float64) * 2.0**-53, (mix64(x ^ _STEP[1]) % U64(PLACES - j)).astype(np.int64) + j


def superminhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (rows x PLACES) of non-empty sets; a place's value is its round plus a fraction."""
    n = len(sets)
    sig = np.full((n, PLACES), np.inf)
    flat = sig.reshape(-1)
    e = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    r, place = _draw(e, 0)
    np.minimum.at(flat, row * PLACES + place, r)
    perm = None
    for j in range(1, PLACES):
        open_ = sig.max(axis=1) >= j
        live = open_[row]
        if not live.any():
            break
        if not live.all() or perm is None:
            e, row, place = e[live], row[live], place[live]
            if perm is None:
                perm = np.tile(np.arange(PLACES, dtype=np.uint8), (len(e), 1))
                _swap(perm, 0, place)
            else:
                perm = perm[live]
        r, place = _draw(e, j)
        _swap(perm, j, place)
        np.minimum.at(flat, row * PLACES + perm[:, j], r + j)
    return sig


def _swap(perm: np.ndarray, j: int, place: np.ndarray) -> None:
    i = np.arange(len(perm))
    held = perm[i, place]
    perm[i, place] = perm[:, j]
    perm[:, j] = held


def _sketcher(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            for a, b in row_chunks(off):
                sets = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands = np.zeros((len(sets), BANDS), np.int64)
                digest = [b""] * len(sets)
                bits = np.zeros((len(sets), WORDS), np.int64)
                if full:
                    v = superminhash([sets[i] for i in full]).view(U64).reshape(len(full), BANDS, ROWS)
                    x = np.zeros((len(full), BANDS), U64)
                    for t in range(ROWS):
                        x = mix64(x + v[:, :, t] * _STEP[t % 4])
                    bands[full] = mix64(x + np.arange(BANDS, dtype=U64) * _STEP[2]).view(np.int64)
                    for i in full:
                        s = sets[i]
                        odd = np.bincount((mix64(s ^ _STEP[0]) % U64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
                        bits[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                        digest[i] = np.array([mix64(s).sum(dtype=U64), mix64(s ^ _STEP[3]).sum(dtype=U64)], U64).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest, pa.binary()),
                        *(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1), pa.int64())) for x in (bands, bits)),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands", "bits"],
                )

    return sketch


def _verifier(k: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = text_bytes(batch.column("ta")), text_bytes(batch.column("tb"))
            keep = []
            # the left text is often that of the row before: a bucket's smallest member meets each other one
            last: tuple[bytes, np.ndarray] | None = None
            for a, b in row_chunks(oa + ob):
                right = shingle_sets(db[ob[a] : ob[b]], ob[a : b + 1] - ob[a], k)
                for i in range(a, b):
                    raw = da[oa[i] : oa[i + 1]]
                    key = raw.tobytes()
                    if last is None or last[0] != key:
                        last = (key, shingle_sets(raw, np.array([0, len(raw)]), k)[0])
                    x, y = last[1], right[i - a]
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(mask)

    return verify


def _exploder(k: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            for a, b in row_chunks(off):
                sets = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)
                size = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], size)), pa.array(np.repeat(n[a:b], size)), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "n", "token"])

    return explode


def _need(n: Column, m: Column, percent: int) -> Column:
    """Least number of shared elements with which sets of n and m elements reach the similarity."""
    return F.ceil((percent * (n + m)) / F.lit(100 + percent))


def _size_class(n: Column) -> Column:
    """Sets whose sizes differ by two in a hundred at most share a class, or stand in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(1.02)).cast("int")


def prefix_groups(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, n, key, p): each document of ``rows`` (doc_id, n, text) under its rarest shingles, by frequency in ``rows``.

    p is the shingle's place in that order, from 1. Two sets whose similarity is ``percent`` or more share a key.
    Keys of one document only are left out. A document in several rows counts once.
    """
    tokens = written(rows.select("doc_id", "n", "text").mapInArrow(_exploder(k), "node long, n long, token long").distinct(), "tokens")
    # shingles of one document need no row here, and a table apart lets the join split hot shingles
    shared = written(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    w = Window.partitionBy("node").orderBy("df", "token")
    ranked = tokens.join(small(shared), "token", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("p", F.row_number().over(w))
    out = written(ranked.filter((F.col("df") > 1) & (F.col("p") <= F.col("n") - F.ceil(percent * F.col("n") / F.lit(100)) + 1)).select("node", "n", F.col("token").alias("key"), "p"), "groups")
    discard(tokens)
    return out


def prefix_meetings(groups: DataFrame, percent: int, bits: DataFrame | None = None) -> DataFrame:
    """Distinct (a, b), a < b, of different components that may be similar, from ``groups`` (node, n, key, p, c).

    Of a pair, the smaller set x (n elements) and the larger y (m) must share an element whose places leave room for
    the shared elements that the similarity needs: n - p + 1 and m - q + 1 are at least need(n, m). So x is filed
    under its first n - need(n, n) + 1 keys, by the class of its size, and y looks in each class that its place q
    still allows. In a family of documents that share a template and differ in more than the similarity allows, the
    first places are their own shingles, and they do not meet. Within a key, only what is outside the component
    with most seats is compared with the others. ``bits`` (node, bits) are the bitmaps; with them a pair that they rule
    out is never made.
    """
    n, p = F.col("n"), F.col("p")
    filed = groups.filter(p <= n - _need(n, n, percent) + 1).withColumn("cls", _size_class(n)).withColumn("looks", F.lit(False))
    low = F.ceil(percent * n / F.lit(100))
    high = F.least(n, F.floor((100 + percent) * (n - p + 1) / F.lit(percent)) - n)
    looks = groups.filter(high >= low).withColumn("cls", F.explode(F.sequence(_size_class(low), _size_class(high)))).withColumn("looks", F.lit(True))
    seats = written(looks.join(small(written(filed.select("key", "cls").distinct(), "shelves")), ["key", "cls"], "left_semi").unionByName(filed), "seats")
    taken = seats.groupBy("key", "cls", "c").agg(F.count("*").alias("s"))
    busy = written(taken.groupBy("key", "cls").agg(F.max_by("c", F.struct("s", "c")).alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k"), "busy")
    contested = seats.join(small(busy), ["key", "cls"])
    if bits is not None:
        contested = contested.join(bits, "node")
    contested = written(contested, "contested")
    carried = [x for x in contested.columns if x not in ("key", "cls", "main")]
    minor = written(contested.filter("c <> main").select("key", "cls", *[F.col(x).alias(f"{x}2") for x in carried]), "minor")
    room = (F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) + 1 >= _need(F.col("n"), F.col("n2"), percent)) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    if bits is not None:
        room &= _may_link("bits", "bits2", F.col("n") + F.col("n2"), percent)
    met = contested.join(small(minor), ["key", "cls"]).filter((F.col("looks") != F.col("looks2")) & (F.col("c") != F.col("c2")) & room)
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _buckets(classes: DataFrame) -> DataFrame:
    """(node, n, key, crowd): the classes by the bands that they share with others; crowd counts whom a class meets."""
    banded = written(classes.select("node", "n", F.explode("bands").alias("key")), "banded")
    shared = written(banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    seats = written(banded.join(small(shared), "key"), "seats")
    discard(banded)
    crowd = written(seats.groupBy("node").agg(F.sum("c").alias("crowd")), "crowd")
    return written(seats.drop("c").join(small(crowd), "node"), "buckets")


def _drawn(buckets: DataFrame) -> DataFrame:
    """(key, drawn, size): of each bucket its central member and the first by a hash, and how many members it has.

    Both orders are the same in all buckets, so members that share many of them meet the same few others.
    """
    h, one = F.xxhash64("node"), F.struct(F.col("node").alias("other"), F.col("n").alias("m"))
    drawn = F.array_distinct(F.array(F.max_by(one, F.struct("crowd", h)), F.min_by(one, h)))
    return written(buckets.groupBy("key").agg(drawn.alias("drawn"), F.count("*").alias("size")), "drawn")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * shared shingles >= ``percent`` * shingles of either; component_id is the
    smallest doc_id that links reach. Empty and null texts have no shingles and stay alone. A row without a
    doc_id is not linked: its component_id is null and it is kept. Repeated rows share a component; rows that
    share a doc_id are one document, so each of them is kept if the document is.
    """
    sketch = written(docs.select("doc_id", "text").mapInArrow(_sketcher(k), "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"), "sketch")
    usable = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes")
    buckets = _buckets(classes)
    texts = docs.select("doc_id", "text")
    drawn = small(_drawn(buckets))
    met = buckets.join(drawn, "key").select("node", "n", F.inline("drawn"))
    links = _verified(_bounded(_ordered(met, percent), classes, percent), texts, k, percent)
    label = small(written(components(links), "label"))
    known = buckets.join(label, "node", "left").withColumn("c", F.coalesce("component", "node"))
    mixed = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    # where all members but one are drawn, each pair has met
    mixed = written(mixed.join(drawn, "key").filter(F.col("size") > F.size("drawn") + 1).select("key"), "mixed")
    open_ = written(known.join(small(mixed), "key", "left_semi").select(F.col("node").alias("doc_id"), "n").distinct(), "open")
    if not open_.isEmpty():
        groups = prefix_groups(texts.join(small(open_), "doc_id"), k, percent).join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).select("node", "n", "key", "p", "c")
        pairs = prefix_meetings(written(groups, "members"), percent, classes.select("node", "bits"))
        links = links.union(_verified(pairs, texts, k, percent))
        label = small(written(components(links), "label"))
    member = classes.join(label, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    linked = usable.select("doc_id", "n_shingles", "digest").join(member, "digest").select("doc_id", "n_shingles", "component_id")
    alone = sketch.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _may_link(bits: str, other: str, sizes: Column, percent: int) -> Column:
    """Whether the bitmaps leave room for the similarity: differing elements <= (100 - percent) / (100 + percent) of both sizes."""
    differ = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other)[i])) for i in range(WORDS)])
    return differ * (100 + percent) <= sizes * (100 - percent)


def _ordered(met: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of (node, n, other, m) whose sizes allow the similarity."""
    fits = met.filter(f"node <> other AND 100 * least(n, m) >= {percent} * greatest(n, m)")
    return fits.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose bitmaps in ``classes`` leave room for the similarity."""
    for c in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}")), c)
    return pairs.filter(_may_link("bits_a", "bits_b", F.col("n_a") + F.col("n_b"), percent)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among ``pairs``, confirmed on the full sets of both texts."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    t = written(texts.join(small(ids), "doc_id", "left_semi"), "texts")
    one = pairs.join(t.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    two = one.join(t.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    found = written(two.select("a", "b", "ta", "tb").mapInArrow(_verifier(k, percent), "a long, b long"), "links")
    for x in (pairs, ids, t):
        discard(x)
    return found


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


ORACLE_OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) c ON c.a = s.doc_id
"""
