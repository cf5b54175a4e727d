"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text: shift left by one and add a random number for the byte. A byte ends a
chunk where the top bits of the hash are zero and no other such byte lies within ``MIN_BYTES`` before it; runs
without one are cut every ``MAX_BYTES``. Cuts depend on the last ``WINDOW`` bytes only, so an insertion shifts
chunks but leaves those behind it alike. Chunks are compared by a 64-bit digest, with A-Z lower-cased and white
space runs as one space; a digest is repeated if it stands in several documents, or at several places of one. A run of
repeated chunks is a repeated passage. ``least_words`` says how long the passages are that are sought: shorter runs are
chance or set phrases; 0 returns them all. The chunks at both ends are cut within the passage, so the limit of the
registered query lies below the 50 words that it is meant for. A false match of two 64-bit digests adds a chunk to a
run at most, since a passage needs several in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, LOWER, U64, Words, mix64, row_chunks, table, text_bytes, written

WINDOW = 8
MASK_BITS = 4
MIN_BYTES = 12
MAX_BYTES = 64
#: Words that a run of repeated chunks needs to count as a passage: those of 50 words less a chunk at either end.
LEAST_WORDS = 28
#: Gear numbers: one of 16 bits for each byte value, from a fixed rule.
GEAR = (mix64(np.arange(256, dtype=U64) + U64(0x51ED270B)) >> U64(48)).astype(np.uint32)


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased and one space after each word, row offsets, place of each kept byte in the source)."""
    space = SPACES[data]
    keep = ~space
    if len(data):
        after = np.zeros(len(data), bool)
        after[1:] = space[1:] & ~space[:-1]
        inner = off[:-1][(off[:-1] < len(data))]
        after[inner] = False
        keep |= after
    src = np.flatnonzero(keep)
    out = np.where(space[src], np.uint8(32), LOWER[data[src]])
    return out, np.searchsorted(src, off), src


def cut_points(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all rows, in order; the last chunk of a row ends with the row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = GEAR[data]
    for s in (1, 2, 4):  # doubling: after each step the hash covers twice as many bytes
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    hit = np.flatnonzero(((h >> np.uint32(WINDOW - MASK_BITS)) & np.uint32((1 << MASK_BITS) - 1)) == 0) + 1
    # bytes of the row before, or fewer than WINDOW bytes, decide nothing
    row = np.searchsorted(off, hit - 1, "right") - 1
    hit = hit[hit - off[row] >= WINDOW]
    if len(hit):
        hit = hit[np.concatenate([[True], np.diff(hit) >= MIN_BYTES])]
    ends = np.unique(np.concatenate([hit, off[1:][off[1:] > off[:-1]]]))
    starts = np.concatenate([[0], ends[:-1]])
    more = (ends - starts - 1) // MAX_BYTES
    at = np.repeat(starts, more) + MAX_BYTES * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    return np.unique(np.concatenate([ends, at]))


def chunk_rows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, row, words, start and end in the source) of each chunk; a chunk counts the words that start in it."""
    text, roff, src = normalised(data, off)
    ends = cut_points(text, roff)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    w = Words(text, roff, np.zeros(256, bool), np.arange(256, dtype=np.uint8))
    w.starts, w.ends = starts, ends
    digest = w.hashes()
    begin = np.zeros(len(text) + 1, np.int64)
    if len(text):
        first = text != 32
        first[1:] &= text[:-1] == 32
        first[roff[:-1][roff[:-1] < roff[1:]]] = text[roff[:-1][roff[:-1] < roff[1:]]] != 32
        np.cumsum(first, out=begin[1:])
    row = np.searchsorted(roff, starts, "right") - 1
    return digest, row, begin[ends] - begin[starts], src[starts] if len(starts) else starts, src[ends - 1] + 1 if len(ends) else ends


def places_in_row(row: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """For each chunk 0 if its row has the digest once, 1 at the first of several places, 2 at the later ones."""
    out = np.zeros(len(row), np.int8)
    if len(row):
        order = np.lexsort((np.arange(len(row)), digest, row))
        same = (row[order][1:] == row[order][:-1]) & (digest[order][1:] == digest[order][:-1])
        out[order[:-1][same]] = 1
        out[order[1:][same]] = 2
    return out


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        ids, keys = batch.column("doc_id"), batch.column("k").to_numpy()
        for a, b in row_chunks(off):
            base = off[a : b + 1] - off[a]
            digest, row, words, start, end = chunk_rows(data[off[a] : off[b]], base)
            seq = np.arange(len(row)) - np.searchsorted(row, row)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row + a)), pa.array(keys[row + a]), pa.array(seq.astype(np.int32)), pa.array(digest.view(np.int64)), pa.array(words.astype(np.int32)), pa.array((start - base[row]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(places_in_row(row, digest))],
                names=["doc_id", "k", "seq", "digest", "words", "start", "size", "place"],
            )


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages that repeat: doc_id, start, stop (bytes of the UTF-8 text), n_words, run_words, first_doc, kept.

    first_doc is the smallest doc_id that holds the passage's chunks. kept says whether this is the first place in that
    document, so that a filter on it leaves one copy of each chunk, whether it repeats in other documents or in
    the same. A run of repeated chunks with ``least_words`` or more (run_words) is reported in parts where first_doc or
    kept changes; n_words counts the part.
    Rows without a doc_id, and null and empty texts, have no passages; repeated rows count as one document and
    give their passages once. Rows that share a doc_id but not the text are texts of one document: what only they
    share is no repeat, and kept holds for each of them.
    """
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("k"))
    c = written(rows.mapInArrow(_chunker, "doc_id long, k long, seq int, digest long, words int, start int, size int, place tinyint"), "chunks")
    seen = c.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max("place").alias("inner")).filter("first_doc <> last_doc OR inner > 0").select("digest", "first_doc")
    # a table apart, so that the join can split hot digests
    twice = c.join(written(seen, "seen"), "digest").select("doc_id", "k", "seq", "words", "start", "size", "first_doc", ((F.col("doc_id") == F.col("first_doc")) & (F.col("place") < 2)).alias("kept"))
    twice = twice.repartition("doc_id", "k").dropDuplicates(["doc_id", "k", "seq"])
    # consecutive chunks of one document share seq - rank; a part of a run ends where its owner changes
    order = Window.partitionBy("doc_id", "k").orderBy("seq")
    whole = Window.partitionBy("doc_id", "k", "run")
    owner = F.struct("first_doc", "kept")
    turn = F.coalesce(F.lag(owner).over(order) != owner, F.lit(True)).cast("int")
    out = (
        twice.withColumns({"run": F.col("seq") - F.row_number().over(order), "turn": turn})
        .withColumn("part", F.sum("turn").over(order))
        .groupBy("doc_id", "k", "run", "part")
        .agg(F.min("start").cast("long").alias("start"), F.max(F.col("start") + F.col("size")).cast("long").alias("stop"), F.sum("words").alias("n_words"), F.first("first_doc").alias("first_doc"), F.first("kept").alias("kept"))
        .withColumn("run_words", F.sum("n_words").over(whole))
        .filter(F.col("run_words") >= least_words)
    )
    return out.select("doc_id", "start", "stop", "n_words", "run_words", "first_doc", "kept")


def op3(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
