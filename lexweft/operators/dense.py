"""Dense retrieval around a pluggable encoder: index building, search, scores of given candidates.

The encoder is loaded once a worker and maps a list of texts to a float matrix; rows are scaled to unit length. The
built-in one hashes character trigrams, needs no model and stands in for tests.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import dot
from .retrieve import dense_topk, merge_models

Encoder = Callable[[list[str]], np.ndarray]
#: Texts that go through the encoder at a time.
BATCH = 256


def hashed_trigrams(width: int = 64) -> Callable[[], Encoder]:
    """A loader of the built-in encoder: signed counts of hashed character trigrams."""

    def load() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width), np.float32)
            for i, t in enumerate(texts):
                t = f"  {t.lower()} "
                for j in range(len(t) - 2):
                    h = zlib.crc32(t[j : j + 3].encode())
                    out[i, h % width] += 1 if h >> 31 else -1
            return out

        return encode

    return load


def encode(rows: DataFrame, text: str, load: Callable[[], Encoder]) -> DataFrame:
    """``rows`` with a unit vector ``embedding`` of the column ``text``; a null text is encoded as empty."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            parts = [np.asarray(model(texts[i : i + BATCH]), np.float32) for i in range(0, len(texts), BATCH)]
            m = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*names, "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, embedding array<float>")


def index_labels(entities: DataFrame, most_synonyms: int = 10) -> DataFrame:
    """(entity_id, label, label_ord): the preferred label and the first synonyms that differ from it."""
    other = F.slice(F.filter("synonyms", lambda s: F.lower(s) != F.lower("preferred_label")), 1, most_synonyms)
    return entities.select("entity_id", F.posexplode(F.concat(F.array("preferred_label"), other)).alias("label_ord", "label")).select("entity_id", "label", F.col("label_ord").cast("long").alias("label_ord"))


def build_index(entities: DataFrame, load: Callable[[], Encoder], most_synonyms: int = 10) -> DataFrame:
    """(entity_id, label, label_ord, embedding) of every label; write it as Parquet under the model's name."""
    return encode(index_labels(entities, most_synonyms), "label", load)


def retrieve(mentions: DataFrame, index: DataFrame, load: Callable[[], Encoder], k: int = 10) -> DataFrame:
    """(query, entity_id, score, rank) of (query, mention) against an index with numeric entity ids."""
    return dense_topk(encode(mentions.select("query", "mention"), "mention", load), index, k)


def retrieve_with(models: dict[str, tuple[DataFrame, Callable[[], Encoder]]], mentions: DataFrame, k: int = 10) -> DataFrame:
    """Union over several models: best and mean score of each entity."""
    return merge_models([retrieve(mentions, index, load, k).select("query", "entity_id", "score") for index, load in models.values()])


def score_candidates(candidates: DataFrame, load: Callable[[], Encoder]) -> DataFrame:
    """``candidates`` with ``dense``: 100 times the cosine of mention and preferred label. Texts are encoded once."""
    texts = candidates.select(F.col("mention").alias("text")).union(candidates.select("preferred_label")).distinct()
    vectors = encode(texts, "text", load)
    side = lambda c, e: vectors.select(F.col("text").alias(c), F.col("embedding").alias(e))
    both = candidates.join(side("mention", "__m"), "mention").join(side("preferred_label", "__p"), "preferred_label")
    return both.withColumn("dense", F.lit(100.0) * dot(F.col("__m"), F.col("__p"))).drop("__m", "__p")
