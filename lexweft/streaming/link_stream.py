"""Linking of a stream of documents (ours; the batch operators do the work).

Linking needs one document at a time, so a stream is linked micro-batch by micro-batch against the static
terminology; a repeated batch overwrites its own output, which makes the sink idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.config import LinkConfig
from ..plans.link import link_text

DOCUMENTS = "doc_id long, title string, text string"


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON documents that arrive in a directory."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def link_stream(docs: DataFrame, entities: DataFrame, path: str, checkpoint: str, config: LinkConfig = LinkConfig(), then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write link results under ``path``/batch=<n>; ``then`` sees each batch's result."""

    def one(batch: DataFrame, n: int) -> None:
        out = link_text(batch, entities, config)["result"]
        out.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if then:
            then(out.sparkSession.read.parquet(f"{path}/batch={n}"), n)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
