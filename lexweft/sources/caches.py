"""Built tables kept as Parquet: a table is rebuilt if it is missing, or if its key says that its inputs changed."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: str = "") -> DataFrame:
    """The table under ``path`` for ``key`` (a model's name, a list of vocabularies, a source's time), built if need be."""
    at = f"{path}/{hashlib.md5(key.encode()).hexdigest()[:12]}"
    if not exists(spark, f"{at}/_SUCCESS"):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def source_key(spark: SparkSession, *paths: str) -> str:
    """A key for ``cached`` that changes with the time or size of the inputs."""
    parts = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        parts.append(f"{path}:{status.getModificationTime()}:{status.getLen()}")
    return "|".join(parts)


def raw_copy(spark: SparkSession, path: str, fetch: Callable[[], str]) -> DataFrame:
    """(value): a fetched text as it came, kept under ``path`` and fetched only if it is not there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(fetch(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.option("wholetext", True).text(path)


def save_synonyms(names: DataFrame, path: str) -> None:
    """Write (entity_id, name) as JSON lines of an id and its sorted names, as ``load_synonyms`` reads them."""
    names.groupBy("entity_id").agg(F.sort_array(F.collect_set("name")).alias("names")).write.mode("overwrite").json(path)


def load_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, name) of ``save_synonyms``."""
    return spark.read.schema("entity_id string, names array<string>").json(path).select("entity_id", F.explode("names").alias("name"))


def requests(spark: SparkSession, items: list[str | dict]) -> DataFrame:
    """(mention_id, mention, entity_type) of a request body: strings, or objects with text and entity_type."""
    rows = [(i, x, None) if isinstance(x, str) else (i, x.get("text"), x.get("entity_type")) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "mention_id long, mention string, entity_type string")


def response(candidates: DataFrame, most: int = 20, trees: int = 3) -> DataFrame:
    """(mention_id, json): the first candidates of each mention, scores with two decimals."""
    c = candidates.filter(F.col("rank") <= most).select("mention_id", F.struct("rank", "entity_id", "preferred_label", F.bround("score", 2).alias("score"), F.slice("tree_numbers", 1, trees).alias("tree_numbers")).alias("c"))
    return c.groupBy("mention_id").agg(F.to_json(F.array_sort(F.collect_list("c"))).alias("json"))


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of PDF files; needs PyMuPDF or pdfplumber on the workers, else text is null."""

    def text(data: bytes) -> str | None:
        try:
            import fitz

            with fitz.open(stream=data, filetype="pdf") as doc:
                return "\n".join(page.get_text() for page in doc).strip()
        except ImportError:
            pass
        try:
            import pdfplumber

            with pdfplumber.open(io.BytesIO(data)) as doc:
                return "\n".join(page.extract_text() or "" for page in doc.pages).strip()
        except ImportError:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": f["content"].map(text)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")
