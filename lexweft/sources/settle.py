"""Cutting lineage, and the checked size below which a table is sent to every executor."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow table is broadcast.
BROADCAST_ROWS = 500_000


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into ``spark.checkpoint.dir``, which survives lost executors; later plans read it from there.

    Where the folder is unset, a session whose executors are threads of the driver gets a local one; any other is an
    error.
    """
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexweft-"))
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count finds ``BROADCAST_ROWS`` rows at most; else the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
