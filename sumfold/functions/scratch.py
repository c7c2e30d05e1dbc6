"""Cutting the lineage of plans that grow with each round."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed now, once, and kept as a table in the folder that ``spark.checkpoint.dir`` names.

    Where that is unset it is a folder of our own if all tasks run in the driver's process, as in tests, else an error.
    """
    path = f"{shared_dir(df)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(df: DataFrame) -> str:
    """The folder that driver and executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sumfold-"))
    return context.getCheckpointDir().rstrip("/")
