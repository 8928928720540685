"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/siftmill-{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the cluster's shared folder; a session without one, on a local
    master, gets its own."""
    _folder(df)
    return df.checkpoint()


def filed(df: DataFrame) -> DataFrame:
    """As ``cut``, in files that are read back. A checkpoint keeps the size that was estimated for its
    plan, and a join's estimate is the product of its sides': over rounds of joins these
    numbers double their digits again and again, until they fill the driver. A file has its own size."""
    spark = df.sparkSession
    path = f"{_folder(df)}/siftmill/filed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
