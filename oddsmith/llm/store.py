"""Tables and files that a job keeps in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: its lineage ends there, and a lost executor costs no recomputation."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def crc_fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: 2 marks the rows that are held out from learning."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4
