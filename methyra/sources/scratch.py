"""A place for tables between steps: the shared checkpoint folder of the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="methyra-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/methyra-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again: it is worked out once, and a lost executor costs a re-read."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
