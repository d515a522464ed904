"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a single machine where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = getattr(spark, "_lodestream_scratch", None) or tempfile.mkdtemp(prefix="lodestream-")
    spark._lodestream_scratch = base
    return base
