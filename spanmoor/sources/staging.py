"""Tables written once between two steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def stage(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet under ``spark.checkpoint.dir``, the folder that
    executors share, and reads it back. Where that is unset, a temporary folder
    takes its place on a single machine; on a cluster that is an error."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master or 'the cluster'} share")
        folder = "file://" + tempfile.mkdtemp(prefix="spanmoor-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if hasattr(spark, "_jvm"):  # the files go when the driver ends
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
