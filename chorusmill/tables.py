"""Written tables that cut lineage: what several results read is computed once, and lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session (tests) that names none gets a folder of this machine."""
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (named.get() if named.isDefined() else None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="chorusmill-run-")
    return _OWN[app]


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """df as a table of its own under the shared folder, read back."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark) + '/chorusmill-run'}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
