"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder of our own only where none is set."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    app = spark.sparkContext.applicationId
    if app not in _own and (named := spark.sparkContext.getCheckpointDir()):
        return named
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
