"""Tables written once: in the folder that driver and executors share, so a lost executor costs no earlier stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a local master uses a folder of its own and any other master is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        folder = _OWN[app]
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back; its lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/tidewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
