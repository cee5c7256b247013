"""Tables that are built once a run, written to the shared folder, and read from there by all that use them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: (application, name, what it was built from) -> path.
_built: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may do without; then a temporary folder is made the checkpoint folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df's rows, written to the shared folder in one job and read from there: its lineage ends."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table called name, built from source: written at first use, then read; filters and columns are pushed to its files."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _built:
        path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _built[key] = path
    return spark.read.parquet(_built[key])
