"""Where jobs keep intermediate tables.

On a cluster the session names a shared folder in ``spark.checkpoint.dir``.
Only a local master, where driver and executors share one disk, may fall back
to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; also usable by ``checkpoint()``."""
    sc = spark.sparkContext
    configured = spark.conf.get(_KEY, None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder all executors can reach")
        configured = sc.getCheckpointDir()
        if configured is None:
            configured = tempfile.mkdtemp(prefix="textloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage with a table that outlives any executor, and stops an
    expensive input that a plan reads twice from being computed twice.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
