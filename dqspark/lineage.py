"""Where iterative jobs and file-writing helpers keep their intermediate data.

A cluster names a shared folder in ``spark.checkpoint.dir``. Only where that is unset (tests,
a laptop) is a scratch folder made, once per session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; also registers it for ``checkpoint()``."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if current is None:
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            named = tempfile.mkdtemp(prefix="dqspark-")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
