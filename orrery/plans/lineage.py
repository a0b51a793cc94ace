"""Cutting lineage of iterative plans in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir and all executors share.

    Only a session whose executors are threads of the driver may do without one; it gets a
    temporary folder. Elsewhere the executors would not see the driver's folder, so this raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="orrery-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder and read again.

    It survives lost executors, and carries none of the lineage, constraints and
    orderings that a checkpointed plan keeps, which multiply in iterative joins.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/orrery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
