"""Intermediate results that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df checkpointed to the folder in spark.checkpoint.dir, which cuts its lineage; a local session without one gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not given and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="tickloom-"))
    return df.checkpoint(eager=True)
