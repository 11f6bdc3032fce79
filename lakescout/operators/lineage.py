"""Cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows as a checkpoint: written once, safe from lost executors, and the start of a short plan.

    Where ``spark.checkpoint.dir`` is unset, a local session (tests) gets a temporary folder; on a cluster that is an
    error. ``partitions`` is for tables of the catalogue, whose rows are columns of the lake.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return (df if partitions is None else df.coalesce(partitions)).checkpoint(eager=True)
