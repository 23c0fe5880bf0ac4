"""Results that later steps read several times, written once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. In local mode, where all is one machine, a folder of our own if it is unset; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shroudlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def paired(left: DataFrame, right: DataFrame, on: Column | list[Column | str] | str, how: str = "inner") -> DataFrame:
    """left.join(right), both by exchange. For tables that grow with the input: the planner takes rows that were made from arrays, or by Python, for as few as they were made from, and would send them through the driver."""
    return left.join(right.hint("merge"), on, how)


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder, so it is made once and its plan ends there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
