"""Keyed upserts of micro-batches into a partitioned Parquet table, and static tables as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import shared_folder
from .loops import STORE

#: Partitions of an upserted table: a batch rewrites those that its keys fall into.
BUCKETS = 16


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def merged(rows: DataFrame, keys: Sequence[str], order: str, keep: str) -> DataFrame:
    """One row for each key: the last by order, or the first; of equal ones the one of the earlier batch."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    rank: Column = F.struct(F.col(order), -F.col("batch")) if keep == "last" else F.struct(F.col(order), F.col("batch"))
    pick = F.max_by(rest, rank) if keep == "last" else F.min_by(rest, rank)
    return rows.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def upserts(path: str, schema: StructType, keys: Sequence[str], order: str, keep: str = "last", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: merges each batch into the table at path, which has the schema's columns, bucket (its partition) and batch (that wrote a row).

    Only the buckets of the batch's keys are read and written again, each as a whole. A batch that is delivered twice, or again after it failed half way, changes nothing more: rows are picked by order
    alone. Rows with a null order come first. The table does not grow but by new keys.
    """
    stored = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", batch long, bucket int"

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = batch.select(*[F.col(f.name).cast(f.dataType) for f in schema]).withColumns({"batch": F.lit(batch_id).cast("long"), "bucket": bucket})
        held = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
        merged(new, [*keys, "bucket"], order, keep).write.parquet(held)  # at most a row for each key of the batch
        new = spark.read.parquet(held)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # buckets at most
        if not touched:
            return
        rows = new.select(*[c.split(" ")[0].strip("`") for c in stored.split(", ")])
        if exists(spark, path):
            rows = spark.read.schema(stored).parquet(path).where(F.col("bucket").isin(touched)).unionByName(rows)
        after = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
        merged(rows, [*keys, "bucket"], order, keep).write.partitionBy("bucket").parquet(after)  # a table is not read while it is written
        spark.read.parquet(after).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in (held, after):
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)

    return put


def replayed(df: DataFrame, by: str, slices: int = 4) -> DataFrame:
    """A static table as a stream in the order of a column: slices of it are written one after another, and each micro-batch takes the files of about one slice.

    Rows without a value come with the first slice. Slices are ranges of equal width between the least and the largest value.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    x = (F.col(by).cast("timestamp") if df.schema[by].dataType.typeName().startswith("timestamp") else F.col(by)).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    width = ((high or 0) - (low or 0)) / slices or 1.0
    part = F.coalesce(F.least(F.floor((x - F.lit(low or 0.0)) / F.lit(width)), F.lit(slices - 1)), F.lit(0))
    for k in range(slices):
        df.where(part == k).write.mode("append").parquet(path)  # the source takes files by age
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // slices))).parquet(path)


def drained(stream: DataFrame, name: str, put: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> DataFrame | None:
    """Runs a stream over all that its source has now: into put(), or else into a table in the shared folder, which is returned."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{path}-state")
    query = (writer.foreachBatch(put) if put else writer.format("parquet").option("path", path).outputMode("append")).start()
    query.awaitTermination()
    return None if put else spark.read.schema(stream.schema).parquet(path)


def with_state(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set(*STORE)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        if (value := spark.conf.get(key, None)) is not None and own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own
