"""Reassembly of a transaction log: what becomes of each change, and the store after every epoch.

A log has rows (pos, tx, kind, key, crc): tx names one stream of successive transactions, kind is one of the numbers below, and a change has the key it writes and the
checksum of what it writes, null where it deletes the key. A change is undone by the next rollback of its own level, that is with no savepoint and no end of the transaction
between; else the transaction's end decides. Commits apply changes to one shared store in the order of the commits.

The log is cut into blocks: ranges of positions, as many as the session has shuffle partitions, so a stream that holds a third of the log is dealt out over all blocks. A shard has whole
(stream, block) groups, and DuckDB works on it inside the task: a change is ASOF-joined with the next rollback of equal level and with the next end. What a block's last
changes need of later blocks are two rows, the next marker and the next end of their stream, found from one summary row for each stream and block and added to the shard. Commits
are numbered block by block, from the blocks' counts.

Versions of a key are thinned out to the last of each epoch before they are exchanged; key shards of (key, range of epochs) ASOF-join each version with the previous one, which the summary of
earlier ranges adds where it lies before the range, and give the epoch's change of count and sum. Running totals over epochs go by ranges of epochs likewise.
So no task holds more than a block of a stream, and only figures of blocks, as many as there are shuffle partitions, are joined by broadcast.

Defined cases: rows with a null doc_id have no place in the log and are left out. Rows of one doc_id are one after another by source, then deletions first, then by checksum; they
are of one kind, so nothing of their stream lies between. A null text deletes, an empty one is stored. Labels of an id that conflict delete if one is 1; without labels nothing is toxic. A null source is
a stream of its own, unlike an empty one. A log without commits has no epochs; an empty one gives no rows. Other columns are ignored; texts of any length are reduced to checksums in the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SQL_CRC, durable, sql_crc, tidy

CHANGE, SAVEPOINT, ROLLBACK, COMMIT, ABORT = range(5)
#: Commits of an epoch, and keys that documents write to.
EPOCH, KEYS = 64, 30_000
#: What DuckDB may hold of a shard in memory; it writes nothing to disk.
SHARD_MEMORY = "700MB"

#: Of a shard log(tx, block, pos, kind, key, crc, rank, carried): each change with the rollback or the end that decides on it.
FATES = f"""
WITH l AS (SELECT *, count(*) FILTER (WHERE kind IN ({SAVEPOINT}, {COMMIT}, {ABORT})) OVER (PARTITION BY tx, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM log),
c AS (SELECT * FROM l WHERE kind = {CHANGE}),
r AS (SELECT DISTINCT tx, block, level, pos FROM l WHERE kind = {ROLLBACK}),
e AS (SELECT tx, block, pos, any_value(kind) AS kind, min(rank) AS rank FROM l WHERE kind IN ({COMMIT}, {ABORT}) GROUP BY tx, block, pos)
SELECT c.pos, c.key, c.crc, r.pos AS rolled, e.pos AS ended, e.rank AS rank
FROM c ASOF LEFT JOIN r ON c.tx = r.tx AND c.block = r.block AND c.level = r.level AND c.pos < r.pos
ASOF LEFT JOIN e ON c.tx = e.tx AND c.block = e.block AND c.pos < e.pos
"""
#: Of a shard log(key, part, epoch, there, crc, carried): what each epoch adds to the count and the sum.
DELTAS = """
SELECT v.epoch, CAST(sum(v.there - coalesce(p.there, 0)) AS BIGINT) AS n, CAST(sum(v.crc - coalesce(p.crc, 0)) AS BIGINT) AS value
FROM (SELECT * FROM log WHERE NOT carried) v ASOF LEFT JOIN log p ON v.key = p.key AND v.part = p.part AND v.epoch > p.epoch GROUP BY v.epoch
"""


def document_log(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The log that documents(doc_id, text, source) and labels(doc_id, toxic) stand for."""
    h = F.crc32(F.col("pos").cast("string").cast("binary"))
    r = F.col("h") % 17
    kind = F.when(r <= 1, COMMIT).when(r == 2, ABORT).when(r <= 4, SAVEPOINT).when(r <= 6, ROLLBACK).otherwise(CHANGE)
    change = F.col("kind") == CHANGE
    rows = docs.select(F.col("doc_id").cast("long").alias("pos"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tx"), "text").where("pos is not null")
    rows = rows.withColumn("h", h).withColumn("kind", kind.cast("int")).withColumn("key", F.when(change, F.floor(F.col("h") / 100).cast("long") % KEYS))
    rows = rows.select("pos", "tx", "kind", "key", F.when(change, F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("text").cast("string")).cast("binary"))).alias("crc"))
    toxic = labels.where(F.col("toxic") == 1).select(F.col("doc_id").cast("long").alias("_t")).where("_t is not null").distinct()
    return rows.join(toxic.hint("merge"), F.col("pos") == F.col("_t"), "left").withColumn("crc", F.when(F.col("_t").isNull(), F.col("crc"))).drop("_t")


def blocks_of(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_duckdb(sql: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A statement over the shard that a task holds, as the view log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        con = duckdb.connect(config={"threads": "1", "memory_limit": SHARD_MEMORY, "temp_directory": ""})
        try:
            con.register("log", pa.Table.from_batches(held))
            yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=10_000)
        finally:
            con.close()

    return tidy(run)


def totals_before(counts: DataFrame, part: str, *names: str) -> DataFrame:
    """counts with the sums of all lower parts in place of its own; it has a row for each block at most."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in names])


def numbered(log: DataFrame) -> DataFrame:
    """log with block, and rank: a commit's number among all commits, from 1."""
    log = durable(durable(log, "log").repartitionByRange(blocks_of(log), "pos").withColumn("block", F.spark_partition_id()), "log-blocks")
    commits = log.where(F.col("kind") == COMMIT)
    before = totals_before(commits.groupBy("block").agg(F.count("*").alias("before")), "block", "before")
    own = F.row_number().over(Window.partitionBy("block").orderBy("pos", "tx"))
    ranked = commits.withColumn("rank", own.cast("long")).join(F.broadcast(before), "block").withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    rest = log.where(F.col("kind") != COMMIT).withColumn("rank", F.lit(None).cast("long"))
    return durable(rest.unionByName(ranked), "log-numbered")


def fates(log: DataFrame) -> DataFrame:
    """(pos, key, crc, rolled, ended, rank): each change of numbered(log) with the rollback that undoes it, else the end of its transaction, and the number of that end if it is a commit."""
    at = F.struct("pos", "kind", "rank")
    firsts = log.groupBy("tx", "block").agg(F.min(F.when(F.col("kind") != CHANGE, at)).alias("m"), F.min(F.when(F.col("kind").isin(COMMIT, ABORT), at)).alias("e"))
    later = Window.partitionBy("tx").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("tx", "block", F.min("m").over(later).alias("m"), F.min("e").over(later).alias("e"))
    added = firsts.select("tx", "block", F.explode(F.array_distinct(F.array_compact(F.array("m", "e")))).alias("x")).select("tx", "block", "x.*")
    rows = log.unionByName(added, allowMissingColumns=True).repartition(blocks_of(log), "tx", "block")
    return rows.mapInArrow(in_duckdb(FATES), "pos long, key long, crc long, rolled long, ended long, rank long")


def undone(found: DataFrame) -> DataFrame:
    """(kind, pos, by, key): the changes of fates() that a rollback or an abort undoes, and where; by is null at the log's end."""
    rolled = F.col("rolled").isNotNull()
    return found.where(rolled | F.col("rank").isNull()).select(F.when(rolled, "rollback").otherwise("abort").alias("kind"), "pos", F.coalesce("rolled", "ended").alias("by"), "key")


def versions(found: DataFrame, commits_per_epoch: int = EPOCH) -> DataFrame:
    """(key, epoch, rank, pos, there, crc): the last version of each key in each epoch."""
    applied = found.where("rolled is null and rank is not null").withColumn("epoch", F.floor((F.col("rank") - 1) / commits_per_epoch).cast("long") + 1)
    last = applied.groupBy("key", "epoch").agg(F.max(F.struct("rank", "pos", F.col("crc").isNotNull().cast("long").alias("there"), "crc")).alias("v"))
    return last.select("key", "epoch", "v.*")


def store(found: DataFrame) -> DataFrame:
    """(key, pos): the keys that are stored at the log's end, and the change that wrote each."""
    return versions(found).groupBy("key").agg(F.max(F.struct("rank", "pos", "there")).alias("v")).where("v.there = 1").select("key", "v.pos")


def states(last: DataFrame, epochs: int) -> DataFrame:
    """(epoch, n, value): the count of stored keys and the sum of their checksums after each epoch, from versions()."""
    spark, blocks = last.sparkSession, blocks_of(last)
    part: Column = F.floor((F.col("epoch") - 1) * blocks / max(1, epochs)).cast("int")
    rows = durable(last.select("key", part.alias("part"), "epoch", "there", F.coalesce("crc", F.lit(0)).alias("crc"), F.lit(False).alias("carried")), "log-versions")
    ends = rows.groupBy("key", "part").agg(F.max(F.struct("epoch", "there", "crc")).alias("v"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    added = ends.select("key", "part", F.max("v").over(earlier).alias("v")).where("v is not null").select("key", "part", "v.*", F.lit(True).alias("carried"))
    shards = rows.unionByName(added).repartition(blocks, "key", "part")
    deltas = shards.mapInArrow(in_duckdb(DELTAS), "epoch long, n long, value long").groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    every = spark.range(1, epochs + 1).withColumnRenamed("id", "epoch").join(deltas.hint("merge"), "epoch", "left").select("epoch", part.alias("part"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0)).alias("value"))
    every = durable(every, "log-epochs")
    before = totals_before(every.groupBy("part").agg(F.sum("n").alias("n0"), F.sum("value").alias("value0")), "part", "n0", "value0")
    upto = Window.partitionBy("part").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    own = every.select("epoch", "part", F.sum("n").over(upto).alias("n"), F.sum("value").over(upto).alias("value"))
    return own.join(F.broadcast(before), "part").select("epoch", (F.col("n") + F.col("n0")).alias("n"), (F.col("value") + F.col("value0")).alias("value"))


def reassemble(log: DataFrame, commits_per_epoch: int = EPOCH) -> DataFrame:
    """(kind, id, n, value): a row ``state`` for each epoch with the count and the sum of what is stored, and for each change that is undone a row ``rollback`` or ``abort`` with its position, what undoes it, and its key."""
    log = numbered(log)
    found = durable(fates(log), "log-fates")
    commits = log.agg(F.max("rank")).first()[0] or 0
    gone = undone(found).select("kind", F.col("pos").alias("id"), F.col("by").alias("n"), F.col("key").alias("value"))
    kept = states(versions(found, commits_per_epoch), -(-commits // commits_per_epoch))
    return gone.unionByName(kept.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", "value"))


def sql() -> str:
    """reassemble(document_log()) as DuckDB SQL over documents and labels, by windows over whole streams."""
    return f"""
WITH {SQL_CRC},
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
d AS (SELECT doc_id AS pos, coalesce('=' || source, '') AS tx, text, {sql_crc("doc_id::VARCHAR")} AS h FROM documents, crc WHERE doc_id IS NOT NULL),
k AS (SELECT *, CASE WHEN h % 17 <= 1 THEN {COMMIT} WHEN h % 17 = 2 THEN {ABORT} WHEN h % 17 <= 4 THEN {SAVEPOINT} WHEN h % 17 <= 6 THEN {ROLLBACK} ELSE {CHANGE} END AS kind, ((h // 100) % {KEYS})::BIGINT AS key FROM d),
l AS (SELECT k.pos, tx, kind, key, CASE WHEN kind = {CHANGE} AND toxic.doc_id IS NULL AND text IS NOT NULL THEN {sql_crc("key::VARCHAR || ':' || text")}::BIGINT END AS crc FROM crc, k LEFT JOIN toxic ON k.pos = toxic.doc_id),
v AS (SELECT *, count(*) FILTER (WHERE kind IN ({SAVEPOINT}, {COMMIT}, {ABORT})) OVER (PARTITION BY tx ORDER BY pos ROWS UNBOUNDED PRECEDING) AS level, CASE WHEN kind = {COMMIT} THEN row_number() OVER (PARTITION BY kind ORDER BY pos, tx) END AS rank FROM l),
f AS (SELECT *, min(CASE WHEN kind = {ROLLBACK} THEN pos END) OVER (PARTITION BY tx, level ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rolled,
  min(CASE WHEN kind IN ({COMMIT}, {ABORT}) THEN {{'pos': pos, 'rank': rank}} END) OVER (PARTITION BY tx ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ending FROM v),
c AS (SELECT *, ending.pos AS ended, ending.rank AS place FROM f WHERE kind = {CHANGE}),
last AS (SELECT key, (place - 1) // {EPOCH} + 1 AS epoch, max({{'rank': place, 'pos': pos, 'there': (crc IS NOT NULL)::INT, 'crc': coalesce(crc, 0)}}) AS x FROM c WHERE rolled IS NULL AND place IS NOT NULL GROUP BY ALL),
moved AS (SELECT epoch, x.there - coalesce(lag(x.there) OVER w, 0) AS n, x.crc - coalesce(lag(x.crc) OVER w, 0) AS value FROM last WINDOW w AS (PARTITION BY key ORDER BY epoch)),
epochs AS (SELECT unnest(range(1, (max(rank) - 1) // {EPOCH} + 2)) AS epoch FROM v)
SELECT CASE WHEN rolled IS NOT NULL THEN 'rollback' ELSE 'abort' END AS kind, pos AS id, coalesce(rolled, ended) AS n, key AS value FROM c WHERE rolled IS NOT NULL OR place IS NULL
UNION ALL SELECT 'state', epoch, (sum(coalesce(sum(n), 0)) OVER (ORDER BY epoch))::BIGINT, (sum(coalesce(sum(value), 0)) OVER (ORDER BY epoch))::BIGINT FROM epochs LEFT JOIN moved USING (epoch) GROUP BY epoch"""
