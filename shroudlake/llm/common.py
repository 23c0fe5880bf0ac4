"""Shared helpers: table access, durable intermediate tables, and byte-level text maths on Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the 64-bit hashes, and ASCII white space.
MUL_A = np.uint64(0x9E3779B97F4A7C15)
MUL_B = np.uint64(0xC2B2AE3D27D4EB4F)
BASE = np.uint64(0x100000001B3)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Bytes of text that one numpy step works on; longer texts are taken alone, whole.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. In local mode, where all is one machine, one of our own if it is unset; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shroudlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a written folder removed when the application ends; results read it until then."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of numbers that are broadcast at most: some 20 MB.
FEW = 500_000


def sized(df: DataFrame, name: str, most: int = FEW) -> DataFrame:
    """df written to the shared folder and counted: marked for broadcast if it has at most ``most`` rows, else joined by exchange."""
    written = durable(df, name)
    return F.broadcast(written) if written.count() <= most else written


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches of whole texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """All labelled documents (doc_id, y); conflicting labels of an id count once, as the larger."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def sample_labels(labels: DataFrame, label: str, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` of labelled(), the first by a hash of the id."""
    return labelled(labels, label).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)


def trim() -> None:
    """Gives memory that is not in use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives the memory it took back when its partition is done; workers are used again."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return done


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans_of(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, or one document alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


_pow = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        grown = np.full(max(n, 2 * len(_pow)), BASE, np.uint64)
        grown[0] = 1
        _pow = np.cumprod(grown, dtype=np.uint64)
    return _pow[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MUL_A
    h = (h ^ (h >> np.uint64(29))) * MUL_B
    return h ^ (h >> np.uint64(32))


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def ascii_lower(b: np.ndarray) -> np.ndarray:
    return _lower[b]


def byte_class(members: list[int] | tuple[int, ...]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


WHITE = byte_class(SPACES)
#: Everything in ASCII that is neither a letter nor a digit.
NON_ALNUM = byte_class([c for c in range(128) if not chr(c).isalnum()])


def words(b: np.ndarray, off: np.ndarray, sep: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of bytes outside ``sep``; runs end where documents end."""
    n = b.size
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = sep[b]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    start = np.flatnonzero(~gap & (before | first[:n]))
    end = np.flatnonzero(~gap & (after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def run_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each run b[start:end]; runs are in order and apart."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    pos = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    at = pos + np.repeat(start, length)
    val = (b[at].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[pos]
    return mix(np.add.reduceat(val, np.cumsum(length) - length))


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(a * MUL_B + (b ^ np.uint64(salt * 0x9E3779B1 + 1)))


#: DuckDB SQL: a CTE crc(tab) with the checksum's 256 entries, made by its rule.
SQL_CRC = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS tab)"


def sql_crc(text: str) -> str:
    """The checksum of a text's UTF-8 bytes, where crc(tab) is joined."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::UBIGINT)"
    return f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, {data}), lambda a, b: xor(a >> 8, tab[((xor(a, b)) & 255)::BIGINT + 1])))"
