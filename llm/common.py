"""Shared plumbing: input tables, materialised intermediates, Arrow batches, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text handled together by numpy code are cut so that a slice holds about this many bytes.
SLICE_BYTES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) takes the warehouse; on a cluster that is an error, as a
    machine's own folder would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes the shuffle files of an execution when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of it.

    Cuts lineage (a lost executor costs no more than the lost tasks), freezes row order dependent
    values such as generated ids, and leaves both sides of a later join as plain exchanges, which
    adaptive execution can split when a key is hot. Deleted by discard(), or when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with _shuffles_dropped(spark):
        df.write.parquet(path, compression=compression)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes materialised tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/llm-" in f:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in the given order as ``name``, from 0: sorted in ranges, whatever their number.

    Each range's rows are numbered where they are; only the ranges' counts reach the driver.
    """
    at = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    part, within = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, rows = 0, []
    for r in at.groupBy(part.alias("_part")).count().orderBy("_part").collect():
        rows.append((r["_part"], before))
        before += r["count"]
    offsets = at.sparkSession.createDataFrame(rows, "_part int, _before long")
    return at.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_before") + within).drop("_at", "_part", "_before")


def parts(df: DataFrame, rows_per_part: int) -> int:
    """A partition count that follows the data: rows / ``rows_per_part``, at least the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_per_part + 1)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows of about ``limit`` text bytes (a longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def flat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by a line feed, and where each starts (one more entry: the end)."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return flat, np.concatenate([[0], np.cumsum(sizes)])


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.array([(0x2545F4914F6CDD1D * (b + 1) ^ ((b + 77) * 0xD6E8FEB86659FD93 >> 7)) & (1 << 64) - 1 for b in range(256)], dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        m = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(flat: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of value(byte) * base**position over [i, j)."""
    up, _ = powers(len(flat) + 1)
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTES[flat] * up[: len(flat)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of flat[start:end] that depends on the bytes and the length alone."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_spans(flat: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes for which ``is_word[byte]`` holds."""
    inside = is_word[flat].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Bytes that are not white space [\x20\x09-\x0D]
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: ASCII letters, digits and every byte of a non-ASCII character
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Lower-cases A-Z alone
ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
