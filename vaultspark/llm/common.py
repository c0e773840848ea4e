"""Shared plumbing of the training-data operators: tables, held-out folds, Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship

#: Bytes of text that numpy works on at once.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Let Python workers find this package. Batches stay as the session has them (64 MB at most by default); see `slices`."""
    ship(spark)


def slices(batch: pa.RecordBatch, text: int, most: int = 4 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of its string column `text`, so a worker's memory follows bytes, not rows.

    A longer row stands alone; an empty batch gives none.
    """
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(text))
    for a, b in chunks(offsets, most):
        yield batch.slice(a, b - a)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; one of our own only where the session names none."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where is None and (set_by_call := context._jsc.sc().getCheckpointDir()).isDefined():
        where = set_by_call.get()
    if where is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/vaultspark-{context.applicationId}"
    return where.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `df` as Parquet in the shared folder and read it back, which cuts its lineage.

    The write's shuffle files go when it is done. The table goes with `release`, or with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(spark: SparkSession, *paths: str) -> None:
    """Remove tables that `materialize` wrote and nothing reads any more."""
    for path in paths:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it where `df` has such a column already; case does not tell names apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: More keys than this are never sent to all workers as hot ones.
HOT_KEYS = 10_000


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = HOT_KEYS) -> DataFrame:
    """`left` joined with `right` on `key`, the rows of hot keys dealt over many tasks.

    A key is hot if `left` has more than 1/most of its rows there, so there are fewer than `most` hot
    keys, which is what makes them small enough to broadcast. Each gets a number of salts in proportion;
    `right`'s rows of it are repeated for each salt. Null keys match nothing. `left` is read twice more.
    """
    share = max(1, -(-left.count() // most))
    count = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > share)
    hot = F.broadcast(count.select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts")))  # fewer than `most` rows
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.floor(F.rand(7) * salts).cast("int")).drop("_salts")
    spread = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


# --- Arrow text -----------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, ends, data = column.buffers()
    if n == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `most` bytes each; a longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the number of words of each row."""
    n = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    ink = ~_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    some = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][some], offsets[1:][some] - 1
    first[begin] = ink[begin]
    last[end] = ink[end]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0xD1B54A32D192ED03))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_BASE, _BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (sorted, not overlapping), one megabyte at a time.

    A polynomial over random byte values, by prefix sums; equal bytes give equal hashes in every
    batch and process.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        forth, back = _powers(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * forth[: b - a], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        at = to
    return out


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0])


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes; n - 1 fewer entries than `h`."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(_BASE) + h[i : len(h) - n + 1 + i])
    return out
