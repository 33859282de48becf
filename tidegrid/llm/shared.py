"""What the corpus operators share: cutting lineage, reading tables, and byte blocks of text columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import ship

#: Text bytes that a vectorised step holds at once; the work arrays are about 60 times this.
BLOCK_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from spark.checkpoint.dir; set here only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of one Arrow batch between the JVM and a worker: rows can be of any length, so they are not counted.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Before an operator with Python code: workers can import it, and batches are bounded in bytes. A limit that
    the application was started with stays."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps never recompute what
    led to it, and a lost executor takes nothing with it. A file for each task that computes a part."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidegrid/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """cut() for a few numbers a row: a checkpoint in the shared folder, which opens fewer files than a table."""
    shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def rekeyed(df: DataFrame, key: str) -> DataFrame:
    """df with a text key that the planner takes for a new one. After an aggregation by the key a join would
    reuse its partitions as they are; so it deals both sides anew, and may split those that a hot key fills."""
    return df.withColumn(key, F.substring(key, 1, 2**31 - 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total_bytes(df: DataFrame, column: str) -> int:
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def fragments_for(size: int, each: int = 24 << 20, least: int = 12) -> int:
    """Hash fragments so that each holds about `each` bytes; grows with the data, with no upper limit."""
    return max(least, -(-size // each))


def dealt(df: DataFrame, key: str, size: int, each: int = 64 << 20) -> DataFrame:
    """df dealt by a number of the library's own making, to at least as many partitions as hold `each` bytes of
    `size`: groups cannot be split later, so their number must not hang on a session's default alone. An int is
    a fragment's number: taken modulo the partitions, so that fragments lie apart; a long is hashed."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
    whole = df.schema[key].dataType.simpleString() == "int"
    return df.repartitionById(n, F.col(key)) if whole else df.repartition(n, key)


def crc_text(column: str) -> "F.Column":
    return F.crc32(F.col(column).cast("string").cast("binary"))


def give_back() -> None:
    """Hand freed memory back to the system: Python workers live on after a task and would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def unpacked(x: bytes, size: int, kind) -> np.ndarray:
    """`size` numbers of a kind from packed()."""
    n = size * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True) if n else b"", kind)


def slices(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Consecutive parts of an array as the bytes of a binary column."""
    offsets = (np.asarray(bounds) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


# ---- text columns as bytes -------------------------------------------------------------------


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its offsets from 0; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def block_slices(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Row ranges of at most `most` bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random odd 64-bit number per byte value, and per place in an n-gram.
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_CODES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * np.uint64(pow(base, filled, 2**64))
        filled += take
    return out[:n]


_POWERS = _powers(_BASE, BLOCK_BYTES + 4096), _powers(_BASE_INVERSE, BLOCK_BYTES + 4096)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: polynomial prefix sums modulo 2**64, shifted back and mixed
    with the length."""
    n = len(data)
    power, inverse = _POWERS if n <= len(_POWERS[0]) else (_powers(_BASE, n), _powers(_BASE_INVERSE, n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * power[:n], out=sums[1:])
    out = sums[ends] - sums[starts]
    out *= inverse[np.minimum(starts, n - 1)] if n else np.uint64(1)
    return mix(out + (ends - starts).astype(np.uint64) * PLACE_CODES[63])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: the data with A-Z lower-cased, each word's start and end, and for each
    text the number of its first word (with one more at the end). Words are runs without 0x20, 0x09-0x0D."""
    data = LOWER[data]
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[firsts] = solid[firsts]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    lasts = firsts[1:] - 1 if len(firsts) else firsts
    closes[lasts] = solid[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(word_hashes: np.ndarray, first_word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `width` words inside a text, and each text's number of them; a text with
    fewer words has its whole sequence as one, a text without words none."""
    counts = np.diff(first_word)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    starts = np.repeat(first_word[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    length = np.repeat(np.minimum(counts, width), n)
    total = np.zeros(len(starts), np.uint64)
    for k in range(width):
        inside = length > k
        at = np.minimum(starts + k, max(len(word_hashes) - 1, 0))
        if len(starts):
            total += np.where(inside, word_hashes[at] * PLACE_CODES[k], np.uint64(0))
    return mix(total + length.astype(np.uint64) * PLACE_CODES[62]), n
