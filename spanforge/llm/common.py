"""Shared pieces of the training-data operators: tables in the shared folder, size-checked
broadcasts, and vectorised word scanning over Arrow string buffers."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a small side that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20

#: Tables after which the driver gives memory back.
SETTLE = 4

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. On one machine, where it may be unset as in
    tests, a folder of our own; on a cluster a local folder would lose rows, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def aliased(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all but the needed columns under names of their place, so that names inside an operator can't clash with
    the table's own; restored() gives them back."""
    return docs.toDF(*(c if c in needed else f"own_{i}" for i, c in enumerate(docs.columns)))


def restored(rows: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of own = aliased(docs), which rows has besides others, as docs names them."""
    return rows.select(*own.columns).toDF(*docs.columns)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


_tables = itertools.count(1)


def trim_jvm(spark: SparkSession) -> str:
    """Return memory that the driver's JVM has freed outside its heap to the system: jcmd's System.trim_native_heap."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    args = new(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # by reflection: the server's own class isn't public
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def settle(spark: SparkSession) -> None:
    """Return what the driver's JVM has freed to the system. The plans of many small tables leave garbage, for which the heap
    grows, and freed memory outside it, neither of which goes back by itself."""
    spark.sparkContext._jvm.System.gc()
    try:
        trim_jvm(spark)
    except Exception:  # a JVM without this command
        pass


def stored(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and return a scan of it: lineage ends here, and a lost
    executor costs only its own tasks. The table is removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanforge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if next(_tables) % SETTLE == 0:
        settle(spark)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table made by stored()."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for f in df.inputFiles():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(conf).getFileStatus(p).getLen()
    return total


def fits(df: DataFrame, limit: int = BROADCAST_BYTES, expand: int = 8) -> bool:
    """Whether a stored() table is small enough to be broadcast, even when it grows `expand` times in memory."""
    return stored_bytes(df) * expand <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES, expand: int = 8) -> DataFrame:
    """Hint a broadcast of a stored() table if its size, checked here, allows it; otherwise leave the choice of a shuffle join
    to Spark."""
    return F.broadcast(df) if fits(df, limit, expand) else df


def ascii_lower(col):
    """Lower-case A-Z only. lower() does the same to pure ASCII and is far cheaper than translate()."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())).otherwise(F.lower(col))


def give_back() -> None:
    """Return what a finished task has freed to the system: workers are reused, and executors' memory counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def parts(batches, rows: int = 512):
    """Batches in slices of some rows, so that a task holds few texts as Python objects at a time; gives freed
    memory back at the end."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


# ---- vectorised scanning of a batch of texts -------------------------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, size=(2, 256), dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data[:0], off - off[0]


def chunks(col: pa.Array, most: int = 1 << 20):
    """Split a column into runs (first row, end row) of about `most` bytes; a longer text stands alone."""
    if not len(col):
        return
    lens = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    first = size = 0
    for i, n in enumerate(lens.tolist()):
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    yield first, len(col)


#: 1 for a byte that belongs to a word of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def word_spans(data: np.ndarray, off: np.ndarray, wordy: np.ndarray = NOT_SPACE):
    """Starts and ends (bytes) of all words, and the index of the first word of each document."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = wordy[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True  # a document's edge ends a word
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut)).astype(np.int64)
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut)).astype(np.int64)
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes; row 0 and 1 are independent functions."""
    pw, ipw = powers(int(_BASE) if row == 0 else 0xD1342543DE82EF95, len(data))
    c = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[row][data] * pw[: len(data)], out=c[1:])
    return mix((c[ends] - c[starts]) * ipw[starts] + (ends - starts).astype(np.uint64) * _U(0xA24BAED4963EE407))
