"""What the operators of this package share: shared storage and byte-level batch tokenising."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at once in a Python worker.
SLICE_BYTES = 2 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one is made only for a local master."""
    global _own_dir
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return _own_dir


_written: dict[str, SparkSession] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and survives the loss of executors.

    The table stays until discard() or clean_up(), or until the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def keep_until_end(spark: SparkSession, path: str) -> str:
    """Has clean_up() delete a folder, too."""
    _written[path] = spark
    return path


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables from which nothing is read any more."""
    for df in tables:
        path = getattr(df, "_corpusloom_path", None)
        if path in _written:
            _delete(_written.pop(path), path)


def clean_up() -> None:
    """Deletes all tables that this driver materialised; results that were not yet written can't be read then. Runs by itself when the driver ends."""
    for path in list(_written):
        spark = _written.pop(path)
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


atexit.register(clean_up)


def column(name: str) -> Column:
    """The column of that very name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes up to which a table of a counted size is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


#: Rows of a batch of texts on its way to Python: small batches keep workers small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, if they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- batches -----------------------------------------------------------------------------------


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text each (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if sizes.sum() <= most:
        yield batch
        return
    start = size = 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and size + s > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += s
    yield batch.slice(start, n - start)


def flat(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a string column, each followed by one newline, and the offsets (rows + 1). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    column = pc.binary_join_element_wise(column, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


# ---- words --------------------------------------------------------------------------------------

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = True
_WORD[0x80:] = True
_WIDE = np.zeros(256, bool)
_WIDE[0xE3:0xEE] = True  # first bytes of three-byte CJK, kana and Hangul characters


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of ASCII letters, digits and non-ASCII characters; each wide (CJK) character is a word of its own."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _WORD[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    wide = np.flatnonzero(_WIDE[data])
    if len(wide):
        start[wide] = True
        after = wide + 3
        after = after[after < len(data)]
        start[after] |= word[after]
    cut = np.flatnonzero(start | ~word)
    is_start = start[cut]
    ends = np.append(cut[1:], len(data))
    return cut[is_start], ends[is_start]


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if size > (SLICE_BYTES * 2):
            return have[:n]
        _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span, without a loop: differences of a running polynomial sum."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.multiply(data, _power(_BASE, n), out=total[1:], dtype=np.uint64, casting="unsafe")
    np.cumsum(total, out=total)
    h = (total[ends] - total[starts]) * _power(_INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_word(word: str) -> int:
    """What hash_spans gives for one whole string."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def counts_by_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first word of each text (rows + 1 values)."""
    return np.searchsorted(starts, offsets)
