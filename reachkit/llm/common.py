"""Helpers shared by the corpus operators: Arrow text -> flat NumPy views, word hashes, rolling
hashes, written intermediate tables.

Text columns arrive in Python workers as Arrow buffers.  They are never turned into Python strings:
a slice of rows is one byte array with row offsets, words are (start, end) pairs found by table
look-up, and hashes are computed for all words of the slice at once.  Slices are bounded by bytes,
so the memory of a task does not depend on how long single documents are (beyond one document).
"""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SLICE_ROWS = 50_000  # row numbers of a slice fit 16 bits
U64 = np.uint64

# word separators of the contracts: space and \t \n \v \f \r
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# separators of the alphanumeric words: every ASCII byte that is no digit and no letter
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not (chr(i).isalnum()) for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- code and written tables

_SHIPPED: set[str] = set()
# bounds of an Arrow batch in the jobs of these operators: setting, Spark's default, value used
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
           ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(8 << 20)))


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of whole texts bounded in rows and bytes, for the memory of the Python workers:
    while a job of these operators runs.  The session has its own settings back afterwards, and a value
    that the user chose stays in force."""
    ours = [(key, old, new) for key, old, new in BATCHES if spark.conf.get(key, old) == old]
    for key, _, new in ours:
        spark.conf.set(key, new)
    try:
        yield
    finally:
        for key, _, _ in ours:
            spark.conf.unset(key)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (Spark's own ``addPyFile``), so that
    functions in tasks find it wherever the package was imported from on the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="llm-code-")) / "llm_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a folder of its own is
    chosen only where none is set and the session runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for it")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` under the shared folder and return the reread table: computed once, lineage cut,
    so a lost executor costs a reread and not a recomputation."""
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    with small_batches(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id, text`` (and ``more``) of a table that may hold any other columns."""
    ship(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n: the fold that is held out is 2 (null ids: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def group_count(spark: SparkSession, units: int, each: int, least: int = 1) -> int:
    """Groups so that each holds about ``each`` units: grows with the data, never with one key."""
    return max(least, -(-int(units) // int(each)))


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` of a function over the batches of a task that hands its memory back at the end."""
    return df.mapInArrow(lambda batches: relaxed(run(batches)), schema)


# ---------------------------------------------------------------- Arrow -> flat bytes

try:  # glibc keeps freed blocks; other C libraries have no such call
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _TRIM = None


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of a string or binary column; a null is an empty row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0 or col.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if big else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    start, end = off[:-1], off[1:].copy()
    if col.null_count:
        gone = col.is_null().to_numpy(zero_copy_only=False)
        end[gone] = start[gone]
    return buf, start, end


def row_slices(start: np.ndarray, end: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``most`` bytes (a longer single row stands alone) and SLICE_ROWS rows."""
    n, i = len(start), 0
    reach = np.cumsum(end - start)
    while i < n:
        done = reach[i - 1] if i else 0
        j = min(max(i + 1, int(np.searchsorted(reach, done + most, "right"))), i + SLICE_ROWS)
        yield i, j
        i = j


def text_slices(batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text", most: int = SLICE_BYTES):
    """Yield (ids, bytes, start, end) for row ranges of bounded size; offsets count from 0 and rows
    follow each other without gaps.  Rows without an id keep a masked id (``ids`` is an Arrow array)."""
    for batch in batches:
        ids = column(batch, key)
        buf, start, end = flat(column(batch, text))
        for i, j in row_slices(start, end, most):
            lo, hi = int(start[i]), int(end[j - 1])
            s, e = start[i:j] - lo, end[i:j] - lo
            part = buf[lo:max(lo, hi)]
            if len(s) and (s[1:] != e[:-1]).any():  # bytes behind nulls: close the gaps
                part = np.concatenate([part[a:b] for a, b in zip(s, e, strict=True)]) if len(s) else part
                e = np.cumsum(e - s)
                s = np.concatenate([[0], e[:-1]])
            yield ids.slice(i, j - i), part, s, e


def relaxed(batches: Iterator) -> Iterator:
    """The batches of a task; behind the last one, freed memory goes back to the system, since Python
    workers outlive tasks."""
    yield from batches
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def as_longs(ids: pa.Array) -> np.ndarray:
    """Ids as int64; a null id becomes the smallest long (callers keep null ids apart before)."""
    return ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


# ---------------------------------------------------------------- words and hashes

def words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, space: np.ndarray = SPACE, cut: np.ndarray | None = None):
    """(first byte, byte after the last, row) of every word; words never cross rows.  ``cut`` marks
    bytes at which a word is divided."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    isw = np.zeros(n + 2, bool)
    np.logical_not(space[buf], out=isw[1:-1])
    first = isw[1:-1] & ~isw[:-2]
    last = isw[1:-1] & ~isw[2:]
    if cut is not None:
        first |= cut & isw[1:-1]
        last[:-1] |= cut[1:] & isw[1:-2]
    begins = start[start < n]
    first[begins] = isw[1:-1][begins]
    ends = end[end > 0] - 1
    last[ends] = isw[1:-1][ends]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    return ws, we, np.searchsorted(start, ws, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public-domain constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse: ``KEEP`` of them stay with the worker; a
    longer text gets its own, which go with it."""

    KEEP = 2 << 20

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, U64)

    def to(self, n: int) -> np.ndarray:
        if n > self.KEEP:
            return _powers(self.base, n)
        if len(self.up) < n:
            self.up = _powers(self.base, min(self.KEEP, max(n, 2 * len(self.up), 2)))
        return self.up[:n]

    def back(self, n: int) -> np.ndarray:
        if n > self.KEEP:
            return _powers(self.inverse, n)
        if len(self.down) < n:
            self.down = _powers(self.inverse, min(self.KEEP, max(n, 2 * len(self.down), 2)))
        return self.down[:n]


_CHAR, _WORD = _Powers(0x9E3779B97F4A7C15 | 1), _Powers(0xD6E8FEB86659FD93 | 1)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))


def word_hashes(buf: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every word's bytes, mixed with its length.  (Prefix sums of
    byte value * base**i over the slice; a word is brought to the origin by the inverse power.)"""
    if len(ws) == 0:
        return np.zeros(0, U64)
    n = len(buf)
    prefix = np.zeros(n + 1, U64)
    value = _BYTE[buf]
    value *= _CHAR.to(n)
    np.cumsum(value, out=prefix[1:])
    return mix((prefix[we] - prefix[ws]) * _CHAR.back(n)[ws] + (we - ws).astype(U64))


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of all n-value windows: windows[i] covers values[i:i+n].
    (Prefix sums of value * base**i; a window is brought to the origin by the inverse power.)"""
    m = len(values)
    if m < n:
        return np.zeros(0, U64)
    prefix = np.zeros(m + 1, U64)
    np.cumsum(values * _WORD.to(m), out=prefix[1:])
    return mix((prefix[n:] - prefix[:m + 1 - n]) * _WORD.back(m + 1 - n))


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over x[i:i+w] for every i (length len(x) - w + 1), by doubling."""
    if len(x) < w:
        return x[:0]
    have = 1
    while 2 * have <= w:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:len(x) - (w - have)], x[w - have:]) if have < w else x


def in_row(position: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(count per row, index of every item inside its row) for items sorted by row."""
    count = np.bincount(row, minlength=n_rows).astype(np.int64)
    first = np.cumsum(count) - count
    return count, position - first[row]


# ---------------------------------------------------------------- spans and packed arrays

def merge_spans(begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [a, b) of the union of [s, s + size) for sorted starts."""
    if len(begin) == 0:
        return begin, begin
    cut = np.flatnonzero(np.diff(begin) > size)
    a = begin[np.concatenate([[0], cut + 1])]
    b = begin[np.concatenate([cut, [len(begin) - 1]])] + size
    return a, b


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column whose row i holds the raw bytes of the next counts[i] values."""
    width = values.dtype.itemsize
    off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * width, out=off[1:])
    if off[-1] >= 1 << 31:
        raise ValueError("a slice holds more than 2 GB")
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32).tobytes()), data])


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """List column whose row i holds the next counts[i] values."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), values)


def crc(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
