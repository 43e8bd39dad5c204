"""What the corpus operators share: reading, staging in the shared folder, shipping the package, and batch helpers.

Rows are identified by ``doc_id`` and, where a later step must meet the row again, by ``rk``, a 64-bit hash
of the text.  Two rows that agree in both are the same document to every operator here.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session settings of Arrow batches where the user has none: rows, and bytes, of a batch.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8m"))
ROWS_A_FILE = 50_000
_STAGED: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset: a temporary folder in local mode, the warehouse elsewhere, which executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        key = spark.sparkContext.applicationId
        if key not in _LOCAL:
            _LOCAL[key] = tempfile.mkdtemp(prefix="brindle-")
            atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
        return "file://" + os.path.realpath(_LOCAL[key])
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, and every later
    use reads files that survive the loss of any executor.

    ``rows`` is a known bound of the number of narrow rows; a small table then takes few tasks and files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{shared_dir(spark).rstrip('/')}/brindle/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = df.__dict__.get("_staged_path")
        if path and (df.sparkSession, path) in _STAGED:
            _STAGED.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


def staged() -> int:
    """A mark for ``release``."""
    return len(_STAGED)


def release(since: int = 0, but: DataFrame | None = None) -> None:
    """Delete the tables of this process that were staged after the mark, all by default, except ``but``.  Call it
    once the results that read them are written."""
    keep = but.__dict__.get("_staged_path") if but is not None else None
    for spark, path in _STAGED[since:]:
        if path != keep:
            _delete(spark, path)
    _STAGED[since:] = [x for x in _STAGED[since:] if x[1] == keep]


def fresh(taken: list[str], name: str) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers import it and keep
    module-level caches between tasks even where the repository is not installed; and keep the batches that
    go to workers small, since whole texts are in them (a value that the user set stays)."""
    sc = spark.sparkContext
    for key, value in BATCHES:
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if getattr(sc, "_brindle_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    place = os.path.realpath(tempfile.mkdtemp(prefix="brindle-ship-"))
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    target = f"{place}/brindle_ship.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(target)
    sc._brindle_shipped = True


_CACHES: dict[str, Callable[[], None]] = {}


def cached(name: str, clear: Callable[[], None]) -> None:
    """Register how to empty what an operator keeps in a worker between tasks."""
    _CACHES[name] = clear


def trim() -> None:
    """Hand freed memory back: workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays over 1 MB are mapped, and unmapped when freed
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker(name: str, keep: bool = False):
    """Marks the function of an operator's tasks: what operators hold in the worker goes when the task ends, or, with
    ``keep``, when a task of another operator starts."""

    def mark(run):
        def task(batches):
            for other, clear in _CACHES.items():
                if other != name:
                    clear()
            trim()
            try:
                yield from run(batches)
            finally:
                if not keep:
                    for clear in _CACHES.values():
                        clear()
                trim()

        return task

    return mark


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(name: str = "text") -> Column:
    return F.xxhash64(text_or_empty(name))


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of a slice stays near ``limit`` bytes; one longer text is a slice alone."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        _, ends = string_buffers(batch.column(column))
        start = 0
        while start < n:
            base = ends[start]
            stop = int(np.searchsorted(ends, base + limit, side="right")) - 1
            stop = min(n, max(start + 1, stop))
            yield batch.slice(start, stop - start)
            start = stop


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and n + 1 offsets from 0."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return raw, o - (o[0] if len(o) else 0)


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
cached("powers", lambda: _POWERS.clear())
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of them."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if (base, size) not in _POWERS:
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        for key in [k for k in _POWERS if k[0] == base and k[1] < size]:
            del _POWERS[key]
        if size > 1 << 24:  # a single very long text: not worth keeping
            return out[0], out[1]
        _POWERS[base, size] = (out[0], out[1])
    return _POWERS[base, size]


class Rolling:
    """Polynomial hashes of any range of a sequence in constant time each, modulo 2**64.

    Different sequences can be made to collide, so these hashes only choose what is compared.
    """

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        p, self.inverse = powers(n + 1, base)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values.astype(_U) * p[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, width: int) -> np.ndarray:
        """Of every window of ``width`` values, in order."""
        n = max(0, len(self.sums) - width)
        return (self.sums[width:] - self.sums[:n]) * self.inverse[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end: starts, ends, and words before each text."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    np.logical_not(ink[:-1], out=first[1:])
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    first[inner] = True
    starts = np.flatnonzero(ink & first)
    last = np.empty(len(raw), bool)
    last[-1] = True
    np.logical_not(ink[1:], out=last[:-1])
    last[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(ink & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def encoded(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct strings of ``raw`` cut at ``offsets``, byte for byte, and the number of each one's."""
    data = np.ascontiguousarray(raw)
    at = np.ascontiguousarray(offsets.astype(np.int64))
    array = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    return array.dictionary.to_pylist(), np.asarray(array.indices).astype(np.int64)


def word_values(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2b digest of each word; equal words are found byte for byte first."""
    if not len(starts):
        return np.zeros(0, _U)
    distinct, number = encoded(raw[~_SPACE[raw]], np.concatenate(([0], np.cumsum(ends - starts))))
    made = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in distinct]), "<u8")
    return made.astype(_U)[number]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out
