"""Shared plumbing: hand-off tables in the cluster's shared folder, and byte-level text kernels."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; temporaries are a small multiple of it.
CHUNK_BYTES = 1 << 20
#: ASCII blanks that separate words: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset, one of our own, but on a single machine only."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tallymark-")
    return _own_dir


def _forget(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            _forget(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._handed_over = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` whose last reader has run; the others go when the process ends."""
    for df in tables:
        _written.remove((df.sparkSession, df._handed_over))
        _forget(df.sparkSession, df._handed_over)


def valid_text(column: str = "text") -> Column:
    """The column as a string; bytes that are no UTF-8 read as U+FFFD, so that no worker fails on them."""
    return F.make_valid_utf8(F.col(column).cast("string"))


#: A key is hot if it has more than one row in so many.  By counting, fewer keys than that can be hot.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` (a table) with ``counted`` (a table; one row a key, ``n``: its number of rows in ``rows``).

    Keys with more than 1 / HOT_SHARE of the rows, fewer than HOT_SHARE of them, are broadcast, so their rows stay where they are;
    only the others are shuffled.
    """
    total = rows.count()
    hot = F.col("n") * HOT_SHARE > total
    known = F.broadcast(counted.where(hot))
    there = rows.join(known, keys)
    rest = rows.join(F.broadcast(counted.where(hot).select(*keys)), keys, "left_anti").join(counted.where(~hot), keys)
    return there.unionByName(rest)


def ship_code(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package (clusters pass it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    env.setdefault("OMP_NUM_THREADS", "1")  # a worker has one core; matrix libraries would start a thread for each of the machine's
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: What a Python worker keeps from task to task; it goes when the worker turns to another module's tasks.
kept: dict[str, object] = {}
_tasks_of: str | None = None


def give_back() -> None:
    """Return free memory, that of Arrow's pool and of the C library, to the system: workers live on, idle, beside all later stages."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function of ``mapInArrow``, as a task that leaves no free memory in its worker, and drops what other modules keep there."""
    module = run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _turn_to(module)
        yield from run(batches)
        give_back()

    return task


def _turn_to(module: str) -> None:
    global _tasks_of
    if module != _tasks_of:
        _tasks_of = module
        kept.clear()
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, np.uint8)
    return data, offsets


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``limit`` bytes of text, with (bytes, offsets from 0); a longer text is a slice of its own."""
    for batch in batches:
        data, offsets = flat(batch.column(column))
        row, n = 0, batch.num_rows
        while row < n:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            last = min(last, n)
            yield batch.slice(row, last - row), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
            row = last


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _P)]), dtype=np.uint64)
            _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _P_INV)]), dtype=np.uint64)


def prefix_hash(data: np.ndarray, byte_table: np.ndarray = _BYTE) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any byte span."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(byte_table[data] * _powers[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end): equal bytes give equal values wherever they stand."""
    with np.errstate(over="ignore"):
        raw = (prefix[end] - prefix[start]) * _inverses[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[ord(c) for c in BLANKS]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every blank-separated word of every row."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a row boundary inside a run of word bytes cuts it
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[_IS_WORD[data[cuts - 1]] & _IS_WORD[data[cuts]]] if len(cuts) else cuts
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
