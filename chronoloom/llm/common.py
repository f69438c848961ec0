"""Helpers shared by the training-data operators.

Arrow batches are cut into slices of bounded text volume before NumPy sees them, so a batch of
very long documents needs no more memory than one of short ones.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one is made only where none is set in local mode (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if configured is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            configured = tempfile.mkdtemp(prefix="chronoloom-checkpoint-")
        sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


#: Values kept between the tasks of a Python worker process.
_STORE: dict = {}


def process_cache(name: str, build, version=None):
    """One value for each name in a Python worker process, kept between tasks until its version changes.

    Workers live on from one operator to the next: what another operator kept (names begin with the
    operator) goes when a new value is made, so that a pipeline needs no more memory than its stages.
    """
    if _STORE.get(name) is None or _STORE[name][0] != version:
        _STORE.pop(name, None)
        if not name.startswith("word-"):
            forget_others(name.split("-")[0])
        _STORE[name] = (version, build())
        give_back()
    return _STORE[name][1]


def forget_others(operator: str) -> None:
    """Drops what other operators kept in this worker."""
    for name in [k for k in _STORE if k.split("-")[0] not in (operator, "word")]:
        del _STORE[name]
    give_back()


def give_back() -> None:
    """Freed memory goes to the system, where the allocators can do that."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows with about `limit` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and where each row begins in them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(array: pa.Array, lower: bool = True, inside: np.ndarray | None = None, prefixes: tuple = ()):
    """64-bit hashes of the words of each row, and where each row's words begin.

    Words are what lies between characters U+0000 to U+0020, after lower-casing; `inside`, 256
    flags, gives other bytes of words. A word's hash is a difference of prefix sums of byte codes
    times powers of an odd number, scaled back to the word's own start, so that no Python code runs
    for a word. For each length in `prefixes` follows an array with the hashes of the first so many
    bytes of the words, 0 for shorter words.
    """
    if lower:
        array = pc.utf8_lower(array)
    raw, off = text_bytes(array)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(len(off), np.int64), *[none] * len(prefixes)
    codes, powers, inverse = process_cache("word-hash", _hash_tables)
    if len(powers) < n:
        powers, inverse = _powers(n)
    within = raw > 32 if inside is None else inside[raw]
    first = within.copy()
    first[1:] &= ~within[:-1]
    rows = off[:-1][off[:-1] < n]
    first[rows] = within[rows]
    starts = np.flatnonzero(first)
    last = within.copy()
    last[:-1] &= ~within[1:]
    row_ends = off[1:][off[1:] > 0] - 1
    last[row_ends] = within[row_ends]
    ends = np.flatnonzero(last) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes[raw] * powers[:n], out=sums[1:])
    more = []
    for k in prefixes:
        long = ends - starts >= k
        more.append(np.where(long, mix((sums[np.minimum(starts + k, n)] - sums[starts]) * inverse[starts] + np.uint64(k)), np.uint64(0)))
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    return h, np.searchsorted(starts, off).astype(np.int64), *more


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up = np.full(n, base, np.uint64)
    up[0] = 1
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hash_tables():
    rng = np.random.default_rng(20240607)
    codes = rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return (codes, *_powers(SLICE_BYTES + SLICE_BYTES // 8))


def segments(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start..start+count-1 of every segment, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint where `rows`, which the caller has counted, is at most `most`."""
    return F.broadcast(df) if rows <= most else df


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of queries that end inside are deleted as they end, not when the driver happens
    to collect its garbage: for checkpoints, which need them no more. A query counts by where its
    DataFrame is made."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder; the shuffle files behind it are deleted."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with shuffles_freed(spark):
        return df.select("*").checkpoint()
