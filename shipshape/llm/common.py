"""Helpers shared by the operators: tables, the shared folder, word hashing and components.

Every operator takes column names, selects the columns it needs first, and so tolerates any other
columns of the input, whatever their names.
"""

from __future__ import annotations

import ctypes
import pathlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of one Arrow batch handed to a Python worker; bounds the worker's memory for long texts.
BATCH_BYTES = 2 << 20
BATCH_ROWS = 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def batches(spark: SparkSession) -> None:
    """Prepare a session for Python tasks: batches bounded by bytes and rows, and this package on every executor."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = pathlib.Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='shipshape-')}/shipshape_code", "zip", package.parent, package.name)
        sc.addPyFile(archive)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a scratch folder of its own; a cluster without it
    is an error, since executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shipshape-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: computed once, lineage cut, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str, **more) -> DataFrame:
    """Like ``written``, dealt into buckets by ``key``: joins on that key read the table without an exchange.

    The rows are shuffled once, here; columns ``more`` are added behind the shuffle. The table's entry
    leaves the catalog again, its files stay.
    """
    spark, n, name = df.sparkSession, partitions(df.sparkSession), f"bucketed_{uuid.uuid4().hex}"
    df.repartition(n, key).withColumns(more).write.format("parquet").bucketBy(n, key).option("path", shared_folder(spark)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


#: What this process keeps between its tasks, by operator.
_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """A dict that a Python worker keeps for its later tasks of the same operator."""
    return _kept.setdefault(operator, {})


def trim(operator: str | None = None, dropped: bool = False) -> None:
    """Give freed memory back to the system; with ``dropped`` first what is kept for operators other than this."""
    if dropped:
        others = [x for k, x in _kept.items() if k != operator and x]
        if not others:
            return
        for x in others:
            x.clear()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def tidy(run, operator: str | None = None):
    """A task's generator that gives freed memory back to the system at its end: Python workers live on between tasks.

    What a worker keeps for another operator than ``operator`` is dropped at its start.
    """
    def body(batches):
        trim(operator, dropped=True)
        try:
            yield from run(batches)
        finally:
            trim()
    return body


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- words and shingles of Arrow string columns, without a Python object per word ----

_RNG = np.random.default_rng(20240607)
_BYTE = (_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_STEP = (_RNG.integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def string_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and its offsets, both from 0."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    arr = arr.cast(pa.large_string()).fill_null("")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def word_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of the words ``[^\\x20\\x09-\\x0D]+`` of rows of UTF-8 bytes."""
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    edges = off[:-1][off[:-1] < off[1:]]
    begins[edges] = ~space[edges]
    return np.flatnonzero(begins)


def word_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased), and the words' offsets by row."""
    raw, off = string_bytes(col)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    starts = word_starts(raw, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    body = slice(starts[0], None)
    at = starts - starts[0]
    lengths = np.diff(at, append=len(raw) - starts[0])
    within = np.arange(len(raw) - starts[0]) - np.repeat(at, lengths)
    val = _BYTE[raw[body]]
    val *= _powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(val, at)), np.searchsorted(starts, off)


def shingle_hashes(col, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles in text order (fewer words: the whole sequence), row offsets, word counts."""
    words, off = word_hashes(col)
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(count)])
    starts = np.repeat(off[:-1] - out_off[:-1], count) + np.arange(out_off[-1])
    size = np.repeat(np.minimum(n, k), count)
    h = size.astype(np.uint64) * _STEP[63]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        h += np.where(j < size, padded[starts + j], np.uint64(0)) * _STEP[j]
    return mix(h), out_off, n


def shingle_sets(col, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sorted distinct shingle hashes, concatenated, and their offsets."""
    h, off, _ = shingle_hashes(col, k)
    keep = np.ones(len(h), bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    if len(h):
        keep[1:] = h[1:] != h[:-1]
        keep[off[:-1][off[:-1] < off[1:]]] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums (mod 2^64) of consecutive runs."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[off[1:]] - total[off[:-1]]


# ---- connected components ----

def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(id, root): the smallest id reachable from each id that has an edge.

    Alternating large-star and small-star steps (the MapReduce connected-components scheme): each
    step hangs neighbours on the smallest one seen, by grouping and joining on node ids only; every
    round is written to the shared folder. Hot nodes are pre-aggregated minima, and joins may be
    split by AQE. Ends when a round changes nothing.
    """
    e = written(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a > b").distinct())
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        big = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        hung = big.join(low, F.col("a") == F.col("k"))
        e = written(hung.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                  F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                    .select("e.a", "e.b").where("a > b").distinct())
    roots = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
