"""Helpers shared by the operators of this subpackage: table access, written
intermediates, vectorised word and shingle hashing, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import bound_batches, checkpoint_dir, ensure_shipped

SLICE_BYTES = 1 << 20  # text handled per vectorised step; bounds a task's temporary arrays


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors, and bound what a Python worker holds of its input: where the session
    has Spark's own limit of 64 MB for an Arrow batch, 8 MB (texts are handled 1 MB at a time anyway)."""
    ensure_shipped(spark)
    bound_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table with all its columns, split as Spark's scan splits it."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back:
    cuts lineage, survives lost executors, and lets Spark drop the shuffles behind it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_executors(spark: SparkSession) -> None:
    """Collect garbage in the executors, so that heaps which one stage has filled shrink before the next one starts
    its Python workers beside them (the collector gives memory back only then).  One row for each core."""
    n = spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("collected")
    spark.range(0, n, 1, n).select(collected).write.format("noop").mode("overwrite").save()


def release_memory() -> None:
    """In a Python worker: give memory that is no longer used back to the machine.  Workers outlive their tasks."""
    for i in (0, 1):
        _POW[i] = _POW[i][:1].copy()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# ---------------------------------------------------------------- vectorised text

_C1, _C2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective), element-wise."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)  # a random 64-bit value for each byte
_BASE = 0x5851F42D4C957F2F  # odd, and _BASE - 1 is 2 modulo 4
_INV = pow(_BASE, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = 1 << int(n - 1).bit_length()
        for i, b in ((0, _BASE), (1, _INV)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _POW[i] = np.cumprod(p, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def text_slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """Yield (sub-batch, bytes, offsets): rows of ``batch`` in runs of about ``limit`` bytes
    of text (a single longer text is a run of its own)."""
    data, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a), data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]`` (non-empty), all by one prefix sum.
    ``byte``: the 64-bit values of the bytes, for a second independent hash."""
    n = len(data)
    if not n or not len(starts):
        return np.zeros(len(starts), np.uint64)
    p, inv = _powers(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE if byte is None else byte)[data] * p, out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` bytes, not finalized: their upper bits are the good ones."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(data))
    c = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], p, out=c[1:])
    np.cumsum(c[1:], out=c[1:])
    x = c[k:] - c[:-k]
    x *= inv[:n]
    x *= _GOLD
    return x


def words(data: np.ndarray, off: np.ndarray, lower: bool = True):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (starts, ends, row, hash); A-Z lowered."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    sep = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    word = ~sep
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= sep[:-1]
    after[:-1] |= sep[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    row = np.searchsorted(off, starts, "right") - 1
    return starts, ends, row, hash_runs(_LOWER[data] if lower else data, starts, ends)


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    x = mix(h[:m] + np.uint64(k))
    for j in range(1, k):
        x = mix(x * _GOLD + h[j:j + m])
    return x


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingle hashes of each text, sorted: (values, offsets by text).
    A text with fewer words has its whole word sequence as the one shingle; none has none."""
    _, _, row, h = words(data, off)
    rows = len(off) - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    count = np.diff(first)
    x = chain(h, k)
    inside = row[:len(x)] == row[k - 1:] if len(x) else np.zeros(0, bool)
    x, xrow = x[inside], row[:len(x)][inside]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([chain(h[first[r]:first[r + 1]], int(count[r]))[0] for r in short], np.uint64)
        x, xrow = np.concatenate([x, extra]), np.concatenate([xrow, short])
        order = np.argsort(xrow, kind="stable")
        x, xrow = x[order], xrow[order]
    at = np.searchsorted(xrow, np.arange(rows + 1))
    for a, b in zip(at[:-1], at[1:], strict=True):
        x[a:b].sort()
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (xrow[1:] != xrow[:-1])
    return x[keep], np.searchsorted(xrow[keep], np.arange(rows + 1))


def cell_sums(cells: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of ``values`` by cell (exact: halves of 32 bits in doubles)."""
    lo = np.bincount(cells, weights=(values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    hi = np.bincount(cells, weights=(values >> np.uint64(32)).astype(np.float64), minlength=n)
    return lo.astype(np.uint64) + (hi.astype(np.uint64) << np.uint64(32))


# ---------------------------------------------------------------- bit filters

FILTER_WORDS = 1 << 21  # of 64 bits: a filter has 16 MB, whatever the number of keys


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each key (a bigint hash) in an array of fixed size, to be broadcast.  Tasks use it to
    leave out rows that cannot match; false hits only add rows, as every match is checked later."""
    bit = F.expr(f"shiftleft(1L, cast(shiftright({column}, 40) & 63 as int))")
    filled = keys.groupBy(F.col(column).bitwiseAND(FILTER_WORDS - 1).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, np.int64)
    words[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    return words


def in_filter(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (words[key & (FILTER_WORDS - 1)] >> ((key >> 40) & 63)) & 1 == 1


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two bigint columns.  Returns (node, component): the smallest id
    reachable, for every node that has an edge to another.  Each round is aggregates
    and equi-joins over the edge list, written to the shared folder; the number of
    rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def state() -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state()
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                              F.struct("u", F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        e = written(small)
        # equal sums: the rounds have reached a fixed point (every node points at its root)
        before, seen = seen, state()
        if before == seen:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
