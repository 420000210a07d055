"""Ordering, indexing, slicing and mixing.

Every dataset carries an explicit dense ``idx`` (0-based): a Spark table has
no row order.  ``dense_index`` is computed without a single-partition window:
range-partition, number rows inside each partition, then add per-partition
offsets from a tiny count table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.guards import broadcast_small
from tessera.session import cut_lineage

_LOW33 = (1 << 33) - 1  # monotonically_increasing_id = partition << 33 | row in partition


def _cols(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in ([order] if isinstance(order, (str, Column)) else order)]


def dense_index(df: DataFrame, order, out: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """``row_number() - 1`` over ``order`` (which must be a unique key), scalably.

    1. range-partition by the key, sort inside partitions (one shuffle), and
       number the rows; this is checkpointed into ``spark.checkpoint.dir``:
       the partition counts and the positions must come from the *same*
       materialisation (a recomputation may sample other range bounds), and
       the checkpoint also survives executor loss;
    2. count rows per partition (partial aggregate; one row per partition);
    3. exclusive running sum of those counts = partition offsets (tiny);
    4. idx = offset + position inside the partition (broadcast join of 3).
    No step gathers the data into one task, and a hot key range only
    makes one partition larger, never a group collected in memory.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    oc = _cols(order)
    ranged = cut_lineage(df.repartitionByRange(n, *oc).sortWithinPartitions(*oc)
                         .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid").bitwiseAND(_LOW33))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_pos")).cast("bigint"))
            .drop("_mid", "_pid", "_pos", "_off"))


def index_within(df: DataFrame, part: list[str], order, out: str = "pos") -> DataFrame:
    """0-based position inside each ``part`` group by ``order``, skew-safe.

    A global dense index over (part, order) minus each group's first index;
    the group start is a partial-aggregated ``min``, so one group holding a
    third of the rows is still spread over many tasks.
    """
    g = dense_index(df, [*part, *(_cols(order))], out="_g")
    starts = g.groupBy(*part).agg(F.min("_g").alias("_s"))
    return (g.join(starts, part).withColumn(out, F.col("_g") - F.col("_s")).drop("_g", "_s"))


def length_offsets(lengths: DataFrame, order: str, n: str = "n", out: str = "offset") -> DataFrame:
    """Exclusive running sum of lengths over a small per-task table."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("bigint"))


def rank_stride(df: DataFrame, rank: int, world: int, idx: str = "idx") -> DataFrame:
    """A3: rows (or row groups, items) with ``idx % world == rank``."""
    if not 0 <= rank < world:
        raise ValueError("need 0 <= rank < world")
    return df.where(F.pmod(F.col(idx), F.lit(world)) == rank)


def batch_stride(df: DataFrame, batch_size: int, rank: int, world: int, idx: str = "idx") -> DataFrame:
    """A4: contiguous batches of ``batch_size``, batches strided over ranks."""
    batch = F.floor(F.col(idx) / batch_size)
    return df.withColumn("batch", batch.cast("bigint")).where(F.pmod(F.col("batch"), F.lit(world)) == rank)


def shuffle_key(seed, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_shuffle(df: DataFrame, seed: int, key, out: str = "idx") -> DataFrame:
    """Deterministic order for a seed: by ``md5(seed:key)``, then key."""
    k = _cols(key)[0]
    return dense_index(df.withColumn("_shuf", shuffle_key(seed, k)), [F.col("_shuf"), k], out=out).drop("_shuf")


def limit_problems(df: DataFrame, n: int | None, idx: str = "idx") -> DataFrame:
    """The first ``n`` by idx; null or <= 0 keeps all."""
    return df if n is None or n <= 0 else df.where(F.col(idx) < n)


def slice_task(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, idx: str = "idx") -> DataFrame:
    """G1: logical view ``[start:stop:step]`` with a new dense idx (stop clamped to n)."""
    if start < 0 or step < 1 or (stop is not None and stop < start):
        raise ValueError("need start >= 0, step >= 1 and stop >= start")
    cond = (F.col(idx) >= start) & (F.pmod(F.col(idx) - start, F.lit(step)) == 0)
    if stop is not None:
        cond = cond & (F.col(idx) < stop)
    return df.where(cond).withColumn(idx, ((F.col(idx) - start) / step).cast("bigint"))


def _tagged(dfs: list[DataFrame], idx: str) -> DataFrame:
    parts = [d.withColumn("task_idx", F.lit(i)) for i, d in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def mix_tasks(dfs: list[DataFrame], seed: int = 42, idx: str = "idx") -> DataFrame:
    """All examples of all inputs in one seeded order; a repeated input is oversampled."""
    u = _tagged(dfs, idx).withColumnRenamed(idx, "local_idx")
    key = F.concat_ws(":", F.col("task_idx").cast("string"), F.col("local_idx").cast("string"))
    return seeded_shuffle(u.withColumn("_key", key), seed, "_key", out=idx).drop("_key")


def chain_tasks(dfs: list[DataFrame], idx: str = "idx") -> DataFrame:
    """Concatenation in list order; global idx = offset of the task + local idx."""
    u = _tagged(dfs, idx).withColumnRenamed(idx, "local_idx")
    lengths = u.groupBy("task_idx").agg(F.count(F.lit(1)).alias("n"))  # one row per task
    offs = length_offsets(lengths, "task_idx")
    return (u.join(broadcast_small(offs, "task lengths"), "task_idx")
            .withColumn(idx, F.col("offset") + F.col("local_idx")).drop("offset", "n"))


def _next_prime(n: int) -> int:
    def is_prime(p):
        if p < 2:
            return False
        i = 2
        while i * i <= p:
            if p % i == 0:
                return False
            i += 1
        return True
    p = max(n, 2)
    while not is_prime(p):
        p += 1
    return p


def fewshot_indices(df: DataFrame, k: int, seed: int, n: int, idx: str = "idx", out: str = "shot_idx") -> DataFrame:
    """F9 core: per item ``k`` distinct other indices in [0, n), deterministic.

    For a prime ``P >= n`` the walk ``(b + j*a) mod P`` (a != 0) visits every
    residue once, so among its first ``k + (P - n) + 1`` steps at least ``k``
    land in ``[0, n)`` and differ from the item: exact, no all-pairs join.
    ``a``, ``b`` are md5 draws of the item (reproducible in SQL).
    """
    if not 0 <= k < n:
        raise ValueError("need 0 <= k < n")
    P = _next_prime(n)
    m = k + (P - n) + 1
    key = F.col(idx).cast("string")
    a = F.lit(1) + F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:a:"), key)), 1, 8), 16, 10).cast("bigint") % (P - 1)
    b = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:b:"), key)), 1, 8), 16, 10).cast("bigint") % P
    walk = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.pmod(b + j.cast("bigint") * a, F.lit(P)))
    ok = F.filter(walk, lambda x: (x < n) & (x != F.col(idx)))
    return df.withColumn(out, F.slice(ok, 1, k))


def global_fewshot(pool: DataFrame, k: int, seed: int = 42, idx: str = "idx", fields: list[str] | None = None) -> "Column":
    """F9 (global mode): one sample of ``k`` pool rows shared by all items, as a
    scalar-subquery column (the k rows with the smallest ``md5(seed:idx)``;
    a top-k, computed once)."""
    fields = fields or [c for c in pool.columns if c != idx]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(idx).cast("string")))
    top = pool.orderBy(key, idx).limit(k).select(key.alias("_k"), *fields)
    return top.select(F.transform(F.sort_array(F.collect_list(F.struct("_k", *fields))),
                                  lambda x: F.struct(*[x.getField(f).alias(f) for f in fields]))).scalar()


def sample_fewshot(df: DataFrame, k: int, seed: int = 1234, idx: str = "idx", fields: list[str] | None = None,
                   out: str = "shots") -> DataFrame:
    """attach ``k`` shots (distinct, never the item itself) as an ordered array.

    Shot rows are fetched by an equi join on ``idx`` (each row is referenced
    about ``k`` times on average, uniformly), then regrouped per item; a
    group holds exactly ``k`` rows.  ``k == 0`` gives empty arrays.
    """
    fields = fields or [c for c in df.columns if c != idx]
    shot_struct = F.struct(*[F.col(c) for c in fields])
    if k == 0:
        return df.withColumn(out, F.filter(F.array(shot_struct), lambda x: F.lit(False)))
    n = df.count()
    with_ix = fewshot_indices(df.select(idx), k, seed, n, idx)
    pairs = with_ix.select(F.col(idx).alias("_item"), F.posexplode("shot_idx").alias("_j", idx))
    shots = pairs.join(df.select(idx, shot_struct.alias("_s")), idx)
    grouped = shots.groupBy("_item").agg(F.sort_array(F.collect_list(F.struct("_j", "_s"))).alias("_g"))
    return (df.join(grouped.withColumnRenamed("_item", idx), idx, "left")
            .withColumn(out, F.transform("_g", lambda x: x.getField("_s"))).drop("_g"))


def chunk_positions(df: DataFrame, key: list[str], order, chunk_rows: int = 100_000) -> DataFrame:
    """Per-key 0-based position (skew-safe, see ``index_within``) and its chunk
    ``pos div chunk_rows``; the unit for bounded per-key scans."""
    g = index_within(df, key, order, out="_pos")
    # positions feed several passes (windows, chunk totals, joins back): materialise once
    return cut_lineage(g.withColumn("_chunk", (F.col("_pos") / chunk_rows).cast("bigint")))


def chunked_running_max(g: DataFrame, key: list[str], value: Column, out: str) -> DataFrame:
    """Inclusive running maximum per key in ``_pos`` order (nulls are passed over), chunked like the sums."""
    g = g.withColumn("_v", value)
    w = Window.partitionBy(*key, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("_in", F.max("_v").over(w))
    wc = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = g.groupBy(*key, "_chunk").agg(F.max("_v").alias("_t")).select(*key, "_chunk", F.max("_t").over(wc).alias("_o"))
    return g.join(before, [*key, "_chunk"]).withColumn(out, F.greatest("_o", "_in")).drop("_v", "_in", "_o")


def chunked_running_sums(g: DataFrame, key: list[str], values: dict) -> DataFrame:
    """Inclusive running sums per key in ``_pos`` order, without a per-key window.

    ``values`` maps output name -> numeric Column.  Inside each (key, chunk)
    a window adds up at most ``chunk_rows`` rows (the one large shuffle);
    chunk totals are a map-side partial aggregate (one row per chunk and map
    task), get an exclusive running sum per key and are joined back as
    offsets.  A key holding a third of all rows becomes many bounded chunks.
    """
    names = list(values)
    for n, c in values.items():
        g = g.withColumn(f"_v_{n}", c)
    w = Window.partitionBy(*key, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in names:
        g = g.withColumn(f"_in_{n}", F.sum(f"_v_{n}").over(w))
    tot = g.groupBy(*key, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    wc = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*key, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(wc), F.lit(0)).alias(f"_o_{n}") for n in names])
    g = g.join(off, [*key, "_chunk"])
    for n in names:
        g = g.withColumn(n, F.col(f"_o_{n}") + F.col(f"_in_{n}"))
    return g.drop(*[f"_{p}_{n}" for n in names for p in ("v", "in", "o")])
