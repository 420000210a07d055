"""Corpus scan, split, stride, resume, repeat, chunk and shard manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.order import rank_stride
from tessera.plans.guards import broadcast_small
from tessera.sources.rowgroups import footers, group_of


def scan_corpus(spark: SparkSession, path: str, rows_per_group: int | None = None,
                column: str = "text", spread: bool = True, keep: tuple = (), row_groups: bool = False) -> DataFrame:
    """A1: ``*.parquet`` under ``path`` (partial ``.tmp`` files are skipped by the
    glob), reading only ``column``; shard = file name, pos = row index in the file.

    Column pruning keeps every other column out of the scan.  ``row_groups`` adds the
    files' own ``row_group`` numbers and each row's place in its group (``group_pos``), from
    their footers (a row per file, joined by file);
    ``rows_per_group`` instead derives them, as ``pos div rows_per_group``.  With
    ``spread``, a scan with fewer splits than cores is spread over all cores
    (after the metadata columns are taken from the files).  ``keep`` names further
    columns to read in the same scan.
    """
    from tessera.plans.tables import spread_small_scan
    df = (spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
          .select(F.col("_metadata.file_name").alias("shard"), *([F.col("_metadata.file_path").alias("_file")] if row_groups else []),
                  F.col("_metadata.row_index").alias("pos"), F.col(column).alias("text"), *keep))
    if spread:
        df = spread_small_scan(df)
    if row_groups:
        starts = footers(spark, path).select(F.col("file").alias("_file"), F.col("starts").alias("_starts"))
        df = (df.join(broadcast_small(starts, "row groups by file"), "_file")
              .withColumn("row_group", group_of(F.col("pos"), F.col("_starts")))
              .withColumn("group_pos", F.col("pos") - F.get("_starts", F.col("row_group").cast("int"))).drop("_file", "_starts"))
    if rows_per_group:
        df = df.withColumn("row_group", (F.col("pos") / rows_per_group).cast("bigint"))
    return df


def split_corpus(df: DataFrame, split: str, shard: str = "shard") -> DataFrame:
    """A2: the last shard by name is ``val``, all others ``train`` (one shard: train empty).

    The last shard is a scalar subquery (one value), not a join.
    """
    if split not in ("train", "val"):
        raise ValueError("split must be train|val")
    last = df.select(F.max(shard)).scalar()
    return df.where(F.col(shard) == last) if split == "val" else df.where(F.col(shard) != last)


def shard_index(df: DataFrame, shard: str = "shard", out: str = "shard_idx") -> DataFrame:
    """0-based position of each shard in name order (file list: bounded, broadcast)."""
    shards = df.select(shard).distinct()
    from pyspark.sql import Window
    idx = shards.withColumn(out, (F.row_number().over(Window.orderBy(shard)) - 1).cast("bigint"))
    return df.join(broadcast_small(idx, "shard list"), shard)


def repeat_epochs(df: DataFrame, n: int, out: str = "epoch") -> DataFrame:
    """The corpus ``n`` times with ``epoch`` = 1..n (a generator, not a join)."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(n))))


def resume_after(df: DataFrame, pq_idx: int, rg_idx: int, epoch: int, rank: int, world: int,
                 shard_idx: str = "shard_idx", row_group: str = "row_group", ep: str = "epoch") -> DataFrame:
    """A5: what a rank reads after the saved position ``(pq_idx, rg_idx, epoch)``.

    In the saved shard the rank restarts at ``(rg_idx // world + 1) * world + rank``;
    later shards and epochs start at ``rank``; partly used groups are skipped.
    """
    start = (rg_idx // world + 1) * world
    e, s, g = F.col(ep), F.col(shard_idx), F.col(row_group)
    after = (e > epoch) | ((e == epoch) & ((s > pq_idx) | ((s == pq_idx) & (g >= start))))
    return rank_stride(df.where(after), rank, world, idx=row_group)


def chunk_texts(df: DataFrame, size: int = 128, keys=("shard", "row_group"), pos: str = "pos") -> DataFrame:
    """Batches of at most ``size`` documents that never cross a row group.

    Groups are bounded by ``size`` by construction.
    """
    k = list(keys)
    return (df.withColumn("chunk", (F.col(pos) / size).cast("bigint"))
            .groupBy(*k, "chunk")
            .agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col("text")))).alias("docs")))


def shard_manifest(spark: SparkSession, n_train: int, max_shard: int, present: DataFrame | None = None,
                   name: str = "shard") -> DataFrame:
    """The first ``n_train`` train shards plus always the last (val) shard,
    minus those already present (left anti join)."""
    n = max_shard if n_train < 0 else min(n_train, max_shard)
    ids = spark.range(n).union(spark.range(max_shard, max_shard + 1))
    wanted = ids.select(F.col("id").alias("shard_id"),
                        F.format_string("shard_%05d.parquet", F.col("id")).alias(name))
    return wanted if present is None else wanted.join(present.select(name).distinct(), name, "left_anti")
