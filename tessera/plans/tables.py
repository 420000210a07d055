"""Driver tables: one parquet file per table under an sf directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A driver table.  With ``spread``, a scan that yields fewer input splits
    than the session's parallelism (a small file with a single row group) is
    round-robin repartitioned so narrow per-row work uses every core; a large
    table with many splits is left alone (no extra shuffle at scale).  Column
    pruning and filters still reach the parquet scan below the repartition."""
    if name not in TABLES:
        raise KeyError(name)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_small_scan(df) if spread else df


def spread_small_scan(df: DataFrame) -> DataFrame:
    """Round-robin repartition a scan only when it yields fewer input splits than the
    session's cores (e.g. one file with one row group); many-split inputs are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
