"""Row groups of Parquet shards as the files themselves have them.

Footers are read by tasks, one file after the other; no data page is.  Paths are opened by Arrow's
file systems (local, HDFS, S3, GCS, ...).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_shipped

FOOTERS = "file string, shard string, starts array<bigint>, n_rows bigint"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(path)


def shard_files(path: str) -> list[str]:
    """The ``*.parquet`` files of a folder (or the one file that ``path`` is) in name order, as paths of its file system."""
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [inner]
    files = fs.get_file_info(pafs.FileSelector(inner))
    return [f.path for f in sorted(files, key=lambda f: f.base_name) if f.type == pafs.FileType.File and f.base_name.endswith(".parquet")]


def group_starts(path: str) -> list[int]:
    """First row of each row group, then the number of rows."""
    fs, inner = file_system(path)
    with fs.open_input_file(inner) as f:
        meta = pq.ParquetFile(f).metadata
    starts = [0]
    for i in range(meta.num_row_groups):
        starts.append(starts[-1] + meta.row_group(i).num_rows)
    return starts


def footers(spark: SparkSession, path: str) -> DataFrame:
    """``FOOTERS`` of the ``*.parquet`` files under ``path``: the list comes from Spark (no content is read), the footers from tasks."""
    ensure_shipped(spark)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("shard")))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            starts = [group_starts(x) for x in f["file"]]
            yield f.assign(starts=[s[:-1] for s in starts], n_rows=[s[-1] for s in starts])
    return files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(read, FOOTERS)


def group_of(pos: Column, starts: Column) -> Column:
    """Number of the row group that holds row ``pos``; empty groups hold none."""
    return (F.size(F.filter(starts, lambda s: s <= pos)) - 1).cast("bigint")
