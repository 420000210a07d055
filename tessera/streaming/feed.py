"""An endless, resumable feed of the corpus as a streaming source.

The offset is the position (epoch, pq_idx, rg_idx) of the next row group: shards in name order, row
groups in file order, then the next epoch, for ever or for a given number of epochs.  Spark's
checkpoint holds it, so a stopped query goes on where it ended.  Row groups are read by tasks; the
source itself opens footers only, one for each shard that it passes.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.session import ensure_shipped
from tessera.sources import rowgroups
from tessera.sources.rowgroups import file_system, group_starts, shard_files

NAME = "tessera_corpus"
FEED = "text string, shard string, epoch bigint, pq_idx bigint, rg_idx bigint, pos bigint"
BATCH_ROWS = 1024


class RowGroups(InputPartition):
    """What one task reads: (file, epoch, pq_idx, rg_idx, first row) of each row group."""

    def __init__(self, groups: list[tuple[str, int, int, int, int]]):
        self.groups = groups


class CorpusReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.column = options["path"], options.get("column", "text")
        self.per_batch, self.epochs = int(options.get("groups_per_batch", "64")), int(options.get("epochs", "0"))
        self.per_task = int(options.get("groups_per_task", "1"))
        self.rank, self.world = int(options.get("rank", "0")), int(options.get("world", "1"))
        if self.per_batch < 1 or self.per_task < 1 or not 0 <= self.rank < self.world:
            raise ValueError("need groups_per_batch >= 1, groups_per_task >= 1 and 0 <= rank < world")
        split = options.get("split", "all")
        files = shard_files(self.path)
        if split not in ("all", "train", "val"):
            raise ValueError("split must be all|train|val")
        self.files = files if split == "all" else files[:-1] if split == "train" else files[-1:]
        self.starts: dict[int, list[int]] = {}
        self.now: tuple[int, int, int] | None = None

    def _starts(self, pq_idx: int) -> list[int]:
        if pq_idx not in self.starts:
            scheme = self.path.partition("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
            self.starts = {pq_idx: group_starts(scheme + self.files[pq_idx])}  # the shard being passed
        return self.starts[pq_idx]

    def _settled(self, at: tuple[int, int, int]) -> tuple[int, int, int]:
        """``at``, or the first row group after it where it is past the end of a shard or of the shards."""
        epoch, shard, group = at
        empty = 0
        while self.files and empty <= len(self.files) and not (self.epochs and epoch > self.epochs):
            if shard == len(self.files):
                epoch, shard, group = epoch + 1, 0, 0
            elif group >= len(self._starts(shard)) - 1:
                shard, group, empty = shard + 1, 0, empty + (group == 0)
            else:
                break
        return at if empty > len(self.files) else (epoch, shard, group)  # no shard has a row group

    def _ended(self, at) -> bool:
        return not self.files or bool(self.epochs and at[0] > self.epochs) or at[1] == len(self.files) or at[2] >= len(self._starts(at[1])) - 1

    def _offset(self, at) -> dict:
        return {"epoch": at[0], "pq_idx": at[1], "rg_idx": at[2]}

    def initialOffset(self) -> dict:
        return self._offset((1, 0, 0))

    def latestOffset(self) -> dict:
        at = self._settled(self.now or (1, 0, 0))
        for _ in range(self.per_batch):
            if self._ended(at):
                break
            at = self._settled((at[0], at[1], at[2] + 1))
        self.now = at
        return self._offset(at)

    def partitions(self, start: dict, end: dict):
        stop = (end["epoch"], end["pq_idx"], end["rg_idx"])
        if self.now is None:  # a restarted query plans its last batch first
            self.now = stop
        at, out = self._settled((start["epoch"], start["pq_idx"], start["rg_idx"])), []
        while at < stop and not self._ended(at):
            if at[2] % self.world == self.rank:
                out.append((self.files[at[1]], *at, self._starts(at[1])[at[2]]))
            at = self._settled((at[0], at[1], at[2] + 1))
        return [RowGroups(out[i:i + self.per_task]) for i in range(0, len(out), self.per_task)]

    def read(self, partition: RowGroups):
        fs, _ = file_system(self.path)
        for file, epoch, pq_idx, rg_idx, pos in partition.groups:
            with fs.open_input_file(file) as f:
                for b in pq.ParquetFile(f).iter_batches(BATCH_ROWS, row_groups=[rg_idx], columns=[self.column]):
                    n = b.num_rows
                    same = [pa.array(np.full(n, x, np.int64)) for x in (epoch, pq_idx, rg_idx)]
                    yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array([file.rpartition("/")[2]] * n), *same,
                                                      pa.array(np.arange(pos, pos + n))], ["text", "shard", "epoch", "pq_idx", "rg_idx", "pos"])
                    pos += n


class CorpusSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return FEED

    def streamReader(self, schema):
        return CorpusReader(self.options)


def corpus_feed(spark: SparkSession, path: str, groups_per_batch: int = 64, epochs: int | None = None, split: str = "all", rank: int = 0,
                world: int = 1, column: str = "text", groups_per_task: int = 1) -> DataFrame:
    """A17 over the ``*.parquet`` shards of a folder: (text, shard, epoch, pq_idx, rg_idx, pos), ``groups_per_batch`` row groups
    a micro-batch, ``groups_per_task`` of them a task (more than one where they are small), epochs from 1 on, without end
    unless ``epochs`` is given.

    ``split``: all shards, all but the last by name (train) or the last (val).  A rank of ``world`` gets the row groups
    with ``rg_idx % world == rank`` (A3).  Shards are listed when the query starts; a resumed query expects the same list.
    """
    ensure_shipped(spark)
    for module in (rowgroups, sys.modules[__name__]):  # the source is planned by a process that knows no shipped files
        cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(CorpusSource)
        reader = spark.readStream.format(NAME).option("path", path).option("column", column)
        options = {"groups_per_batch": groups_per_batch, "epochs": epochs or 0, "split": split, "rank": rank, "world": world,
                   "groups_per_task": groups_per_task}
        return reader.options(**{k: str(v) for k, v in options.items()}).load()
    finally:
        for module in (rowgroups, sys.modules[__name__]):
            cloudpickle.unregister_pickle_by_value(module)


def run_to_end(stream: DataFrame, out: str, progress: str) -> None:
    """Run a feed of a given number of epochs until it has nothing left, appending Parquet under ``out``; with the same
    ``progress`` folder a later run goes on where the last one ended."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
