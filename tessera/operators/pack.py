"""Best-fit packing of token sequences into fixed-length rows.

Rules.  Documents of a lane arrive in ``idx`` order, in batches of ``refill``.  A document
is picked only while the buffer holds ``buffer_size`` or more (so the buffer is refilled
before every pick, in the middle of a row too): the longest that fits into the rest of the
row, or, if none fits, the shortest, cropped to the rest.  Of equal lengths the one that
arrived first is picked.  A finite lane ends without refills: picking goes on until the
buffer is empty, and what is left in the open row is put out as an incomplete row, so
tokens in = kept + cropped + left.

Packing is sequential inside a lane, so a lane is one ordered stream over a bounded buffer
(``repartition`` + ``sortWithinPartitions`` + ``mapInPandas``).  Lanes come from data, such as
(shard, row group), and their number grows with it; they never depend on the cluster.  The
streaming form (L1) keeps the same state between micro-batches.
"""

from __future__ import annotations

import sys
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tessera.session import bound_batches, ensure_shipped

POSITION = ("pq_idx", "rg_idx", "epoch")
OUT_SCHEMA = ("lane string, row_no bigint, tokens array<int>, last_idx bigint, n_docs int, n_cropped int, complete boolean, "
              "pq_idx bigint, rg_idx bigint, epoch bigint")
OUT_COLS = ["lane", "row_no", "tokens", "last_idx", "n_docs", "n_cropped", "complete", *POSITION]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LanePacker:
    """The state of one lane; rows come out of ``add`` and ``finish``."""

    def __init__(self, lane, T: int, buffer_size: int, refill: int):
        self.lane, self.width, self.buffer_size, self.refill = lane, T + 1, buffer_size, refill
        self.by_length: list[tuple[int, int]] = []  # (length, -turn): of one length, the oldest is last
        self.docs: dict[int, tuple[int, list[int]]] = {}  # turn -> (idx, tokens)
        self.batch: list = []
        self.turn = self.row_no = 0
        self.place = [None] * 3
        self._open()

    def _open(self):
        self.row, self.n_docs, self.n_cropped, self.last_idx = [], 0, 0, None

    def _close(self, complete: bool):
        out = (self.lane, self.row_no, self.row, self.last_idx, self.n_docs, self.n_cropped, complete, *self.place)
        self.row_no += 1
        self._open()
        return out

    def _load(self):
        for idx, tokens, place in self.batch:
            self.docs[self.turn] = (idx, tokens)
            insort(self.by_length, (len(tokens), -self.turn))
            self.turn += 1
            self.place = place
        self.batch = []

    def _pick(self):
        """Move one document into the open row; the row, if that fills it."""
        rest = self.width - len(self.row)
        # turns are negated, so (n, 1) is beyond all documents of length n and the oldest of them is last
        fits = bisect_right(self.by_length, (rest, 1))
        at = (fits or bisect_right(self.by_length, (self.by_length[0][0], 1))) - 1
        length, turn = self.by_length.pop(at)
        idx, tokens = self.docs.pop(-turn)
        self.row += tokens[:rest]
        self.n_cropped += max(0, length - rest)
        self.n_docs += 1
        self.last_idx = idx if self.last_idx is None else max(self.last_idx, idx)
        return [self._close(True)] if len(self.row) == self.width else []

    def add(self, idx: int, tokens, place=(None, None, None)):
        """One more document; the rows that it completes."""
        self.batch.append((int(idx), np.asarray(tokens).tolist(), list(place)))
        out = []
        if len(self.batch) == self.refill:
            self._load()
            while len(self.docs) >= self.buffer_size:
                out += self._pick()
        return out

    def finish(self):
        """No more documents: the rows that the buffer fills, and the incomplete one."""
        self._load()
        out = []
        while self.docs:
            out += self._pick()
        return out + ([self._close(False)] if self.n_docs else [])

    def state(self):
        docs = [(n, -t, *self.docs[-t]) for n, t in self.by_length]
        return (docs, self.batch, self.turn, self.row_no, self.row, self.n_docs, self.n_cropped, self.last_idx, self.place)

    def restore(self, state):
        docs, batch, self.turn, self.row_no, row, self.n_docs, self.n_cropped, self.last_idx, place = state
        self.by_length = [(n, -t) for n, t, _, _ in docs]
        self.docs = {t: (i, list(x)) for _, t, i, x in docs}
        self.batch = [(i, list(x), list(p)) for i, x, p in batch]
        self.row, self.place = list(row), list(place)
        return self


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=OUT_COLS).astype({c: "Int64" for c in ("last_idx", *POSITION)})


def _places(f: pd.DataFrame):
    return ([None if pd.isna(x) else int(x) for x in p] for p in f[list(POSITION)].itertuples(index=False))


def _pack_partition(T: int, buffer_size: int, refill: int):
    def fn(frames):
        packer = None
        for f in frames:
            out = []
            for lane, idx, tokens, place in zip(f["lane"], f["idx"], f["tokens"], _places(f), strict=True):
                if packer is None or lane != packer.lane:
                    out += packer.finish() if packer else []
                    packer = LanePacker(lane, T, buffer_size, refill)
                out += packer.add(idx, tokens, place)
            if out:
                yield _frame(out)
        if packer and (out := packer.finish()):
            yield _frame(out)
    return fn


def _lane_input(df: DataFrame, lane: str, order: str, tokens: str) -> DataFrame:
    place = [F.col(c).cast("bigint").alias(c) if c in df.columns else F.lit(None).cast("bigint").alias(c) for c in POSITION]
    return df.select(F.col(lane).cast("string").alias("lane"), F.col(order).cast("bigint").alias("idx"), F.col(tokens).alias("tokens"), *place)


def pack_bestfit(df: DataFrame, T: int, buffer_size: int = 1000, refill: int = 128, lane: str = "lane",
                 order: str = "idx", tokens: str = "tokens", num_partitions: int | None = None, incomplete: bool = False) -> DataFrame:
    """rows of ``T + 1`` tokens, without padding; every document starts with bos if the encoder
    prepended it.  ``pq_idx``, ``rg_idx`` and ``epoch`` of ``df``, where there, give each row the position of the
    newest document loaded when it was filled.  ``incomplete``: also each lane's last, unfilled row (F7 needs it)."""
    spark = df.sparkSession
    ensure_shipped(spark)
    bound_batches(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # range partitioning spreads the lanes evenly; hashing few of them may collide
    s = _lane_input(df, lane, order, tokens).repartitionByRange(n, "lane").sortWithinPartitions("lane", "idx")
    rows = s.mapInPandas(_pack_partition(T, buffer_size, refill), OUT_SCHEMA)
    return rows if incomplete else rows.where("complete")


class _BufferedDocs(dict):
    """turn -> (idx, tokens) of the buffered documents; those of earlier micro-batches are read when they are picked."""

    def __init__(self, entries, sizes, old):
        super().__init__()
        self.entries, self.sizes, self.old = entries, sizes, old

    def __len__(self):
        return super().__len__() + len(self.old)

    def pop(self, turn):
        if turn not in self.old:
            return super().pop(turn)
        self.old.remove(turn)
        idx, tokens, *_ = self.entries.getValue((turn,))
        self.entries.removeKey((turn,))
        self.sizes.removeKey((turn,))
        return idx, list(tokens)


class LaneProcessor(StatefulProcessor):
    """A lane's packer between micro-batches: one state entry for each document that waits or is buffered, their
    lengths apart, and the open row.  A micro-batch reads the lengths and the documents that it picks, and writes
    its own documents that stay; the others are not touched."""

    def __init__(self, T: int, buffer_size: int, refill: int):
        self.options = T, buffer_size, refill

    def init(self, handle):
        self.head = handle.getValueState("head", "turn bigint, loaded bigint, row_no bigint, open array<int>, n_docs int, n_cropped int, "
                                                 "last_idx bigint, place array<bigint>")
        self.entries = handle.getMapState("documents", "turn bigint", "idx bigint, tokens array<int>, place array<bigint>")
        self.sizes = handle.getMapState("lengths", "turn bigint", "length int")

    def handleInputRows(self, key, rows, timerValues):
        packer = LanePacker(key[0], *self.options)
        size = {int(t[0]): int(n[0]) for t, n in self.sizes.iterator()}
        turn = loaded = 0
        if self.head.exists():
            turn, loaded, packer.row_no, row, packer.n_docs, packer.n_cropped, packer.last_idx, place = self.head.get()
            packer.row, packer.place = [int(x) for x in row], list(place)
        buffered = {t for t in size if t < loaded}
        packer.turn, packer.by_length = loaded, sorted((size[t], -t) for t in buffered)
        packer.docs = _BufferedDocs(self.entries, self.sizes, buffered)
        waiting = range(loaded, turn)  # fewer than a refill
        for t in waiting:
            idx, tokens, place = self.entries.getValue((t,))
            packer.batch.append((int(idx), [int(x) for x in tokens], list(place)))
        f = pd.concat(list(rows), ignore_index=True).sort_values("idx", kind="stable")
        out, places = [], {t: b[2] for t, b in zip(waiting, packer.batch, strict=True)}
        for idx, tokens, place in zip(f["idx"], f["tokens"], _places(f), strict=True):
            places[turn] = place
            turn += 1
            out += packer.add(idx, tokens, place)
        for t in waiting:
            if t < packer.turn and t not in packer.docs:  # loaded and picked since
                self.entries.removeKey((t,))
                self.sizes.removeKey((t,))
        stay = {t: (*packer.docs[t], places[t]) for t in packer.docs} | {packer.turn + i: b for i, b in enumerate(packer.batch)}
        for t, (idx, tokens, place) in stay.items():
            if t not in size:
                self.entries.updateValue((t,), (idx, tokens, place))
                self.sizes.updateValue((t,), (len(tokens),))
        self.head.update((turn, packer.turn, packer.row_no, packer.row, packer.n_docs, packer.n_cropped, packer.last_idx, packer.place))
        if out:
            yield _frame(out)

    def close(self):
        pass


def stream_pack(stream: DataFrame, T: int, buffer_size: int = 1000, refill: int = 128, lane: str = "lane",
                order: str = "idx", tokens: str = "tokens") -> DataFrame:
    """L1: F6 over an endless feed; a lane's documents are keyed state (``transformWithStateInPandas``, append mode,
    RocksDB).  A micro-batch's documents of a lane are taken in ``idx`` order, whatever Arrow batches they come
    in, so the rows equal the batch form's complete rows as long as later micro-batches have larger ``idx``;
    documents that still wait or stand in the buffer are the state, not yet rows."""
    spark = stream.sparkSession
    ensure_shipped(spark)
    bound_batches(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only store with keyed state of several kinds
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)  # state is declared by a process that knows no shipped files
    try:
        return _lane_input(stream, lane, order, tokens).groupBy("lane").transformWithStateInPandas(
            LaneProcessor(T, buffer_size, refill), OUT_SCHEMA, "Append", "None")
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def packing_stats(docs: DataFrame, rows: DataFrame, T: int, tokens: str = "tokens") -> DataFrame:
    """tokens in, kept, cropped, left in incomplete rows; complete rows, utilisation.  ``rows`` is F6's
    output with its incomplete rows."""
    tin = docs.agg(F.sum(F.size(tokens)).cast("bigint").alias("tokens_in"))
    size = F.size("tokens")
    r = rows.agg(F.sum(F.col("complete").cast("bigint")).alias("rows"), F.sum("n_cropped").cast("bigint").alias("tokens_cropped"),
                 F.sum(F.when(F.col("complete"), size).otherwise(0)).cast("bigint").alias("tokens_kept"),
                 F.sum(F.when(F.col("complete"), 0).otherwise(size)).cast("bigint").alias("tokens_left"))
    j = r.withColumn("tokens_in", tin.scalar())  # scalar subquery, one value
    return (j.withColumn("tokens_lost", F.col("tokens_in") - F.col("tokens_kept"))
            .withColumn("lost_share", F.col("tokens_lost") / F.col("tokens_in"))
            .withColumn("utilisation", F.col("tokens_kept") / (F.col("rows") * (T + 1))))
