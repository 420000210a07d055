"""Token-sequence (array) operators F1-F5 and F8.

Per-item groups here are the options of one item (a handful of arrays), so
collecting them is bounded by construction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_shipped


def sequences(long: DataFrame, keys: list[str], pos: str = "pos", token: str = "token", out: str = "tokens") -> DataFrame:
    """Long ``(keys, pos, token)`` rows -> one ordered token array per key."""
    return long.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, token))),
                                               lambda x: x.getField(token)).alias(out))


def common_length_expr(seqs: Column, side: str = "left") -> Column:
    """F1 on an array of arrays: common prefix ('left') or suffix ('right') length;
    the whole minimum length when no position differs."""
    if side == "right":
        seqs = F.transform(seqs, lambda s: F.reverse(s))
    min_len = F.array_min(F.transform(seqs, lambda s: F.size(s)))
    first = F.element_at(seqs, 1)
    diffs = F.filter(F.sequence(F.lit(1), F.greatest(min_len, F.lit(1))),
                     lambda i: (i <= min_len) & F.exists(seqs, lambda s: F.element_at(s, i) != F.element_at(first, i)))
    return F.when(F.size(diffs) > 0, F.array_min(diffs) - 1).otherwise(min_len)


def _lcp(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    diffs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                     lambda i: (i <= n) & (F.element_at(a, i) != F.element_at(b, i)))
    return F.when(F.size(diffs) > 0, F.array_min(diffs) - 1).otherwise(n)


def common_length(df: DataFrame, item: str, tokens: str = "tokens", side: str = "left", out: str = "common",
                  order: str = "option_idx") -> DataFrame:
    """per item, the common prefix ('left') or suffix ('right') length of all
    its sequences; the whole minimum length when no position differs.

    Without gathering an item's sequences: the common prefix of a set is the
    minimum over its members of their common prefix with the first member
    (lowest ``order``).  The first member per item is a partial-aggregated
    ``min(struct)``, joined back by item; the final ``min`` is partial too.
    """
    both = common_lengths(df, item, tokens, order)
    return both.select(item, F.col("prefix_len" if side == "left" else "suffix_len").alias(out))


def common_lengths(df: DataFrame, item: str, tokens: str = "tokens", order: str = "option_idx") -> DataFrame:
    """F1, both sides at once: (item, prefix_len, suffix_len) from one join with the items' first sequences
    and one aggregate (a side that is not read is pruned)."""
    seqs = df.select(item, order, F.col(tokens).alias("_t"))
    first = seqs.groupBy(item).agg(F.min(F.struct(order, "_t")).getField("_t").alias("_t0"))
    t, t0 = F.col("_t"), F.col("_t0")
    return seqs.join(first, item).groupBy(item).agg(F.min(_lcp(t, t0)).alias("prefix_len"),
                                                    F.min(_lcp(F.reverse(t), F.reverse(t0))).alias("suffix_len"))


def answer_spans(df: DataFrame, task_type: str | list[str], item: str = "item_id", tokens: str = "tokens",
                 tokens_without: str | None = None) -> DataFrame:
    """answer span ``[start, end)`` per option sequence.

    mc: start = common prefix, end = own length; schema: start = end - common
    suffix; lm: start = length without, end = length with, and ``ok`` checks
    that "without" is a strict prefix of "with".  Of a list of mc and schema,
    ``<type>_start`` for each from one pass.
    """
    if isinstance(task_type, list):
        j = df.join(common_lengths(df, item, tokens), item).withColumn("end", F.size(tokens))
        starts = {"multiple_choice": F.col("prefix_len"), "schema": F.col("end") - F.col("suffix_len")}
        return j.select(*df.columns, "end", *[starts[t].alias(f"{t}_start") for t in task_type])
    if task_type == "language_modeling":
        w, t = F.col(tokens_without), F.col(tokens)
        ok = (F.size(w) < F.size(t)) & (F.slice(t, 1, F.size(w)) == w)
        return df.withColumn("start", F.size(w)).withColumn("end", F.size(t)).withColumn("ok", ok)
    side = "left" if task_type == "multiple_choice" else "right"
    if task_type not in ("multiple_choice", "schema"):
        raise ValueError(f"unsupported task type {task_type}")
    c = common_length(df, item, tokens, side)
    j = df.join(c, item)
    end = F.size(tokens)
    start = F.col("common") if side == "left" else end - F.col("common")
    return j.withColumn("start", start).withColumn("end", end).withColumn("ok", F.lit(True)).drop("common")


def truncate_left(df: DataFrame, max_len: int, tokens: str = "tokens") -> DataFrame:
    """keep the last ``max_len`` tokens and shift start/end; a negative index is an error row."""
    t = F.col(tokens)
    crop = F.greatest(F.size(t) - max_len, F.lit(0))
    return (df.withColumn("start", F.col("start") - crop).withColumn("end", F.col("end") - crop)
            .withColumn(tokens, F.when(F.size(t) > max_len, F.slice(t, -max_len, max_len)).otherwise(t))
            .withColumn("ok", F.col("ok") & (F.col("start") >= 0) & (F.col("end") >= 0)))


def pad_right(df: DataFrame, batch: str, pad_id: int, tokens: str = "tokens") -> DataFrame:
    """pad to the longest sequence of the batch; remember the true last position."""
    w = Window.partitionBy(batch)
    longest = F.max(F.size(tokens)).over(w)
    t = F.col(tokens)
    return (df.withColumn("last_pos", F.size(t) - 1)
            .withColumn(tokens, F.concat(t, F.array_repeat(F.lit(pad_id), longest - F.size(t)))))


def inputs_targets(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """a row of T+1 tokens -> inputs ``[:-1]`` and targets ``[1:]``."""
    t = F.col(tokens)
    n = F.size(t) - 1
    return df.withColumn("inputs", F.slice(t, 1, n)).withColumn("targets", F.slice(t, 2, n))


def bin_by_sequence_cap(df: DataFrame, cap: int, n_per_item: int, idx: str = "idx") -> DataFrame:
    """F8 (constant n per item): greedy batches of whole items under ``cap`` sequences;
    an oversized item stands alone."""
    per = max(1, cap // n_per_item)
    return df.withColumn("batch", (F.col(idx) / per).cast("bigint"))


BIN_SCHEMA = "lane bigint, idx bigint, n int, batch bigint"


def _chunk_effect(n: list[int], cap: int) -> tuple[list[int], list[int]]:
    """For every count that the open batch may have before these items (0 to ``cap`` + 1, which stands for all above):
    the count after them, and the batches closed meanwhile."""
    count, closed = np.arange(cap + 2), np.zeros(cap + 2, np.int64)
    back = np.arange(cap + 2)  # counts that have become equal go on as one
    for at, k in enumerate(n):
        flush = (count > 0) & (count + k > cap)
        count = np.minimum(np.where(flush, k, count + k), cap + 1)
        closed = closed + flush
        if len(count) > 1 and (at % 16 == 0):
            both, first, inverse = np.unique(np.stack([count, closed]), axis=1, return_index=True, return_inverse=True)
            count, closed, back = both[0], both[1], inverse.ravel()[back]
    return count[back].tolist(), closed[back].tolist()


def bin_by_sequence_cap_var(df: DataFrame, cap: int, n: str = "n", lane: str = "lane", idx: str = "idx",
                            num_partitions: int | None = None, chunk_rows: int = 1 << 16) -> DataFrame:
    """F8 (variable n): greedy batches in ``idx`` order per lane: flush when
    ``count + n > cap`` and the batch is not empty; an oversized item stands alone.

    A lane is cut into chunks of ``chunk_rows`` consecutive ``idx`` values, which run in parallel: first each chunk
    gives its effect for every count that the open batch may have before it (``cap`` + 2 numbers), then these are
    chained lane by lane (a row per chunk), then each chunk runs from the count and batch it starts with.
    """
    ensure_shipped(df.sparkSession)
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    i = F.col(idx).cast("bigint")
    rows = df.select(F.col(lane).cast("bigint").alias("lane"), i.alias("idx"), F.col(n).cast("int").alias("n"),
                     F.floor(i / chunk_rows).cast("bigint").alias("chunk"))
    sort = lambda d, by: d.repartition(parts, *by).sortWithinPartitions(*by, *(["idx"] if "idx" in d.columns else []))

    def effects(frames):
        key, held = None, []
        for f in frames:
            out = []
            for k, g in f.groupby(["lane", "chunk"], sort=False):
                if key is not None and k != key:
                    out.append((*key, *_chunk_effect(held, cap)))
                    held = []
                key = k
                held += g["n"].tolist()
            if out:
                yield pd.DataFrame(out, columns=["lane", "chunk", "counts", "closed"])
        if key is not None:
            yield pd.DataFrame([(*key, *_chunk_effect(held, cap))], columns=["lane", "chunk", "counts", "closed"])

    def chain(frames):
        now, count, batch = None, 0, 0
        for f in frames:
            out = []
            for ln, ch, counts, closed in zip(f["lane"], f["chunk"], f["counts"], f["closed"], strict=True):
                if ln != now:
                    now, count, batch = ln, 0, 0
                out.append((ln, ch, count, batch))
                batch, count = batch + int(closed[count]), int(counts[count])
            yield pd.DataFrame(out, columns=["lane", "chunk", "count0", "batch0"])

    def run(frames):
        now, count, batch = None, 0, 0
        for f in frames:
            out = []
            for ln, ch, k, c0, b0 in zip(f["lane"], f["chunk"], f["n"], f["count0"], f["batch0"], strict=True):
                if (ln, ch) != now:
                    now, count, batch = (ln, ch), c0, b0
                if count > 0 and count + k > cap:
                    batch, count = batch + 1, 0
                count = min(count + k, cap + 1)
                out.append(batch)
            yield f[["lane", "idx", "n"]].assign(batch=out)
    effect = sort(rows, ["lane", "chunk"]).mapInPandas(effects, "lane bigint, chunk bigint, counts array<int>, closed array<bigint>")
    starts = (effect.repartition(parts, "lane").sortWithinPartitions("lane", "chunk")
              .mapInPandas(chain, "lane bigint, chunk bigint, count0 int, batch0 bigint"))
    return sort(rows.join(starts, ["lane", "chunk"]), ["lane", "chunk"]).mapInPandas(run, BIN_SCHEMA)
