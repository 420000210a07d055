"""Hard negatives by threshold joins over an inverted index (after L2AP).

A window asks for the best k rows of one anchor with scores between two bounds: the positives of an
anchor (same label, no bounds), then for each positive the rows of other labels whose score is 30 to
90 hundredths of the positive's.  All windows start with a high threshold and are joined with the
rows; windows that stay unfilled go on with a lower one, at last with their own lower bound.  A
window that is filled above its threshold is exact, as every row above it was found.

A join works on blocks of rows and of anchors.  A block's rows are indexed by groups of dimensions
in order of the anchors' energy; a row is left out of the lists of all groups from which on its
norm cannot reach the smallest threshold with any anchor.  Partial scores are accumulated list by
list, pairs are pruned by the norms that remain, and what is left is scored on whole vectors.

First thresholds come from the mean and the variance of each dimension over all rows, as if scores
were normal; they decide how much is searched, never what is found.  What passes the driver are two
numbers for each dimension and counts.
"""

from __future__ import annotations

from functools import reduce
from math import erf, inf, isinf, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare, written

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score in hundredths of the positive's
ANCHOR_EVERY, RELABEL_EVERY, LABELS, SCALE = 100, 7, 10, 256
BLOCK_ROWS, BLOCK_ANCHORS = 8_192, 2_048
STEP = 256  # anchors joined with a block of rows at a time
GROUPS = 4  # groups of dimensions, each a step of accumulation
FIRST, WIDER = 4, 16  # rows expected above the first threshold for each wanted one; growth of that number by round

FOUND = "anchor_id bigint, win int, vec_id bigint, score bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, comps): one row for each vec_id that takes part, its label as used, comps as doubles.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part.  Of rows
    with the same vec_id that of the smallest label, then vector, counts.  Scores are sums of doubles, so they
    are exact up to 2^53.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(inf)))
    rows = (embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("embedding"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(bad, F.lit(True))))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("r.label") + 1) % LABELS).otherwise(F.col("r.label"))
    return rows.select("vec_id", label.alias("label"), F.transform("r.embedding", lambda v: F.floor(v * SCALE).cast("double")).alias("comps"))


def _stacked(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < np.diff(column.offsets.to_numpy())[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def joined(x: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray):
    """All pairs of an anchor ``q[i]`` and a row ``x[j]`` with low[i] <= score <= high[i]: yields (i, j, score)
    for some anchors at a time."""
    order = np.argsort(-(q * q).sum(0), kind="stable")
    x, q = x[:, order], q[:, order]
    cut = np.linspace(0, x.shape[1], GROUPS + 1).astype(int)
    rest = lambda m: np.sqrt(np.stack([(m[:, c:] ** 2).sum(1) for c in cut], 1))  # noqa: E731  norms from each group on
    rx, rq = rest(x), rest(q)
    # a row is in no list from the group on where the rest of it cannot reach any anchor's threshold
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(low[:, None] > 0, low[:, None] / rq, 0.0).min(0) * (1 - 1e-9)
    depth = (rx[:, :GROUPS] >= need[:GROUPS]).sum(1)
    by = np.argsort(-depth, kind="stable")
    x, rx, depth = x[by], rx[by], depth[by]
    listed = [int((depth > g).sum()) for g in range(GROUPS)]
    n = listed[0]
    for a in range(0, len(q) if n else 0, STEP):
        qa, ra, lo, hi = q[a:a + STEP], rq[a:a + STEP], low[a:a + STEP, None], high[a:a + STEP, None]
        slack = 0.5 + 1e-9 * ra[:, :1] * rx[:, 0].max()
        acc = np.zeros((len(qa), n))
        i = None
        for g in range(GROUPS):
            d, to = slice(cut[g], cut[g + 1]), np.minimum(g + 1, depth[:n])  # a list that ended leaves its bound as it was
            if i is None:
                acc[:, :listed[g]] += qa[:, d] @ x[:listed[g], d].T
                left = ra[:, to] * rx[np.arange(n), to] + slack
                alive = (acc + left >= lo) & (acc - left <= hi)
                if alive.mean() < 1 / 16:
                    i, j = np.nonzero(alive)
                    s = acc[i, j]
                continue
            s = s + np.where(g < depth[j], (qa[i, d] * x[j, d]).sum(1), 0.0)
            left = ra[i, to[j]] * rx[j, to[j]] + slack[i, 0]
            keep = (s + left >= lo[i, 0]) & (s - left <= hi[i, 0])
            i, j, s = i[keep], j[keep], s[keep]
        if i is None:  # most pairs are wanted
            score = qa @ x[:n].T
            i, j = np.nonzero((score >= lo) & (score <= hi))
            s = score[i, j]
        else:
            s = np.einsum("ij,ij->i", qa[i], x[j])
            keep = (s >= lo[i, 0]) & (s <= hi[i, 0])
            i, j, s = i[keep], j[keep], s[keep]
        yield i + a, by[j], s


def _find(rows: DataFrame, todo: DataFrame, k: int, dims: int, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """``FOUND``: for each window of ``todo`` the best k rows of each block between its threshold and its bound."""
    def task(block: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and asked.num_rows:
            ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
            anchors, own = asked.column("anchor_id").to_numpy(), asked.column("own").to_numpy()
            windows = asked.column("windows").to_pylist()
            low = np.array([min(w["lo"] for w in ws) for ws in windows])
            high = np.array([max(w["hi"] for w in ws) for ws in windows])
            for i, j, s in joined(_stacked(block.column("comps"), dims), _stacked(asked.column("anchor"), dims), low, high):
                by = np.lexsort((ids[j], -s, i))
                i, j, s = i[by], j[by], s[by]
                for at in np.unique(i).tolist():
                    part = slice(np.searchsorted(i, at), np.searchsorted(i, at, "right"))
                    same, score, vec = labels[j[part]] == own[at], s[part], ids[j[part]]
                    for w in windows[at]:
                        fits = (same == w["same"]) & (vec != anchors[at]) & (score >= w["lo"]) & (score <= w["hi"])
                        best = np.flatnonzero(fits)[:k]
                        out.append((np.full(len(best), anchors[at]), np.full(len(best), w["win"], np.int32), vec[best], score[best].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]
        return pa.table(dict(zip(("anchor_id", "win", "vec_id", "score"), cols, strict=True)))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("rb"), every(anchor_blocks).alias("ab"),
                        "vec_id", "label", "comps")
    asked = todo.groupBy("anchor_id").agg(F.collect_list(F.struct("win", "same", "lo", "hi")).alias("windows"))  # one for each positive at most
    anchors = rows.select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("comps").alias("anchor"))
    asked = anchors.join(asked, "anchor_id").select(
        every(row_blocks).alias("rb"), F.pmod(F.xxhash64("anchor_id"), F.lit(anchor_blocks)).cast("int").alias("ab"), "anchor_id", "own", "anchor", "windows")
    return dealt.groupBy("rb", "ab").cogroup(asked.groupBy("rb", "ab")).applyInArrow(task, FOUND)


def _lowered(windows: DataFrame, wanted: int) -> DataFrame:
    """``windows`` with ``lo``: the score above which, and up to ``hi``, ``wanted`` of ``pop`` rows are expected, ``floor`` at least."""
    normal = NormalDist()

    def run(frames):
        for f in frames:
            lo = []
            for hi, floor, middle, spread, pop in zip(f["hi"], f["floor"], f["middle"], f["spread"], f["pop"], strict=True):
                above = 1.0 if isinf(hi) else 0.5 * (1 + erf((hi - middle) / (spread * sqrt(2)))) if spread > 0 else 0.0
                share = above - wanted / pop if pop > 0 else 0.0
                lo.append(max(floor, middle + spread * normal.inv_cdf(share)) if 0 < share < 1 and spread > 0 else floor)
            yield f.assign(lo=pd.Series(lo, dtype="float64"))
    return windows.drop("lo").mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.drop("lo").schema) + ", lo double")


def fill(rows: DataFrame, windows: DataFrame, k: int, dims: int, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """(anchor_id, win, vec_id, score, rank): the first k rows (all, if fewer) of every window, higher scores first,
    ties by vec_id.  ``windows``: (anchor_id, win, same, hi, floor, middle, spread, pop)."""
    order = Window.partitionBy("anchor_id", "win").orderBy(F.desc("score"), "vec_id")
    parts, wanted = [], FIRST * k
    while True:
        todo = written(_lowered(windows, wanted))
        ranked = _find(rows, todo, k, dims, row_blocks, anchor_blocks).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = written(ranked)
        full = ranked.where(F.col("rank") == k).select("anchor_id", "win", F.lit(True).alias("full"))
        state = todo.join(full, ["anchor_id", "win"], "left")
        ended = F.coalesce("full", F.lit(False)) | (F.col("lo") <= F.col("floor"))
        parts.append(ranked.join(state.where(ended).select("anchor_id", "win"), ["anchor_id", "win"], "left_semi"))
        windows = written(state.where(~ended).drop("full", "lo"))
        if windows.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        wanted *= WIDER


def _dot(a: Column, b: list[float], square: bool = False) -> Column:
    terms = F.zip_with(a, F.lit(b), lambda x, y: F.coalesce(x * x * y if square else x * y, F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_every: int = ANCHOR_EVERY,
         block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """``RESULT``: for each anchor (vec_id divisible by ``anchor_every``) and each of its first ``positives`` rows of
    the same label, the first ``negatives`` rows of other labels with LOW * positive <= 100 * negative <= HIGH * positive.

    See ``usable`` for rows that take no part and for repeated ones; shorter vectors end in zeros.  An anchor
    without another row of its label, or whose positives have negative scores, has no rows; an empty table gives none.  Ties are
    broken by the smaller vec_id.  Columns besides vec_id, embedding and label are not read.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    rows = written(usable(embeddings.select("vec_id", "embedding", "label")))
    n = rows.count()
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    n_anchors = anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    parts = rows.select(F.posexplode("comps").alias("d", "x")).groupBy("d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    moments = {r["d"]: (r["s"] / n, max(r["ss"] / n - (r["s"] / n) ** 2, 0.0)) for r in parts.collect()}  # one row for each dimension
    dims = max(moments, default=0) + 1
    mean, var = ([moments.get(d, (0.0, 0.0))[i] for d in range(dims)] for i in (0, 1))
    size = (-(-n // block_rows), -(-n_anchors // block_anchors))
    model = anchors.join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("like")), "label").select(
        F.col("vec_id").alias("anchor_id"), _dot(F.col("comps"), mean).alias("middle"), F.sqrt(_dot(F.col("comps"), var, True)).alias("spread"), "like")
    model = written(model)
    window = lambda df, same, hi, floor, pop: df.select(
        "anchor_id", "win", F.lit(same).alias("same"), hi.cast("double").alias("hi"), floor.cast("double").alias("floor"), "middle", "spread",
        pop.cast("bigint").alias("pop"))
    first = window(model.withColumn("win", F.lit(0)), True, F.lit(inf), F.lit(-inf), F.col("like") - 1)
    near = fill(rows, first, positives, dims, *size).select(
        "anchor_id", F.col("rank").alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = written(near)
    asked = near.where("positive_score >= 0").join(model, "anchor_id")
    asked = window(asked, False, F.expr(f"{HIGH} * positive_score div 100"), F.expr(f"({LOW} * positive_score + 99) div 100"), F.lit(n) - F.col("like"))
    hard = fill(rows, asked.where("floor <= hi"), negatives, dims, *size)
    return hard.join(near, ["anchor_id", "win"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
