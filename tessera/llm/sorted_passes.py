"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one class.  In each pass a class has a key of
``BITS`` concatenated random hashes (signs of random projections); the classes are ordered
by (label, key) and each is compared with the ``WINDOW`` that follow it, by cosine in
double precision.  Verified pairs of all passes give components.  Windows are bounded, so
within a component they need not meet every pair: there the links are counted exactly, by
products of blocks of at most about ``BLOCK`` vectors, which put out counts and no pairs.
What can be missed is a link between two components that no pass found.

Passes come in rounds of ``PASSES``, with new hashes each.  The more vectors a label has, the
more bits two of them must share to come near each other in the order, so a label takes part
until it had the passes that find a pair at the bound with probability ``RECALL`` (for
directions spread evenly), and from then on until a round links no two of its components.
Labels of which the windows meet all pairs take part once.

The passes of a round share one sort; its rows are dealt by their place in the order, so no key,
however frequent, makes a large task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bit_filter, components, in_filter, prepare, written
from tessera.operators.order import dense_index

PASSES, BITS, WINDOW = 10, 64, 24
RECALL = 0.97
BLOCK = 1024
RUN = 2048  # classes of the sorted order that one task compares
MIN_COSINE = 0.93


def unit(rows) -> np.ndarray:
    """Vectors of one length, scaled to norm 1 in double precision (first by the largest component,
    so that no square overflows or vanishes)."""
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys(x: np.ndarray, passes: int, bits: int = BITS, turn: int = 0) -> np.ndarray:
    """(passes, rows) sort keys of a round: the bits of one pass, first hash highest, as ordered signed integers."""
    planes = np.random.default_rng(41 + turn).standard_normal((passes * bits, x.shape[1]))  # fixed, by dimension
    sign = (x @ planes.T > 0).reshape(len(x), passes, bits)
    weight = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    value = (sign * weight).sum(-1, dtype=np.uint64)
    return (value ^ np.uint64(1 << 63)).view(np.int64).T


def passes_needed(n, least: float, window: int):
    """Passes (a column) that find a pair at cosine ``least`` among ``n`` > ``window`` vectors with probability
    ``RECALL``: in one, both must share the bits by which the order tells windows apart."""
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi  # that one bit is the same
    one = F.pow(F.lit(agree), F.log2(n / window))
    return F.ceil(math.log(1 - RECALL) / F.log(1 - F.least(one, F.lit(1 - 1e-9))))


def _keyed(passes, turn, live):
    def run(batches):
        for batch in batches:
            if live is not None:  # false hits only add vectors to the round
                batch = batch.filter(pa.array(in_filter(live.value, batch.column(3).to_numpy())))
            vectors = batch.column(2).to_pylist()
            size = np.array([len(v) for v in vectors])
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                k = keys(unit([vectors[i] for i in at]), passes, turn=turn)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p)), pa.array(np.full(len(at), dim)), pa.array(k[p]),
                                                      *[c.take(pa.array(at)) for c in batch.columns]],
                                                     ["pass", "dim", "key", "node", "label", "vector", "g"])
    return run


def _windows(window, least):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        node, at, g = rows["node"].to_numpy(), rows["at"].to_numpy(), rows["g"].to_numpy()
        group = rows[["pass", "dim", "label"]].to_numpy()
        a, b, of = [], [], []
        cut = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
        for s, e in zip(np.append(0, cut), np.append(cut, len(rows)), strict=True):
            if e - s < 2:
                continue
            x = unit(rows["vector"].iloc[s:e])
            for d in range(1, min(window, e - s - 1) + 1):
                hit = np.flatnonzero((np.einsum("ij,ij->i", x[:-d], x[d:]) >= least) & (at[s + d:e] - at[s:e - d] == d))
                a.append(node[s + hit])
                b.append(node[s + hit + d])
                of.append(g[s + hit])
        a, b, of = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b, of))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "g": of}).drop_duplicates()
    return run


def _pairs(classes: DataFrame, least: float, passes: int, window: int, turn: int, live) -> DataFrame:
    """Pairs (a, b, g) that one round finds, ``g`` the hash of their label and length."""
    keyed = (classes.select("node", "label", "vector", "g")
             .mapInArrow(_keyed(passes, turn, live), "pass bigint, dim bigint, key bigint, node bigint, label string, vector array<double>, g bigint"))
    order = dense_index(keyed, ["pass", "dim", "label", "key", "node"], out="at")
    run = F.expr(f"at div {RUN}")
    # a row near the end of a run is compared in the next run as well
    runs = order.withColumn("run", F.explode(F.when(F.pmod("at", F.lit(RUN)) >= RUN - window, F.array(run, run + 1)).otherwise(F.array(run))))
    return written(runs.groupBy("run").applyInPandas(_windows(window, least), "a bigint, b bigint, g bigint"))


def _components(classes: DataFrame, least: float, passes: int, window: int) -> DataFrame:
    """Components (node, component) of the pairs of all rounds."""
    spark = classes.sparkSession
    large = written(classes.groupBy("label", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window + 1)
                    .select("g", passes_needed(F.col("n"), least, window).alias("need")))
    found = new = _pairs(classes, least, passes, window, 0, None)
    comp = written(components(found))
    turn = 1
    while True:
        linked = new.select("g").distinct().withColumn("linked", F.lit(True))
        go_on = written(large.join(linked, "g", "left").where((F.col("need") > turn * passes) | F.col("linked")).select("g"))
        if go_on.isEmpty():
            return comp
        live = spark.sparkContext.broadcast(bit_filter(go_on, "g"))
        ca, cb = (comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        new = written(_pairs(classes, least, passes, window, turn, live).join(ca, "a", "left").join(cb, "b", "left")
                      .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "g"))
        if not new.isEmpty():
            found = found.unionByName(new)
            comp = written(components(found))
        turn += 1


def _block_links(least):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        left, right = (rows[rows["chunk"] == c] for c in (i, j))
        if not len(left) or not len(right):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        near = unit(left["vector"]) @ unit(right["vector"]).T >= least
        if i == j:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"node": left["node"], "links": near @ right["size"].to_numpy()})
        return pd.DataFrame({"node": pd.concat([left["node"], right["node"]]),
                             "links": np.concatenate([near @ right["size"].to_numpy(), near.T @ left["size"].to_numpy()])})
    return run


def near_duplicates(vectors: DataFrame, least: float = MIN_COSINE, passes: int = PASSES, window: int = WINDOW,
                    block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector row.

    ``vectors`` has vec_id, embedding and label.  A vector links only with vectors of its label and length.
    Null labels, null ids, null, empty or zero vectors and vectors with null or non-finite components link
    with nothing: ``n_links`` 0, a component of their own.  Repeated rows count as vectors of their own; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"),
                          F.col("label").cast("string").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("live", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
    rows = rows.withColumn("k1", F.xxhash64("label", "vector")).withColumn("k2", F.xxhash64(F.lit(7), "vector", "label"))
    classes = written(rows.where("live").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size"),
                                                                 F.first("label").alias("label"), F.first("vector").alias("vector"))
                      .withColumn("g", F.xxhash64("label", F.size("vector"))))
    comp = _components(classes, least, passes, window)
    # exact link counts inside the components
    size = comp.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("chunks"))
    member = (comp.join(size, "component").join(classes.select("node", "size", "vector"), "node")
              .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))))
    both = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    both = both.select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "size", "vector")
    links = both.groupBy("component", "i", "j").applyInPandas(_block_links(least), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    found = (classes.select("k1", "k2", "node", "size").join(links, "node", "left").join(comp, "node", "left")
             .select("k1", "k2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c")))
    out = rows.select("vec_id", "live", "k1", "k2").join(found, ["k1", "k2"], "left")
    return out.select("vec_id", F.when(F.col("live"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
                      F.when(F.col("live"), F.col("c")).otherwise(F.col("vec_id")).alias("component_id"),
                      F.coalesce(F.when(F.col("live"), F.col("c")).otherwise(F.col("vec_id")) == F.col("vec_id"), F.lit(False)).alias("kept"))
