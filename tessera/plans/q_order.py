"""Queries for indexing, strides, slices, mixtures and the corpus supply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import order as O
from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.plans.views import v_corpus, v_part_idx, v_supplier_idx
from tessera.sources import corpus as C


@register("dense_index", """
SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS idx FROM lineitem""")
def dense_index_q(spark, sf):
    """Two-pass dense index of lineitem by (orderkey, linenumber)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return O.dense_index(li, ["l_orderkey", "l_linenumber"])


@register("length_offsets", """
WITH t AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, CAST(coalesce(sum(n) OVER (ORDER BY l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM t""")
def length_offsets_q(spark, sf):
    """Exclusive running sum of task lengths (tasks = return flags)."""
    t = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return O.length_offsets(t, "l_returnflag")


@register("rank_stride", f"""WITH {DV.V_CORPUS}
SELECT CAST(row_group % 4 AS INT) AS rank, shard, doc_id, row_group FROM v_corpus""")
def rank_stride_q(spark, sf):
    """A3: the corpus row groups of every rank of 4 (their union is the whole corpus)."""
    c = v_corpus(spark, sf)
    parts = [O.rank_stride(c, r, 4, idx="row_group").select(F.lit(r).alias("rank"), "shard", "doc_id", "row_group")
             for r in range(4)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("batch_stride", f"""WITH {DV.V_CORPUS}
SELECT CAST((idx // 7) % 3 AS INT) AS rank, doc_id, idx, idx // 7 AS batch FROM v_corpus""")
def batch_stride_q(spark, sf):
    """A4: batches of 7 problems strided over 3 ranks; every rank's share."""
    c = v_corpus(spark, sf)
    parts = [O.batch_stride(c, 7, r, 3).select(F.lit(r).alias("rank"), "doc_id", "idx", "batch") for r in range(3)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("seeded_shuffle", """
SELECT p_partkey, row_number() OVER (ORDER BY md5('42:' || CAST(p_partkey AS VARCHAR)), p_partkey) - 1 AS idx FROM part""")
def seeded_shuffle_q(spark, sf):
    """Seed-42 order of part by md5(seed:key)."""
    return O.seeded_shuffle(table(spark, sf, "part").select("p_partkey"), 42, "p_partkey")


@register("limit_problems", """
SELECT p_partkey, idx FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('1337:' || CAST(p_partkey AS VARCHAR)), p_partkey) - 1 AS idx FROM part) WHERE idx < 100""")
def limit_problems_q(spark, sf):
    """First 100 problems after the seed-1337 shuffle."""
    s = O.seeded_shuffle(table(spark, sf, "part").select("p_partkey"), 1337, "p_partkey")
    return O.limit_problems(s, 100)


@register("slice_task", f"""WITH {DV.V_PART_IDX}
SELECT p_partkey, (idx - 5) // 3 AS idx FROM v_part_idx WHERE idx >= 5 AND idx < 500 AND (idx - 5) % 3 = 0""")
def slice_task_q(spark, sf):
    """G1: view [5:500:3] with a new dense idx."""
    return O.slice_task(v_part_idx(spark, sf), 5, 500, 3).select("p_partkey", "idx")


_MIX_INPUTS_SQL = f"""WITH {DV.V_PART_IDX}, {DV.V_SUPPLIER_IDX},
u AS (SELECT 0 AS task_idx, idx AS local_idx FROM v_part_idx
      UNION ALL SELECT 1, idx FROM v_supplier_idx
      UNION ALL SELECT 2, idx FROM v_part_idx)"""


def _mix_inputs(spark, sf):
    p = v_part_idx(spark, sf).select("idx")
    s = v_supplier_idx(spark, sf).select("idx")
    return [p, s, p]


@register("mix_tasks", _MIX_INPUTS_SQL + """
SELECT task_idx, local_idx, row_number() OVER (ORDER BY md5('42:' || CAST(task_idx AS VARCHAR) || ':' || CAST(local_idx AS VARCHAR)), CAST(task_idx AS VARCHAR) || ':' || CAST(local_idx AS VARCHAR)) - 1 AS idx FROM u""")
def mix_tasks_q(spark, sf):
    """Part, supplier and part again (oversampled) in one seed-42 order."""
    return O.mix_tasks(_mix_inputs(spark, sf)).select("task_idx", "local_idx", "idx")


@register("chain_tasks", _MIX_INPUTS_SQL + """,
n AS (SELECT task_idx, count(*) AS n FROM u GROUP BY 1),
o AS (SELECT task_idx, coalesce(sum(n) OVER (ORDER BY task_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n)
SELECT u.task_idx, local_idx, CAST(off + local_idx AS BIGINT) AS idx FROM u JOIN o USING (task_idx)""")
def chain_tasks_q(spark, sf):
    """Curriculum concatenation; idx = task offset + local idx."""
    return O.chain_tasks(_mix_inputs(spark, sf)).select("task_idx", "local_idx", "idx")


# ------------------------------------------------------------------ corpus
@register("scan_corpus", """
SELECT 'documents.parquet' AS shard, doc_id AS pos, doc_id, CAST(length(text) AS INT) AS n_chars FROM documents""")
def scan_corpus_q(spark, sf):
    """A1: scan with shard file name and row position; doc_id read in the same scan."""
    s = C.scan_corpus(spark, f"{sf.rstrip('/')}/documents.parquet", keep=("doc_id",))
    return s.select("shard", "pos", "doc_id", F.length("text").alias("n_chars"))


@register("split_corpus", f"""WITH {DV.V_CORPUS}
SELECT CASE WHEN shard = (SELECT max(shard) FROM v_corpus) THEN 'val' ELSE 'train' END AS split, shard, count(*) AS n_docs
FROM v_corpus GROUP BY 1, 2""")
def split_corpus_q(spark, sf):
    """A2: val = last shard by name (src9), train = the rest."""
    c = v_corpus(spark, sf)
    tr = C.split_corpus(c, "train").withColumn("split", F.lit("train"))
    va = C.split_corpus(c, "val").withColumn("split", F.lit("val"))
    return tr.unionByName(va).groupBy("split", "shard").agg(F.count(F.lit(1)).alias("n_docs"))


@register("repeat_epochs", f"""WITH {DV.V_CORPUS}
SELECT CAST(e AS INT) AS epoch, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM v_corpus, generate_series(1, 3) t(e) GROUP BY 1""")
def repeat_epochs_q(spark, sf):
    """Three epochs of the corpus."""
    r = C.repeat_epochs(v_corpus(spark, sf), 3)
    return r.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@register("resume_after", f"""WITH {DV.V_CORPUS},
tr AS (SELECT * FROM v_corpus WHERE shard <> (SELECT max(shard) FROM v_corpus)),
s AS (SELECT *, dense_rank() OVER (ORDER BY shard) - 1 AS shard_idx FROM tr),
e AS (SELECT s.*, CAST(ep AS INT) AS epoch FROM s, generate_series(1, 2) t(ep))
SELECT CAST(row_group % 2 AS INT) AS rank, epoch, shard_idx, row_group, doc_id FROM e
WHERE (epoch > 1 OR (epoch = 1 AND (shard_idx > 3 OR (shard_idx = 3 AND row_group >= 4))))""")
def resume_after_q(spark, sf):
    """A5: train split, two epochs, resume after (pq 3, rg 2, epoch 1); both ranks of 2."""
    c = C.shard_index(C.split_corpus(v_corpus(spark, sf), "train"))
    e = C.repeat_epochs(c, 2)
    parts = [C.resume_after(e, 3, 2, 1, r, 2).select(F.lit(r).alias("rank"), "epoch", "shard_idx", "row_group", "doc_id")
             for r in range(2)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("chunk_texts", f"""WITH {DV.V_CORPUS}
SELECT shard, row_group, pos // 3 AS chunk, count(*) AS n_docs,
       string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM v_corpus GROUP BY 1, 2, 3""")
def chunk_texts_q(spark, sf):
    """Batches of 3 documents inside each row group (whole texts carried)."""
    ch = C.chunk_texts(v_corpus(spark, sf), 3)
    return ch.select("shard", "row_group", "chunk", F.size("docs").cast("bigint").alias("n_docs"),
                     F.array_join(F.transform("docs", lambda d: d.pos.cast("string")), ",").alias("positions"),
                     F.aggregate("docs", F.lit(0).cast("bigint"), lambda acc, d: acc + F.length(d.text)).alias("n_chars"))


@register("shard_manifest", """
WITH present AS (SELECT DISTINCT printf('shard_%05d.parquet', CAST(substr(source, 4) AS INT)) AS shard FROM documents WHERE lang = 'de'),
mx AS (SELECT max(CAST(substr(source, 4) AS INT)) AS m FROM documents),
ids AS (SELECT i AS shard_id FROM mx, generate_series(0, least(15, mx.m) - 1) t(i) UNION ALL SELECT m FROM mx)
SELECT shard_id, printf('shard_%05d.parquet', shard_id) AS shard FROM ids
WHERE printf('shard_%05d.parquet', shard_id) NOT IN (SELECT shard FROM present)""")
def shard_manifest_q(spark, sf):
    """Shards to fetch: first 15 train shards + the val shard, minus those
    with German documents (plays 'already present'); shard ids from sources."""
    d = table(spark, sf, "documents")
    sid = F.substring("source", 4, 10).cast("int")
    max_shard = d.select(F.max(sid)).first()[0]  # one scalar: the last shard id
    present = (d.where(F.col("lang") == "de")
               .select(F.format_string("shard_%05d.parquet", sid).alias("shard")))
    return C.shard_manifest(spark, 15, max_shard, present)
