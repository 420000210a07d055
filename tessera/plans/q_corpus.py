"""Queries over shards with row groups of uneven size.

The documents are written as shards of 300 ids whose row groups hold 5, 1, 9 and 3 rows in turn, so the
oracles know every boundary; what is tested reads it back from the files.
"""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.operators import order as O
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.session import checkpoint_dir, ensure_shipped
from tessera.sources import corpus as C
from tessera.sources import rowgroups as R
from tessera.streaming import feed

SIZES, SHARD_IDS = (5, 1, 9, 3), 300
_BOUNDS = [sum(SIZES[:i + 1]) for i in range(len(SIZES))]
_SQL = f"""c AS (SELECT doc_id, text, format('shard_{{:05d}}.parquet', doc_id // {SHARD_IDS}) AS shard, doc_id // {SHARD_IDS} AS shard_idx,
                 row_number() OVER (PARTITION BY doc_id // {SHARD_IDS} ORDER BY doc_id) - 1 AS pos FROM documents),
g AS (SELECT *, {len(SIZES)} * (pos // {_BOUNDS[-1]}) + CASE {" ".join(f"WHEN pos % {_BOUNDS[-1]} < {b} THEN {i}" for i, b in enumerate(_BOUNDS))} END AS row_group FROM c)"""


def shards(spark, sf) -> str:
    """Folder of the written shards; a shard has at most ``SHARD_IDS`` documents."""
    ensure_shipped(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus/{uuid.uuid4().hex}"
    fs, inner = R.file_system(folder)
    fs.create_dir(inner)

    def write(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id", kind="stable")
        rows = pa.Table.from_pandas(f[["doc_id", "text"]], preserve_index=False)
        fs, inner = R.file_system(folder)
        name = f"shard_{int(f['doc_id'].iloc[0]) // SHARD_IDS:05d}.parquet"
        part = f"{inner}/{uuid.uuid4().hex}.tmp"  # renamed when whole, as a task may run twice
        with fs.open_output_stream(part) as out, pq.ParquetWriter(out, rows.schema) as w:
            at = i = 0
            while at < rows.num_rows:
                w.write_table(rows.slice(at, SIZES[i % len(SIZES)]))
                at, i = at + SIZES[i % len(SIZES)], i + 1
        fs.move(part, f"{inner}/{name}")
        return pd.DataFrame({"shard": [name]})
    docs = table(spark, sf, "documents").select("doc_id", "text", F.expr(f"doc_id div {SHARD_IDS}").alias("shard"))
    docs.groupBy("shard").applyInPandas(write, "shard string").count()
    return folder


def _hashes(pos="pos"):
    """Hash of a bounded group's texts in order."""
    return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.md5("text").alias("h")))), lambda x: x["h"]), ","))


@register("scan_row_groups", f"""WITH {_SQL}
SELECT shard, row_group, count(*) AS n_docs, min(pos) AS first_pos, md5(string_agg(md5(text), ',' ORDER BY pos)) AS texts_md5 FROM g GROUP BY 1, 2""")
def scan_row_groups(spark, sf):
    """A1: the files' own row groups, of uneven size, with the documents that each holds."""
    c = C.scan_corpus(spark, shards(spark, sf), row_groups=True)
    return c.groupBy("shard", "row_group").agg(F.count(F.lit(1)).alias("n_docs"), F.min("pos").alias("first_pos"), _hashes().alias("texts_md5"))


@register("stride_row_groups", f"""WITH {_SQL}
SELECT CAST(row_group % 3 AS INT) AS rank, shard, row_group, doc_id FROM g""")
def stride_row_groups(spark, sf):
    """A3: what every rank of 3 reads when row groups are strided."""
    c = C.scan_corpus(spark, shards(spark, sf), keep=("doc_id",), row_groups=True)
    ranks = [O.rank_stride(c, r, 3, idx="row_group").withColumn("rank", F.lit(r)) for r in range(3)]
    return ranks[0].unionByName(ranks[1]).unionByName(ranks[2]).select("rank", "shard", "row_group", "doc_id")


@register("resume_row_groups", f"""WITH {_SQL}, e AS (SELECT g.*, CAST(t.e AS INT) AS epoch FROM g, generate_series(1, 2) t(e))
SELECT epoch, shard_idx, row_group, doc_id FROM e
WHERE row_group % 4 = 1 AND (epoch = 2 OR shard_idx > 0 OR (shard_idx = 0 AND row_group >= (10 // 4 + 1) * 4))""")
def resume_row_groups(spark, sf):
    """A5: what rank 1 of 4 reads over two epochs after row group 10 of the first shard."""
    c = C.shard_index(C.scan_corpus(spark, shards(spark, sf), keep=("doc_id",), row_groups=True))
    return C.resume_after(C.repeat_epochs(c, 2), 0, 10, 1, 1, 4).select("epoch", "shard_idx", "row_group", "doc_id")


@register("chunk_row_groups", f"""WITH {_SQL}, f AS (SELECT *, pos - min(pos) OVER (PARTITION BY shard, row_group) AS gp FROM g)
SELECT shard, row_group, gp // 4 AS chunk, count(*) AS n_docs, md5(string_agg(md5(text), ',' ORDER BY pos)) AS texts_md5 FROM f GROUP BY ALL""")
def chunk_row_groups(spark, sf):
    """Chunks of at most 4 documents, counted from the start of each row group."""
    c = C.scan_corpus(spark, shards(spark, sf), row_groups=True)
    ch = C.chunk_texts(c, 4, pos="group_pos")
    texts = F.transform("docs", lambda d: F.md5(d["text"]))
    return ch.select("shard", "row_group", "chunk", F.size("docs").cast("bigint").alias("n_docs"), F.md5(F.array_join(texts, ",")).alias("texts_md5"))


@register("corpus_feed", f"""WITH {_SQL}
SELECT CAST(t.e AS BIGINT) AS epoch, shard, shard_idx AS pq_idx, row_group AS rg_idx, count(*) AS n_docs, min(pos) AS first_pos,
       md5(string_agg(md5(text), ',' ORDER BY pos)) AS texts_md5 FROM g, generate_series(1, 2) t(e) GROUP BY ALL""")
def corpus_feed(spark, sf):
    """Two epochs of the shards as a stream that is stopped after the first and resumed from its checkpoint."""
    folder = shards(spark, sf)
    out = f"{folder}/feed"
    n = table(spark, sf, "documents", spread=False).count()
    for epochs in (1, 2):
        feed.run_to_end(feed.corpus_feed(spark, folder, groups_per_batch=max(50, n // 16), epochs=epochs, groups_per_task=32), f"{out}/rows", f"{out}/progress")
    rows = spark.read.schema(feed.FEED).parquet(f"{out}/rows")
    return rows.groupBy("epoch", "shard", "pq_idx", "rg_idx").agg(F.count(F.lit(1)).alias("n_docs"), F.min("pos").alias("first_pos"),
                                                                 _hashes().alias("texts_md5"))
