"""Streaming operators run to completion over the available input (``availableNow``),
returned as batch tables so the rows check covers them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import pack as PK
from tessera.operators import tok as TK
from tessera.plans.q_tok import merges_for
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.session import checkpoint_dir
from tessera.sources import sinks
from tessera.streaming import flows as FL


def _stream_of(spark, sf, name):
    schema = table(spark, sf, name, spread=False).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf))


@register("stream_corpus", """
SELECT 'documents.parquet' AS shard, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents""")
def stream_corpus_q(spark, sf):
    """The documents shard as a resumable stream; documents and bytes per shard."""
    s = FL.stream_corpus(spark, f"{sf.rstrip('/')}/documents.parquet", files_per_trigger=1)
    out = FL.run_available(spark, s.select("shard", F.octet_length("text").alias("n_bytes")))
    return out.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_bytes").cast("bigint").alias("n_bytes"))


@register("stream_accuracy", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(event_type <> 'error' AS INT)) AS BIGINT) AS n_correct,
       round(sum(CAST(event_type <> 'error' AS INT)) / count(*), 6) AS accuracy FROM events GROUP BY event_type""")
def stream_accuracy_q(spark, sf):
    """L2: running success rate per event type while the events arrive (complete mode)."""
    s = _stream_of(spark, sf, "events").withColumn("correct", F.col("event_type") != "error")
    out = FL.run_available(spark, FL.streaming_accuracy(s, ["event_type"]), mode="complete")
    return out.select("event_type", "n", "n_correct", F.round("accuracy", 6).alias("accuracy"))


@register("stream_pack")
def stream_pack_q(spark, sf):
    """L1: best-fit packing of the encoded documents as a stream with per-lane state (equals the complete rows
    that the batch packer makes before a lane ends).  Lanes are runs of 256 document ids."""
    merges = merges_for(spark, sf)
    docs = _stream_of(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"), F.expr("doc_id div 256").alias("lane"), F.expr("doc_id div 8").alias("rg_idx"),
        TK.encode("text", merges, prepend="<|bos|>").alias("tokens"))
    rows = FL.run_available(spark, PK.stream_pack(docs, 2048, buffer_size=64, refill=16))
    return rows.select("lane", "row_no", F.size("tokens").alias("n_tokens"), "n_docs", "n_cropped", "last_idx", "rg_idx",
                       F.md5(F.concat_ws(",", F.transform("tokens", lambda x: x.cast("string")))).alias("tokens_md5"))


@register("stream_log_accuracy", """
SELECT 'orders' AS task, 'org_model-' || CAST(o_orderkey % 3 AS VARCHAR) AS model_slug, count(*) AS n,
       CAST(sum(CAST(o_orderkey % 4 <> 0 AS INT)) AS BIGINT) AS n_correct, round(sum(CAST(o_orderkey % 4 <> 0 AS INT)) / count(*), 6) AS accuracy
FROM orders GROUP BY 1, 2""")
def stream_log_accuracy_q(spark, sf):
    """L2: accuracy per model while response logs arrive, with a fifth of the records logged twice."""
    key = F.col("o_orderkey")
    truth = (key % 7).cast("string")
    log = table(spark, sf, "orders").select(
        key.cast("bigint").alias("index"), F.concat(F.lit("order "), key.cast("string")).alias("question"), truth.alias("ground_truth"),
        F.when(key % 4 == 0, F.lit("none")).otherwise(truth).alias("predicted"), (key % 4 != 0).alias("correct"),
        F.col("o_orderstatus").alias("raw_response"), F.lit("orders").alias("task"), F.concat(F.lit("org/model-"), (key % 3).cast("string")).alias("model"),
        F.lit("n8").alias("variant"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/logs/{uuid.uuid4().hex}"
    for part in (log.where("index % 2 = 0"), log.where("index % 5 = 0"), log.where("index % 2 = 1")):
        sinks.write_response_log(part, folder)
    keys = ("task", "model_slug")
    out = FL.run_available(spark, FL.stream_log_accuracy(spark, folder, keys, files_per_trigger=20), mode="update", keys=keys)
    return out.select(*keys, "n", "n_correct", F.round("accuracy", 6).alias("accuracy"))
