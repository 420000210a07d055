"""Streaming flows and sinks: batch result = streaming result."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import score as S
from tessera.sources import sinks
from tessera.streaming import flows

SF = "/root/testdata/sf0.001"


def test_response_log_and_stream_accuracy(spark):
    d = tempfile.mkdtemp(prefix="tessera-log-")
    rows = [(i, f"q{i}", "1", "1" if i % 3 else "2", i % 3 != 0, "raw", "gsm8k", "org/model-a", "n8") for i in range(30)]
    df = spark.createDataFrame(rows, "index long, question string, ground_truth string, predicted string, "
                                     "correct boolean, raw_response string, task string, model string, variant string")
    sinks.write_response_log(df, d)
    assert any("model_slug=org_model-a" in r for r, _, _ in os.walk(d))
    s = flows.stream_accuracy(spark, d)
    q = s.writeStream.outputMode("complete").format("memory").queryName("acc_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT * FROM acc_stream").first()
    batch = S.accuracy_by(df.withColumn("model_slug", F.lit("org_model-a")), ["task", "model_slug"]).first()
    assert (got.n, got.n_correct) == (batch.n, batch.n_correct) == (30, 20)


def test_stream_corpus_resumes(spark):
    src = tempfile.mkdtemp(prefix="tessera-shards-")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "source")
    for i, s in enumerate(["src0", "src1"]):
        docs.where(F.col("source") == s).select("text").coalesce(1).write.parquet(f"{src}/part{i}")
    ck = tempfile.mkdtemp(prefix="tessera-ck-")
    out = tempfile.mkdtemp(prefix="tessera-out-")
    st = flows.stream_corpus(spark, f"{src}/part0")
    q = st.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
    q.awaitTermination()
    n1 = spark.read.parquet(out).count()
    q = flows.stream_corpus(spark, f"{src}/part0").writeStream.format("parquet").option(
        "checkpointLocation", ck).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == n1 == docs.where(F.col("source") == "src0").count()


def test_core_csv_lines(spark):
    import glob
    res = spark.createDataFrame([("hellaswag", 0.625, 0.5)], "task string, accuracy double, centered double")
    core = S.core_metric(res)
    d = tempfile.mkdtemp(prefix="tessera-core-")
    path = sinks.write_core_csv(res, core, d, "org/model")
    assert path.endswith("org-model")
    lines = open(glob.glob(f"{path}/part-*")[0]).read().splitlines()
    assert lines == [f"{'Task':<35}, {'Accuracy':<10}, {'Centered':<10}",
                     f"{'hellaswag':<35}, {0.625:<10.6f}, {0.5:<10.6f}",
                     f"{'CORE':<35}, {'':<10}, {0.5:<10.6f}"]


def test_centered_golden(spark):
    r = spark.createDataFrame([(0.625, 25.0)], "a double, b double").select(
        S.centered(F.col("a"), F.col("b")).alias("c")).first()
    assert abs(r.c - 0.5) < 1e-12
