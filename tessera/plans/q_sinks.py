"""Sinks checked by a round trip: write under the shared checkpoint folder, read the
files back, aggregate.  The partition folders are part of what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import score as S
from tessera.plans import duck as D
from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.views import v_gsm, v_runs
from tessera.session import checkpoint_dir
from tessera.sources import sinks


def _folder(spark, what):
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{what}-{uuid.uuid4().hex[:12]}"


@register("write_response_log", f"""WITH {DV.V_GSM}
SELECT 'gsm8k' AS task, 'org_model-' || CAST(l_orderkey % 3 AS VARCHAR) AS model_slug, 'n8' AS variant, count(*) AS n,
       CAST(sum(CAST(coalesce({D.hash_number('completion')} = {D.hash_number('answer')}, false) AS INT)) AS BIGINT) AS n_correct
FROM v_gsm GROUP BY 2""")
def write_response_log_q(spark, sf):
    """Graded GSM responses written as JSON lines per task / model slug / variant,
    read back, accuracy counts per partition folder."""
    g = v_gsm(spark, sf).select(
        F.col("l_orderkey").alias("index"), "question", T.extract_hash_number("answer").alias("ground_truth"),
        T.extract_hash_number("completion").alias("predicted"), F.col("completion").alias("raw_response"),
        F.lit("gsm8k").alias("task"), F.concat(F.lit("org/model-"), (F.col("l_orderkey") % 3).cast("string")).alias("model"),
        F.lit("n8").alias("variant"))
    g = S.grade_exact(g, "predicted", "ground_truth")
    path = _folder(spark, "responses")
    sinks.write_response_log(g, path)
    back = spark.read.json(path).select(F.col("task").cast("string"), F.col("model_slug").cast("string"),
                                        F.col("variant").cast("string"), F.col("correct").cast("boolean"))
    return back.groupBy("task", "model_slug", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).cast("bigint").alias("n_correct"))


@register("write_run_summary", f"""WITH {DV.V_RUNS},
lt AS (SELECT model, task, arg_max(accuracy, (timestamp, event_id)) AS accuracy, max(timestamp) AS timestamp FROM v_runs GROUP BY 1, 2)
SELECT replace(model, '/', '_') AS model_slug, task, accuracy, timestamp FROM lt""")
def write_run_summary_q(spark, sf):
    """The latest record per (model, task) written as run summaries, read back."""
    from tessera.operators.report import leaderboard
    r = v_runs(spark, sf)
    lt = leaderboard(r, tiebreak="event_id").join(r.groupBy("model", "task").agg(F.max("timestamp").alias("timestamp")),
                                                  ["model", "task"])
    path = _folder(spark, "runs")
    sinks.write_run_summary(lt, path)
    back = spark.read.json(path)
    return back.select(F.col("model_slug").cast("string"), F.col("task").cast("string"),
                       F.col("accuracy").cast("double"), F.col("timestamp").cast("string"))
