"""Queries for multiple-choice scoring and metrics (minimum slice first)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import score as S
from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.views import v_letter_scores

R = lambda c, n=6: F.round(c, n)

# ------------------------------------------------------------ flagship: mc_eval
_PICK_SQL = f"""WITH {DV.V_LETTER_SCORES},
p AS (SELECT item_id, gold, letter_idx AS pred_idx, letter AS pred_letter FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, letter_idx) AS rn
        FROM v_letter_scores) WHERE rn = 1)"""


def mc_graded(spark, sf):
    s = v_letter_scores(spark, sf)
    # the task is named after the item's letter count (data-derived: "letters10")
    p = S.pick_letter(s, carry=["gold"])
    p = p.withColumn("task", F.concat(F.lit("letters"), F.col("n_letters").cast("string")))
    return S.grade_exact(p, "pred_idx", "gold")


@register("mc_eval", _PICK_SQL + """,
g AS (SELECT 'letters10' AS task, coalesce(pred_idx = gold, false) AS correct FROM p),
a AS (SELECT task, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS n_correct FROM g GROUP BY task)
SELECT task, n, n_correct, round(n_correct / n, 6) AS accuracy, CAST(10.0 AS DOUBLE) AS baseline,
       round((n_correct / n - 0.1) / (1 - 0.1), 6) AS centered
FROM a""")
def mc_eval(spark, sf):
    """I8 -> I5 -> I1 -> H1 -> I11 on the ten-letter score table."""
    acc = S.accuracy_by(mc_graded(spark, sf), ["task"])
    base = spark.createDataFrame([("letters10", 10.0)], "task string, baseline double")
    j = S.attach_baseline(acc, base, missing="error")
    return j.select("task", "n", "n_correct", R(F.col("accuracy")).alias("accuracy"), "baseline",
                    R(S.centered(F.col("accuracy"), F.col("baseline"))).alias("centered"))


@register("pick_letter", _PICK_SQL + " SELECT item_id, pred_idx, pred_letter, gold FROM p")
def pick_letter_q(spark, sf):
    """I8 alone: argmax letter per item, first on ties."""
    return S.pick_letter(v_letter_scores(spark, sf), carry=["gold"]).select("item_id", "pred_idx", "pred_letter", "gold")


@register("pick_letter_allowed", f"""WITH {DV.V_LETTER_SCORES},
allowed AS (SELECT item_id, letter FROM v_letter_scores WHERE letter_idx < 4 + (item_id % 3)),
s AS (SELECT s.* FROM v_letter_scores s SEMI JOIN allowed a ON s.item_id = a.item_id AND s.letter = a.letter)
SELECT item_id, letter_idx AS pred_idx, letter AS pred_letter FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, letter_idx) AS rn FROM s) WHERE rn = 1""")
def pick_letter_allowed(spark, sf):
    """I8 restricted to each item's available letters (4, 5 or 6 of them)."""
    s = v_letter_scores(spark, sf)
    allowed = s.where(F.col("letter_idx") < F.lit(4) + F.col("item_id") % 3).select("item_id", "letter")
    return S.pick_letter(s, allowed=allowed).select("item_id", "pred_idx", "pred_letter")


@register("accuracy_by_gold", _PICK_SQL + """
SELECT gold, count(*) AS n, CAST(sum(CAST(pred_idx = gold AS INT)) AS BIGINT) AS n_correct,
       round(sum(CAST(pred_idx = gold AS INT)) / count(*), 6) AS accuracy
FROM p GROUP BY gold""")
def accuracy_by_gold(spark, sf):
    """Accuracy broken down by the gold letter."""
    a = S.accuracy_by(mc_graded(spark, sf), ["gold"])
    return a.select("gold", "n", "n_correct", R(F.col("accuracy")).alias("accuracy"))


@register("accuracy_rollup", _PICK_SQL + """,
g AS (SELECT gold % 2 AS parity, gold, CAST(pred_idx = gold AS INT) AS c FROM p)
SELECT parity, gold, CAST(grouping(parity, gold) AS INT) AS gid, count(*) AS n, CAST(sum(c) AS BIGINT) AS n_correct,
       round(sum(c) / count(*), 6) AS accuracy
FROM g GROUP BY ROLLUP (parity, gold)""")
def accuracy_rollup(spark, sf):
    """I2 with rollup: per (parity, gold), per parity, and overall, with grouping id."""
    g = mc_graded(spark, sf).withColumn("parity", F.col("gold") % 2)
    a = S.accuracy_by(g, ["parity", "gold"], mode="rollup")
    return a.select("parity", "gold", F.col("gid").cast("int").alias("gid"), "n", "n_correct",
                    R(F.col("accuracy")).alias("accuracy"))


@register("accuracy", _PICK_SQL + """
SELECT count(*) AS n, CAST(coalesce(sum(CAST(pred_idx = gold AS INT)), 0) AS BIGINT) AS n_correct,
       round(CASE WHEN count(*) > 0 THEN sum(CAST(pred_idx = gold AS INT)) / count(*) ELSE 0.0 END, 6) AS accuracy
FROM p""")
def accuracy_q(spark, sf):
    """Overall accuracy (0.0 when empty)."""
    a = S.accuracy(mc_graded(spark, sf))
    return a.select("n", "n_correct", R(F.col("accuracy")).alias("accuracy"))


@register("mean_reward", _PICK_SQL + """
SELECT gold, round(avg(CAST(coalesce(pred_idx = gold, false) AS DOUBLE)), 6) AS mean_reward FROM p GROUP BY gold""")
def mean_reward_q(spark, sf):
    """I4: mean 0/1 reward per gold letter."""
    r = S.mean_reward(mc_graded(spark, sf), dims=["gold"])
    return r.select("gold", R(F.col("mean_reward")).alias("mean_reward"))
