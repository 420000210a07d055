"""Joins, grading and metric aggregation.

All aggregates are algebraic (sum/count/max of structs), so Spark computes them
with a map-side partial aggregate before the shuffle: a hot key costs one row
per map task, never a collected group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.plans.guards import broadcast_small


def _round(c: Column, nd: int = 6) -> Column:
    return F.round(c, nd)


# ---------------------------------------------------------------- I5 / I1 / I2 / I4
def grade_exact(df: DataFrame, pred: str, ref: str, strict: bool = True, out: str = "correct") -> DataFrame:
    """Predicted equals reference.  ``strict``: a null prediction is wrong;
    otherwise null = null counts as right (local GSM8K / SpellingBee)."""
    p, r = F.col(pred), F.col(ref)
    verdict = F.coalesce(p == r, F.lit(False)) if strict else p.eqNullSafe(r)
    return df.withColumn(out, verdict)


def _acc(n_correct: Column, n: Column) -> Column:
    return F.when(n > 0, n_correct / n).otherwise(F.lit(0.0))


def accuracy(graded: DataFrame, correct: str = "correct") -> DataFrame:
    """Correct / total over the whole table; 0.0 when empty."""
    return accuracy_by(graded, [], correct)


def accuracy_by(graded: DataFrame, dims: list[str], correct: str = "correct", mode: str = "groupBy") -> DataFrame:
    """Accuracy per group; ``mode`` groupBy | rollup | cube (adds ``gid``)."""
    c = F.col(correct).cast("int")
    aggs = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("n_correct")]
    if mode == "groupBy":
        g = graded.groupBy(*dims).agg(*aggs)
    elif mode in ("rollup", "cube"):
        g = getattr(graded, mode)(*dims).agg(*aggs, F.grouping_id().alias("gid"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return g.withColumn("accuracy", _acc(F.col("n_correct"), F.col("n")))


def mean_reward(graded: DataFrame, correct: str = "correct", dims: list[str] | None = None) -> DataFrame:
    """I4: the 0/1 reward as a float, averaged."""
    return graded.groupBy(*(dims or [])).agg(F.avg(F.col(correct).cast("double")).alias("mean_reward"))


def pass_any(graded: DataFrame, problem: list[str], correct: str = "correct") -> DataFrame:
    """A problem passes when any of its samples passes (bool_or, partial-aggregated)."""
    return graded.groupBy(*problem).agg(F.bool_or(F.col(correct)).alias(correct),
                                        F.count(F.lit(1)).alias("n_samples"))


# ---------------------------------------------------------------- I8
def pick_letter(scores: DataFrame, allowed: DataFrame | None = None, item: str = "item_id",
                carry: list[str] | None = None) -> DataFrame:
    """I8: argmax over the item's available letters, the first letter on ties.

    ``scores``: (item, letter_idx, letter, score).  ``allowed`` (item, letter)
    restricts the candidates by a semi join; ``carry`` are columns fixed per item.
    ``n_letters`` counts the candidates (same aggregation, no extra pass).  ``max(struct(score, -idx))`` is
    a partial aggregate, unlike a sort per item.
    """
    if allowed is not None:
        scores = scores.join(allowed.select(item, "letter"), [item, "letter"], "left_semi")
    best = F.max(F.struct(F.col("score"), (-F.col("letter_idx")).alias("neg_idx"), F.col("letter")))
    keys = [item] + list(carry or [])
    return (scores.groupBy(*keys).agg(best.alias("b"), F.count(F.lit(1)).alias("n_letters"))
            .select(*keys, (-F.col("b.neg_idx")).alias("pred_idx"), F.col("b.letter").alias("pred_letter"), "n_letters"))


# ---------------------------------------------------------------- H1 / I11 / I12
def attach_baseline(results: DataFrame, baselines: DataFrame, on: str = "task", missing: str = "error",
                    col: str = "baseline") -> DataFrame:
    """H1: equi-join of results with the (small, size-checked) baseline table.

    ``missing='error'`` fails the job on a task without baseline (CORE);
    ``missing='zero'`` uses 0.0 (ChatCORE).
    """
    j = results.join(broadcast_small(baselines, "baselines"), on, "left")
    if missing == "error":
        return j.withColumn(col, F.when(F.col(col).isNull(),
                                        F.raise_error(F.concat(F.lit("no baseline for task "), F.col(on))))
                            .otherwise(F.col(col)))
    if missing == "zero":
        return j.withColumn(col, F.coalesce(F.col(col), F.lit(0.0)))
    raise ValueError(missing)


def centered(acc: Column, baseline: Column, percent: bool = True) -> Column:
    """``(acc - b) / (1 - b)`` with ``b`` a fraction (``pct/100`` for CORE)."""
    b = baseline * 0.01 if percent else baseline
    return (acc - b) / (F.lit(1.0) - b)


def core_metric(centered_df: DataFrame, col: str = "centered") -> DataFrame:
    """The plain mean of the centred per-task values."""
    return centered_df.agg(F.avg(col).alias("core_metric"), F.count(F.lit(1)).alias("n_tasks"))


def chatcore(acc_df: DataFrame, baselines: DataFrame | None = None, group: list[str] | None = None,
             task: str = "task", acc: str = "accuracy") -> DataFrame:
    """ChatCORE per group; a row only when all six tasks are present.

    Baselines are fractions and default to the fixed ChatCORE table.
    """
    spark = acc_df.sparkSession
    if baselines is None:
        baselines = spark.createDataFrame(K.CHATCORE_BASELINES, f"{task} string, baseline double")
    j = acc_df.join(broadcast_small(baselines, "chatcore baselines"), task, "inner")
    c = centered(F.col(acc), F.col("baseline"), percent=False)
    return (j.groupBy(*(group or []))
            .agg(F.count_distinct(task).alias("n_tasks"), F.avg(c).alias("chatcore"))
            .where(F.col("n_tasks") == len(K.CHATCORE_BASELINES)))


# ---------------------------------------------------------------- H4
def join_predictions(items: DataFrame, preds: DataFrame, keys: list[str], completion: str = "completion") -> DataFrame:
    """H4: every problem with its response; a missing or failed response is ''
    (graded wrong, kept in the total)."""
    return (items.join(preds, keys, "left")
            .withColumn(completion, F.coalesce(F.col(completion), F.lit(""))))


# ---------------------------------------------------------------- J1
def running_accuracy(graded: DataFrame, part: list[str], order="idx", correct: str = "correct",
                     chunk_rows: int = 100_000) -> DataFrame:
    """Correct so far / answered so far, per partition key in ``order``.

    A chunked two-level scan (``chunked_running_sums``), so a key with a third
    of all rows is still processed by many bounded tasks.
    """
    from tessera.operators.order import chunk_positions, chunked_running_sums
    g = chunk_positions(graded, part, [order] if isinstance(order, str) else order, chunk_rows)
    g = chunked_running_sums(g, part, {"n_so_far": F.lit(1).cast("bigint"),
                                       "correct_so_far": F.col(correct).cast("bigint")})
    return g.withColumn("running_accuracy", F.col("correct_so_far") / F.col("n_so_far")).drop("_pos", "_chunk")


LN2 = math.log(2.0)


# ---------------------------------------------------------------- H2 / I9 / I10
def lookup_token_bytes(tokens: DataFrame, token_bytes: DataFrame, target: str = "target",
                       token: str = "token", n_bytes: str = "n_bytes") -> DataFrame:
    """H2: target id -> byte length through a vocabulary-sized (checked) broadcast;
    negative ids and unknown tokens count 0 bytes."""
    tb = broadcast_small(token_bytes.select(F.col(token).alias("_tok"), F.col(n_bytes).alias("_nb")), "token bytes")
    return (tokens.join(tb, F.col(target) == F.col("_tok"), "left")
            .withColumn(n_bytes, F.when(F.col(target) < 0, 0).otherwise(F.coalesce(F.col("_nb"), F.lit(0))))
            .drop("_tok", "_nb"))


def bits_per_byte(losses: DataFrame, token_bytes: DataFrame, group: list[str] | None = None,
                  loss: str = "loss", target: str = "target") -> DataFrame:
    """``sum(loss where bytes > 0) / (ln 2 * sum(bytes))``; ``inf`` when no bytes.

    Masked positions are filtered (a NaN there does not poison the sum).
    """
    j = lookup_token_bytes(losses, token_bytes, target)
    nb = F.col("n_bytes")
    agg = j.groupBy(*(group or [])).agg(F.sum(F.when(nb > 0, F.col(loss)).otherwise(F.lit(0.0))).alias("sum_nats"),
                                        F.sum(nb).cast("bigint").alias("sum_bytes"))
    return agg.withColumn("bpb", F.when(F.col("sum_bytes") > 0, F.col("sum_nats") / (F.lit(LN2) * F.col("sum_bytes")))
                          .otherwise(F.lit(float("inf"))))


def bpb_by_split(losses: DataFrame, token_bytes: DataFrame, split: str, sequence: str, token_budget: int | None = None,
                 rows: int = 32, row_tokens: int = 2048) -> DataFrame:
    """I9 by split, over the first sequences of each split that whole steps of ``rows`` rows of ``row_tokens``
    tokens take from the budget (``token_budget // (rows * row_tokens)`` steps); ``None``: over all sequences."""
    if token_budget is not None:
        from tessera.operators.order import index_within
        n = token_budget // (rows * row_tokens) * rows
        kept = index_within(losses.select(sequence, split).distinct(), [split], sequence, out="_rank").where(F.col("_rank") < n)
        losses = losses.join(kept.select(sequence, split), [sequence, split], "left_semi")
    return bits_per_byte(losses, token_bytes, [split])


# ---------------------------------------------------------------- I6 / I7
def score_options(losses: DataFrame, spans: DataFrame, item: str = "item_id", option: str = "option_idx",
                  gold: str = "gold") -> DataFrame:
    """Mean loss over positions ``[start-1, end-1)`` per option; prediction =
    the first option of least mean (an empty span never wins); correct if = gold."""
    j = losses.join(spans.select(item, option, "start", "end"), [item, option])
    in_span = (F.col("pos") >= F.col("start") - 1) & (F.col("pos") < F.col("end") - 1)
    means = j.where(in_span).groupBy(item, option).agg(F.avg("loss").alias("mean_loss"))
    best = means.groupBy(item).agg(F.min(F.struct("mean_loss", option)).alias("_b"))
    golds = spans.select(item, gold).distinct()
    return (best.join(golds, item).select(item, F.col("_b").getField(option).alias("pred"),
                                          F.col("_b").getField("mean_loss").alias("best_mean"), gold)
            .withColumn("correct", F.col("pred") == F.col(gold)))


def score_exact_continuation(losses: DataFrame, spans: DataFrame, item: str = "item_id",
                             option: str = "option_idx") -> DataFrame:
    """Every prediction on the span equals the actual next token
    (the prediction at ``i`` is for token ``i + 1``)."""
    j = losses.join(spans.select(item, option, "start", "end"), [item, option])
    cur = j.where((F.col("pos") >= F.col("start") - 1) & (F.col("pos") < F.col("end") - 1))
    nxt = losses.select(item, option, (F.col("pos") - 1).alias("pos"), F.col("token").alias("next_token"))
    pairs = cur.join(nxt, [item, option, "pos"], "left")
    return pairs.groupBy(item, option).agg(
        F.bool_and(F.coalesce(F.col("pred_token") == F.col("next_token"), F.lit(False))).alias("correct"))


# ---------------------------------------------------------------- I13
def exec_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcome class per recorded execution (passed / timeout / memory / error /
    no_code_extracted)."""
    cls = (F.when(~F.col("has_code"), "no_code_extracted").when(F.col("success"), "passed")
           .when(F.col("timeout"), "timeout").when(F.col("memory_exceeded"), "memory").otherwise("error"))
    return outcomes.withColumn("outcome", cls)


# ---------------------------------------------------------------- J4
def error_streaks(log: DataFrame, key: list[str], order: list[str], status: str = "status",
                  threshold: int = K.STREAK_THRESHOLD, start: int = K.STREAK_START_BUDGET,
                  floor: int = K.STREAK_MIN_BUDGET, chunk_rows: int = 100_000) -> DataFrame:
    """Consecutive-400 streaks and the halved token budget, per key in time order.

    Gaps and islands: an island starts at each success; inside it the 400s
    are counted; every ``threshold + 1``-th one halves the budget (floor
    ``floor``) and restarts the counter; other failures leave the counter.
    All running values are chunked scans (no per-key window, no join on an
    island, which may hold all rows of a key): the count at the island's start
    is the largest running count at a success so far.
    """
    from tessera.operators.order import chunk_positions, chunked_running_max, chunked_running_sums
    is400, ok = (F.col(status) == 400), (F.col(status) == 200)
    g = chunk_positions(log, key, order, chunk_rows)
    g = chunked_running_sums(g, key, {"_r400": is400.cast("bigint")})
    g = chunked_running_max(g, key, F.when(ok, F.col("_r400")), "_base")
    g = g.withColumn("_c", F.col("_r400") - F.coalesce(F.col("_base"), F.lit(0)))
    g = g.withColumn("_halve", (is400 & (F.col("_c") % (threshold + 1) == 0)).cast("bigint"))
    g = chunked_running_sums(g, key, {"halvings": F.col("_halve")})
    return (g.withColumn("halvings", F.col("halvings").cast("int"))
            .withColumn("streak", (F.col("_c") % (threshold + 1)).cast("int"))
            .withColumn("budget", F.greatest(F.expr(f"shiftright({int(start)}, least(halvings, 30))"), F.lit(floor)))
            .drop("_r400", "_base", "_c", "_halve", "_pos", "_chunk"))
