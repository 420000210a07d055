"""Queries for spans, sequence ops, loss scoring, bits per byte and log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import order as O
from tessera.operators import score as S
from tessera.operators import seq as Q
from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.views import v_log, v_losses, v_outcomes, v_part_idx, v_spans, v_token_bytes
from tessera.session import cut_lineage

R = lambda c, n=6: F.round(c, n)
LS = f"WITH {DV.V_LOSSES}, {DV.V_SPANS}"


def _arr(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@register("score_options", LS + """,
m AS (SELECT l.item_id, l.option_idx, avg(loss) AS mean_loss FROM v_losses l JOIN v_spans s USING (item_id, option_idx)
      WHERE pos >= start - 1 AND pos < "end" - 1 GROUP BY 1, 2),
b AS (SELECT item_id, option_idx AS pred, mean_loss, row_number() OVER (PARTITION BY item_id ORDER BY mean_loss, option_idx) AS rn FROM m),
g AS (SELECT DISTINCT item_id, gold FROM v_spans)
SELECT item_id, pred, round(mean_loss, 6) AS best_mean, gold, pred = gold AS correct FROM b JOIN g USING (item_id) WHERE rn = 1""")
def score_options_q(spark, sf):
    """Least mean loss over each option's span; first option on ties."""
    r = S.score_options(v_losses(spark, sf), v_spans(spark, sf))
    return r.select("item_id", "pred", R(F.col("best_mean")).alias("best_mean"), "gold", "correct")


@register("score_exact_continuation", LS + """,
c AS (SELECT l.* FROM v_losses l JOIN v_spans s USING (item_id, option_idx) WHERE pos >= start - 1 AND pos < "end" - 1),
p AS (SELECT c.item_id, c.option_idx, coalesce(c.pred_token = n.token, false) AS ok FROM c
      LEFT JOIN v_losses n ON n.item_id = c.item_id AND n.option_idx = c.option_idx AND n.pos - 1 = c.pos)
SELECT item_id, option_idx, bool_and(ok) AS correct FROM p GROUP BY 1, 2""")
def score_exact_continuation_q(spark, sf):
    """All span predictions equal the next actual tokens."""
    return S.score_exact_continuation(v_losses(spark, sf), v_spans(spark, sf))


@register("lookup_token_bytes", f"""WITH {DV.V_LOSSES}, {DV.V_TOKEN_BYTES}
SELECT item_id, option_idx, pos, target, CASE WHEN target < 0 THEN 0 ELSE coalesce(n_bytes, 0) END AS n_bytes
FROM v_losses LEFT JOIN v_token_bytes tb ON target = tb.token""")
def lookup_token_bytes_q(spark, sf):
    """H2: byte length of each target token (negative -> 0)."""
    r = S.lookup_token_bytes(v_losses(spark, sf), v_token_bytes(spark, sf))
    return r.select("item_id", "option_idx", "pos", "target", F.col("n_bytes").cast("int").alias("n_bytes"))


_BPB_SQL = f"""WITH {DV.V_LOSSES}, {DV.V_TOKEN_BYTES},
j AS (SELECT *, CASE WHEN target < 0 THEN 0 ELSE coalesce(n_bytes, 0) END AS nb FROM v_losses LEFT JOIN v_token_bytes tb ON target = tb.token)"""


@register("bits_per_byte", _BPB_SQL + """
SELECT option_idx, CAST(sum(nb) AS BIGINT) AS sum_bytes,
       round(CASE WHEN sum(nb) > 0 THEN sum(CASE WHEN nb > 0 THEN loss ELSE 0.0 END) / (ln(2) * sum(nb)) ELSE 'inf'::DOUBLE END, 6) AS bpb
FROM j GROUP BY option_idx""")
def bits_per_byte_q(spark, sf):
    """Bits per byte per option stream."""
    r = S.bits_per_byte(v_losses(spark, sf), v_token_bytes(spark, sf), ["option_idx"])
    return r.select("option_idx", "sum_bytes", R(F.col("bpb")).alias("bpb"))


def _split_sql(kept):
    return _BPB_SQL + f""",
it AS (SELECT item_id, CASE WHEN item_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT item_id FROM v_losses)),
kept AS (SELECT item_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY item_id) - 1 AS r FROM it) WHERE {kept})
SELECT split, CAST(sum(nb) AS BIGINT) AS sum_bytes,
       round(sum(CASE WHEN nb > 0 THEN loss ELSE 0.0 END) / (ln(2) * sum(nb)), 6) AS bpb
FROM j JOIN kept USING (item_id) GROUP BY split"""


def _by_split(spark, sf, budget):
    lo = v_losses(spark, sf).withColumn("split", F.when(F.col("item_id") % 10 == 0, "val").otherwise("train"))
    r = S.bpb_by_split(lo, v_token_bytes(spark, sf), "split", "item_id", budget, rows=32, row_tokens=7)
    return r.select("split", "sum_bytes", R(F.col("bpb")).alias("bpb"))


@register("bpb_by_split", _split_sql("r < 704"))
def bpb_by_split_q(spark, sf):
    """Bits per byte for train and val over a budget of 5000 tokens, rounded down to whole steps of 32 rows
    of 7 tokens (704 sequences per split)."""
    return _by_split(spark, sf, 5000)


@register("bpb_by_split_all", _split_sql("true"))
def bpb_by_split_all_q(spark, sf):
    """I10 without a budget: bits per byte for train and val over all sequences."""
    return _by_split(spark, sf, None)


_SEQ_SQL = f"""WITH {DV.V_LOSSES},
sq AS (SELECT item_id, option_idx, list(token ORDER BY pos, token) AS tokens FROM v_losses GROUP BY 1, 2)"""


def _seqs(spark, sf):
    lo = v_losses(spark, sf)
    return lo.groupBy("item_id", "option_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x.token).alias("tokens"))


def _common_sql(side):
    seqs = "seqs" if side == "left" else "list_transform(seqs, lambda s: list_reverse(s))"
    return f"""(SELECT item_id, coalesce((SELECT min(i) - 1 FROM range(1, ml + 1) t(i)
                 WHERE list_bool_or(list_transform(ss, lambda s: s[i] <> ss[1][i]))), ml) AS common
       FROM (SELECT item_id, {seqs} AS ss, list_min(list_transform(seqs, lambda s: len(s))) AS ml
             FROM (SELECT item_id, list(tokens) AS seqs FROM sq GROUP BY item_id)))"""


@register("common_length", _SEQ_SQL + f"""
SELECT p.item_id, p.common AS prefix_len, s.common AS suffix_len FROM {_common_sql('left')} p JOIN {_common_sql('right')} s USING (item_id)""")
def common_length_q(spark, sf):
    """common prefix and suffix length over the option sequences of each item."""
    sq = _seqs(spark, sf)
    c = Q.common_lengths(sq, "item_id")
    return c.select("item_id", F.col("prefix_len").cast("bigint"), F.col("suffix_len").cast("bigint"))


@register("answer_spans", _SEQ_SQL + f"""
SELECT sq.item_id, option_idx, CAST(p.common AS BIGINT) AS start, CAST(len(tokens) AS BIGINT) AS "end",
       CAST(len(tokens) - s.common AS BIGINT) AS schema_start
FROM sq JOIN {_common_sql('left')} p USING (item_id) JOIN {_common_sql('right')} s USING (item_id)""")
def answer_spans_q(spark, sf):
    """multiple-choice spans (common prefix .. end) and schema starts (end - common suffix)."""
    sq = cut_lineage(_seqs(spark, sf))  # read as sequences and as the items' first sequences
    both = Q.answer_spans(sq, ["multiple_choice", "schema"])
    return both.select("item_id", "option_idx", F.col("multiple_choice_start").alias("start"), "end", F.col("schema_start").alias("schema_start")).select(
        "item_id", "option_idx", F.col("start").cast("bigint"), F.col("end").cast("bigint"),
        F.col("schema_start").cast("bigint"))


@register("truncate_left", _SEQ_SQL + """,
sp AS (SELECT sq.*, 2 + option_idx % 2 AS start, 2 + option_idx % 2 + 2 + item_id % 3 AS "end" FROM sq)
SELECT item_id, option_idx, array_to_string(CASE WHEN len(tokens) > 5 THEN tokens[-5:] ELSE tokens END, ',') AS tokens,
       CAST(start - greatest(len(tokens) - 5, 0) AS BIGINT) AS start, CAST("end" - greatest(len(tokens) - 5, 0) AS BIGINT) AS "end",
       start - greatest(len(tokens) - 5, 0) >= 0 AND "end" - greatest(len(tokens) - 5, 0) >= 0 AS ok FROM sp""")
def truncate_left_q(spark, sf):
    """keep the last five tokens, shift the spans, flag negative starts."""
    sq = _seqs(spark, sf)
    start = F.lit(2) + F.col("option_idx") % 2
    sp = sq.withColumn("start", start).withColumn("end", start + 2 + F.col("item_id") % 3).withColumn("ok", F.lit(True))
    t = Q.truncate_left(sp, 5)
    return t.select("item_id", "option_idx", _arr(F.col("tokens")).alias("tokens"), F.col("start").cast("bigint"),
                    F.col("end").cast("bigint"), "ok")


@register("pad_right", _SEQ_SQL + """
SELECT item_id, option_idx, array_to_string(tokens || list_transform(range(max(len(tokens)) OVER (PARTITION BY item_id // 8) - len(tokens)), lambda x: -1), ',') AS tokens,
       CAST(len(tokens) - 1 AS INT) AS last_pos FROM sq""")
def pad_right_q(spark, sf):
    """right padding with -1 to the longest sequence of each batch of 8 items."""
    sq = _seqs(spark, sf).withColumn("batch", (F.col("item_id") / 8).cast("bigint"))
    p = Q.pad_right(sq, "batch", -1)
    return p.select("item_id", "option_idx", _arr(F.col("tokens")).alias("tokens"), F.col("last_pos").cast("int"))


@register("inputs_targets", _SEQ_SQL + """
SELECT item_id, option_idx, array_to_string(tokens[1:len(tokens) - 1], ',') AS inputs, array_to_string(tokens[2:], ',') AS targets FROM sq""")
def inputs_targets_q(spark, sf):
    """shifted inputs and targets of every sequence."""
    t = Q.inputs_targets(_seqs(spark, sf))
    return t.select("item_id", "option_idx", _arr(F.col("inputs")).alias("inputs"), _arr(F.col("targets")).alias("targets"))


@register("bin_by_sequence_cap", f"""WITH {DV.V_PART_IDX}
SELECT p_partkey, idx, idx // 8 AS batch FROM v_part_idx""")
def bin_by_sequence_cap_q(spark, sf):
    """F8: items of four sequences each, batches under a cap of 32 sequences."""
    return Q.bin_by_sequence_cap(v_part_idx(spark, sf), 32, 4).select("p_partkey", "idx", "batch")


@register("pass_any", f"""WITH {DV.V_OUTCOMES},
p AS (SELECT problem, bool_or(success AND has_code) AS passed FROM v_outcomes GROUP BY problem)
SELECT count(*) AS n, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS n_correct, round(sum(CAST(passed AS INT)) / count(*), 6) AS accuracy FROM p""")
def pass_any_q(spark, sf):
    """I3 -> I1: a problem passes when any of its samples passed."""
    o = S.exec_outcomes(v_outcomes(spark, sf)).withColumn("correct", F.col("outcome") == "passed")
    p = S.pass_any(o, ["problem"])
    a = S.accuracy(p)
    return a.select("n", "n_correct", R(F.col("accuracy")).alias("accuracy"))


@register("exec_outcomes", f"""WITH {DV.V_OUTCOMES}
SELECT CASE WHEN NOT has_code THEN 'no_code_extracted' WHEN success THEN 'passed' WHEN timeout THEN 'timeout'
            WHEN memory_exceeded THEN 'memory' ELSE 'error' END AS outcome, count(*) AS n FROM v_outcomes GROUP BY 1""")
def exec_outcomes_q(spark, sf):
    """Execution outcome classes."""
    return S.exec_outcomes(v_outcomes(spark, sf)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register("running_accuracy", f"""WITH {DV.V_LOG}
SELECT user_id, event_id,
  count(*) OVER w AS n_so_far, CAST(sum(CAST(status = 200 AS INT)) OVER w AS BIGINT) AS correct_so_far,
  round(sum(CAST(status = 200 AS INT)) OVER w / count(*) OVER w, 6) AS running_accuracy
FROM v_log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_accuracy_q(spark, sf):
    """Success rate so far, per user in time order."""
    g = v_log(spark, sf).withColumn("correct", F.col("status") == 200)
    r = S.running_accuracy(g, ["user_id"], order=["ts", "event_id"])
    return r.select("user_id", "event_id", "n_so_far", "correct_so_far", R(F.col("running_accuracy")).alias("running_accuracy"))


@register("error_streaks", f"""WITH {DV.V_LOG},
a AS (SELECT *, sum(CAST(status = 200 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM v_log),
b AS (SELECT *, sum(CAST(status = 400 AS INT)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM a),
h AS (SELECT *, sum(CAST(status = 400 AND c % 11 = 0 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hv FROM b)
SELECT user_id, event_id, CAST(c % 11 AS INT) AS streak, CAST(hv AS INT) AS halvings,
       CAST(greatest(65536 >> least(hv, 30), 256) AS INT) AS budget FROM h""")
def error_streaks_q(spark, sf):
    """400-streaks and the max-token budget per user."""
    r = S.error_streaks(v_log(spark, sf), ["user_id"], ["ts", "event_id"])
    return r.select("user_id", "event_id", "streak", "halvings", F.col("budget").cast("int"))


def _toy_scorer(seqs):
    """Deterministic stand-in for a model: loss = token mod 7, prediction = (token + 1) mod 5."""
    return [([t % 7 for t in s], [(t + 1) % 5 for t in s]) for s in seqs]


@register("score_with", _SEQ_SQL + """
SELECT item_id, option_idx, CAST(i - 1 AS INT) AS pos, CAST(tokens[i] AS INT) AS token,
       CASE WHEN i < len(tokens) THEN CAST(tokens[i] % 7 AS DOUBLE) END AS loss,
       CASE WHEN i < len(tokens) THEN CAST((tokens[i] + 1) % 5 AS INT) END AS pred_token
FROM (SELECT *, unnest(generate_series(1, len(tokens))) AS i FROM sq)""")
def score_with_q(spark, sf):
    """M3: a toy user scorer turns every option sequence into the long loss table."""
    from tessera.operators.ext import score_with
    return score_with(_seqs(spark, sf), _toy_scorer, ["item_id", "option_idx"])


def _bins_sql(lane):
    """Greedy batches by a recursive query, one item of every lane at a time."""
    return f"""WITH RECURSIVE {DV.V_PART_IDX},
i AS (SELECT {lane} AS lane, idx, CAST(CASE WHEN p_partkey % 11 = 0 THEN 20 ELSE 3 + p_partkey % 3 END AS INT) AS n,
             row_number() OVER (PARTITION BY {lane} ORDER BY idx) AS k FROM v_part_idx),
walk AS (SELECT lane, idx, n, k, 0::BIGINT AS batch, n AS held FROM i WHERE k = 1
  UNION ALL SELECT i.lane, i.idx, i.n, i.k, batch + CAST(held > 0 AND held + i.n > 16 AS INT), CASE WHEN held > 0 AND held + i.n > 16 THEN i.n ELSE held + i.n END
  FROM walk JOIN i ON i.lane = walk.lane AND i.k = walk.k + 1)
SELECT lane, idx, n, batch FROM walk"""


def _binned(spark, sf, lane, **options):
    n = F.when(F.col("p_partkey") % 11 == 0, 20).otherwise(F.lit(3) + F.col("p_partkey") % 3).cast("int")
    p = v_part_idx(spark, sf).select("idx", n.alias("n"))
    return Q.bin_by_sequence_cap_var(p.withColumn("lane", lane), 16, **options)


@register("bin_by_sequence_cap_var", _bins_sql("idx % 4"))
def bin_by_sequence_cap_var_q(spark, sf):
    """F8 (variable n): parts with 3-5 option sequences each, some with more than the cap, greedy batches under
    a cap of 16 sequences, four ranks (lane = idx % 4)."""
    return _binned(spark, sf, F.col("idx") % 4)


@register("bin_one_lane", _bins_sql("0::BIGINT"))
def bin_one_lane(spark, sf):
    """F8 (variable n) with all items in one lane, in chunks of 256."""
    return _binned(spark, sf, F.lit(0), chunk_rows=256)


@register("answer_spans_lm", _SEQ_SQL + """,
w AS (SELECT item_id, option_idx, tokens AS t_with, tokens[1:CAST(item_id % 3 AS INT) + option_idx] AS t_without FROM sq)
SELECT item_id, option_idx, CAST(len(t_without) AS BIGINT) AS start, CAST(len(t_with) AS BIGINT) AS "end",
       len(t_without) < len(t_with) AND t_with[1:len(t_without)] = t_without AS ok FROM w""")
def answer_spans_lm_q(spark, sf):
    """F2 (language modelling): "without" = a prefix of "with" (0-4 tokens long,
    sometimes all of it, so ``ok`` is false there)."""
    sq = _seqs(spark, sf).withColumn(
        "t_without", F.slice("tokens", 1, (F.col("item_id") % 3).cast("int") + F.col("option_idx")))
    s = Q.answer_spans(sq, "language_modeling", tokens="tokens", tokens_without="t_without")
    return s.select("item_id", "option_idx", F.col("start").cast("bigint"), F.col("end").cast("bigint"), "ok")
