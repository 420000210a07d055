"""Queries for conversation assembly, validation and surgery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import conv as CV
from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.plans.views import v_conv_rows, v_gsm, v_mc


@register("assemble_messages", """
SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM conversations GROUP BY conv_id""")
def assemble_messages_q(spark, sf):
    """B1: ordered messages per conversation."""
    a = CV.assemble_messages(table(spark, sf, "conversations"))
    return a.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: m.role), ",").alias("roles"),
                    F.aggregate("messages", F.lit(0).cast("bigint"), lambda acc, m: acc + F.length(m.text)).alias("n_chars"))


def _validate_sql(mode):
    min_rest, sys_ok, strings = CV.MODES[mode]
    cb = "is_parts" if strings == "all" else "(is_parts AND role = 'user')"
    plain = f"(role <> CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END OR {cb})"
    sysr = f"(role <> CASE WHEN turn = 0 THEN 'system' WHEN (turn - 1) % 2 = 0 THEN 'user' ELSE 'assistant' END OR {cb})"
    why = lambda e: (f"CASE WHEN role <> {e} THEN 'bad_role' ELSE 'non_string_content' END")
    e_plain = "CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END"
    e_sys = "CASE WHEN turn = 0 THEN 'system' WHEN (turn - 1) % 2 = 0 THEN 'user' ELSE 'assistant' END"
    has_sys = "first_role = 'system'" if sys_ok else "false"
    return f"""SELECT '{mode}' AS mode, conv_id, reason IS NULL AS is_valid, reason,
       CASE WHEN reason IN ('bad_role', 'non_string_content') THEN bad_pos END AS bad_index
FROM (SELECT conv_id, bad_pos,
        CASE WHEN t0 <> 0 OR t1 <> n - 1 THEN 'turn_gap'
             WHEN n - CASE WHEN {has_sys} THEN 1 ELSE 0 END < {min_rest} THEN 'too_short'
             WHEN bad_pos IS NOT NULL THEN bad_why END AS reason
      FROM (SELECT conv_id, n, t0, t1, first_role,
                   CASE WHEN {has_sys} THEN bs_pos ELSE bp_pos END AS bad_pos,
                   CASE WHEN {has_sys} THEN bs_why ELSE bp_why END AS bad_why
            FROM (SELECT conv_id, count(*) AS n, min(turn) AS t0, max(turn) AS t1, arg_min(role, turn) AS first_role,
                         min(turn) FILTER (WHERE {plain}) AS bp_pos, arg_min({why(e_plain)}, turn) FILTER (WHERE {plain}) AS bp_why,
                         min(turn) FILTER (WHERE {sysr}) AS bs_pos, arg_min({why(e_sys)}, turn) FILTER (WHERE {sysr}) AS bs_why
                  FROM v_conv_rows GROUP BY conv_id)))"""


@register("validate_conversation", f"WITH {DV.V_CONV_ROWS} " + " UNION ALL ".join(
    f"({_validate_sql(m)})" for m in CV.MODES))
def validate_conversation_q(spark, sf):
    """B2 in its three modes over conversations with data-derived defects."""
    rows = v_conv_rows(spark, sf)
    outs = [CV.validate_conversation(rows, m, is_parts="is_parts").withColumn("mode", F.lit(m)) for m in CV.MODES]
    u = reduce(lambda a, b: a.unionByName(b), outs)
    return u.select("mode", "conv_id", "is_valid", "reason", F.col("bad_index").cast("bigint").alias("bad_index"))


@register("merge_system", """
WITH a AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, m, m[1].role = 'system' AS is_sys, m[2].role = 'user' AS nxt_user FROM a)
SELECT conv_id,
       CAST(CASE WHEN is_sys AND coalesce(nxt_user, false) THEN len(m) - 1 ELSE len(m) END AS BIGINT) AS n_messages,
       CASE WHEN is_sys AND coalesce(nxt_user, false) THEN 'user' ELSE m[1].role END AS first_role,
       CAST(CASE WHEN is_sys AND coalesce(nxt_user, false) THEN length(m[1].text || chr(10) || chr(10) || m[2].text) ELSE length(m[1].text) END AS INT) AS first_len,
       is_sys AND NOT coalesce(nxt_user, false) AS merge_error
FROM b""")
def merge_system_q(spark, sf):
    """System text merged into the first user message."""
    a = CV.merge_system(CV.assemble_messages(table(spark, sf, "conversations")))
    first = F.element_at("messages", 1)
    return a.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    first.getField("role").alias("first_role"), F.length(first.getField("text")).alias("first_len"),
                    "merge_error")


@register("pop_last_assistant", """
WITH a AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn) AS m FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(m[-1].role = 'assistant', false) AS pop_ok,
       CAST(CASE WHEN m[-1].role = 'assistant' THEN length(m[-1].text) END AS INT) AS ref_len,
       CAST(CASE WHEN m[-1].role = 'assistant' THEN len(m) - 1 ELSE len(m) END AS BIGINT) AS n_left
FROM a""")
def pop_last_assistant_q(spark, sf):
    """Completion prompts keep all but the final assistant message."""
    a = CV.pop_last_assistant(CV.assemble_messages(table(spark, sf, "conversations")))
    return a.select("conv_id", "pop_ok", F.length("reference").alias("ref_len"),
                    F.size("messages").cast("bigint").alias("n_left"))


@register("flatten_parts", f"""WITH {DV.V_GSM},
p AS (SELECT l_orderkey, l_linenumber,
             string_split(regexp_replace(answer, '(<<[^>]+>>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS pieces FROM v_gsm)
SELECT l_orderkey, l_linenumber, array_to_string(list_transform(pieces, lambda x:
  CASE WHEN starts_with(x, '<<') AND ends_with(x, '>>') AND length(x) >= 4 THEN
    (CASE WHEN contains(substr(x, 3, length(x) - 4), '=')
          THEN substr(substr(x, 3, length(x) - 4), 1, length(substr(x, 3, length(x) - 4)) - length(split_part(substr(x, 3, length(x) - 4), '=', -1)) - 1)
               || split_part(substr(x, 3, length(x) - 4), '=', -1)
          ELSE substr(x, 3, length(x) - 4) END)
  ELSE x END), '') AS flat FROM p""")
def flatten_parts_q(spark, sf):
    """Part texts of the parsed GSM8K solutions joined back into one string."""
    g = v_gsm(spark, sf)
    return g.select("l_orderkey", "l_linenumber", CV.flatten_parts(T.split_tool_calls("answer")).alias("flat"))


@register("answer_index_to_letter", f"""WITH {DV.V_MC}
SELECT item_id, CASE WHEN len(choices) = 4 THEN ['A', 'B', 'C', 'D'][answer + 1] END AS answer_letter,
       len(choices) = 4 AS choices_ok, subject FROM v_mc""")
def answer_index_to_letter_q(spark, sf):
    """B6 + B7: MMLU auxiliary rows wrapped in ``train`` are unwrapped, then index -> letter."""
    wrapped = v_mc(spark, sf).select(F.struct("item_id", "question", "choices", "answer", "subject").alias("train"))
    u = CV.unwrap(wrapped, "train")
    return CV.answer_index_to_letter(u).select("item_id", "answer_letter", "choices_ok", "subject")


@register("normalize_labels", f"""WITH {DV.V_MC},
a AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN ['1', '2', '3', '4', '5'][1:3 + item_id % 3]
                           ELSE ['A', 'B', 'C', 'D', 'E'][1:3 + item_id % 3] END AS labels, answer FROM v_mc),
b AS (SELECT item_id, labels, labels[answer % len(labels) + 1] AS answerKey FROM a)
SELECT item_id, array_to_string(['A', 'B', 'C', 'D', 'E'][1:len(labels)], ',') AS norm_labels,
       ['A', 'B', 'C', 'D', 'E'][list_position(labels, answerKey)] AS correct_label FROM b""")
def normalize_labels_q(spark, sf):
    """ARC label schemes (digits or letters, 3-5 choices) -> A..E."""
    m = v_mc(spark, sf)
    n = (F.lit(3) + F.col("item_id") % 3).cast("int")
    labels = F.when(F.col("item_id") % 2 == 0, F.slice(F.array(*[F.lit(x) for x in "12345"]), 1, n)).otherwise(
        F.slice(F.array(*[F.lit(x) for x in "ABCDE"]), 1, n))
    a = m.select("item_id", labels.alias("labels"), "answer")
    a = a.withColumn("answerKey", F.element_at("labels", (F.col("answer") % F.size("labels") + 1).cast("int")))
    r = CV.normalize_labels(a)
    return r.select("item_id", F.array_join("norm_labels", ",").alias("norm_labels"), "correct_label")
