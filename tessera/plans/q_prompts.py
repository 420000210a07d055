"""Queries for few-shot sampling and prompt rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import order as O
from tessera.operators import prompts as P
from tessera.plans import duck as D
from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.views import v_code, v_gpqa, v_gsm, v_icl_lm, v_icl_mc, v_icl_schema, v_mc

NL2 = "chr(10) || chr(10)"


@register("sample_fewshot", f"""WITH {DV.V_ICL_BASE}, {DV.fewshot_sql('v_icl_base', 3, 1234)}
SELECT idx, string_agg(CAST(shot_idx AS VARCHAR), ',' ORDER BY j) AS shot_idx FROM shots GROUP BY idx""")
def sample_fewshot_q(spark, sf):
    """three distinct non-self shot indices per benchmark item."""
    from tessera.plans.views import v_icl_base
    b = v_icl_base(spark, sf).select("idx")
    ix = O.fewshot_indices(b, 3, 1234, b.count())
    return ix.select("idx", F.array_join(F.transform("shot_idx", lambda x: x.cast("string")), ",").alias("shot_idx"))


@register("render_icl_mc", f"""WITH {DV.V_ICL_BASE}, {DV.V_ICL_MC}, {DV.fewshot_sql('v_icl_mc', 2, 1234)},
st AS (SELECT s.idx, string_agg(m.query || ' ' || m.choices[m.gold + 1] || {NL2}, '' ORDER BY s.j) AS txt
       FROM shots s JOIN v_icl_mc m ON m.idx = s.shot_idx GROUP BY s.idx)
SELECT v.item_id, CAST(o - 1 AS INT) AS option_idx, coalesce(st.txt, '') || v.query || ' ' || v.choices[o] AS prompt
FROM v_icl_mc v LEFT JOIN st USING (idx), generate_series(1, 4) t(o)""")
def render_icl_mc_q(spark, sf):
    """F9 + C2: two-shot multiple-choice prompts, one per choice."""
    m = v_icl_mc(spark, sf)
    s = O.sample_fewshot(m, 2, seed=1234, fields=["query", "choices", "gold"])
    return P.render_icl_mc(s).select("item_id", "option_idx", "prompt")


@register("render_icl_schema", f"""WITH {DV.V_ICL_BASE}, {DV.V_ICL_SCHEMA}, {DV.fewshot_sql('v_icl_schema', 2, 1234)},
st AS (SELECT s.idx, string_agg(m.context_options[m.gold + 1] || ' ' || m.continuation || {NL2}, '' ORDER BY s.j) AS txt
       FROM shots s JOIN v_icl_schema m ON m.idx = s.shot_idx GROUP BY s.idx)
SELECT v.item_id, CAST(o - 1 AS INT) AS option_idx, coalesce(st.txt, '') || v.context_options[o] || ' ' || v.continuation AS prompt
FROM v_icl_schema v LEFT JOIN st USING (idx), generate_series(1, 3) t(o)""")
def render_icl_schema_q(spark, sf):
    """F9 + C3: schema prompts, one per context option."""
    m = v_icl_schema(spark, sf)
    s = O.sample_fewshot(m, 2, seed=1234, fields=["context_options", "continuation", "gold"])
    return P.render_icl_schema(s).select("item_id", "option_idx", "prompt")


@register("render_icl_lm", f"""WITH {DV.V_ICL_BASE}, {DV.V_ICL_LM}, {DV.fewshot_sql('v_icl_lm', 2, 1234)},
st AS (SELECT s.idx, string_agg({D.strip('m.context')} || ' ' || m.continuation || {NL2}, '' ORDER BY s.j) AS txt
       FROM shots s JOIN v_icl_lm m ON m.idx = s.shot_idx GROUP BY s.idx)
SELECT item_id, {D.strip("coalesce(st.txt, '') || " + D.strip('v.context') + " || ' '")} AS prompt_without,
       coalesce(st.txt, '') || {D.strip('v.context')} || ' ' || v.continuation AS prompt_with
FROM v_icl_lm v LEFT JOIN st USING (idx)""")
def render_icl_lm_q(spark, sf):
    """F9 + C4: language-modelling prompts without / with the continuation."""
    m = v_icl_lm(spark, sf)
    s = O.sample_fewshot(m, 2, seed=1234, fields=["context", "continuation"])
    return P.render_icl_lm(s).select("item_id", "prompt_without", "prompt_with")


@register("render_mc", f"""WITH {DV.V_MC}
SELECT item_id, 'Multiple Choice question: ' || question || chr(10) ||
  array_to_string(list_transform(generate_series(1, 4), lambda i: '- ' || choices[i] || '=' || letters[i] || chr(10)), '')
  || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt FROM v_mc""")
def render_mc_q(spark, sf):
    """The common multiple-choice prompt."""
    return v_mc(spark, sf).select("item_id", P.render_mc("question", "letters", "choices").alias("prompt"))


_GSM_KEY_SQL = "md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)"


@register("gsm8k_messages", f"""WITH {DV.V_GSM.replace('SELECT l_orderkey, l_linenumber,', 'SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,', 1)},
sh AS (SELECT question, answer FROM v_gsm ORDER BY {_GSM_KEY_SQL} LIMIT 2),
st AS (SELECT string_agg('user: ' || question || chr(10) || '---' || chr(10) || 'assistant: ' || answer || chr(10) || '---' || chr(10), ''
                         ORDER BY {_GSM_KEY_SQL.replace('l_', 'x.l_')}) AS txt
       FROM (SELECT * FROM v_gsm ORDER BY {_GSM_KEY_SQL} LIMIT 2) x)
SELECT l_orderkey, l_linenumber, 'system: You are an expert at solving high school level math problems.' || chr(10) || '---' || chr(10)
  || st.txt || 'user: ' || question || {NL2} || 'Let''s think over the problem step by step. At the end, you MUST write the answer as an integer after ''#### ''.' AS messages
FROM v_gsm, st""")
def gsm8k_messages_q(spark, sf):
    """Prompt with two global shots (a seed-42 top-2 draw) for every problem."""
    g = v_gsm(spark, sf, keys=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    key = F.md5(F.concat_ws(":", F.lit("42"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    shots = (g.orderBy(key).limit(2)  # top-k: TakeOrdered, two rows
             .select(F.sort_array(F.collect_list(F.struct(key.alias("k"), "question", "answer"))).alias("s")))
    g = g.withColumn("shots", shots.scalar())  # scalar subquery, computed once
    return g.select("l_orderkey", "l_linenumber", P.render_messages(P.gsm8k_messages("question", "shots")).alias("messages"))


@register("shuffle_choices", f"""WITH {DV.V_GPQA},
k AS (SELECT item_id, correct, list_transform(list_sort(list_transform([correct, incorrect1, incorrect2, incorrect3],
        lambda c, i: {{'k': md5('0:' || Question || ':' || CAST(i - 1 AS VARCHAR)), 'c': c}})), lambda x: x.c) AS choices FROM v_gpqa)
SELECT item_id, array_to_string(list_transform(generate_series(1, 4), lambda i: ['(A)', '(B)', '(C)', '(D)'][i] || ' ' || {D.strip('choices[i]')}), chr(10)) AS choices_text,
       ['(A)', '(B)', '(C)', '(D)'][list_position(choices, correct)] AS correct_label FROM k""")
def shuffle_choices_q(spark, sf):
    """Stable per-question shuffle of four GPQA choices and the correct label."""
    g = P.shuffle_choices(v_gpqa(spark, sf), "Question", "correct", ["incorrect1", "incorrect2", "incorrect3"])
    return g.select("item_id", P.format_gpqa_choices("choices").alias("choices_text"), "correct_label")


@register("arc_messages", f"""WITH {DV.V_MC},
a AS (SELECT item_id, question, (choices || ['none of these'])[1:3 + item_id % 3] AS texts FROM v_mc),
b AS (SELECT *, ['A', 'B', 'C', 'D', 'E'][1:len(texts)] AS labels FROM a)
SELECT item_id, 'system: You are an expert at science and logical reasoning.' || chr(10) || '---' || chr(10) || 'user: ' ||
  'Given the following question and ' || CASE len(texts) WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 5 THEN 'five' END ||
  ' candidate answers (' || array_to_string(labels[1:len(labels) - 1], ', ') || ' and ' || labels[-1] ||
  '), choose the best answer.' || chr(10) || 'Question: ' || question || chr(10) ||
  array_to_string(list_transform(generate_series(1, len(texts)), lambda i: labels[i] || '. ' || texts[i]), chr(10)) || chr(10) ||
  'Your response should end with "The best answer is [the_answer_letter]" where the [the_answer_letter] is one of ' ||
  array_to_string(labels[1:len(labels) - 1], ', ') || ' or ' || labels[-1] || '.' AS messages FROM b""")
def arc_messages_q(spark, sf):
    """ARC prompts with three to five candidate answers."""
    m = v_mc(spark, sf)
    n = (F.lit(3) + F.col("item_id") % 3).cast("int")
    texts = F.slice(F.concat("choices", F.array(F.lit("none of these"))), 1, n)
    return m.select("item_id", P.render_messages(P.arc_messages("question", texts)).alias("messages"))


@register("humaneval_messages", f"""WITH {DV.V_CODE}
SELECT item_id, 'system: You are an expert Python programmer.' || chr(10) || '---' || chr(10) || 'user: ' ||
  'Write a solution to the following problem and make sure that it passes the tests:' || chr(10) || '```python' || chr(10)
  || prompt || chr(10) || '```' AS messages FROM v_code""")
def humaneval_messages_q(spark, sf):
    """C11: fenced HumanEval+ prompt."""
    return v_code(spark, sf).select("item_id", P.render_messages(P.humaneval_messages("prompt")).alias("messages"))
