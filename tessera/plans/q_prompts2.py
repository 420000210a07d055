"""Queries for MATH, GPQA, MBPP+ prompts and the SpellingBee generators."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from tessera import constants as K
from tessera import prompt_texts as PT
from tessera.operators import prompts as P
from tessera.operators import synth as SY
from tessera.plans import duck as D
from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.views import v_code, v_gpqa, v_math, v_words

SEP = "\n---\n"


def _render_py(msgs):
    """Messages fixed on the driver, rendered like ``render_messages``."""
    return SEP.join(f"{r}: {c}" for r, c in msgs)


def _fmt_sql(template, **exprs):
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(D.q(text))
        if field is not None:
            parts.append(exprs[field])
    return " || ".join(parts)


# ------------------------------------------------------------------ C6
_MATH_PREFIX = _render_py([("system", K.MATH_SYSTEM)] + [x for p, s in PT.MATH_FEW_SHOT for x in
                                                          (("user", "Problem:\n" + p), ("assistant", "Solution:\n" + s))])


@register("math_messages", f"""WITH {DV.V_MATH}
SELECT item_id, {D.q(_MATH_PREFIX + SEP + "user: Problem:" + chr(10))} || problem || {D.q(chr(10) * 2 + K.MATH_INSTRUCTION)} AS messages FROM v_math""")
def math_messages_q(spark, sf):
    """Four canonical Minerva shots, then the problem and the answer-format instruction."""
    m = v_math(spark, sf)
    return m.select("item_id", P.render_messages(P.math_messages("problem", P.math_shots())).alias("messages"))


# ------------------------------------------------------------------ C10
_MBPP_PREFIX = _render_py([x for u, a in PT.MBPP_FEW_SHOT for x in (("user", u), ("assistant", a))])


@register("mbpp_messages", f"""WITH {DV.V_CODE}
SELECT item_id, {D.q(_MBPP_PREFIX + SEP + "user: You are an expert Python programmer, and here is your task:" + chr(10))}
  || prompt || {D.q(chr(10) + "Your code should pass the following tests:" + chr(10))} || array_to_string(test_list, chr(10)) AS messages
FROM v_code""")
def mbpp_messages_q(spark, sf):
    """Three literal MBPP+ shots, then the task with its tests."""
    c = v_code(spark, sf)
    return c.select("item_id", P.render_messages(P.mbpp_messages("prompt", "test_list", P.mbpp_shots())).alias("messages"))


# ------------------------------------------------------------------ C7
def _gpqa_sql(mode):
    ch = [D.strip(f"choices[{i + 1}]") for i in range(4)]
    head = D.q("system: " + K.GPQA_SYSTEM + SEP + "user: ")
    if mode in ("0-shot", "0-shot-cot"):
        tpl = PT.GPQA_ZERO_SHOT_PROMPT if mode == "0-shot" else PT.GPQA_ZERO_SHOT_COT_PROMPT
        ext = PT.GPQA_ZERO_SHOT_ANSWER_EXTRACTION if mode == "0-shot" else PT.GPQA_ZERO_SHOT_COT_EXTRACTION
        body = _fmt_sql(tpl, question="Question", choice_a=ch[0], choice_b=ch[1], choice_c=ch[2], choice_d=ch[3])
        return f"{head} || {body} || {D.q(chr(10) * 2 + ext)}"
    cot = mode == "few-shot-cot"
    msgs = [("system", K.GPQA_SYSTEM), ("user", PT.GPQA_FEW_SHOT_PREAMBLE), ("assistant", PT.GPQA_FEW_SHOT_ACK)]
    for qq, a in PT.GPQA_FEW_SHOT_EXAMPLES:
        msgs += [("user", qq), ("assistant", a if cot else a.strip().split("\n")[-1])]
    instr = PT.GPQA_FEW_SHOT_FINAL_COT if cot else PT.GPQA_FEW_SHOT_FINAL_NO_COT
    labels = ", ".join(f"{D.q(x)}" for x in K.GPQA_LABELS)
    choices_text = (f"array_to_string(list_transform(generate_series(1, 4), lambda i: [{labels}][i] || ' ' || "
                    f"{D.strip('choices[i]')}), chr(10))")
    return (f"{D.q(_render_py(msgs) + SEP + 'user: Question: ')} || Question || {D.q(chr(10) + 'Choices:' + chr(10))} || "
            f"{choices_text} || {D.q(chr(10) * 2 + instr)}")


@register("gpqa_messages", f"""WITH {DV.V_GPQA},
k AS (SELECT item_id, Question, list_transform(list_sort(list_transform([correct, incorrect1, incorrect2, incorrect3],
        lambda c, i: {{'k': md5('0:' || Question || ':' || CAST(i - 1 AS VARCHAR)), 'c': c}})), lambda x: x.c) AS choices FROM v_gpqa)
""" + " UNION ALL ".join(f"SELECT item_id, '{m}' AS mode, {_gpqa_sql(m)} AS messages FROM k" for m in PT.GPQA_MODES))
def gpqa_messages_q(spark, sf):
    """C8 + C7: shuffled choices rendered in all four GPQA modes."""
    g = P.shuffle_choices(v_gpqa(spark, sf), "Question", "correct", ["incorrect1", "incorrect2", "incorrect3"])
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), P.render_messages(P.gpqa_messages(F.col("Question"), F.col("choices"), m)).alias("messages"))
                      for m in PT.GPQA_MODES])
    return g.select("item_id", F.inline(modes))


# ------------------------------------------------------------------ G6 / C12
def _draw_sql(name, key):
    return f"('0x' || substr(md5('{name}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


def _bee_sql(split):
    off = 0 if split == "train" else K.SPELLING_TEST_SEED_OFFSET
    s = f"(i + {off})"
    tpls = "[" + ", ".join(D.q(t) for t in PT.SPELLING_TEMPLATES) + "]"
    quotes = "[" + ", ".join(D.q(x) for x in PT.SPELLING_QUOTES) + "]"
    walk = ("array_to_string(list_transform(string_split(word, ''), lambda ch, j: CAST(j AS VARCHAR) || ':' || ch || "
            "CASE WHEN ch = letter THEN ' hit! count=' || CAST(CAST(j - length(replace(substr(word, 1, j), letter, '')) AS INT) AS VARCHAR) "
            "ELSE '' END || chr(10)), '')")
    return f"""WITH {DV.V_WORDS},
n AS (SELECT count(*) AS n FROM v_words),
ex AS (SELECT i AS example, {_draw_sql('word', s)} % n.n AS w, {_draw_sql('pick', s)} AS d_pick, {_draw_sql('pos', s)} AS d_pos,
              {_draw_sql('any', s)} AS d_any, {_draw_sql('tpl', s)} AS d_tpl, {_draw_sql('low', s)} AS d_low,
              {_draw_sql('lq', s)} AS d_lq, {_draw_sql('wq', s)} AS d_wq, {_draw_sql('qm', s)} AS d_qm
       FROM n, range(0, n.n) t(i)),
j AS (SELECT ex.*, word, CASE WHEN d_pick % 10 < 9 THEN substr(word, CAST(d_pos % length(word) + 1 AS INT), 1)
                               ELSE substr('{PT.SPELLING_LETTERS}', CAST(d_any % 26 + 1 AS INT), 1) END AS letter
      FROM ex JOIN v_words ON v_words.idx = ex.w),
c AS (SELECT *, CAST((length(word) - length(replace(word, letter, ''))) / length(letter) AS INT) AS cnt,
             {tpls}[CAST(d_tpl % {len(PT.SPELLING_TEMPLATES)} + 1 AS INT)] AS tpl0 FROM j),
u AS (SELECT *, replace(replace(CASE WHEN d_low % 10 < 3 THEN lower(tpl0) ELSE tpl0 END, '{{letter}}',
                   {quotes}[CAST(d_lq % 3 + 1 AS INT)] || letter || {quotes}[CAST(d_lq % 3 + 1 AS INT)]), '{{word}}',
                   {quotes}[CAST(d_wq % 3 + 1 AS INT)] || word || {quotes}[CAST(d_wq % 3 + 1 AS INT)])
                 || CASE WHEN d_qm % 2 = 0 THEN '?' ELSE '' END AS user_text FROM c)"""


@register("letter_question", _bee_sql("test") + " SELECT example, word, letter, user_text AS user FROM u")
def letter_question_q(spark, sf):
    """SpellingBee user turns (template, case, quotes, question mark) for test seeds."""
    w = v_words(spark, sf)
    b = SY.spelling_bee(w, w.count(), "test")
    return b.select("example", "word", "letter", "user")


@register("spelling_bee", _bee_sql("train") + """
SELECT example, word, letter, cnt AS count, user_text AS user,
  'We are asked to find the number ''' || letter || ''' in the word ''' || word || '''. Let me try a manual approach first.' || chr(10) || chr(10)
  || 'First spell the word out:' || chr(10) || word || ':' || array_to_string(string_split(word, ''), ',') || chr(10) || chr(10)
  || 'Then count the occurrences of ''' || letter || ''':' || chr(10) || WALK || chr(10) || 'This gives us ' || cnt || '.'
  || '|' || chr(10) || chr(10) || 'Let me double check this using Python:' || chr(10) || chr(10)
  || '|' || '''' || word || '''.count(''' || letter || ''')' || '|' || cnt
  || '|' || chr(10) || chr(10) || 'Python gives us ' || cnt || '.' || chr(10) || chr(10) || 'My final answer is:' || chr(10) || chr(10) || '#### ' || cnt AS assistant
FROM u""".replace("WALK", "array_to_string(list_transform(string_split(word, ''), lambda ch, j: CAST(j AS VARCHAR) || ':' || ch || "
                  "CASE WHEN ch = letter THEN ' hit! count=' || CAST(CAST(j - length(replace(substr(word, 1, j), letter, '')) AS INT) AS VARCHAR) "
                  "ELSE '' END || chr(10)), '')"))
def spelling_bee_q(spark, sf):
    """As many train conversations as corpus words; parts joined by '|'."""
    w = v_words(spark, sf)
    b = SY.spelling_bee(w, w.count(), "train")
    return b.select("example", "word", "letter", F.col("count").cast("int").alias("count"), "user",
                    F.array_join(F.transform("assistant_parts", lambda p: p.text), "|").alias("assistant"))


@register("gpqa_accuracy_cube", f"""WITH {DV.V_GPQA},
k AS (SELECT item_id, domain, subdomain, correct, list_transform(list_sort(list_transform([correct, incorrect1, incorrect2, incorrect3],
        lambda c, i: {{'k': md5('0:' || Question || ':' || CAST(i - 1 AS VARCHAR)), 'c': c}})), lambda x: x.c) AS choices FROM v_gpqa),
g AS (SELECT *, ['(A)', '(B)', '(C)', '(D)'][list_position(choices, correct)] AS gold,
             CASE item_id % 3 WHEN 0 THEN 'The best answer is ' || ['(A)', '(B)', '(C)', '(D)'][list_position(choices, correct)]
                              WHEN 1 THEN 'I pick (B) then (C)' ELSE 'unsure' END AS completion FROM k),
r AS (SELECT domain, subdomain, coalesce({D.paren_letter('completion')} = gold, false) AS c FROM g)
SELECT domain, subdomain, CAST(grouping(domain, subdomain) AS INT) AS gid, count(*) AS n,
       CAST(sum(CAST(c AS INT)) AS BIGINT) AS n_correct FROM r GROUP BY CUBE (domain, subdomain)""")
def gpqa_accuracy_cube_q(spark, sf):
    """C8 -> D3 -> I5 -> I2 (cube): GPQA accuracy by domain x subdomain with all subtotals."""
    from tessera.functions import text as T
    from tessera.operators import score as S
    g = P.shuffle_choices(v_gpqa(spark, sf), "Question", "correct", ["incorrect1", "incorrect2", "incorrect3"])
    k = F.col("item_id") % 3
    completion = (F.when(k == 0, F.concat(F.lit("The best answer is "), F.col("correct_label")))
                  .when(k == 1, F.lit("I pick (B) then (C)")).otherwise(F.lit("unsure")))
    g = g.withColumn("pred", T.extract_paren_letter(completion))
    a = S.accuracy_by(S.grade_exact(g, "pred", "correct_label"), ["domain", "subdomain"], mode="cube")
    return a.select("domain", "subdomain", F.col("gid").cast("int"), "n", "n_correct")
