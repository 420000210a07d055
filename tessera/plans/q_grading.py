"""Queries for answer extraction, normalisation and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import score as S
from tessera.plans import duck as D
from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.plans.views import md5_draw, v_code, v_gsm, v_letters, v_math, v_words
from tessera.session import cut_lineage

NL = "chr(10)"


@register("extract_hash_number", f"""WITH {DV.V_GSM}
SELECT l_orderkey, l_linenumber, {D.hash_number('answer')} AS ref, {D.hash_number('completion')} AS pred FROM v_gsm""")
def extract_hash_number_q(spark, sf):
    """D1 on reference solutions and completions."""
    g = v_gsm(spark, sf)
    return g.select("l_orderkey", "l_linenumber", T.extract_hash_number("answer").alias("ref"),
                    T.extract_hash_number("completion").alias("pred"))


@register("grade_exact", f"""WITH {DV.V_GSM},
x AS (SELECT l_orderkey, l_linenumber, {D.hash_number('answer')} AS ref, {D.hash_number('completion')} AS pred FROM v_gsm)
SELECT l_orderkey, l_linenumber, coalesce(pred = ref, false) AS strict_correct, pred IS NOT DISTINCT FROM ref AS lenient_correct FROM x""")
def grade_exact_q(spark, sf):
    """Strict (API) and lenient (null = null) verdicts."""
    g = v_gsm(spark, sf).select("l_orderkey", "l_linenumber", T.extract_hash_number("answer").alias("ref"),
                                T.extract_hash_number("completion").alias("pred"))
    g = S.grade_exact(g, "pred", "ref", strict=True, out="strict_correct")
    g = S.grade_exact(g, "pred", "ref", strict=False, out="lenient_correct")
    return g.select("l_orderkey", "l_linenumber", "strict_correct", "lenient_correct")


_IS_CALL = "starts_with({x}, '<<') AND ends_with({x}, '>>') AND length({x}) >= 4"
_B9_SQL = f"""WITH {DV.V_GSM},
p AS (SELECT l_orderkey, l_linenumber,
             string_split(regexp_replace(answer, '(<<[^>]+>>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS pieces FROM v_gsm),
u AS (SELECT l_orderkey, l_linenumber, pieces, unnest(pieces) AS piece, unnest(generate_series(1, len(pieces))) AS pi FROM p),
c AS (SELECT *, {_IS_CALL.format(x='piece')} AS is_call, substr(piece, 3, length(piece) - 4) AS inr,
             pi - 1 + len(list_filter(pieces[1:pi - 1], lambda x: {_IS_CALL.format(x='x')})) AS base FROM u),
r AS (SELECT *, CASE WHEN contains(inr, '=') THEN split_part(inr, '=', -1) ELSE '' END AS result FROM c),
parts AS (SELECT l_orderkey, l_linenumber, base AS part_idx, CASE WHEN is_call THEN 'python' ELSE 'text' END AS type,
             CASE WHEN NOT is_call THEN piece WHEN contains(inr, '=') THEN substr(inr, 1, length(inr) - length(result) - 1)
                  ELSE inr END AS text FROM r
      UNION ALL SELECT l_orderkey, l_linenumber, base + 1, 'python_output', result FROM r WHERE is_call)"""


@register("split_tool_calls", _B9_SQL + " SELECT l_orderkey, l_linenumber, CAST(part_idx AS INT) AS part_idx, type, text FROM parts")
def split_tool_calls_q(spark, sf):
    """Every answer split into text / python / python_output parts (one row per part)."""
    g = v_gsm(spark, sf).select("l_orderkey", "l_linenumber", T.split_tool_calls("answer").alias("parts"))
    return g.select("l_orderkey", "l_linenumber", F.posexplode("parts").alias("part_idx", "p")).select(
        "l_orderkey", "l_linenumber", "part_idx", F.col("p.type").alias("type"), F.col("p.text").alias("text"))


@register("reference_answer", f"""WITH {DV.V_GSM},
p AS (SELECT l_orderkey, l_linenumber,
             string_split(regexp_replace(answer, '(<<[^>]+>>)', chr(1) || '\\1' || chr(1), 'g'), chr(1))[-1] AS piece FROM v_gsm),
t AS (SELECT *, CASE WHEN {_IS_CALL.format(x='piece')} THEN
                  (CASE WHEN contains(substr(piece, 3, length(piece) - 4), '=') THEN split_part(substr(piece, 3, length(piece) - 4), '=', -1) ELSE '' END)
                ELSE piece END AS text FROM p)
SELECT l_orderkey, l_linenumber, {D.hash_number('text')} AS ref FROM t""")
def reference_answer_q(spark, sf):
    """The answer from the last part of the solution (last text piece, no full split)."""
    g = v_gsm(spark, sf)
    return g.select("l_orderkey", "l_linenumber", T.gsm_reference_answer("answer").alias("ref"))


@register("extract_letter", f"""WITH {DV.V_MC}, {DV.V_LETTERS}
SELECT item_id, gold, {D.letter('completion')} AS pred, coalesce({D.letter('completion')} = gold, false) AS correct FROM v_letters""")
def extract_letter_q(spark, sf):
    """D2 + I5 (strict) on four phrasings of a letter answer."""
    v = v_letters(spark, sf).withColumn("pred", T.extract_letter("completion"))
    return S.grade_exact(v, "pred", "gold").select("item_id", "gold", "pred", "correct")


@register("extract_paren_letter", f"""WITH {DV.V_MC}, {DV.V_LETTERS}
SELECT item_id, '(' || gold || ')' AS gold, {D.paren_letter('completion')} AS pred FROM v_letters""")
def extract_paren_letter_q(spark, sf):
    """D3: GPQA style ``(X)`` answers over A-D."""
    v = v_letters(spark, sf)
    return v.select("item_id", F.concat(F.lit("("), "gold", F.lit(")")).alias("gold"),
                    T.extract_paren_letter("completion").alias("pred"))


@register("extract_math_answer", f"""WITH {DV.V_MATH}
SELECT item_id, {D.math_answer('completion')} AS pred FROM v_math""")
def extract_math_answer_q(spark, sf):
    """Final-Answer sentence, else last boxed."""
    return v_math(spark, sf).select("item_id", T.extract_math_answer("completion").alias("pred"))


@register("normalize_math", f"""WITH {DV.V_MATH}
SELECT item_id, {D.normalize_math('answer')} AS norm_answer, {D.normalize_math('completion')} AS norm_completion FROM v_math""")
def normalize_math_q(spark, sf):
    """D5 on reference answers and raw completions."""
    return v_math(spark, sf).select("item_id", T.normalize_math("answer").alias("norm_answer"),
                                    T.normalize_math("completion").alias("norm_completion"))


@register("math_equiv", f"""WITH {DV.V_MATH},
x AS (SELECT item_id, subject, level, {D.math_answer('completion')} AS pred, answer FROM v_math)
SELECT subject, level, count(*) AS n,
       CAST(sum(CAST(coalesce({D.normalize_math('pred')} = {D.normalize_math('answer')}, false) AS INT)) AS BIGINT) AS n_correct
FROM x GROUP BY 1, 2""")
def math_equiv_q(spark, sf):
    """D4 -> D6 -> I2: MATH accuracy by subject and level."""
    v = v_math(spark, sf).withColumn("pred", T.extract_math_answer("completion"))
    g = v.withColumn("correct", T.math_equiv("pred", "answer"))
    return S.accuracy_by(g, ["subject", "level"]).select("subject", "level", "n", "n_correct")


_IMPORTS_SQL = (
    "array_to_string(list_filter(CASE WHEN len(stops) > 0 THEN lines[1:list_min(stops) - 1] ELSE lines END, "
    "lambda s: starts_with(s, 'import ') OR starts_with(s, 'from ')), chr(10))")


@register("extract_imports", f"""WITH {DV.V_CODE},
l AS (SELECT item_id, list_transform(string_split(prompt, chr(10)), lambda s: {D.strip('s')}) AS lines FROM v_code),
s AS (SELECT *, list_filter(list_transform(lines, lambda s, i: CASE WHEN NOT (starts_with(s, 'import ') OR starts_with(s, 'from '))
        AND s <> '' AND NOT starts_with(s, '#') THEN i END), lambda x: x IS NOT NULL) AS stops FROM l)
SELECT item_id, {_IMPORTS_SQL} AS imports FROM s""")
def extract_imports_q(spark, sf):
    """Leading import lines of each prompt."""
    return v_code(spark, sf).select("item_id", T.extract_imports("prompt").alias("imports"))


def _code_sql(x):
    from tessera import constants as K
    pp, pa = K.PYTHON_FENCE_RE.replace("|$)", "|\\n?$)"), K.ANY_FENCE_RE.replace("|$)", "|\\n?$)")
    return (f"(CASE WHEN {D.matches(x, pp, 's')} THEN {D.strip(D.extract(x, pp, 1, 's'))} "
            f"WHEN {D.matches(x, pa, 's')} THEN {D.strip(D.extract(x, pa, 1, 's'))} "
            f"WHEN {D.strip(x)} <> '' THEN {D.strip(x)} END)")


def _program_sql(x):
    from tessera import constants as K
    p = K.CLOSED_FENCE_RE
    return f"(CASE WHEN {D.matches(x, p, 's')} THEN {D.strip(D.extract(x, p, 1, 's'))} ELSE {D.strip(x)} END)"


@register("extract_program", f"""WITH {DV.V_CODE}
SELECT item_id, {_program_sql('completion')} AS program FROM v_code""")
def extract_program_q(spark, sf):
    """First closed fence, else the whole completion."""
    return v_code(spark, sf).select("item_id", T.extract_program("completion").alias("program"))


@register("extract_code", f"""WITH {DV.V_CODE}
SELECT item_id, {_code_sql('completion')} AS code, coalesce({_code_sql('completion')}, '') = '' AS no_code FROM v_code""")
def extract_code_q(spark, sf):
    """Python fence (closed or not) > any fence > raw text; flags no-code."""
    c = T.extract_code("completion")
    return v_code(spark, sf).select("item_id", c.alias("code"), (F.coalesce(c, F.lit("")) == "").alias("no_code"))


@register("compose_program", f"""WITH {DV.V_CODE},
l AS (SELECT *, list_transform(string_split(prompt, chr(10)), lambda s: {D.strip('s')}) AS lines FROM v_code),
s AS (SELECT *, list_filter(list_transform(lines, lambda s, i: CASE WHEN NOT (starts_with(s, 'import ') OR starts_with(s, 'from '))
        AND s <> '' AND NOT starts_with(s, '#') THEN i END), lambda x: x IS NOT NULL) AS stops FROM l)
SELECT item_id,
  {_IMPORTS_SQL} || chr(10) || chr(10) || {_program_sql('completion')} || chr(10) || chr(10) || test || chr(10) || 'check(' || entry_point || ')' AS humaneval,
  concat_ws(chr(10) || chr(10), CASE WHEN len(test_imports) > 0 THEN array_to_string(test_imports, chr(10)) END,
            coalesce({_code_sql('completion')}, ''), test) AS mbpp,
  coalesce({_code_sql('completion')}, '') || chr(10) || chr(10) || test || chr(10) || chr(10) || 'check(' || entry_point || ')' || chr(10) AS humaneval_plus
FROM s""")
def compose_program_q(spark, sf):
    """The three program layouts (HumanEval, MBPP+, HumanEval+)."""
    v = v_code(spark, sf)
    code = F.coalesce(T.extract_code("completion"), F.lit(""))
    return v.select("item_id",
                    T.compose_humaneval(T.extract_imports("prompt"), T.extract_program("completion"), F.col("test"),
                                        F.col("entry_point")).alias("humaneval"),
                    T.compose_mbpp(F.col("test_imports"), code, F.col("test")).alias("mbpp"),
                    T.compose_humaneval_plus(code, F.col("test"), F.col("entry_point")).alias("humaneval_plus"))


# ------------------------------------------------------------------ words
def _word_letter(spark, sf):
    w = v_words(spark, sf)
    pos = (md5_draw(7, F.col("idx")) % F.length("word")) + 1
    return w.withColumn("letter", F.when(md5_draw(8, F.col("idx")) % 10 == 0, F.lit("z"))
                        .otherwise(F.col("word").substr(pos.cast("int"), F.lit(1))))


_WL_SQL = f"""WITH {DV.V_WORDS},
wl AS (SELECT *, CASE WHEN {DV.md5_draw(8, 'idx')} % 10 = 0 THEN 'z'
                      ELSE substr(word, CAST({DV.md5_draw(7, 'idx')} % length(word) + 1 AS INT), 1) END AS letter FROM v_words)"""


@register("count_letter", _WL_SQL + """
SELECT word, letter, CAST((length(word) - length(replace(word, letter, ''))) / length(letter) AS INT) AS n FROM wl""")
def count_letter_q(spark, sf):
    """Letter counts over the vocabulary of the corpus."""
    w = _word_letter(spark, sf)
    return w.select("word", "letter", T.count_letter("word", "letter").alias("n"))


@register("spell", f"""WITH {DV.V_WORDS}
SELECT word, word || ':' || array_to_string(string_split(word, ''), ',') AS spelled FROM v_words""")
def spell_q(spark, sf):
    """``word:c,h,a,r,s``."""
    return v_words(spark, sf).select("word", T.spell("word").alias("spelled"))


@register("counting_walkthrough", _WL_SQL + """
SELECT word, letter, array_to_string(list_transform(string_split(word, ''), lambda ch, i:
    CAST(i AS VARCHAR) || ':' || ch || CASE WHEN ch = letter THEN ' hit! count=' ||
      CAST(CAST((i - length(replace(substr(word, 1, i), letter, ''))) AS INT) AS VARCHAR) ELSE '' END || chr(10)), '') AS walkthrough
FROM wl""")
def counting_walkthrough_q(spark, sf):
    """The numbered spelling walk with running hit counts."""
    w = _word_letter(spark, sf)
    return w.select("word", "letter", T.counting_walkthrough("word", "letter").alias("walkthrough"))


@register("slugs", """
SELECT s_suppkey, replace('org/' || s_name || ' Model', '/', '_') AS model_slug,
       replace('org/' || s_name || ' Model', '/', '-') AS csv_slug,
       replace(lower('Chat ' || s_name || ' Evaluation'), ' ', '-') AS section_slug FROM supplier""")
def slugs_q(spark, sf):
    """File-name slugs of model names and report sections."""
    s = table(spark, sf, "supplier")
    name = F.concat(F.lit("org/"), "s_name", F.lit(" Model"))
    sec = F.concat(F.lit("Chat "), "s_name", F.lit(" Evaluation"))
    return s.select("s_suppkey", T.model_slug(name).alias("model_slug"), T.csv_slug(name).alias("csv_slug"),
                    T.section_slug(sec).alias("section_slug"))


@register("join_predictions", f"""WITH {DV.V_GSM},
pr AS (SELECT l_orderkey, l_linenumber, completion FROM v_gsm WHERE l_orderkey % 3 <> 2),
it AS (SELECT DISTINCT l_orderkey, l_linenumber, answer FROM v_gsm),
j AS (SELECT it.l_orderkey, it.l_linenumber, answer, coalesce(pr.completion, '') AS completion
      FROM it LEFT JOIN (SELECT DISTINCT * FROM pr) pr USING (l_orderkey, l_linenumber))
SELECT count(*) AS n, CAST(sum(CAST(coalesce({D.hash_number('completion')} = {D.hash_number('answer')}, false) AS INT)) AS BIGINT) AS n_correct FROM j""")
def join_predictions_q(spark, sf):
    """H4 -> D1 -> I5 -> I1: problems left-joined with the responses that exist;
    a missing response is '' and counts as wrong."""
    g = v_gsm(spark, sf)
    items = g.select("l_orderkey", "l_linenumber", "answer").distinct()
    preds = g.where(F.col("l_orderkey") % 3 != 2).select("l_orderkey", "l_linenumber", "completion").distinct()
    j = S.join_predictions(items, preds, ["l_orderkey", "l_linenumber"])
    j = j.withColumn("pred", T.extract_hash_number("completion")).withColumn("ref", T.extract_hash_number("answer"))
    a = S.accuracy(S.grade_exact(j, "pred", "ref"))
    return a.select("n", "n_correct")


@register("simple_spelling", f"""WITH {DV.V_WORDS},
n AS (SELECT count(*) AS n FROM v_words),
ex AS (SELECT i, {DV.md5_draw('spell', 'i + 10000000')} % n.n AS w FROM n, range(0, n.n) t(i))
SELECT i AS idx, 'Spell the word: ' || word AS user_text, word || ':' || array_to_string(string_split(word, ''), ',') AS assistant_text
FROM ex JOIN v_words ON v_words.idx = ex.w""")
def simple_spelling_q(spark, sf):
    """As many test examples as words: md5-drawn word (test seeds offset by
    10,000,000), 'Spell the word: w' -> D13."""
    from tessera.operators.synth import simple_spelling
    w = v_words(spark, sf)
    s = simple_spelling(w, w.count(), "test")
    return s.select(F.col("example").alias("idx"), F.col("user").alias("user_text"), F.col("assistant").alias("assistant_text"))


@register("complete_with", """SELECT l_orderkey % 7 = 0 AS failed, count(*) AS n,
       CAST(sum(CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_correct FROM lineitem GROUP BY 1""")
def complete_with_q(spark, sf):
    """M4: a toy user callback (echo the gold answer, raise on every 7th problem)
    over all GSM problems, then D1 + I5 + I1; failures count as wrong."""
    from tessera.operators.ext import complete_with
    g = v_gsm(spark, sf).withColumn("prompt", F.concat_ws("\u0002", "l_orderkey", "answer"))

    def echo(p):
        key, ans = p.split("\u0002", 1)
        if int(key) % 7 == 0:
            raise RuntimeError("provider error")
        return ans
    c = complete_with(g, echo)
    c = c.withColumn("pred", T.extract_hash_number("completion")).withColumn("ref", T.extract_hash_number("answer"))
    return S.accuracy_by(S.grade_exact(c, "pred", "ref"), [(F.col("error").isNotNull()).alias("failed")]) \
        .select("failed", "n", "n_correct")


@register("run_task", f"""WITH {DV.V_GSM}
SELECT 'gsm-numbers' AS task, 'generative' AS eval_type, count(*) AS n,
       CAST(sum(CAST(coalesce(l_orderkey % 3 <> 2 AND {D.hash_number('completion')} = {D.hash_number('answer')}, false) AS INT)) AS BIGINT) AS n_correct FROM v_gsm""")
def run_task_q(spark, sf):
    """M1: a registered task (prepare, responses that may be missing, grade) over all GSM problems."""
    from tessera.operators import ext as X
    g = v_gsm(spark, sf).withColumn("row", F.monotonically_increasing_id())
    X.register_task("gsm-numbers", lambda raw: raw.select("row", "answer"),
                    lambda j: S.grade_exact(j.withColumn("pred", T.extract_hash_number("completion")).withColumn("ref", T.extract_hash_number("answer")),
                                            "pred", "ref"), "generative", 0.0)
    g = cut_lineage(g.select("row", "l_orderkey", "answer", "completion"))  # both sides must see the same row numbers
    r = X.run_task("gsm-numbers", g, g.where(F.col("l_orderkey") % 3 != 2), ["row"])
    return r.select("task", "eval_type", "n", "n_correct")


@register("registered_tokenizer", "SELECT doc_id, CAST(strlen(text) + 1 AS INT) AS n_tokens, md5(text) AS text_md5 FROM documents")
def registered_tokenizer_q(spark, sf):
    """M2: a registered byte tokenizer encodes and decodes every document."""
    from tessera.operators import ext as X
    spec = X.bpe_tokenizer([])
    X.register_tokenizer("bytes", spec.encode_batch, spec.decode, spec.specials)
    spec = X.TOKENIZERS["bytes"]
    e = table(spark, sf, "documents").select("doc_id", X.encode_with("text", spec, prepend=spec.specials["<|bos|>"]).alias("ids"))
    d = e.select("doc_id", F.size("ids").alias("n_tokens"), X.decode_with(F.slice("ids", 2, 1 << 30), spec).alias("text"))
    return d.select("doc_id", "n_tokens", F.md5("text").alias("text_md5"))
