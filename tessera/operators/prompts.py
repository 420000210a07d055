"""Prompt rendering (C1-C11): projections into strings and message arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import py_strip


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def msg(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), _c(content).alias("content"))


def render_mc(question, letters, choices) -> Column:
    """``Multiple Choice question: q``, one ``- choice=letter`` line per option
    (no space before the letter), blank line, instruction."""
    lines = F.zip_with(_c(letters), _c(choices), lambda l_, c: F.concat(F.lit("- "), c, F.lit("="), l_, F.lit("\n")))
    return F.concat(F.lit("Multiple Choice question: "), _c(question), F.lit("\n"), F.array_join(lines, ""),
                    F.lit(K.MC_INSTRUCTION))


def _shots_text(shots, render) -> Column:
    return F.coalesce(F.array_join(F.transform(_c(shots), lambda s: F.concat(render(s), F.lit("\n\n"))), ""), F.lit(""))


def render_icl_mc(df: DataFrame, delim: str = " ", shots: str = "shots") -> DataFrame:
    """One prompt per choice: shots (query, delim, gold choice, blank line) + query + delim + choice."""
    st = _shots_text(shots, lambda s: F.concat(s.query, F.lit(delim), F.element_at(s.choices, s.gold + 1)))
    return (df.select("*", F.posexplode("choices").alias("option_idx", "_choice"))
            .withColumn("prompt", F.concat(st, F.col("query"), F.lit(delim), F.col("_choice"))).drop("_choice"))


def render_icl_schema(df: DataFrame, delim: str = " ", shots: str = "shots") -> DataFrame:
    """One prompt per context option, the continuation shared."""
    st = _shots_text(shots, lambda s: F.concat(F.element_at(s.context_options, s.gold + 1), F.lit(delim), s.continuation))
    return (df.select("*", F.posexplode("context_options").alias("option_idx", "_ctx"))
            .withColumn("prompt", F.concat(st, F.col("_ctx"), F.lit(delim), F.col("continuation"))).drop("_ctx"))


def render_icl_lm(df: DataFrame, delim: str = " ", shots: str = "shots") -> DataFrame:
    """C4: prompts without / with the continuation; contexts stripped; the
    "without" prompt stripped at both ends."""
    st = _shots_text(shots, lambda s: F.concat(py_strip(s.context), F.lit(delim), s.continuation))
    base = F.concat(st, py_strip("context"), F.lit(delim))
    return df.withColumn("prompt_without", py_strip(base)).withColumn(
        "prompt_with", F.concat(base, F.col("continuation")))


def gsm8k_messages(question, shots) -> Column:
    """System, user/assistant per shot, then question + blank line + instruction."""
    shot_msgs = F.flatten(F.transform(_c(shots), lambda s: F.array(msg("user", s.question), msg("assistant", s.answer))))
    last = msg("user", F.concat(_c(question), F.lit("\n\n" + K.GSM8K_INSTRUCTION)))
    return F.concat(F.array(msg("system", F.lit(K.GSM8K_SYSTEM))), shot_msgs, F.array(last))


def math_messages(problem, shots) -> Column:
    """``Problem:``/``Solution:`` turns for the shots, then the problem + instruction."""
    shot_msgs = F.flatten(F.transform(_c(shots), lambda s: F.array(
        msg("user", F.concat(F.lit("Problem:\n"), s.problem)), msg("assistant", F.concat(F.lit("Solution:\n"), s.solution)))))
    last = msg("user", F.concat(F.lit("Problem:\n"), _c(problem), F.lit("\n\n" + K.MATH_INSTRUCTION)))
    return F.concat(F.array(msg("system", F.lit(K.MATH_SYSTEM))), shot_msgs, F.array(last))


def shuffle_choices(df: DataFrame, question: str, correct: str, incorrect: list[str], seed: int = 0) -> DataFrame:
    """Deterministic per-question permutation of the four choices.

    Sort key ``md5(seed:question:i)``; the correct label is the first position
    whose text equals the correct answer.  ``choices`` keep raw texts.
    """
    arr = F.array(F.col(correct), *[F.col(c) for c in incorrect])
    keyed = F.transform(arr, lambda c, i: F.struct(
        F.md5(F.concat(F.lit(f"{seed}:"), F.col(question), F.lit(":"), i.cast("string"))).alias("k"), c.alias("c")))
    shuffled = F.transform(F.array_sort(keyed), lambda x: x.c)
    pos = F.array_position(shuffled, F.col(correct))
    labels = F.array(*[F.lit(x) for x in K.GPQA_LABELS])
    return df.withColumn("choices", shuffled).withColumn("correct_label", F.element_at(labels, pos.cast("int")))


def format_gpqa_choices(choices) -> Column:
    """``(A) text`` lines with stripped texts."""
    labels = F.array(*[F.lit(x) for x in K.GPQA_LABELS])
    return F.array_join(F.zip_with(labels, _c(choices), lambda l_, c: F.concat(l_, F.lit(" "), py_strip(c))), "\n")


def arc_messages(question, texts) -> Column:
    """ARC prompt with the count word and the 'A, B and C' / 'A, B or C' lists."""
    t = _c(texts)
    n = F.size(t)
    labels = F.slice(F.array(*[F.lit(x) for x in K.MC_LETTERS]), 1, n)
    choices_str = F.array_join(F.zip_with(labels, t, lambda l_, c: F.concat(l_, F.lit(". "), c)), "\n")
    word = F.coalesce(F.element_at(F.create_map(*[x for kv in K.COUNT_WORDS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]), n),
                      n.cast("string"))
    head = F.array_join(F.slice(labels, 1, n - 1), ", ")
    last = F.element_at(labels, -1)
    user = F.concat(F.lit("Given the following question and "), word, F.lit(" candidate answers ("), head, F.lit(" and "),
                    last, F.lit("), choose the best answer.\nQuestion: "), _c(question), F.lit("\n"), choices_str,
                    F.lit("\nYour response should end with \"The best answer is [the_answer_letter]\" where the "
                          "[the_answer_letter] is one of "), head, F.lit(" or "), last, F.lit("."))
    return F.array(msg("system", F.lit(K.ARC_SYSTEM)), msg("user", user))


def humaneval_messages(prompt) -> Column:
    """C11: system + the prompt in a python fence."""
    user = F.concat(F.lit("Write a solution to the following problem and make sure that it passes the tests:\n```python\n"),
                    _c(prompt), F.lit("\n```"))
    return F.array(msg("system", F.lit(K.HUMANEVAL_SYSTEM)), msg("user", user))


def mbpp_messages(prompt, test_list, shots) -> Column:
    """Literal shots as user/assistant turns, then the task and its tests."""
    shot_msgs = F.flatten(F.transform(_c(shots), lambda s: F.array(msg("user", s.user), msg("assistant", s.assistant))))
    user = F.concat(F.lit("You are an expert Python programmer, and here is your task:\n"), _c(prompt),
                    F.lit("\nYour code should pass the following tests:\n"), F.array_join(_c(test_list), "\n"))
    return F.concat(shot_msgs, F.array(msg("user", user)))


def render_messages(m) -> Column:
    """Messages as one string (``role: content`` blocks) for logs and comparisons."""
    return F.array_join(F.transform(_c(m), lambda x: F.concat(x.role, F.lit(": "), x.content)), "\n---\n")


# ---------------------------------------------------------------- templates
def fmt(template: str, **cols) -> Column:
    """``str.format`` of a fixed template with column values (literal parts stay literals)."""
    import string
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            parts.append(_c(cols[field]))
    return F.concat(*parts) if parts else F.lit("")


def gpqa_messages(question, choices, mode: str) -> Column:
    """The four GPQA modes; few-shot adds a preamble turn and a fixed assistant
    line; non-cot keeps only the last line of each example answer."""
    from tessera import prompt_texts as PT
    if mode not in PT.GPQA_MODES:
        raise ValueError(f"unknown GPQA mode {mode!r}; expected one of {PT.GPQA_MODES}")
    ch = [py_strip(F.element_at(_c(choices), i + 1)) for i in range(4)]
    sys_msg = msg("system", F.lit(K.GPQA_SYSTEM))
    if mode in ("0-shot", "0-shot-cot"):
        tpl = PT.GPQA_ZERO_SHOT_PROMPT if mode == "0-shot" else PT.GPQA_ZERO_SHOT_COT_PROMPT
        ext = PT.GPQA_ZERO_SHOT_ANSWER_EXTRACTION if mode == "0-shot" else PT.GPQA_ZERO_SHOT_COT_EXTRACTION
        body = fmt(tpl, question=question, choice_a=ch[0], choice_b=ch[1], choice_c=ch[2], choice_d=ch[3])
        return F.array(sys_msg, msg("user", F.concat(body, F.lit("\n\n" + ext))))
    cot = mode == "few-shot-cot"
    msgs = [sys_msg, msg("user", F.lit(PT.GPQA_FEW_SHOT_PREAMBLE)), msg("assistant", F.lit(PT.GPQA_FEW_SHOT_ACK))]
    for q, a in PT.GPQA_FEW_SHOT_EXAMPLES:
        msgs.append(msg("user", F.lit(q)))
        msgs.append(msg("assistant", F.lit(a if cot else a.strip().split("\n")[-1])))
    instruction = PT.GPQA_FEW_SHOT_FINAL_COT if cot else PT.GPQA_FEW_SHOT_FINAL_NO_COT
    final = F.concat(F.lit("Question: "), _c(question), F.lit("\nChoices:\n"), format_gpqa_choices(choices),
                     F.lit("\n\n" + instruction))
    msgs.append(msg("user", final))
    return F.array(*msgs)


def math_shots(n_shot: int = 4) -> Column:
    """The canonical MATH shots; at most the four that exist (the reference warns and caps)."""
    from tessera import prompt_texts as PT
    shots = PT.MATH_FEW_SHOT[:max(0, min(n_shot, len(PT.MATH_FEW_SHOT)))]
    return F.array(*[F.struct(F.lit(p).alias("problem"), F.lit(s).alias("solution")) for p, s in shots]) if shots else \
        F.array().cast("array<struct<problem:string,solution:string>>")


def mbpp_shots() -> Column:
    from tessera import prompt_texts as PT
    return F.array(*[F.struct(F.lit(u).alias("user"), F.lit(a).alias("assistant")) for u, a in PT.MBPP_FEW_SHOT])


def letter_question(letter, word, template_idx, lower, letter_quote, word_quote, qmark) -> Column:
    """SpellingBee user turn: template (by index into the fixed list),
    optional lower case, optional quotes around letter and word, optional ``?``."""
    from tessera import prompt_texts as PT
    tpl = F.element_at(F.array(*[F.lit(t) for t in PT.SPELLING_TEMPLATES]), _c(template_idx) + 1)
    tpl = F.when(_c(lower), F.lower(tpl)).otherwise(tpl)
    lw = F.concat(_c(letter_quote), _c(letter), _c(letter_quote))
    ww = F.concat(_c(word_quote), _c(word), _c(word_quote))
    m = F.replace(F.replace(tpl, F.lit("{letter}"), lw), F.lit("{word}"), ww)
    return F.concat(m, F.when(_c(qmark), F.lit("?")).otherwise(F.lit("")))
