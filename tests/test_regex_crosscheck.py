"""Grading functions (Java regex inside Spark) vs plain Python ``re`` on random texts.

The texts are drawn from fragments that exercise the differences between the
engines: unicode whitespace, carriage returns, line separators, fences,
boxes, parentheses and hash markers.
"""

import random
import re

import pytest

from tessera import constants as K
from tessera.functions import text as T

FRAGMENTS = ["#### ", "-", "1", "2,5", "0.5", ".", ",", " ", "\n", "\r", " ", " ", "\t", "(A)", "(b)", "(E)",
             "best answer is ", "Best Answer is (", "B", "c", ")", "Final Answer: The final answer is ", "$", "\\boxed{",
             "{", "}", "x^2", "I hope", " I hope", "```", "```python", "```py\n", "\n```", "def f():", "return 1",
             "=", "\\text{", "cm", "a ", "an ", "é", "Ω", "　", "\x1c"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def py_hash(t):
    m = re.search(K.HASH_NUMBER_RE, t)
    return m.group(1).strip().replace(",", "") if m else None


def py_letter(t, letters="A-E"):
    m = re.search(K.BEST_ANSWER_RE.format(letters=letters), t, re.IGNORECASE)
    if m:
        return m.group(1).upper()
    ms = re.findall(K.PAREN_LETTER_RE.format(letters=letters), t)
    return ms[-1].upper() if ms else None


def py_math(t):
    m = re.search(K.FINAL_ANSWER_RE, t, re.DOTALL)
    if m:
        g = m.group(1) or m.group(2)
        return g.strip() if g else None
    ms = re.findall(K.BOXED_RE, t)
    return ms[-1].strip() if ms else None


def py_program(t):
    ms = re.findall(K.CLOSED_FENCE_RE, t, re.DOTALL)
    return ms[0].strip() if ms else t.strip()


def py_code(t):
    m = re.search(K.PYTHON_FENCE_RE, t, re.DOTALL)
    if m:
        return m.group(1).strip()
    m = re.search(K.ANY_FENCE_RE, t, re.DOTALL)
    if m:
        return m.group(1).strip()
    s = t.strip()
    return s if s else None


@pytest.mark.parametrize("seed", [1, 2])
def test_grading_regexes_match_python(spark, seed):
    ts = texts(400, seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t string")
    got = {r.i: r for r in df.select("i", T.extract_hash_number("t").alias("h"), T.extract_letter("t").alias("l"),
                                     T.extract_math_answer("t").alias("m"), T.extract_program("t").alias("p"),
                                     T.extract_code("t").alias("c"), T.py_strip("t").alias("s")).collect()}
    for i, t in enumerate(ts):
        r = got[i]
        assert r.h == py_hash(t), (t, r.h)
        assert r.l == py_letter(t), (t, r.l)
        assert r.m == py_math(t), (t, r.m)
        assert r.p == py_program(t), (t, r.p)
        assert r.c == py_code(t), (t, r.c)
        assert r.s == t.strip(), (t, r.s)
