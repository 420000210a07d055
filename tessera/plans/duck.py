"""DuckDB SQL builders for the oracle side of each registered query.

These produce SQL *text* for the correctness gate only; nothing here runs
inside the Spark jobs.
"""

from __future__ import annotations

from tessera import constants as K


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def chars(s: str) -> str:
    """SQL expression for a string of arbitrary characters (via chr())."""
    return "(" + " || ".join(f"chr({ord(ch)})" for ch in s) + ")"


WS = chars(K.PY_WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def matches(x: str, p: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {q(p)}, {q(flags)})" if flags else f"regexp_matches({x}, {q(p)})"


def extract(x: str, p: str, g: int = 1, flags: str = "") -> str:
    return f"regexp_extract({x}, {q(p)}, {g}, {q(flags)})" if flags else f"regexp_extract({x}, {q(p)}, {g})"


def extract_first(x: str, p: str, g: int = 1, flags: str = "") -> str:
    return f"(CASE WHEN {matches(x, p, flags)} THEN {extract(x, p, g, flags)} END)"


def extract_last(x: str, p: str, g: int = 1, flags: str = "") -> str:
    fl = f", {q(flags)}" if flags else ""
    return f"(regexp_extract_all({x}, {q(p)}, {g}{fl})[-1])"


def hash_number(x: str) -> str:
    return f"replace({strip(extract_first(x, K.HASH_NUMBER_RE))}, ',', '')"


def letter(x: str, letters: str = "A-E") -> str:
    first = extract_first(x, K.BEST_ANSWER_RE.format(letters=letters), flags="i")
    last = extract_last(x, K.PAREN_LETTER_RE.format(letters=letters))
    return f"upper(coalesce({first}, {last}))"


def paren_letter(x: str) -> str:
    return f"('(' || {letter(x, 'A-D')} || ')')"


def math_answer(x: str) -> str:
    p = K.FINAL_ANSWER_RE
    g1, g2 = extract(x, p, 1, "s"), extract(x, p, 2, "s")
    sentence = f"(CASE WHEN {g1} <> '' THEN {strip(g1)} WHEN {g2} <> '' THEN {strip(g2)} END)"
    boxed = strip(extract_last(x, K.BOXED_RE))
    return f"(CASE WHEN {matches(x, p, 's')} THEN {sentence} ELSE {boxed} END)"


def normalize_math(x: str) -> str:
    e = f"(string_split({x}, '=')[-1])"
    for before, after in K.MATH_SUBSTITUTIONS:
        e = f"replace({e}, {q(before)}, {q(after)})"
    for expr in K.MATH_REMOVED_EXPRESSIONS:
        e = f"replace({e}, {q(expr)}, '')"
    e = f"regexp_replace({e}, {q(r'(.*)\$(.+)\$(.*)')}, '\\2', 'g')"
    for cmd in ("text", "textbf", "overline", "boxed"):
        e = f"regexp_replace({e}, {q(chr(92) + chr(92) + cmd + r'\{(.*?)\}')}, '\\1', 'g')"
    e = f"replace({e}, '$', '')"
    nc = f"replace({e}, ',', '')"
    e = f"(CASE WHEN regexp_full_match({nc}, '\\p{{Nd}}+') THEN {nc} ELSE {e} END)"
    return strip(e)
