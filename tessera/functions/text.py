"""String, regex and scalar grading functions: ``Column -> Column``.

All are native Spark expressions (no Python UDF).  Python regexes are run by
Java's engine with ``(?U)`` (Unicode classes, as Python's ``re``) and ``(?d)``
(only ``\\n`` ends a line, as Python's ``.`` and ``$``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _py_ws_class() -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in K.PY_WHITESPACE) + "]"


def _python_whitespace(pattern: str) -> str:
    """Replace ``\\s`` outside character classes by Python's whitespace set
    (Java's Unicode ``\\s`` lacks U+001C..U+001F, which ``str`` counts as space)."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append(_py_ws_class() if (nxt == "s" and depth == 0) else pattern[i:i + 2])
            i += 2
            continue
        if ch == "[":
            depth += 1
        elif ch == "]" and depth:
            depth -= 1
        out.append(ch)
        i += 1
    return "".join(out)


def java_re(pattern: str, flags: str = "") -> str:
    """A Python ``re`` pattern for Java: Unicode classes, ``\\n``-only lines, and
    Python's exact ``\\s`` set."""
    return f"(?Ud{flags}){_python_whitespace(pattern)}"


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes all Unicode whitespace at both ends."""
    return F.btrim(_c(c), F.lit(K.PY_WHITESPACE))


def extract_first(c, pattern: str, group: int = 1, flags: str = "") -> Column:
    """First match group, null when the pattern does not match (not ``''``)."""
    p = java_re(pattern, flags)
    c = _c(c)
    return F.when(c.rlike(p), F.regexp_extract(c, p, group))


def extract_last(c, pattern: str, group: int = 1, flags: str = "") -> Column:
    """Group of the last non-overlapping match, null when none."""
    return F.try_element_at(F.regexp_extract_all(_c(c), F.lit(java_re(pattern, flags)), F.lit(group)),
                            F.lit(-1))


# ---------------------------------------------------------------- B11 slugs
def model_slug(c) -> Column:
    """``/`` -> ``_`` (file names of response logs)."""
    return F.translate(_c(c), "/", "_")


def csv_slug(c) -> Column:
    """``/`` -> ``-`` (CORE csv names)."""
    return F.translate(_c(c), "/", "-")


def section_slug(c) -> Column:
    """Lower case, spaces to ``-`` (report section files)."""
    return F.replace(F.lower(_c(c)), F.lit(" "), F.lit("-"))


# ---------------------------------------------------------------- D1-D3
def extract_hash_number(c) -> Column:
    """First ``#### <number>``, commas dropped; a trailing ``.`` is kept."""
    g = extract_first(c, K.HASH_NUMBER_RE)
    return F.replace(py_strip(g), F.lit(","), F.lit(""))


def extract_letter(c, letters: str = "A-E") -> Column:
    """``best answer is (X)`` (any case) else the last ``(X)``; upper-cased."""
    first = extract_first(c, K.BEST_ANSWER_RE.format(letters=letters), flags="i")
    last = extract_last(c, K.PAREN_LETTER_RE.format(letters=letters))
    return F.upper(F.coalesce(first, last))


def extract_paren_letter(c) -> Column:
    """D3: as D2 over A-D, wrapped as ``(X)``."""
    return F.concat(F.lit("("), extract_letter(c, "A-D"), F.lit(")"))


# ---------------------------------------------------------------- D4-D6
def extract_math_answer(c) -> Column:
    """The Final-Answer sentence (boxed or bare ``$X$``), else the last ``\\boxed{}``.

    An empty box inside the sentence gives null (the reference raises there).
    """
    c = _c(c)
    p = java_re(K.FINAL_ANSWER_RE, "s")
    g1 = F.regexp_extract(c, p, 1)
    g2 = F.regexp_extract(c, p, 2)
    sentence = F.when(g1 != "", py_strip(g1)).when(g2 != "", py_strip(g2))
    boxed = py_strip(extract_last(c, K.BOXED_RE))
    return F.when(c.rlike(p), sentence).otherwise(boxed)


def normalize_math(c) -> Column:
    """Minerva normalisation, substitutions and removals in their fixed order."""
    x = F.element_at(F.split(_c(c), "=", -1), -1)
    for before, after in K.MATH_SUBSTITUTIONS:
        x = F.replace(x, F.lit(before), F.lit(after))
    for expr in K.MATH_REMOVED_EXPRESSIONS:
        x = F.replace(x, F.lit(expr), F.lit(""))
    x = F.regexp_replace(x, java_re(r"(.*)\$(.+)\$(.*)"), "$2")
    for cmd in ("text", "textbf", "overline", "boxed"):
        x = F.regexp_replace(x, java_re(r"\\" + cmd + r"\{(.*?)\}"), "$1")
    x = F.replace(x, F.lit("$"), F.lit(""))
    no_commas = F.replace(x, F.lit(","), F.lit(""))
    x = F.when(no_commas.rlike(java_re(r"^\p{Nd}+\z")), no_commas).otherwise(x)
    return py_strip(x)


def math_equiv(a, b) -> Column:
    """Equal after D5; a null side is not equal."""
    return F.coalesce(normalize_math(a) == normalize_math(b), F.lit(False))


# ---------------------------------------------------------------- D7-D10
def extract_imports(c) -> Column:
    """Leading import/from lines (stripped); blank and comment lines are skipped,
    the first other line stops the scan."""
    lines = F.transform(F.split(_c(c), "\n", -1), lambda s: py_strip(s))
    is_imp = lambda s: s.startswith("import ") | s.startswith("from ")
    stops = F.filter(F.transform(lines, lambda s, i: F.when(~is_imp(s) & (s != "") & ~s.startswith("#"), i)),
                     lambda i: i.isNotNull())
    head = F.when(F.size(stops) > 0, F.slice(lines, 1, F.array_min(stops))).otherwise(lines)
    return F.array_join(F.filter(head, is_imp), "\n")


def extract_program(c) -> Column:
    """First closed fence (plain or python) else the whole text; stripped."""
    p = java_re(K.CLOSED_FENCE_RE, "s")
    c = _c(c)
    return F.when(c.rlike(p), py_strip(F.regexp_extract(c, p, 1))).otherwise(py_strip(c))


def extract_code(c) -> Column:
    """First python fence (may be unclosed), else any fence, else the text.

    ``''`` from an empty fence and null from an empty text both mean no code.
    """
    c = _c(c)
    pp, pa = java_re(K.PYTHON_FENCE_RE, "s"), java_re(K.ANY_FENCE_RE, "s")
    whole = py_strip(c)
    return (F.when(c.rlike(pp), py_strip(F.regexp_extract(c, pp, 1)))
            .when(c.rlike(pa), py_strip(F.regexp_extract(c, pa, 1)))
            .when(whole != "", whole))


def compose_humaneval(imports, code, test, entry_point) -> Column:
    """D10 (local HumanEval): imports, code, tests, ``check(entry)``."""
    return F.concat(_c(imports), F.lit("\n\n"), _c(code), F.lit("\n\n"), _c(test),
                    F.lit("\n"), F.lit("check("), _c(entry_point), F.lit(")"))


def compose_mbpp(test_imports, code, test) -> Column:
    """D10 (MBPP+): optional imports block, code, harness, blank-line separated."""
    imports = F.when(F.size(_c(test_imports)) > 0, F.array_join(_c(test_imports), "\n"))
    return F.concat_ws("\n\n", imports, _c(code), _c(test))


def compose_humaneval_plus(code, test, entry_point) -> Column:
    """D10 (HumanEval+): code, harness, ``check(entry)`` and a newline."""
    return F.concat(_c(code), F.lit("\n\n"), _c(test), F.lit("\n\ncheck("), _c(entry_point), F.lit(")\n"))


# ---------------------------------------------------------------- D12-D14
def count_letter(word, letter) -> Column:
    """Non-overlapping occurrences of ``letter`` in ``word``."""
    w, l_ = _c(word), _c(letter)
    return ((F.length(w) - F.length(F.replace(w, l_, F.lit("")))) / F.length(l_)).cast("int")


def spell(word) -> Column:
    """``word:c,h,a,r,s``."""
    w = _c(word)
    return F.concat(w, F.lit(":"), F.array_join(F.split(w, "", -1), ","))


def counting_walkthrough(word, letter) -> Column:
    """One ``i:c`` line per character; hits carry `` hit! count=k``."""
    w, l_ = _c(word), _c(letter)
    chars = F.split(w, "", -1)

    def line(ch, i):
        k = count_letter(F.substring(w, 1, i + 1), l_)
        return F.concat((i + 1).cast("string"), F.lit(":"), ch,
                        F.when(ch == l_, F.concat(F.lit(" hit! count="), k.cast("string"))).otherwise(F.lit("")),
                        F.lit("\n"))
    return F.array_join(F.transform(chars, line), "")


# ---------------------------------------------------------------- B9 / B10
def split_tool_calls(c) -> Column:
    """GSM8K answer -> ordered parts ``array<struct<type, text>>``.

    The texts between the calls and the two halves of each call are three passes over the answer.
    Inside a call the last ``=`` separates expression and result (no ``=``: result ``''``).  Empty text
    parts are kept.
    """
    c = _c(c)
    half = lambda i: F.regexp_extract_all(c, F.lit(K.TOOL_CALL_HALVES_RE), F.lit(i))
    rows = F.arrays_zip(F.split(c, K.TOOL_CALL_RE, -1).alias("text"), half(1).alias("expr"), half(2).alias("result"))

    def part(t, x):
        return F.struct(F.lit(t).alias("type"), x.alias("text"))
    return F.flatten(F.transform(rows, lambda r: F.when(r["expr"].isNull(), F.array(part("text", r["text"]))).otherwise(  # after the last call
        F.array(part("text", r["text"]), part("python", r["expr"]), part("python_output", r["result"])))))


def reference_answer(parts) -> Column:
    """D1 over the text of the last part of the last assistant message."""
    return extract_hash_number(F.element_at(_c(parts), -1).getField("text"))


def last_text_part(c) -> Column:
    """The last part of a GSM8K-style answer without building all parts: after the
    final tool call there is always a (possibly empty) text part."""
    return F.element_at(F.split(_c(c), K.TOOL_CALL_RE, -1), -1)


def gsm_reference_answer(c) -> Column:
    """B10 on an answer string: D1 over its last text part."""
    return extract_hash_number(last_text_part(c))
