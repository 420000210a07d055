"""Arithmetic of Python literals as column expressions: whole numbers and floats, ``+ - * / //``, signs, brackets.

One fold over the tokens.  A frame holds an open bracket's sum and the term that is still being multiplied, so two
levels of precedence need no operator stack; outer frames wait in an array.  A value is a struct of a whole
number (at most 38 digits) or a float; both null is a failure, which every operation passes on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[0-9]+\.?[0-9]*|\.[0-9]+|//|[-+*/()]|[^ ]"
_WHOLE, _VALUE = "decimal(38,0)", "struct<i:decimal(38,0),d:double>"
_FRAME = f"struct<sum:{_VALUE},add:int,term:{_VALUE},op:string,sign:int>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that stands in the expression, and is evaluated, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _value(i: Column, d: Column) -> Column:
    return F.struct(i.cast(_WHOLE).alias("i"), d.cast("double").alias("d"))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _whole(*vs: Column) -> Column:
    out = F.lit(True)
    for v in vs:
        out = out & v["i"].isNotNull()
    return out


def _float(v: Column) -> Column:
    return F.coalesce(v["i"].cast("double"), v["d"])


def _try(name: str, a: Column, b: Column) -> Column:
    return F.call_function(name, a, b)


def _floor_div_whole(p: Column) -> Column:
    """Python's ``//`` on whole numbers: what the remainder, with the divisor's sign, leaves."""
    zero, a, b = F.lit(0).cast(_WHOLE), p["a"]["i"], p["b"]["i"]
    return _let(_try("try_mod", a, b), lambda r: _try(
        "try_divide", a - F.when((r != zero) & ((r < zero) != (b < zero)), r + b).otherwise(r), b).cast(_WHOLE))


def _floor_div_float(x: Column, y: Column) -> Column:
    """Python's ``//`` on floats; a zero keeps its sign."""
    def of(q: Column) -> Column:
        low = F.when(F.abs(q) < 2.0 ** 53, F.floor(q).cast("double")).otherwise(q)
        return F.when(q == 0, x / y * 0.0).otherwise(_let(low, lambda n: n + F.when(q - n > 0.5, 1.0).otherwise(0.0)))
    quotient = _let(_try("try_mod", x, y), lambda m: (x - m) / y - F.when((m != 0) & ((m < 0) != (y < 0)), 1.0).otherwise(0.0))
    return F.when(y != 0, _let(quotient, of))


def _apply(op: Column, a: Column, b: Column) -> Column:
    def of(p: Column) -> Column:
        a, b = p["a"], p["b"]
        both = _whole(a, b)
        i = F.when(both, F.when(op == "*", _try("try_multiply", a["i"], b["i"]).cast(_WHOLE)).when(op == "//", _floor_div_whole(p))
                   .when(op == "+", _try("try_add", a["i"], b["i"]).cast(_WHOLE)).when(op == "-", _try("try_subtract", a["i"], b["i"]).cast(_WHOLE)))
        d = _let(F.struct(_float(a).alias("x"), _float(b).alias("y")), lambda f: F.when(op == "/", _try("try_divide", f["x"], f["y"])).when(
            ~both, F.when(op == "*", f["x"] * f["y"]).when(op == "//", _floor_div_float(f["x"], f["y"])).when(op == "+", f["x"] + f["y"]).otherwise(f["x"] - f["y"])))
        return _value(i, d)
    return _let(F.struct(a.alias("a"), b.alias("b")), of)


def _frame(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(_FRAME)


def _closed(f: Column) -> Column:
    """Value of a frame: its sum with the last term."""
    return F.when(f["sum"].isNull(), f["term"]).otherwise(_apply(F.when(f["add"] == 1, "+").otherwise("-"), f["sum"], f["term"]))


def _with_operand(f: Column, v: Column) -> Column:
    """The frame with a value as its next factor, after the signs before it."""
    def of(x: Column) -> Column:
        signed = F.when(f["sign"] == 1, x).otherwise(_value(-x["i"], -x["d"]))
        term = F.when(f["term"].isNull(), signed).otherwise(_apply(f["op"], f["term"], signed))
        return _frame(sum=f["sum"], add=f["add"], term=term, op=_null("string"), sign=F.lit(1))
    return _let(v, of)


def _literal(t: Column) -> Column:
    """A number as Python reads it; a whole number that starts with a zero is none, unless it is zero."""
    whole = t.rlike("^[0-9]+$")
    return _value(F.when(whole & ~t.rlike("^0+[1-9]"), t.try_cast(_WHOLE)), F.when(~whole, t.try_cast("double")))


def evaluate(expr: Column) -> Column:
    """``struct<i, d>`` of an expression; null where it is none, or divides by zero."""
    start = _frame(sum=_null(_VALUE), add=F.lit(1), term=_null(_VALUE), op=_null("string"), sign=F.lit(1))
    state = lambda stack, frame, want, ok: F.struct(stack.cast(f"array<{_FRAME}>").alias("stack"), frame.cast(_FRAME).alias("frame"),
                                                    want.alias("want"), ok.alias("ok"))

    def step(s: Column, t: Column) -> Column:
        f, want, stack = s["frame"], s["want"], s["stack"]
        top = F.try_element_at(stack, F.lit(-1))
        signed = _frame(sum=f["sum"], add=f["add"], term=f["term"], op=f["op"], sign=F.when(t == "-", -f["sign"]).otherwise(f["sign"]))
        summed = _frame(sum=_closed(f), add=F.when(t == "+", 1).otherwise(-1), term=_null(_VALUE), op=_null("string"), sign=F.lit(1))
        factor = _frame(sum=f["sum"], add=f["add"], term=f["term"], op=t, sign=F.lit(1))
        number = t.rlike("^[0-9.]*[0-9][0-9.]*$")
        bad = state(stack, f, want, F.lit(False))
        return (F.when(~s["ok"], s)
                .when(number, F.when(want, state(stack, _with_operand(f, _literal(t)), F.lit(False), F.lit(True))).otherwise(bad))
                .when(t.isin("+", "-"), F.when(want, state(stack, signed, want, F.lit(True))).otherwise(state(stack, summed, F.lit(True), F.lit(True))))
                .when(t.isin("*", "/", "//"), F.when(want, bad).otherwise(state(stack, factor, F.lit(True), F.lit(True))))
                .when(t == "(", F.when(want, state(F.concat(stack, F.array(f)), start, want, F.lit(True))).otherwise(bad))
                .when((t == ")") & ~want & (F.size(stack) > 0),
                      state(F.slice(stack, 1, F.size(stack) - 1), _with_operand(top, _closed(f)), F.lit(False), F.lit(True)))
                .otherwise(bad))
    none = F.array().cast(f"array<{_FRAME}>")
    end = F.aggregate(F.regexp_extract_all(expr, F.lit(TOKEN), F.lit(0)), state(none, start, F.lit(True), F.lit(True)), step,
                      lambda s: F.when(s["ok"] & ~s["want"] & (F.size(s["stack"]) == 0), _closed(s["frame"])))
    return end


def float_text(d: Column) -> Column:
    """A float as Python's ``str`` writes it: the fewest digits that give it back (of numbers under 1e-307 maybe
    one more), plain from 1e-4 up to 1e16."""
    def written(short: Column) -> Column:
        minus = F.when(short.startswith("-"), "-").otherwise("")
        digits = F.regexp_replace(F.replace(F.regexp_extract(short, "^-?([0-9.]+)e", 1), F.lit("."), F.lit("")), "(?<=.)0+$", "")
        power = F.regexp_extract(short, "e([-+][0-9]+)$", 1).cast("int")
        return _let(F.struct(minus.alias("m"), digits.alias("d"), power.alias("p"), F.abs(power).cast("string").alias("e")), placed)

    def placed(x: Column) -> Column:
        digits, power, n = x["d"], x["p"], F.length(x["d"])
        rest = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        science = F.concat(F.substring(digits, 1, 1), rest, F.when(power < 0, "e-").otherwise("e+"), F.lpad(x["e"], F.greatest(F.length(x["e"]), F.lit(2)), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        large = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."),
                         F.when(n > power + 1, F.substring(digits, power + 2, n)).otherwise("0"))
        plain = F.when(power < 0, small).otherwise(large)
        return F.concat(x["m"], F.when((power < -4) | (power >= 16), science).otherwise(plain))
    tries = [F.format_string(f"%.{k}e", d) for k in (14, 15, 16)]
    short = F.when(tries[0].cast("double") == d, tries[0]).when(tries[1].cast("double") == d, tries[1]).otherwise(tries[2])
    return (F.when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").otherwise(_let(short, written)))


def arithmetic(expr: Column) -> Column:
    """Python's ``str`` of the value of an arithmetic expression, null where it has none."""
    return _let(evaluate(expr), lambda x: F.when(x["i"].isNotNull(), x["i"].cast("string")).when(x["d"].isNotNull(), float_text(x["d"])))


# ---------------------------------------------------------------- counts in strings

_LITERALS = r"""((?:\s*(?:'[^']*'|"[^"]*"))+)\s*"""
_SIDE = rf"(?:{_LITERALS}|\(\s*{_LITERALS}\))\s*"
_CALL = rf"{_SIDE}\.\s*count\s*\(\s*{_SIDE}\)\s*"
COUNT = rf"^\s*(?:{_CALL}|\(\s*{_CALL}\))\s*$"


def string_count(expr: Column) -> Column:
    """``'word'.count('x')`` as text: string literals in either quotes, several in a row joined, in brackets or not."""
    one = lambda i: F.regexp_extract(expr, COUNT, i)
    side = lambda i: F.concat(one(i), one(i + 1), one(i + 4), one(i + 5))  # noqa: E731  one of the four stands there
    text = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"""'[^']*'|"[^"]*\""""), F.lit(0)),
                                              lambda s: s.substr(F.lit(2), F.length(s) - 2)), "")
    word, x = text(side(1)), text(side(3))
    n = F.when(x == "", F.length(word) + 1).otherwise(((F.length(word) - F.length(F.replace(word, x, F.lit("")))) / F.length(x)).cast("int"))
    return F.when(expr.rlike(COUNT), n.cast("string"))
