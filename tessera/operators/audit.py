"""Re-run recorded calculator calls and compare with their recorded output.

The gate (which expressions the calculator accepts), the arithmetic and the counts in strings are column
expressions (``functions.calculator``); no row leaves the JVM.  Anything the gate rejects, or that fails, is
null, as are whole numbers of more than 38 digits and accepted string expressions other than a count of one
string in another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.calculator import arithmetic, string_count

# ---------------------------------------------------------------- fixed values
ARITH_CHARS = "0123456789*+-/.() "
STRING_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'\"()._ "
DANGEROUS = ['__', 'import', 'exec', 'eval', 'compile', 'open', 'file',
             'input', 'raw_input', 'globals', 'locals', 'vars', 'dir',
             'getattr', 'setattr', 'delattr', 'hasattr']


def _only(chars: str) -> str:
    return "^[" + "".join("\\" + c if c in "\\^-[]" else c for c in chars) + "]*$"


def calculator_kind(expr) -> Column:
    """'arith', 'string' or null (rejected), after removing commas."""
    e = F.replace(F.col(expr) if isinstance(expr, str) else expr, F.lit(","), F.lit(""))
    low = F.lower(e)
    danger = F.lit(False)
    for d in DANGEROUS:
        danger = danger | low.contains(d)
    return (F.when(e.rlike(_only(ARITH_CHARS)), F.when(~e.contains("**"), F.lit("arith")))
            .when(e.rlike(_only(STRING_CHARS)) & ~danger & e.contains(".count("), F.lit("string")))


def _whole(e: Column) -> Column:
    """The result where ``e`` is two whole numbers of at most nine digits and one of ``+-*``, with blanks around them, without a
    regex; else null."""
    op = F.translate(e, "0123456789 ", "")

    def number(n):
        x = F.trim(F.call_function("substring_index", e, op, F.lit(n)))
        value = x.try_cast("bigint")  # of other spellings, such as 007, the digits differ from the value's
        return F.when((F.length(x) <= 9) & (value.cast("string") == x), value)
    a, b = number(1), number(-1)
    return F.when(op == "*", a * b).when(op == "+", a + b).when(op == "-", a - b).cast("string")


def use_calculator(expr, kind: Column | None = None) -> Column:
    """The calculator result as text (null when rejected or failing); ``kind``, if the caller has it, is ``calculator_kind``."""
    e = F.replace(F.col(expr) if isinstance(expr, str) else expr, F.lit(","), F.lit(""))
    kind = calculator_kind(e) if kind is None else kind
    return F.coalesce(_whole(e), F.when(kind == "arith", arithmetic(e)).when(kind == "string", string_count(e)))


def tool_calls(parts) -> Column:
    """(expr, recorded output) for every python part followed by its python_output part."""
    p = F.col(parts) if isinstance(parts, str) else parts
    n = F.greatest(F.size(p) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: F.when(
        (a["type"] == "python") & (b["type"] == "python_output"), F.struct(a["text"].alias("expr"), b["text"].alias("recorded"))))
    return F.filter(pairs, lambda x: x.isNotNull())


def audit_tool_calls(df: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per recorded call with its recomputed result and agreement."""
    calls = df.select("*", F.posexplode(tool_calls(parts)).alias("call_no", "call")).drop(parts)
    calls = calls.withColumn("expr", F.col("call.expr")).withColumn("recorded", F.col("call.recorded")).drop("call")
    return (calls.withColumn("kind", calculator_kind("expr")).withColumn("recomputed", use_calculator("expr", F.col("kind")))
            .withColumn("agrees", F.coalesce(F.col("recomputed") == F.col("recorded"), F.lit(False))))
