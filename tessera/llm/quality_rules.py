"""Quality rules as a short-circuit cascade.

Every rule is a boolean expression over a document.  ``plan`` estimates on a sample what a rule costs
(seconds of a one-task job, less those of a job without a rule) and what it rejects, and orders the
rules by rejection per cost: after each choice, rejection is counted among the rows that the chosen
rules let pass.  The cascade is one CASE expression, so a document that a rule rejects is not shown
to the later ones.  The order decides the cost only: the verdict is the same in any order.

Everything is DataFrame expressions; no document is shuffled.  What passes the driver are at most
``SAMPLE`` rows of booleans.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
WORD_WITHOUT_LETTER = rf"(?<![^{SPACE}])[^{SPACE}\p{{L}}]++(?![^{SPACE}])"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30  # least words; most words in repeated windows, in hundredths
SAMPLE = 2_000  # documents on which costs and rejections are estimated
#: bounds of the method's rules, in hundredths unless said otherwise
MAX_SYMBOLS, WORD_LENGTH, MAX_DUP_LINES, MAX_UPPER, MIN_ALPHA, MAX_DIGITS, MAX_STUTTER, MAX_ELLIPSIS = 10, (3, 10), 50, 50, 80, 30, 30, 30
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _next(a: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of each element and that ``by`` places later."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, by + 1, n), f)


def repeated_words(words: Column) -> Column:
    """Words that lie in a run of eight found twice or more.  Runs are told apart by 64-bit hashes."""
    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twin = _let(by_hash, lambda s: _next(s, 1, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))))
        at = F.sort_array(F.array_distinct(F.flatten(F.filter(twin, lambda x: x.isNotNull()))))
        walk = F.aggregate(at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda s, p: F.struct(
            p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), walk["n"]).otherwise(0)
    both = lambda x, y: F.xxhash64(x, y)
    # hashes of one word, then of two, four and eight; without a repeated run of four there is none of eight
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda a: _let(_next(a, 1, both), lambda b: _let(_next(b, 2, both), lambda c: F.when(
        F.size(F.array_distinct(c)) < F.size(c), _let(_next(c, 4, both), covered)).otherwise(0))))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def metrics(text: Column) -> dict[str, Column]:
    """The five measures of a text (not null) and ``n_lines``, lines with a word; each by itself."""
    return {"n_words": F.size(_words(text)), "word_chars": F.char_length(F.regexp_replace(text, rf"[{SPACE}]+", "")),
            "n_symbols": _count(text, rf"[{SYMBOLS}]"), "n_dup_lines": _let(_lines(text), lambda a: F.size(a) - F.size(F.array_distinct(a))),
            "n_lines": F.size(_lines(text)), "n_repeat_words": repeated_words(_words(text))}


def measured(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with all of ``metrics`` as columns; words and lines are cut out of a text once."""
    of_words = _let(_words(F.col(text)), lambda a: F.struct(F.size(a).alias("n_words"), F.char_length(F.array_join(a, "")).alias("word_chars"),
                                                           repeated_words(a).alias("n_repeat_words")))
    of_lines = _let(_lines(F.col(text)), lambda a: F.struct(F.size(a).alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).alias("n_dup_lines")))
    df = docs.select("*", of_words.alias("_of_words"), of_lines.alias("_of_lines"), metrics(F.col(text))["n_symbols"].alias("_symbols"))
    from_struct = {"n_words": "_of_words", "word_chars": "_of_words", "n_symbols": "", "n_dup_lines": "_of_lines", "n_lines": "_of_lines",
                   "n_repeat_words": "_of_words"}
    cols = [F.col(f"{s}.{n}" if s else "_symbols").cast("bigint").alias(n) for n, s in from_struct.items()]
    return df.select(*docs.columns, *cols)


def base_rules(m: dict[str, Column]) -> dict[str, Column]:
    return {"few_words": m["n_words"] < MIN_WORDS, "repeated_windows": 100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"]}


def method_rules(text: Column, m: dict[str, Column]) -> dict[str, Column]:
    """The method's rules: true for a document to reject.  None rejects a document for being empty."""
    stutter = _let(_words(text), lambda a: F.size(F.filter(_next(a, 1, lambda x, y: x == y), lambda x: x)))
    ellipsis = F.size(F.filter(_lines(text), lambda x: x.rlike(rf"(\.\.\.|…)[{SPACE}]*$")))
    return {
        "symbols": 100 * m["n_symbols"] > MAX_SYMBOLS * m["n_words"],
        "word_length": (m["word_chars"] < WORD_LENGTH[0] * m["n_words"]) | (m["word_chars"] > WORD_LENGTH[1] * m["n_words"]),
        "duplicate_lines": 100 * m["n_dup_lines"] > MAX_DUP_LINES * m["n_lines"],
        "upper_case": 100 * _count(text, r"\p{Lu}") > MAX_UPPER * m["word_chars"],
        "letters": 100 * _count(text, WORD_WITHOUT_LETTER) > (100 - MIN_ALPHA) * m["n_words"],
        "digits": 100 * _count(text, "[0-9]") > MAX_DIGITS * m["word_chars"],
        "stutter": 100 * stutter > MAX_STUTTER * m["n_words"],
        "ellipsis": 100 * ellipsis > MAX_ELLIPSIS * m["n_lines"],
    }


def _sample(docs: DataFrame, key: str, size: int) -> DataFrame:
    """At most ``size`` rows, of the smallest md5 of their key, in one partition."""
    place = F.md5(F.col(key).cast("string"))
    ids = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_sampled"), place.alias("_place")).distinct().orderBy("_place", "_sampled")
    ids = written(ids.limit(size).select("_sampled"))
    chosen = docs.join(F.broadcast(ids), docs[key] == ids["_sampled"], "left_semi")  # at most ``size`` ids
    return written(chosen.limit(size).coalesce(1))


def costs(sample: DataFrame, rules: dict[str, Column]) -> dict[str, float]:
    """Seconds that each rule takes on the sample, the best of three runs, less those of a job without a rule; a fifth
    of these at least, as smaller differences are the clock's noise."""
    def seconds(job: DataFrame) -> float:
        best = []
        for _ in range(3):
            start = time.perf_counter()
            job.collect()
            best.append(time.perf_counter() - start)
        return min(best)
    nothing = seconds(sample.agg(F.count(F.lit(1))))
    return {name: max(seconds(sample.agg(F.count_if(rule))) - nothing, 0.2 * nothing) for name, rule in rules.items()}


def plan(sample: DataFrame, rules: dict[str, Column], cost: dict[str, float] | None = None) -> list[tuple[str, float, int]]:
    """(rule, seconds, rejected among the rows left) in the order of the cascade.  ``sample``: a bounded table in one
    partition; ``cost``: seconds by rule, measured there if not given.  A rule counts as rejecting half a row more,
    so that of rules that reject none the cheapest comes first; ties, and an empty sample, keep the given order."""
    fails = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    patterns = sample.groupBy(*[f.alias(n) for n, f in fails.items()]).agg(F.count(F.lit(1)).alias("n")).collect()
    if not patterns:
        return [(name, 0.0, 0) for name in fails]
    cost = costs(sample, fails) if cost is None else cost
    order, left = [], [(r.asDict(), r["n"]) for r in patterns]
    while len(order) < len(fails):
        chosen = {name for name, _, _ in order}
        gain = {name: sum(n for r, n in left if r[name]) for name in fails if name not in chosen}
        name = max(gain, key=lambda x: (gain[x] + 0.5) / cost[x])
        order.append((name, cost[name], gain[name]))
        left = [(r, n) for r, n in left if not r[name]]
    return order


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """The first rule in ``order`` that rejects a row, or null; the rules after it are not evaluated."""
    out = F.when(F.lit(False), "")
    for name in order:
        out = out.when(F.coalesce(rules[name], F.lit(False)), name)
    return out


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns by position, so that no column of ``docs`` clashes with the operator's own."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def judge(docs: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    ``kept`` is false where a base rule or one of ``method_rules`` rejects the text; the measures are always
    computed, the method's rules only for texts that pass the base, and each only if those before it let the text pass.
    A null or empty text has no words, fails the base and is not kept; repeated rows and null ids are judged like
    others; an empty table gives no rows.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    columns = {n: F.col(n) for n in (*METRICS, "n_lines")}
    rules = method_rules(F.col("_text"), columns)
    tried = written(measured(_sample(docs, "doc_id", sample), "_text").coalesce(1))
    order = [name for name, _, _ in plan(tried, rules)]
    base = base_rules(columns)
    failed = base["few_words"] | base["repeated_windows"]
    kept = F.when(failed, False).otherwise(cascade(rules, order).isNull())
    return measured(docs, "_text").select("doc_id", *METRICS, failed.alias("base_failed"), kept.alias("kept"))


def keep(docs: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they were.  Base and method rules form one cascade, so
    for most rejected texts few measures are computed.  Same verdicts as ``judge``."""
    df, names = _renamed(docs)
    body = F.coalesce(F.col(names[text]).cast("string"), F.lit(""))
    rules = {**base_rules(metrics(body)), **method_rules(body, metrics(body))}
    order = [name for name, _, _ in plan(_sample(df, names[key], sample), rules)]
    return df.where(cascade(rules, order).isNull()).toDF(*docs.columns)
