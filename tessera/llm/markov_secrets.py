"""Secret scan: fixed patterns, and character Markov models.

Base spans are leftmost non-overlapping matches of three patterns.  The method adds
spans: long tokens outside the base spans whose characters follow a Markov chain trained
on random strings rather than one trained on ordinary identifiers, by log-likelihood
ratio.  Both chains are trained here from labelled samples of the corpus: the values of
the base matches (random), and words of ``MAX_ORDINARY`` documents without any (ordinary).
Ratios are whole milli-nats, so that sums do not depend on their order.

Everything is DataFrame expressions; the only values that pass the driver are the model's
``len(ALPHABET) ** 2`` ratios.  No document is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# maximal runs, so a run that is too short can be left out by the pattern itself
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{8,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MAX_ORDINARY = 2_000
#: a token is reported from this ratio in milli-nats, in all and for each pair of characters
MIN_TOTAL, MIN_EACH = 15_000, 800
MASK = "[SECRET]"
BACK_OFF = 4.0  # weight of a character's own frequency in its chances after another


def _matches(text: Column, pattern: str) -> Column:
    """Spans array<struct<start, end, hit>> of the pattern, in code points.  Splitting on the pattern
    gives what lies before each match, so lengths alone give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    step = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), h.alias("hit")))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    walk = F.aggregate(step, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, x: F.struct(
        (s["at"] + x["gap"] + F.char_length(x["hit"])).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.char_length(x["hit"])).alias("end"),
                                            x["hit"].alias("hit")))).alias("out")))
    return F.when(text.rlike(pattern), walk["out"]).otherwise(none)


def _spans(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def _with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds _text (null as empty), _assign, _access, _hex (spans with their matches)."""
    docs = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    value = lambda x: F.regexp_extract(x["hit"], ASSIGN, 1)
    return (docs.withColumn("_assign", F.filter(_matches(F.col("_text"), ASSIGN), lambda x: F.char_length(value(x)) >= MIN_VALUE))
            .withColumn("_access", _matches(F.col("_text"), ACCESS)).withColumn("_hex", _matches(F.col("_text"), HEX)))


def _pairs(words: DataFrame, word: str = "word") -> DataFrame:
    """(a, b, n): neighbouring characters of the words, by place in the alphabet, counted."""
    at = F.sequence(F.lit(1), F.char_length(word) - 1)
    pair = words.where(F.char_length(word) > 1).select(F.explode(F.transform(at, lambda i: F.substring(F.col(word), i, F.lit(2)))).alias("pair"))
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring("pair", i, 1))
    return pair.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).select(place(1).alias("a"), place(2).alias("b"), "n").where("a > 0 and b > 0")


def train(docs: DataFrame, max_ordinary: int = MAX_ORDINARY) -> list[int]:
    """Log-likelihood ratios (milli-nats) of the character pairs, row by row of the alphabet.

    Random strings: the values of base matches in all documents.  Ordinary identifiers: tokens of eight
    characters or more in those of the ``max_ordinary`` documents of smallest md5 of their id that have no
    base match.  A pair's chances back off to its second character's frequency, and that to an even one; an
    empty corpus gives zeros.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    hits = _with_base(docs, "text").select(F.explode(F.concat(
        F.transform("_assign", lambda x: F.regexp_extract(x["hit"], ASSIGN, 1)),
        F.transform("_access", lambda x: F.substring(x["hit"], 5, 1 << 30)), F.transform("_hex", lambda x: x["hit"]))).alias("word"))
    key = F.md5(F.col("doc_id").cast("string"))
    chosen = written(docs.where("doc_id is not null").select("doc_id").distinct().orderBy(key, "doc_id").limit(max_ordinary))
    sample = docs.join(F.broadcast(chosen), "doc_id")  # at most max_ordinary ids
    sample = _with_base(sample, "text").where(F.size("_assign") + F.size("_access") + F.size("_hex") == 0)
    words = sample.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("word"))
    size = len(ALPHABET)
    counts = [[[0] * size for _ in range(size)] for _ in range(2)]
    both = _pairs(hits).withColumn("kind", F.lit(0)).unionByName(_pairs(words).withColumn("kind", F.lit(1)))
    for r in both.collect():  # at most 2 * size^2 rows
        counts[r["kind"]][r["a"] - 1][r["b"] - 1] += r["n"]
    rows = [[sum(row) for row in table] for table in counts]
    own = [[(sum(row[b] for row in table) + 1) / (sum(map(sum, table)) + size) for b in range(size)] for table in counts]
    chance = lambda c, a, b: (counts[c][a][b] + BACK_OFF * own[c][b]) / (rows[c][a] + BACK_OFF)
    return [round(1000 * math.log(chance(0, a, b) / chance(1, a, b))) for a in range(size) for b in range(size)]


def _ratio(word: Column, model: Column) -> Column:
    """Sum of the ratios over a token's character pairs."""
    place = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = F.zip_with(F.slice(place, 1, F.char_length(word) - 1), F.slice(place, 2, F.char_length(word) - 1),
                       lambda a, b: F.element_at(model, (a - 1) * len(ALPHABET) + b))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x)


def scan(docs: DataFrame, model: list[int] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: arrays of struct<start, rank, end> by start, then kind
    (``rank`` is the place in ``KINDS``).  All columns of ``docs`` stay, whatever their names.

    A null text counts as empty and has no spans; repeated rows and null ids are scanned like others.
    Added spans never overlap base spans or each other.
    """
    model = train(docs) if model is None else model
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    df = _with_base(docs.toDF(*names), names[cols.index(text)])
    df = df.withColumn("_base", F.array_sort(F.concat(*[_spans(F.col(f"_{k}"), i) for i, k in enumerate(KINDS[:3])])))
    ratios = F.lit(model).cast("array<int>")
    enough = lambda x: F.greatest(F.lit(MIN_TOTAL), MIN_EACH * (x["end"] - x["start"] - 1))
    free = lambda x: ~F.exists("_base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    df = df.withColumn("_token", F.filter(_matches(F.col("_text"), TOKEN), free))
    df = df.withColumn("_token", F.when(F.size("_token") > 0, F.filter("_token", lambda x: _ratio(x["hit"], ratios) >= enough(x))).otherwise(F.col("_token")))
    df = df.withColumn("_spans", F.array_sort(F.concat("_base", _spans(F.col("_token"), 3))))
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)], "_base", "_spans")


def report(docs: DataFrame, model: list[int] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document; see ``scan``."""
    found = scan(docs.select("doc_id", "text"), model)
    n = lambda i: F.size(F.filter("_base", lambda s: s["rank"] == i)).cast("bigint").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
                        _joined(F.col("_spans")).alias("spans"))


def mask(docs: DataFrame, model: list[int] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``MASK`` (overlapping spans as one) and ``n_chars``,
    where there is such a column, set to the new length.  Documents without a span are unchanged."""
    model = train(docs) if model is None else model
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    body = names[cols.index("text")]
    found = scan(docs.toDF(*names), model, body)
    text = F.coalesce(F.col(body), F.lit(""))
    walk = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(MASK)))
        .otherwise(s["out"]).alias("out")))
    some = F.size("_spans") > 0
    clean = F.when(some, F.concat(walk["out"], F.substring(text, walk["at"] + 1, F.char_length(text)))).otherwise(F.col(body))
    found = found.withColumn(body, clean)
    if "n_chars" in cols:
        n = names[cols.index("n_chars")]
        found = found.withColumn(n, F.when(some, F.char_length(body).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return found.select(*names).toDF(*cols)
