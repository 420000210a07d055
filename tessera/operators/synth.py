"""Synthetic conversation generators over a word table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import text as T
from tessera.operators import prompts as P


def draw(name: str, key: Column) -> Column:
    """Named md5 draw for example ``key`` (a non-negative bigint)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def part(t: str, text: Column) -> Column:
    return F.struct(F.lit(t).alias("type"), text.alias("text"))


def spelling_bee(words: DataFrame, size: int, split: str = "train", idx: str = "idx", word: str = "word") -> DataFrame:
    """``size`` synthetic letter-counting conversations.

    Per example (seed = index, test seeds offset by 10,000,000): a word by md5
    draw; a letter from the word (90%) or any letter (10%); a user template
    (C12); the assistant's spelled walkthrough (D13, D14), a python call, its
    output and ``#### count``.  Words are fetched by an equi join on ``idx``.
    """
    from tessera import prompt_texts as PT
    if split not in ("train", "test"):
        raise ValueError("split must be train|test")
    n = words.count()
    off = 0 if split == "train" else K.SPELLING_TEST_SEED_OFFSET
    seed = F.col("id") + off
    ex = words.sparkSession.range(size).select(F.col("id").alias("example"), (draw("word", seed) % n).alias("w"),
                                               *[draw(k, seed).alias(f"d_{k}") for k in
                                                 ("pick", "pos", "any", "tpl", "low", "lq", "wq", "qm")])
    j = ex.join(words.select(F.col(idx).alias("w"), F.col(word).alias("word")), "w")
    wl = F.col("word")
    letters = F.lit(PT.SPELLING_LETTERS)
    letter = F.when(F.col("d_pick") % 10 < 9, wl.substr((F.col("d_pos") % F.length(wl) + 1).cast("int"), F.lit(1))) \
        .otherwise(letters.substr((F.col("d_any") % 26 + 1).cast("int"), F.lit(1)))
    j = j.withColumn("letter", letter).withColumn("count", T.count_letter(wl, F.col("letter")))
    quotes = F.array(*[F.lit(q) for q in PT.SPELLING_QUOTES])
    user = P.letter_question(F.col("letter"), wl, (F.col("d_tpl") % len(PT.SPELLING_TEMPLATES)).cast("int"),
                             F.col("d_low") % 10 < 3, F.element_at(quotes, (F.col("d_lq") % 3 + 1).cast("int")),
                             F.element_at(quotes, (F.col("d_wq") % 3 + 1).cast("int")), F.col("d_qm") % 2 == 0)
    lq = F.concat(F.lit("'"), F.col("letter"), F.lit("'"))
    manual = F.concat(F.lit("We are asked to find the number "), lq, F.lit(" in the word '"), wl,
                      F.lit("'. Let me try a manual approach first.\n\nFirst spell the word out:\n"), T.spell(wl),
                      F.lit("\n\nThen count the occurrences of "), lq, F.lit(":\n"),
                      T.counting_walkthrough(wl, F.col("letter")),
                      F.lit("\nThis gives us "), F.col("count").cast("string"), F.lit("."))
    cnt = F.col("count").cast("string")
    parts = F.array(part("text", manual), part("text", F.lit("\n\nLet me double check this using Python:\n\n")),
                    part("python", F.concat(F.lit("'"), wl, F.lit("'.count('"), F.col("letter"), F.lit("')"))),
                    part("python_output", cnt),
                    part("text", F.concat(F.lit("\n\nPython gives us "), cnt, F.lit(".\n\nMy final answer is:\n\n#### "), cnt)))
    return j.select("example", "word", "letter", "count", user.alias("user"), parts.alias("assistant_parts"))


def simple_spelling(words: DataFrame, size: int, split: str = "train", idx: str = "idx", word: str = "word") -> DataFrame:
    """``Spell the word: w`` -> ``w:c,h,a,r,s`` for md5-drawn words."""
    if split not in ("train", "test"):
        raise ValueError("split must be train|test")
    n = words.count()
    off = 0 if split == "train" else K.SPELLING_TEST_SEED_OFFSET
    ex = words.sparkSession.range(size).select(F.col("id").alias("example"),
                                               (draw("spell", F.col("id") + off) % n).alias("w"))
    j = ex.join(words.select(F.col(idx).alias("w"), F.col(word).alias("word")), "w")
    return j.select("example", F.concat(F.lit("Spell the word: "), "word").alias("user"), T.spell("word").alias("assistant"))
