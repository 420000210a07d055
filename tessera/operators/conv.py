"""Conversation operators.

A conversation is either *flat* rows ``(conv_id, turn, role, text[, is_parts])``
with ``turn`` the 0-based message position, or *assembled*
``messages array<struct<role, text>>``.  Validation (B2) runs on the flat form
with per-conversation partial aggregates only, so a huge conversation never
has to be gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as K

MODES = {  # min messages after an optional system, system allowed, who must be a string
    "smoltalk": (2, True, "all"),
    "jsonl": (2, False, "all"),
    "render": (1, True, "user"),
}


def assemble_messages(rows: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """B1: flat rows -> one row per conversation with ordered messages.

    The collected list is one conversation (bounded by its length), sorted by turn.
    """
    m = F.sort_array(F.collect_list(F.struct(F.col(order).alias("turn"), "role", "text")))
    return rows.groupBy(conv).agg(m.alias("_m")).select(
        conv, F.transform("_m", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("messages"))


def validate_conversation(rows: DataFrame, mode: str = "smoltalk", conv: str = "conv_id", turn: str = "turn",
                          is_parts: str | None = None) -> DataFrame:
    """B2: ``(conv, is_valid, reason, bad_index)`` per conversation.

    Rules: optional leading system (not in ``jsonl``), then strict
    user/assistant alternation; a minimum count of non-system messages; string
    content (all messages, or only user messages for ``render``).  Checks are
    applied in the reference's order: too short first, then the first bad
    message (role before content).  ``bad_index`` is the message position.
    """
    min_rest, sys_ok, strings = MODES[mode]
    pos = F.col(turn)
    role = F.col("role")
    parts = F.col(is_parts) if is_parts else F.lit(False)
    exp_plain = F.when(pos % 2 == 0, "user").otherwise("assistant")
    exp_sys = F.when(pos == 0, "system").when((pos - 1) % 2 == 0, "user").otherwise("assistant")
    content_bad = parts if strings == "all" else (parts & (role == "user"))

    def first_bad(expected: Column) -> Column:
        # smallest position that breaks a rule; at equal position the role check wins
        bad_role = role != expected
        return F.min(F.when(bad_role | content_bad,
                            F.struct(pos.alias("pos"), F.when(bad_role, "bad_role").otherwise("non_string_content")
                                     .alias("why"))))

    agg = rows.groupBy(conv).agg(
        F.count(F.lit(1)).alias("n"), F.min(turn).alias("t0"), F.max(turn).alias("t1"),
        F.min_by("role", turn).alias("first_role"),
        first_bad(exp_plain).alias("bp"), first_bad(exp_sys).alias("bs"))
    has_sys = (F.col("first_role") == "system") if sys_ok else F.lit(False)
    rest = F.col("n") - F.when(has_sys, 1).otherwise(0)
    bad = F.when(has_sys, F.col("bs")).otherwise(F.col("bp"))
    reason = (F.when((F.col("t0") != 0) | (F.col("t1") != F.col("n") - 1), "turn_gap")
              .when(rest < min_rest, "too_short")
              .when(bad.isNotNull(), bad.getField("why")))
    bad_index = F.when(reason.isin("bad_role", "non_string_content"), bad.getField("pos"))
    return agg.select(conv, reason.isNull().alias("is_valid"), reason.alias("reason"), bad_index.alias("bad_index"))


def merge_system(df: DataFrame, messages: str = "messages") -> DataFrame:
    """A leading system text is prepended to the first user text with a blank line.

    ``merge_error`` is set when the message after the system one is not a user message.
    """
    m = F.col(messages)
    first, second = F.element_at(m, 1), F.element_at(m, 2)
    is_sys = first.getField("role") == "system"
    merged = F.struct(F.lit("user").alias("role"),
                      F.concat(first.getField("text"), F.lit("\n\n"), second.getField("text")).alias("text"))
    out = F.when(is_sys & (second.getField("role") == "user"),
                 F.concat(F.array(merged), F.slice(m, 3, F.greatest(F.size(m) - 2, F.lit(0))))).otherwise(m)
    err = is_sys & F.coalesce(second.getField("role") != "user", F.lit(True))
    return df.withColumn(messages, out).withColumn("merge_error", err)


def pop_last_assistant(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Drop the final assistant message, keep its text as ``reference``."""
    m = F.col(messages)
    last = F.element_at(m, -1)
    ok = F.coalesce(last.getField("role") == "assistant", F.lit(False))
    return (df.withColumn("pop_ok", ok)
            .withColumn("reference", F.when(ok, last.getField("text")))
            .withColumn(messages, F.when(ok, F.slice(m, 1, F.size(m) - 1)).otherwise(m)))


def flatten_parts(parts) -> Column:
    """The texts of all parts joined without separator."""
    p = F.col(parts) if isinstance(parts, str) else parts
    return F.array_join(F.transform(p, lambda x: x.getField("text")), "")


def unwrap(df: DataFrame, field: str = "train") -> DataFrame:
    """Lift the fields of a wrapper struct to the top level."""
    return df.select(f"{field}.*")


def answer_index_to_letter(df: DataFrame, answer: str = "answer", choices: str = "choices",
                           letters: tuple = ("A", "B", "C", "D")) -> DataFrame:
    """Index -> letter; only rows with exactly four choices are valid."""
    lit_letters = F.array(*[F.lit(x) for x in letters])
    ok = F.size(choices) == len(letters)
    return df.withColumn("answer_letter", F.when(ok, F.element_at(lit_letters, F.col(answer) + 1))).withColumn(
        "choices_ok", ok)


def normalize_labels(df: DataFrame, labels: str = "labels", key: str = "answerKey") -> DataFrame:
    """Any label scheme -> A..E by position; the correct label by position of the key."""
    std = F.array(*[F.lit(x) for x in K.MC_LETTERS])
    new = F.slice(std, 1, F.size(labels))
    at = F.array_position(F.col(labels), F.col(key))
    return df.withColumn("norm_labels", new).withColumn(
        "correct_label", F.when(at > 0, F.element_at(new, at.cast("int"))))
