"""Readers (A8-A12).  Each has a line-level parser (``DataFrame`` of text lines ->
typed rows) and a thin file entry point (``spark.read.text`` / ``csv``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import py_strip


# ---------------------------------------------------------------- A8
def parse_conversation_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """One JSON array of ``{role, content}`` per line; blank lines skipped.

    Instead of aborting on the first bad line, every line gets ``is_valid``,
    ``reason`` and ``bad_index``: bad_json, not_a_list, too_short (< 2),
    missing_role, missing_content, bad_role (user / assistant alternation
    from user; system is not allowed), non_string_content.  JSON types come
    from ``VARIANT`` parsing, so list content is told apart from strings.
    """
    s = py_strip(F.col(line))
    df = lines.withColumn("_s", s).where(F.col("_s") != "")
    v = F.try_parse_json("_s")
    arr = F.try_variant_get(v, "$", "array<variant>")

    def msg_reason(x, i):
        role = F.try_variant_get(x, "$.role", "string")
        ctype = F.schema_of_variant(F.variant_get(x, "$.content", "variant"))
        is_obj = F.schema_of_variant(x).startswith("OBJECT")
        expected = F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
        why = (F.when(~is_obj | role.isNull(), F.lit("missing_role"))
               .when(ctype.isNull(), F.lit("missing_content"))
               .when(role != expected, F.lit("bad_role"))
               .when(ctype != "STRING", F.lit("non_string_content")))
        return F.when(why.isNotNull(), F.struct(i.alias("i"), why.alias("why")))
    first_bad = F.try_element_at(F.filter(F.transform(arr, msg_reason), lambda x: x.isNotNull()), F.lit(1))
    reason = (F.when(v.isNull(), F.lit("bad_json")).when(arr.isNull(), F.lit("not_a_list"))
              .when(F.size(arr) < 2, F.lit("too_short")).otherwise(first_bad.getField("why")))
    msgs = F.transform(arr, lambda x: F.struct(F.try_variant_get(x, "$.role", "string").alias("role"),
                                               F.try_variant_get(x, "$.content", "string").alias("content")))
    out = (df.withColumn("reason", reason)
           .withColumn("bad_index", F.when(F.col("reason").isin("missing_role", "missing_content", "bad_role",
                                                                "non_string_content"), first_bad.getField("i")))
           .withColumn("is_valid", F.col("reason").isNull())
           .withColumn("messages", F.when(F.col("is_valid"), msgs)))
    return out.drop("_s")


def read_conversations_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A8 over files; ``line_no`` grows with the line's place in its file (it is not dense: a text
    scan knows no row index, and numbering lines would need a pass of its own)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"),
                                         F.monotonically_increasing_id().alias("line_no"))
    return parse_conversation_lines(lines)


# ---------------------------------------------------------------- A9
ICL_SCHEMAS = {
    "multiple_choice": "query string, choices array<string>, gold int",
    "schema": "context_options array<string>, continuation string, gold int",
    "language_modeling": "context string, continuation string, gold int",
}


def parse_icl_lines(lines: DataFrame, task_type: str, line: str = "value") -> DataFrame:
    """One ICL item per JSON line under the task type's schema; ``gold`` defaults to -1."""
    if task_type not in ICL_SCHEMAS:
        raise ValueError(f"unsupported task type {task_type}")
    j = F.from_json(F.col(line), ICL_SCHEMAS[task_type])
    return lines.select("*", j.alias("_j")).select(*[c for c in lines.columns if c != line], "_j.*") \
        .withColumn("gold", F.coalesce(F.col("gold"), F.lit(-1)))


def read_icl_items(spark: SparkSession, path: str, task_type: str) -> DataFrame:
    return parse_icl_lines(spark.read.text(path), task_type)


# ---------------------------------------------------------------- A10
def parse_baseline_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """A10: csv lines ``Eval Task,Random baseline`` (percent) -> (task, baseline_pct)."""
    c = F.from_csv(F.col(line), "task string, baseline string")
    rows = lines.select(c.alias("_c")).select("_c.*").where(F.col("task") != "Eval Task")
    return rows.select("task", F.col("baseline").cast("double").alias("baseline_pct"))


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("Eval Task").alias("task"), F.col("Random baseline").cast("double").alias("baseline_pct"))


# ---------------------------------------------------------------- A11
BENCHMARKS = {
    "arc": ["question", "choices", "answerKey"],
    "mmlu": ["question", "choices", "answer", "subject"],
    "gsm8k": ["question", "answer"],
    "humaneval": ["task_id", "prompt", "canonical_solution", "entry_point", "test"],
    "smoltalk": ["messages"],
    "math500": ["problem", "answer", "subject", "level"],
    "gpqa": ["Question", "Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3",
             "High-level domain", "Subdomain"],
    "mbppplus": ["task_id", "prompt", "code", "test_imports", "test_list", "test"],
}
SPLITS = {"arc": ("ARC-Easy", "ARC-Challenge"), "mmlu": ("all", "auxiliary_train"), "gsm8k": ("main", "socratic")}


def load_benchmark(df: DataFrame, name: str, subset: str | None = None, keep: tuple = ()) -> DataFrame:
    """The declared columns of a benchmark plus per-row checks (``valid``, ``reason``).

    Unknown names / subsets and missing columns fail at plan time;
    MMLU ``auxiliary_train`` rows are unwrapped from ``train``; ARC answer
    keys must be among the labels; MMLU needs exactly four choices.
    ``keep`` names extra (id) columns to carry along.
    """
    if name not in BENCHMARKS:
        raise ValueError(f"unknown benchmark {name}")
    if subset is not None and name in SPLITS and subset not in SPLITS[name]:
        raise ValueError(f"{name} subset must be one of {SPLITS[name]}")
    if name == "mmlu" and subset == "auxiliary_train":
        df = df.select(*keep, "train.*")
    missing = [c for c in BENCHMARKS[name] if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    out = df.select(*keep, *[F.col(f"`{c}`") for c in BENCHMARKS[name]])
    reason: Column = F.lit(None).cast("string")
    if name == "arc":
        reason = F.when(~F.array_contains(F.col("choices.label"), F.col("answerKey")), F.lit("answer_not_in_labels"))
    elif name == "mmlu":
        reason = F.when(F.size("choices") != 4, F.lit("not_four_choices"))
    return out.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def read_benchmark(spark: SparkSession, path: str, name: str, subset: str | None = None, keep: tuple = ()) -> DataFrame:
    """A11 from files: JSON lines (``*.json``, ``*.jsonl``) or Parquet under ``path``, then ``load_benchmark``."""
    low = path.rstrip("/").lower()
    df = spark.read.json(path) if low.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return load_benchmark(df, name, subset, keep)


# ---------------------------------------------------------------- A12
def parse_word_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """One word per line, stripped."""
    return lines.select(py_strip(F.col(line)).alias("word"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_word_lines(spark.read.text(path))
