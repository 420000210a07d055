"""Readers over files: lines and tables derived from the driver tables are written under the
shared checkpoint folder and read back through the file entry points (A8-A12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.plans.views import v_code, v_gpqa, v_gsm, v_icl_mc, v_math, v_mc, v_words
from tessera.session import checkpoint_dir
from tessera.sources import readers as RD


def _folder(spark, what):
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex[:12]}-{what}"


def _benchmarks(spark, sf):
    """Rows of every benchmark's shape: name -> (DataFrame with an id, subset)."""
    m, labels = v_mc(spark, sf), F.array(*[F.lit(x) for x in "ABCD"])
    g = v_gsm(spark, sf)
    conv = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
                    lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    math = v_math(spark, sf)
    code, q = v_code(spark, sf), v_gpqa(spark, sf)
    return {
        "arc": (m.select(F.col("item_id").alias("id"), "question", F.struct(F.col("choices").alias("text"), labels.alias("label")).alias("choices"),
                         F.element_at(labels, F.col("answer") + 1).alias("answerKey")), "ARC-Easy"),
        "mmlu": (m.select(F.col("item_id").alias("id"), F.struct("question", "choices", "answer", "subject").alias("train")), "auxiliary_train"),
        "gsm8k": (g.select(F.col("l_orderkey").alias("id"), "question", "answer"), "main"),
        "humaneval": (code.select(F.col("item_id").alias("id"), F.concat(F.lit("T/"), "item_id").alias("task_id"), "prompt",
                                  F.col("completion").alias("canonical_solution"), "entry_point", "test"), None),
        "smoltalk": (conv, None),
        "math500": (math.select(F.col("item_id").alias("id"), "problem", "answer", F.lit("Algebra").alias("subject"), (F.col("item_id") % 5 + 1).alias("level")), None),
        "gpqa": (q.select(F.col("item_id").alias("id"), "Question", F.col("correct").alias("Correct Answer"), F.col("incorrect1").alias("Incorrect Answer 1"),
                          F.col("incorrect2").alias("Incorrect Answer 2"), F.col("incorrect3").alias("Incorrect Answer 3"),
                          F.col("domain").alias("High-level domain"), F.col("subdomain").alias("Subdomain")), None),
        "mbppplus": (code.select(F.col("item_id").alias("id"), F.col("item_id").alias("task_id"), "prompt", F.col("completion").alias("code"),
                                 "test_imports", "test_list", "test"), None),
    }


_LIST = "array_to_string({0}, ',')"
#: name -> (relation, id, row as text)
_ROWS_SQL = {
    "arc": ("v_mc", "item_id", f"question, {_LIST.format('choices')}, 'A,B,C,D', ['A', 'B', 'C', 'D'][answer + 1]"),
    "mmlu": ("v_mc", "item_id", f"question, {_LIST.format('choices')}, CAST(answer AS VARCHAR), subject"),
    "gsm8k": ("v_gsm", "l_orderkey", "question, answer"),
    "humaneval": ("v_code", "item_id", "'T/' || item_id, prompt, completion, entry_point, test"),
    "smoltalk": ("(SELECT conv_id, string_agg(role || ':' || text, ',' ORDER BY turn) AS m FROM conversations GROUP BY conv_id)", "conv_id", "m"),
    "math500": ("v_math", "item_id", "problem, answer, 'Algebra', CAST(item_id % 5 + 1 AS VARCHAR)"),
    "gpqa": ("v_gpqa", "item_id", "Question, correct, incorrect1, incorrect2, incorrect3, domain, subdomain"),
    "mbppplus": ("v_code", "item_id", f"CAST(item_id AS VARCHAR), prompt, completion, {_LIST.format('test_imports')}, {_LIST.format('test_list')}, test"),
}
_VALUES_SQL = f"WITH {DV.V_MC}, {DV.V_GSM}, {DV.V_CODE}, {DV.V_MATH}, {DV.V_GPQA} " + " UNION ALL ".join(
    f"""SELECT '{n}' AS name, count(*) AS n, CAST(sum({i}) AS BIGINT) AS ids, count(*) AS n_valid,
       CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {row})), 1, 8) AS BIGINT)) AS BIGINT) AS row_hashes FROM {t}""" for n, (t, i, row) in _ROWS_SQL.items())


def _values(name):
    """The columns of a benchmark as texts."""
    return {
        "arc": ["question", F.array_join("choices.text", ","), F.array_join("choices.label", ","), "answerKey"],
        "mmlu": ["question", F.array_join("choices", ","), F.col("answer").cast("string"), "subject"],
        "gsm8k": ["question", "answer"],
        "humaneval": ["task_id", "prompt", "canonical_solution", "entry_point", "test"],
        "smoltalk": [F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), ",")],
        "math500": ["problem", "answer", "subject", F.col("level").cast("string")],
        "gpqa": [f"`{c}`" for c in RD.BENCHMARKS["gpqa"]],
        "mbppplus": [F.col("task_id").cast("string"), "prompt", "code", F.array_join("test_imports", ","), F.array_join("test_list", ","), "test"],
    }[name]


@register("read_benchmark", _VALUES_SQL)
def read_benchmark_q(spark, sf):
    """A11 for all eight benchmarks: written as JSON lines or Parquet, read back and checked, with a sum of hashes of all values."""
    out = None
    for i, (name, (df, subset)) in enumerate(_benchmarks(spark, sf).items()):
        # gpqa's column names hold blanks, which Parquet and JSON both keep
        path = _folder(spark, f"{name}.{'jsonl' if i % 2 else 'parquet'}")
        (df.write.option("ignoreNullFields", "false").json if i % 2 else df.write.parquet)(path)
        b = RD.read_benchmark(spark, path, name, subset, keep=("id",))
        row = F.md5(F.concat_ws("|", *_values(name)))
        one = b.agg(F.count(F.lit(1)).alias("n"), F.sum("id").cast("bigint").alias("ids"), F.sum(F.col("valid").cast("bigint")).alias("n_valid"),
                    F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")).alias("row_hashes"))
        one = one.select(F.lit(name).alias("name"), "n", "ids", "n_valid", "row_hashes")
        out = one if out is None else out.unionByName(one)
    return out


_HASH_SQL = "CAST(sum(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)) AS BIGINT)"


@register("read_files", f"""WITH {DV.V_MC}, {DV.V_ICL_BASE}, {DV.V_ICL_MC}, {DV.V_WORDS},
c AS (SELECT conv_id, count(*) AS n, bool_and(role = CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END) AS ok,
             string_agg(role || ':' || text, ',' ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
g AS (SELECT query, choices, CASE WHEN item_id % 5 = 0 THEN -1 ELSE gold END AS gold FROM v_icl_mc),
b AS (SELECT DISTINCT subject FROM v_mc)
SELECT 'conversations' AS what, count(*) AS n, CAST(sum(CAST(ok AND n >= 2 AS INT)) AS BIGINT) AS n_good,
       {_HASH_SQL.format("CASE WHEN ok AND n >= 2 THEN m ELSE '' END")} AS row_hashes FROM c
UNION ALL SELECT 'icl', count(*), CAST(sum(gold + 1) AS BIGINT), {_HASH_SQL.format("concat_ws('|', query, array_to_string(choices, ','), CAST(gold AS VARCHAR))")} FROM g
UNION ALL SELECT 'baselines', count(*), CAST(sum(length(subject)) AS BIGINT), {_HASH_SQL.format("subject || '|' || length(subject)")} FROM b
UNION ALL SELECT 'words', count(*), CAST(sum(length(word)) AS BIGINT), {_HASH_SQL.format("word")} FROM v_words""")
def read_files_q(spark, sf):
    """A8, A9, A10 (csv) and A12 through their file entry points."""
    conv = table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
        lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("value"))
    paths = {k: _folder(spark, k) for k in ("conversations", "icl", "baselines", "words")}
    conv.select("value").write.text(paths["conversations"])
    m = v_icl_mc(spark, sf)
    m.select(F.to_json(F.struct("query", "choices", F.when(F.col("item_id") % 5 != 0, F.col("gold")).alias("gold"))).alias("value")).write.text(paths["icl"])
    (v_mc(spark, sf).select(F.col("subject").alias("Eval Task"), F.length("subject").cast("double").alias("Random baseline")).distinct()
     .write.option("header", True).csv(paths["baselines"]))
    v_words(spark, sf).select(F.concat(F.lit(" "), "word", F.lit("\t")).alias("value")).write.text(paths["words"])
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), ",")

    def totals(df, good, row):
        hashed = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("bigint")
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(good.cast("bigint")).alias("n_good"), F.sum(hashed).alias("row_hashes"))
    a = totals(RD.read_conversations_jsonl(spark, paths["conversations"]), F.col("is_valid"), F.coalesce(said, F.lit("")))
    b = totals(RD.read_icl_items(spark, paths["icl"], "multiple_choice"), F.col("gold") + 1,
               F.concat_ws("|", "query", F.array_join("choices", ","), F.col("gold").cast("string")))
    c = totals(RD.read_baselines(spark, paths["baselines"]), F.col("baseline_pct"), F.concat_ws("|", "task", F.col("baseline_pct").cast("int").cast("string")))
    d = totals(RD.read_word_list(spark, paths["words"]), F.length("word"), F.col("word"))
    out = None
    for name, one in (("conversations", a), ("icl", b), ("baselines", c), ("words", d)):
        one = one.select(F.lit(name).alias("what"), "n", "n_good", "row_hashes")
        out = one if out is None else out.unionByName(one)
    return out
