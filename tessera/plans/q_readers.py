"""Queries for the readers over lines that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import duck as D
from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.plans.views import v_icl_mc, v_mc, v_words
from tessera.sources import readers as RD


def _conv_lines(spark, sf):
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    js = F.to_json(F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))))
    k = F.col("conv_id")
    line = (F.when(k % 13 == 0, F.lit("   "))
            .when(k % 17 == 0, F.regexp_replace(js, "\\]$", ""))
            .when(k % 19 == 0, F.concat(F.lit('{"messages": '), js, F.lit("}")))
            .when(k % 23 == 0, F.replace(F.replace(js, F.lit('"content":"'), F.lit('"content":["')), F.lit('"}'), F.lit('"]}')))
            .otherwise(js))
    return g.select("conv_id", line.alias("value"))


_A8_SQL = """WITH g AS (SELECT conv_id, CAST(to_json(list(struct_pack(role := role, content := text) ORDER BY turn)) AS VARCHAR) AS js
           FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, CASE WHEN conv_id % 13 = 0 THEN '   ' WHEN conv_id % 17 = 0 THEN regexp_replace(js, '\\]$', '')
                           WHEN conv_id % 19 = 0 THEN '{"messages": ' || js || '}'
                           WHEN conv_id % 23 = 0 THEN replace(replace(js, '"content":"', '"content":["'), '"}', '"]}')
                           ELSE js END AS line FROM g),
s AS (SELECT conv_id, TRIM_LINE AS line FROM l WHERE TRIM_LINE <> ''),
p AS (SELECT conv_id, line, json_valid(line) AS ok FROM s),
m AS (SELECT conv_id, line, ok, CASE WHEN ok THEN json_type(line) END AS jt,
             CASE WHEN ok AND json_type(line) = 'ARRAY' THEN json_array_length(line) END AS n FROM p),
msg AS (SELECT conv_id, i, json_type(line, '$[' || i || ']') AS mt, json_extract_string(line, '$[' || i || '].role') AS role,
               json_type(line, '$[' || i || '].content') AS ct
        FROM m, LATERAL (SELECT unnest(range(0, CAST(coalesce(n, 0) AS BIGINT))) AS i) r WHERE jt = 'ARRAY'),
bad AS (SELECT conv_id, i, CASE WHEN mt <> 'OBJECT' OR role IS NULL THEN 'missing_role' WHEN ct IS NULL THEN 'missing_content'
                                WHEN role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 'bad_role'
                                WHEN ct <> 'VARCHAR' THEN 'non_string_content' END AS why FROM msg),
fb AS (SELECT conv_id, arg_min(why, i) AS why, min(i) AS i FROM bad WHERE why IS NOT NULL GROUP BY conv_id)
SELECT m.conv_id, reason IS NULL AS is_valid, reason,
       CASE WHEN reason IN ('missing_role', 'missing_content', 'bad_role', 'non_string_content') THEN fb.i END AS bad_index
FROM (SELECT m.*, CASE WHEN NOT ok THEN 'bad_json' WHEN jt <> 'ARRAY' THEN 'not_a_list' WHEN n < 2 THEN 'too_short' END AS r0 FROM m) m
LEFT JOIN fb USING (conv_id), LATERAL (SELECT coalesce(m.r0, fb.why) AS reason) x""".replace("TRIM_LINE", D.strip("line"))


@register("read_conversations_jsonl", _A8_SQL)
def read_conversations_jsonl_q(spark, sf):
    """JSONL conversation lines derived from the conversations table (blank,
    unterminated, wrapped and list-content lines by conv_id), validated with reasons."""
    r = RD.parse_conversation_lines(_conv_lines(spark, sf))
    return r.select("conv_id", "is_valid", "reason", F.col("bad_index").cast("bigint").alias("bad_index"))


@register("read_icl_items", f"""WITH {DV.V_ICL_BASE}, {DV.V_ICL_MC}
SELECT item_id, query, array_to_string(choices, '|') AS choices, CASE WHEN item_id % 5 = 0 THEN -1 ELSE gold END AS gold FROM v_icl_mc""")
def read_icl_items_q(spark, sf):
    """ICL multiple-choice JSON lines (gold omitted for every fifth item) parsed back."""
    m = v_icl_mc(spark, sf)
    line = F.to_json(F.struct("query", "choices", F.when(F.col("item_id") % 5 != 0, F.col("gold")).alias("gold")))
    items = RD.parse_icl_lines(m.select("item_id", line.alias("value")), "multiple_choice")
    return items.select("item_id", "query", F.array_join("choices", "|").alias("choices"), F.col("gold").cast("int"))


@register("read_baselines", f"""WITH {DV.V_MC}
SELECT DISTINCT subject AS task, CAST(CASE WHEN length(subject) % 2 = 0 THEN 25.0 ELSE 10.0 END AS DOUBLE) AS baseline_pct FROM v_mc""")
def read_baselines_q(spark, sf):
    """A10: a baseline csv (header + one line per subject) parsed back."""
    subj = v_mc(spark, sf).select("subject").distinct()
    pct = F.when(F.length("subject") % 2 == 0, F.lit("25.0")).otherwise(F.lit("10.0"))
    lines = subj.select(F.concat(F.col("subject"), F.lit(","), pct).alias("value"))
    header = spark.createDataFrame([("Eval Task,Random baseline",)], "value string")
    return RD.parse_baseline_lines(header.unionByName(lines)).distinct()


@register("load_benchmark", f"""WITH {DV.V_MC}
SELECT 'arc' AS name, item_id, CASE WHEN item_id % 11 = 0 THEN 'answer_not_in_labels' END AS reason FROM v_mc
UNION ALL
SELECT 'mmlu', item_id, CASE WHEN item_id % 13 = 0 THEN 'not_four_choices' END FROM v_mc""")
def load_benchmark_q(spark, sf):
    """ARC-shaped and MMLU auxiliary-train-shaped rows checked by the typed loaders."""
    m = v_mc(spark, sf)
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    key = F.when(F.col("item_id") % 11 == 0, F.lit("Z")).otherwise(F.element_at(labels, F.col("answer") + 1))
    arc = m.select("item_id", "question", F.struct(F.col("choices").alias("text"), labels.alias("label")).alias("choices"),
                   key.alias("answerKey"))
    a = RD.load_benchmark(arc, "arc", "ARC-Challenge", keep=("item_id",))
    choices = F.when(F.col("item_id") % 13 == 0, F.slice("choices", 1, 3)).otherwise(F.col("choices"))
    mm = m.select("item_id", F.struct("question", choices.alias("choices"), "answer", "subject").alias("train"))
    b = RD.load_benchmark(mm, "mmlu", "auxiliary_train", keep=("item_id",))
    return (a.select(F.lit("arc").alias("name"), "item_id", "reason")
            .unionByName(b.select(F.lit("mmlu").alias("name"), "item_id", "reason")))


@register("read_word_list", f"""WITH {DV.V_WORDS} SELECT word FROM v_words""")
def read_word_list_q(spark, sf):
    """A word list file's lines (padded with whitespace) stripped back to words."""
    w = v_words(spark, sf)
    lines = w.select(F.concat(F.lit("  "), F.col("word"), F.lit("\t\r")).alias("value"))
    return RD.parse_word_lines(lines)
