"""Queries for report parsing, pivots, costs, leaderboards and CORE / ChatCORE."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import text as T
from tessera.operators import report as RP
from tessera.operators import score as S
from tessera.plans import duck as D
from tessera.plans import duck_views as DV
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.plans.views import v_devices, v_letters, v_runs, v_sections

R = lambda c, n=6: F.round(c, n)
KEYS = ["CORE", "ChatCORE", "GSM8K", "MMLU"]
IDS = ["n_nationkey", "stage"]


def _lines_sql(keys):
    ks = ", ".join(f"('{k}')" for k in keys)
    return f"""ln AS (SELECT n_nationkey, stage, unnest(string_split(text, chr(10))) AS line,
                     unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM v_sections),
hit AS (SELECT n_nationkey, stage, k.key, line_no, {D.strip("string_split(line, ':')[2]")} AS value
        FROM ln JOIN (VALUES {ks}) k(key) ON contains(line, k.key) WHERE len(string_split(line, ':')) >= 2),
mv AS (SELECT n_nationkey, stage, key, arg_max(value, line_no) AS value FROM hit GROUP BY 1, 2, 3)"""


@register("parse_metric_lines", f"WITH {DV.V_SECTIONS}, {_lines_sql(KEYS)} SELECT * FROM mv")
def parse_metric_lines_q(spark, sf):
    """Metric values from section lines (substring match, last line wins)."""
    return RP.parse_metric_lines(v_sections(spark, sf), KEYS, IDS).select("n_nationkey", "stage", "key", "value")


@register("parse_timestamp_line", f"""WITH {DV.V_SECTIONS},
ln AS (SELECT n_nationkey, stage, unnest(string_split(text, chr(10))) AS line,
              unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM v_sections),
p AS (SELECT n_nationkey, stage, line_no, try_strptime({D.strip("substr(line, instr(line, ':') + 1)")}, '%Y-%m-%d %H:%M:%S') AS t
      FROM ln WHERE starts_with(line, 'timestamp:')),
f AS (SELECT n_nationkey, stage, arg_min(t, line_no) AS t FROM p WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT s.n_nationkey, s.stage, strftime(f.t, '%Y-%m-%d %H:%M:%S') AS ts FROM v_sections s LEFT JOIN f USING (n_nationkey, stage)""")
def parse_timestamp_line_q(spark, sf):
    """The section timestamp (null when unparsable)."""
    t = RP.parse_timestamp_line(v_sections(spark, sf), "timestamp:", IDS)
    return t.select("n_nationkey", "stage", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


_STAGE_KEYS = {"base": ["CORE"], "sft": K.CHAT_METRICS, "rl": ["GSM8K"]}


def _stage_metrics(spark, sf):
    m = RP.parse_metric_lines(v_sections(spark, sf), sorted(set(sum(_STAGE_KEYS.values(), []))), IDS)
    allowed = spark.createDataFrame([(s, k) for s, ks in _STAGE_KEYS.items() for k in ks], "stage string, key string")
    return m.join(F.broadcast(allowed), ["stage", "key"])


_PIVOT_SQL = f"""WITH {DV.V_SECTIONS}, {_lines_sql(sorted(set(sum(_STAGE_KEYS.values(), []))))},
al AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{k}')" for s, ks in _STAGE_KEYS.items() for k in ks)}) a(stage, key)),
sm AS (SELECT mv.* FROM mv JOIN al USING (stage, key)),
pv AS (SELECT n_nationkey, key, coalesce(max(value) FILTER (WHERE stage = 'base'), '-') AS base,
              coalesce(max(value) FILTER (WHERE stage = 'sft'), '-') AS sft, coalesce(max(value) FILTER (WHERE stage = 'rl'), '-') AS rl
       FROM sm GROUP BY 1, 2)"""


@register("metric_pivot", _PIVOT_SQL + """
SELECT *, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY key <> 'CORE', key = 'ChatCORE', key) - 1 AS INT) AS ord FROM pv""")
def metric_pivot_q(spark, sf):
    """I15 + K1: metric x stage table per nation, '-' where missing, CORE first, ChatCORE last."""
    p = RP.metric_pivot(_stage_metrics(spark, sf), ["n_nationkey"])
    return p.select("n_nationkey", "key", "base", "sft", "rl", F.col("ord").cast("int"))


@register("order_metrics", """
WITH m AS (SELECT DISTINCT task AS key FROM (SELECT CASE WHEN event_type = 'click' THEN 'CORE' WHEN event_type = 'view' THEN 'ChatCORE'
                 ELSE upper(event_type) END AS task FROM events))
SELECT key, CAST(row_number() OVER (ORDER BY key <> 'CORE', key = 'ChatCORE', key) - 1 AS INT) AS ord FROM m""")
def order_metrics_q(spark, sf):
    """K1: metric names ordered CORE first, ChatCORE last, others by name."""
    e = table(spark, sf, "events")
    key = (F.when(F.col("event_type") == "click", "CORE").when(F.col("event_type") == "view", "ChatCORE")
           .otherwise(F.upper("event_type")))
    m = e.select(key.alias("key")).distinct()
    from pyspark.sql import Window
    return m.select("key", (F.row_number().over(Window.orderBy(*RP.metric_order("key"))) - 1).cast("int").alias("ord"))


@register("wall_clock", f"""WITH {DV.V_SECTIONS},
ln AS (SELECT n_nationkey, stage, unnest(string_split(text, chr(10))) AS line,
              unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM v_sections),
p AS (SELECT n_nationkey, stage, line_no, try_strptime({D.strip("substr(line, instr(line, ':') + 1)")}, '%Y-%m-%d %H:%M:%S') AS t
      FROM ln WHERE starts_with(line, 'timestamp:')),
f AS (SELECT n_nationkey, stage, arg_min(t, line_no) AS t FROM p WHERE t IS NOT NULL GROUP BY 1, 2),
al AS (SELECT v.n_nationkey, v.stage, v.stage_no, f.t FROM v_sections v LEFT JOIN f USING (n_nationkey, stage)),
en AS (SELECT n_nationkey, arg_max_null(t, stage_no) AS t1 FROM al WHERE NOT contains(stage, 'rl') GROUP BY n_nationkey),
se AS (SELECT n.n_nationkey, b.t AS t0, en.t1 FROM nation n LEFT JOIN f b ON b.n_nationkey = n.n_nationkey AND b.stage = 'base'
       LEFT JOIN en ON en.n_nationkey = n.n_nationkey)
SELECT n_nationkey, CASE WHEN t0 IS NULL OR t1 IS NULL THEN 'unknown' ELSE
  CAST(CAST(floor(epoch(t1 - t0) / 3600) AS BIGINT) AS VARCHAR) || 'h' ||
  CAST(CAST(floor((CAST(epoch(t1 - t0) AS BIGINT) % 3600) / 60) AS BIGINT) AS VARCHAR) || 'm' END AS wall_clock FROM se""")
def wall_clock_q(spark, sf):
    """I16: from the base section (plays the run header) to the last existing
    non-RL section, ``XhYm``, or unknown when either time is missing."""
    t = RP.parse_timestamp_line(v_sections(spark, sf), "timestamp:", [*IDS, "stage_no"])
    times = RP.section_times(t, ["n_nationkey"], "stage_no", "stage")
    j = table(spark, sf, "nation").select("n_nationkey").join(times, "n_nationkey", "left")
    return j.select("n_nationkey", RP.wall_clock(F.col("start_ts").cast("timestamp"), F.col("end_ts").cast("timestamp")).alias("wall_clock"))


_RATE_SQL = """CAST(CASE WHEN contains(device, 'H100') THEN 3.0 WHEN contains(device, 'A100') THEN 1.79
                    WHEN contains(device, 'V100') THEN 0.55 ELSE 2.0 END AS DOUBLE)"""


@register("first_match", f"WITH {DV.V_DEVICES} SELECT s_suppkey, device, {_RATE_SQL} AS rate FROM v_devices")
def first_match_q(spark, sf):
    """H3: first GPU rule contained in the device name, default 2.0."""
    r = RP.first_match(v_devices(spark, sf), RP.gpu_rates(spark), "device", ["s_suppkey"], "contains",
                       K.GPU_DEFAULT_RATE, out="rate")
    return r.select("s_suppkey", "device", "rate")


@register("run_cost", f"""WITH {DV.V_DEVICES}
SELECT s_suppkey, round({_RATE_SQL} * n_devices, 6) AS hourly_rate,
       CASE WHEN hours <> 0 THEN round({_RATE_SQL} * n_devices * hours, 6) END AS estimated_total FROM v_devices""")
def run_cost_q(spark, sf):
    """Estimated run cost per supplier run."""
    r = RP.run_cost(v_devices(spark, sf), ["s_suppkey"])
    return r.select("s_suppkey", R(F.col("hourly_rate")).alias("hourly_rate"), R(F.col("estimated_total")).alias("estimated_total"))


_LATEST_SQL = f"""WITH {DV.V_RUNS},
lt AS (SELECT model, task, arg_max(accuracy, (timestamp, event_id)) AS accuracy FROM v_runs GROUP BY 1, 2)"""


@register("leaderboard", _LATEST_SQL + " SELECT model, task, accuracy FROM lt")
def leaderboard_q(spark, sf):
    """Latest accuracy per (model, task)."""
    return RP.leaderboard(v_runs(spark, sf), tiebreak="event_id").select("model", "task", "accuracy")


_TASKS = ["ARC-Challenge", "ARC-Easy", "GSM8K", "HumanEval", "MMLU", "SpellingBee"]


@register("leaderboard_table", _LATEST_SQL + " SELECT model, " + ", ".join(
    f"""max(accuracy) FILTER (WHERE task = '{t}') AS "{t}" """ for t in _TASKS) + " FROM lt GROUP BY model")
def leaderboard_table_q(spark, sf):
    """The model x task table, tasks as columns."""
    return RP.leaderboard_table(v_runs(spark, sf), _TASKS, tiebreak="event_id")


_FLOPS_SQL = "CASE " + " ".join("WHEN " + " AND ".join(f"contains(lower(device), '{x}')" for x in p) + f" THEN {v!r}" for p, v in K.PEAK_FLOPS) + " END"


@register("peak_flops", f"WITH {DV.V_DEVICES} SELECT s_suppkey, device, CAST({_FLOPS_SQL} AS DOUBLE) AS peak_flops FROM v_devices")
def peak_flops_q(spark, sf):
    """H3 with all-substrings rules: peak FLOPS of every run's device (null stands for unknown)."""
    r = RP.peak_flops(v_devices(spark, sf), ["s_suppkey"])
    return r.select("s_suppkey", "device", F.when(F.col("peak_flops") != float("inf"), F.col("peak_flops")).alias("peak_flops"))


@register("chatcore", _LATEST_SQL + f""",
b AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {b})" for t, b in K.CHATCORE_BASELINES)}) b(task, baseline))
SELECT model, CAST(count(DISTINCT task) AS BIGINT) AS n_tasks, round(avg((accuracy - baseline) / (1.0 - baseline)), 6) AS chatcore
FROM lt JOIN b USING (task) GROUP BY model HAVING count(DISTINCT task) = 6""")
def chatcore_q(spark, sf):
    """ChatCORE per model over the latest task accuracies (all six tasks required)."""
    lt = RP.leaderboard(v_runs(spark, sf), tiebreak="event_id")
    c = S.chatcore(lt, group=["model"])
    return c.select("model", F.col("n_tasks").cast("bigint"), R(F.col("chatcore")).alias("chatcore"))


@register("core_metric", f"""WITH {DV.V_MC}, {DV.V_LETTERS},
a AS (SELECT subject AS task, count(*) AS n, sum(CAST(coalesce({D.letter('completion')} = gold, false) AS INT)) / count(*) AS acc
      FROM v_letters GROUP BY subject),
c AS (SELECT task, (acc - 0.25) / (1 - 0.25) AS centered FROM a)
SELECT round(avg(centered), 6) AS core_metric, count(*) AS n_tasks FROM c""")
def core_metric_q(spark, sf):
    """D2 -> I5 -> I2 -> H1 -> I11: CORE-style centred mean over subjects (baseline 25%)."""
    v = v_letters(spark, sf).withColumn("pred", T.extract_letter("completion"))
    g = S.grade_exact(v, "pred", "gold").withColumnRenamed("subject", "task")
    acc = S.accuracy_by(g, ["task"])
    base = acc.select("task").distinct().withColumn("baseline", F.lit(25.0))
    c = S.attach_baseline(acc, base).withColumn("centered", S.centered(F.col("accuracy"), F.col("baseline")))
    return S.core_metric(c).select(R(F.col("core_metric")).alias("core_metric"), "n_tasks")


@register("corpus_stats", """
SELECT lang, count(*) AS n_docs, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS n_lines,
       CAST(sum(strlen(text)) AS BIGINT) AS n_chars, CAST(sum(strlen(text)) // 4 AS BIGINT) AS approx_tokens
FROM documents GROUP BY lang""")
def corpus_stats_q(spark, sf):
    """Documents, newline count, bytes and approximate tokens per language (``wc -lc`` style)."""
    return RP.corpus_stats(table(spark, sf, "documents"), ["lang"])


@register("core_csv", f"""WITH {DV.V_MC}, {DV.V_LETTERS},
a AS (SELECT subject AS task, sum(CAST(coalesce({D.letter('completion')} = gold, false) AS INT)) / count(*) AS acc
      FROM v_letters GROUP BY subject),
c AS (SELECT task, acc, (acc - 0.25) / (1 - 0.25) AS centered FROM a)
SELECT 0 AS ord, rpad('Task', 35, ' ') || ', ' || rpad('Accuracy', 10, ' ') || ', ' || rpad('Centered', 10, ' ') AS line
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY task) AS INT), rpad(task, 35, ' ') || ', ' || rpad(printf('%.6f', round(acc, 6)), 10, ' ')
       || ', ' || rpad(printf('%.6f', round(centered, 6)), 10, ' ') FROM c
UNION ALL
SELECT 1073741824, rpad('CORE', 35, ' ') || ', ' || rpad('', 10, ' ') || ', ' || rpad(printf('%.6f', round(avg(centered), 6)), 10, ' ') FROM c""")
def core_csv_q(spark, sf):
    """The CORE result table as its fixed-width csv lines (subjects as tasks, 25% baselines)."""
    from tessera.sources.sinks import core_csv_lines
    v = v_letters(spark, sf).withColumn("pred", T.extract_letter("completion"))
    g = S.grade_exact(v, "pred", "gold").withColumnRenamed("subject", "task")
    acc = S.accuracy_by(g, ["task"])
    base = acc.select("task").distinct().withColumn("baseline", F.lit(25.0))
    c = S.attach_baseline(acc, base).withColumn("centered", S.centered(F.col("accuracy"), F.col("baseline")))
    return core_csv_lines(c, S.core_metric(c)).select(F.col("ord").cast("int"), "line")
