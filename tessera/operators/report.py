"""Report analytics (D15, D16, H3, I14-I18, K1) over sections and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import py_strip
from tessera.plans.guards import broadcast_small


def _lines(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("*", F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def parse_metric_lines(df: DataFrame, keys: list[str], id_cols: list[str], text: str = "text") -> DataFrame:
    """For each key, lines *containing* it give the text between the first and
    second ``:`` (stripped); the last such line wins.  Keys are a literal list."""
    ln = _lines(df.select(*id_cols, text), text)
    # keys are a literal list: each line emits the keys it contains (no join)
    key_arr = F.array(*[F.lit(k) for k in keys])
    hit = ln.select("*", F.explode(F.filter(key_arr, lambda k: F.col("line").contains(k))).alias("key"))
    parts = F.split(F.col("line"), ":", -1)
    hit = hit.where(F.size(parts) >= 2).withColumn("value", py_strip(F.element_at(parts, 2)))
    return hit.groupBy(*id_cols, "key").agg(F.max_by("value", "line_no").alias("value"))


def parse_timestamp_line(df: DataFrame, prefix: str, id_cols: list[str], text: str = "text",
                         out: str = "ts") -> DataFrame:
    """The first line starting with ``prefix`` whose rest parses as
    ``%Y-%m-%d %H:%M:%S``; null when none does."""
    rest = py_strip(F.col("line").substr(F.instr(F.col("line"), ":") + 1, F.lit(1 << 30)))
    ts = F.when(F.col("line").startswith(prefix), F.try_to_timestamp(rest, F.lit("yyyy-MM-dd HH:mm:ss")))
    ln = _lines(df.select(*id_cols, F.coalesce(F.col(text), F.lit("")).alias(text)), text).withColumn("_ts", ts)
    # lines without a time have no order, so they never win; a section without any gives null
    return ln.groupBy(*id_cols).agg(F.min_by("_ts", F.when(F.col("_ts").isNotNull(), F.col("line_no"))).alias(out))


MAX_RULES = 1_000


def _rule_cond(t: Column, pattern, kind: str) -> Column:
    """One literal rule as a predicate on ``t``."""
    if kind == "contains":
        return t.contains(pattern)
    if kind == "regex":
        return t.rlike(pattern)
    c = F.lit(True)
    for p in pattern:  # all_of: every substring present
        c = c & t.contains(p)
    return c


def first_match(df: DataFrame, rules: DataFrame, text: str, key: list[str], kind: str = "contains", default=None,
                out: str = "value") -> DataFrame:
    """H3: ordered rules ``(rule_no, pattern, value)``; the first matching rule wins,
    ``default`` when none.  ``kind``: contains | regex | all_of (pattern is an
    array of substrings that must all be present).  ``key`` identifies rows.

    Rule tables are configuration: they become one ordered ``CASE`` chain in a single
    projection (no join, no shuffle).  More than ``MAX_RULES`` rules are an error.
    """
    if kind not in ("contains", "regex", "all_of"):
        raise ValueError(kind)
    listed = rules.limit(MAX_RULES + 1).collect()
    if len(listed) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    expr = F.lit(default)
    for r in sorted(listed, key=lambda r: r["rule_no"], reverse=True):
        expr = F.when(_rule_cond(F.col(text), r["pattern"], kind), F.lit(r["value"])).otherwise(expr)
    return df.withColumn(out, expr)


def peak_flops(df: DataFrame, key: list[str], device: str = "device", out: str = "peak_flops") -> DataFrame:
    """H3 with the peak-FLOPS table (all substrings of a rule in the lower-case name); infinity when unknown,
    so a utilisation over it is 0."""
    rules = df.sparkSession.createDataFrame([(i, p, v) for i, (p, v) in enumerate(K.PEAK_FLOPS)],
                                            "rule_no int, pattern array<string>, value double")
    low = first_match(df.withColumn("_name", F.lower(device)), rules, "_name", key, "all_of", float("inf"), out=out)
    return low.drop("_name")


def corpus_stats(df: DataFrame, group: list[str] | None = None, text: str = "text") -> DataFrame:
    """Documents, lines and characters as ``wc -lc`` counts them (newline
    characters; bytes), and approximate tokens = characters // 4."""
    t = F.col(text)
    newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return df.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(newlines).cast("bigint").alias("n_lines"),
        F.sum(F.octet_length(t)).cast("bigint").alias("n_chars")).withColumn(
        "approx_tokens", (F.col("n_chars") / 4).cast("bigint"))


def metric_order(metric) -> list[Column]:
    """K1: CORE first, ChatCORE last, the rest by name."""
    m = F.col(metric) if isinstance(metric, str) else metric
    return [(m != "CORE").cast("int"), (m == "ChatCORE").cast("int"), m]


def metric_pivot(metrics: DataFrame, id_cols: list[str], stage: str = "stage", key: str = "key",
                 value: str = "value") -> DataFrame:
    """Metric x stage (base, sft, rl) with ``-`` where missing, in K1 order."""
    p = metrics.groupBy(*id_cols, key).pivot(stage, K.REPORT_STAGES).agg(F.first(value))
    p = p.na.fill("-", subset=K.REPORT_STAGES)
    return p.withColumn("ord", F.row_number().over(Window.partitionBy(*id_cols).orderBy(*metric_order(key))) - 1)


def section_end_time(ts: DataFrame, key: list[str], order: str, name: str, col: str = "ts") -> DataFrame:
    """I16 end: the timestamp of the *last* existing non-RL section (by section
    order), null when that section has no parsable timestamp."""
    non_rl = ts.where(~F.col(name).contains("rl"))
    return non_rl.groupBy(*key).agg(F.max_by(col, order).alias("end_ts"))


def section_times(ts: DataFrame, key: list[str], order: str, name: str, start: str = "base", col: str = "ts") -> DataFrame:
    """I16, both ends from one aggregate: ``start_ts`` of the section named ``start`` and ``end_ts`` as above."""
    non_rl = F.when(~F.col(name).contains("rl"), F.col(order))
    return ts.groupBy(*key).agg(F.max(F.when(F.col(name) == start, F.col(col))).alias("start_ts"),
                                F.max(F.when(non_rl.isNotNull(), F.struct(non_rl, F.col(col).alias("_t")))).getField("_t").alias("end_ts"))


def wall_clock(start: Column, end: Column) -> Column:
    """I16: ``XhYm`` between two timestamps, ``unknown`` when either is missing."""
    secs = (F.unix_timestamp(end) - F.unix_timestamp(start)).cast("bigint")
    return F.when(start.isNull() | end.isNull(), F.lit("unknown")).otherwise(
        F.concat((secs / 3600).cast("bigint").cast("string"), F.lit("h"),
                 ((secs % 3600) / 60).cast("bigint").cast("string"), F.lit("m")))


def gpu_rates(spark) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(K.GPU_HOURLY_RATES)],
                                 "rule_no int, pattern string, value double")


def run_cost(runs: DataFrame, key: list[str], device: str = "device", count: str = "n_devices",
             hours: str = "hours") -> DataFrame:
    """Hourly rate (first GPU type contained in the name, else 2.0) x devices x hours;
    no total when the run time is missing or zero."""
    r = first_match(runs, gpu_rates(runs.sparkSession), device, key, "contains", K.GPU_DEFAULT_RATE, out="rate")
    h = F.col(hours)
    return (r.withColumn("hourly_rate", F.col("rate") * F.col(count))
            .withColumn("estimated_total", F.when(h.isNotNull() & (h != 0), F.col("hourly_rate") * h)))


def leaderboard(summaries: DataFrame, model: str = "model", task: str = "task", acc: str = "accuracy",
                ts: str = "timestamp", tiebreak: str | None = None) -> DataFrame:
    """I18, long form: accuracy of the latest record per (model, task);
    ``max(struct(timestamp, tiebreak, accuracy))`` is a partial aggregate."""
    parts = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else []) + [F.col(acc).alias("_acc")]
    latest = summaries.groupBy(model, task).agg(F.max(F.struct(*parts)).getField("_acc").alias(acc))
    return latest


def leaderboard_table(summaries: DataFrame, tasks: list[str] | None = None, model: str = "model", task: str = "task",
                      acc: str = "accuracy", ts: str = "timestamp", tiebreak: str | None = None) -> DataFrame:
    """A row per model, a column per task (``tasks``, or all that occur, by name), null where a model has no record."""
    latest = leaderboard(summaries, model, task, acc, ts, tiebreak)
    grouped = latest.groupBy(model)
    return (grouped.pivot(task, tasks) if tasks else grouped.pivot(task)).agg(F.first(acc))
