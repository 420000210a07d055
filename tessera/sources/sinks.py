"""Sinks (A13-A15): response logs, run summaries and the CORE csv."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import csv_slug, model_slug


def write_response_log(df: DataFrame, out_dir: str, model: str = "model", task: str = "task",
                       variant: str = "variant", mode: str = "append") -> None:
    """Graded responses as JSON lines, one folder per task, model slug and
    variant (n-shot or mode suffix)."""
    (df.withColumn("model_slug", model_slug(model))
     .write.mode(mode).partitionBy(task, "model_slug", variant).json(out_dir))


def write_run_summary(df: DataFrame, out_dir: str, mode: str = "append") -> None:
    """One JSON record per (model, task[, mode]) run."""
    df.withColumn("model_slug", model_slug("model")).write.mode(mode).partitionBy("model_slug", "task").json(out_dir)


def _f6(c) -> Column:
    # round first (HALF_UP), then print six decimals: no engine-specific tie rounding
    return F.format_string("%.6f", F.round(c, 6))


def core_csv_lines(results: DataFrame, core: DataFrame, task: str = "task", acc: str = "accuracy",
                   cen: str = "centered", order: str | None = None) -> DataFrame:
    """The CORE table as its fixed-width text lines: a header, one line per task
    (``label:<35, acc:<10.6f, centered:<10.6f``) and a final ``CORE`` line with a
    blank accuracy.  ``ord`` orders the lines (header 0, tasks, CORE last)."""
    o = F.col(order) if order else F.col(task)
    w = F.row_number().over(Window.orderBy(o))  # one row per task: a small table
    head = core.select(F.lit(0).alias("ord"), F.concat(F.rpad(F.lit("Task"), 35, " "), F.lit(", "),
                                                      F.rpad(F.lit("Accuracy"), 10, " "), F.lit(", "),
                                                      F.rpad(F.lit("Centered"), 10, " ")).alias("line"))
    rows = results.select(w.alias("ord"), F.concat(F.rpad(F.col(task), 35, " "), F.lit(", "), F.rpad(_f6(F.col(acc)), 10, " "),
                                                    F.lit(", "), F.rpad(_f6(F.col(cen)), 10, " ")).alias("line"))
    total = core.select(F.lit(1 << 30).alias("ord"), F.concat(F.rpad(F.lit("CORE"), 35, " "), F.lit(", "),
                                                             F.rpad(F.lit(""), 10, " "), F.lit(", "),
                                                             F.rpad(_f6(F.col("core_metric")), 10, " ")).alias("line"))
    return head.unionByName(rows).unionByName(total)


def write_core_csv(results: DataFrame, core: DataFrame, out_dir: str, model: str, **kw) -> str:
    """Write the lines as one text file under the csv slug of the model
    (one line per task: a bounded, single-file result)."""
    path = f"{out_dir.rstrip('/')}/{csv_slug_text(model)}"
    core_csv_lines(results, core, **kw).orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(path)
    return path


def csv_slug_text(model: str) -> str:
    return model.replace("/", "-")


__all__ = ["write_response_log", "write_run_summary", "core_csv_lines", "write_core_csv", "csv_slug"]
