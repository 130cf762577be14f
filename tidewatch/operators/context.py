"""Retrieved contexts as compact text, and the prompt built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import error_pct
from ..functions.text import fixed_point, normalize_question
from ..functions.times import iso_format

NO_ANOMALIES = "No anomalies detected in this window."


def is_empty() -> Column:
    return (F.size("anomalies") == 0) & (F.size("service_stats") == 0)


def _stat_line(s: Column) -> Column:
    def millis(name: str) -> Column:
        return fixed_point(F.coalesce(s[name], F.lit(0.0)), 0)

    pct = fixed_point(error_pct(s["total_events"], s["total_errors"]), 1)
    return F.concat(
        F.lit("- "), s["service"], F.lit(": "), s["total_events"].cast("string"),
        F.lit(" events, "), pct, F.lit("% error rate, avg p95 latency "),
        millis("avg_p95_latency_ms"), F.lit("ms, max latency "),
        millis("max_latency_ms"), F.lit("ms"),
    )


def shown_severity(severity: Column) -> Column:
    """A severity as context lines spell it."""
    return F.upper(severity)


def _anomaly_line(a: Column) -> Column:
    return F.concat(
        F.lit("- ["), shown_severity(a["severity"]), F.lit("] "), a["service"], F.lit(" at "),
        iso_format(a["bucket_ts"]), F.lit(": "), a["anomaly_type"],
        F.lit(", value="), fixed_point(a["metric_value"], 2),
        F.lit(", baseline="), fixed_point(a["baseline_mean"], 2),
        F.lit(", z_score="), fixed_point(a["z_score"], 2),
    )


def context_text() -> Column:
    """The text of a row of ``questions.retrieve``."""
    window = F.concat(
        F.lit("Time window: "), iso_format(F.col("window_start")),
        F.lit(" to "), iso_format(F.col("window_end")),
    )
    stats = F.concat(
        F.array(F.lit("Service stats:")),
        F.transform("service_stats", _stat_line),
        F.array(F.lit("")),
    )
    found = F.concat(
        F.array(F.lit("Detected anomalies (most recent first):")),
        F.transform("anomalies", _anomaly_line),
    )
    lines = F.concat(
        F.array(window, F.lit("")),
        F.when(F.size("service_stats") > 0, stats).otherwise(F.array().cast("array<string>")),
        F.when(F.size("anomalies") > 0, found).otherwise(F.array(F.lit(NO_ANOMALIES))),
    )
    return F.array_join(lines, "\n")


def format_context(contexts: DataFrame) -> DataFrame:
    return contexts.withColumn("context", context_text())


def prompts(contexts: DataFrame) -> DataFrame:
    """(question_id, prompt), ready for any model runner. Blank questions are
    never asked, so they get no prompt."""
    asked = normalize_question(F.col("query"))
    text = F.concat(context_text(), F.lit("\n\nQuestion: "), asked, F.lit("\n\nAnswer:"))
    return contexts.filter(asked.isNotNull()).select("question_id", text.alias("prompt"))
