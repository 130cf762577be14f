"""The operations dashboard as data: one entry per plotted expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MINUTE
from ..operators.metrics import histogram_quantile, le_bound, rate, rate_quantile, rates, sum_rates

SCRAPE_S = 15
SERIES = "series"


@dataclass(frozen=True)
class Panel:
    """``shape`` is rate, sum, sum_by or quantile of the metric's rate."""

    title: str
    legend: str
    metric: str
    shape: str
    window_s: int
    phi: float | None = None
    by: tuple[str, ...] = ()


# What each panel plots, over which window.
PANELS = [
    Panel("events ingested", "events written/s", "ingestion_events_written_total", "sum", MINUTE),
    Panel("ingestion write errors", "write errors/s", "ingestion_write_errors_total", "sum", MINUTE),
    Panel("batch flush duration", "p95", "ingestion_batch_flush_duration_seconds_bucket",
          "quantile", 5 * MINUTE, 0.95),
    Panel("batch size", "p50", "ingestion_batch_size_bucket", "quantile", 5 * MINUTE, 0.50),
    Panel("batch size", "p95", "ingestion_batch_size_bucket", "quantile", 5 * MINUTE, 0.95),
    Panel("anomalies detected", "by severity", "anomaly_detected_total", "sum_by", 5 * MINUTE,
          by=("severity",)),
    Panel("detection cycles", "cycles/s", "anomaly_detection_cycles_total", "rate", 5 * MINUTE),
    Panel("detection database errors", "errors/s", "anomaly_db_query_errors_total", "rate",
          5 * MINUTE),
    Panel("questions", "questions/s", "llm_queries_total", "rate", 5 * MINUTE),
    Panel("questions", "failures/s", "llm_query_failures_total", "rate", 5 * MINUTE),
    Panel("question duration", "p50", "llm_query_duration_seconds_bucket", "quantile",
          10 * MINUTE, 0.50),
    Panel("question duration", "p95", "llm_query_duration_seconds_bucket", "quantile",
          10 * MINUTE, 0.95),
]


def with_series(samples: DataFrame) -> DataFrame:
    """Adds a series id: the labels as text, in key order."""
    entries = F.array_sort(F.map_entries("labels"))
    text = F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"]))
    return samples.withColumn(SERIES, F.array_join(text, ","))


def plot(
    samples: DataFrame, panel: Panel, prefix: str = "", step_s: int = SCRAPE_S,
    window_s: int | None = None,
) -> DataFrame:
    """A panel's values: (ts, label columns, value)."""
    wanted = panel.phi is not None and ("le", *panel.by) or panel.by
    chosen = with_series(samples.filter(F.col("metric") == prefix + panel.metric)).select(
        SERIES, "ts", "value", *[F.col("labels")[name].alias(name) for name in wanted]
    )
    window_s = window_s or panel.window_s
    series = [SERIES, *wanted]
    if panel.shape == "quantile":
        return rate_quantile(
            chosen, series, panel.phi, window_s, step_s, list(panel.by), out="value"
        )
    rates = rate(chosen, series, window_s, step_s, out="value")
    if panel.shape == "rate":
        return rates
    return sum_rates(rates, list(panel.by), "value")


def plot_all(
    samples: DataFrame, panels: list[Panel] = PANELS, prefix: str = "", step_s: int = SCRAPE_S
) -> DataFrame:
    """All panels in one pass over the samples: (title, legend, series, ts, value).

    ``series`` is the text of the labels that a panel keeps: all of them for a rate, those of
    ``by`` else. Panels of the same metric share slot summaries, those of the same window rates too.
    """
    labels = sorted({name for p in panels for name in p.by} | {"le"})
    series = ["metric", SERIES, *labels]
    wanted = samples.filter(F.col("metric").isin(sorted({prefix + p.metric for p in panels})))
    chosen = with_series(wanted).select(
        "metric", SERIES, "ts", "value", *[F.col("labels")[name].alias(name) for name in labels]
    )
    by_metric: dict[str, list[Panel]] = {}
    for panel in panels:
        by_metric.setdefault(prefix + panel.metric, []).append(panel)

    def of_metric(entries) -> Column:
        first, *others = by_metric
        found = F.when(F.col("metric") == first, F.array(*entries(by_metric[first])))
        for name in others:
            found = found.when(F.col("metric") == name, F.array(*entries(by_metric[name])))
        return found

    windows = of_metric(lambda found: [F.lit(w).cast("long") for w in sorted({p.window_s for p in found})])
    drawn = of_metric(lambda found: [_entry(p) for p in found])
    shared = rates(chosen, series, windows, step_s, out="value").select(
        "ts", "value", "le", "window_s", F.explode(drawn).alias("p")
    ).filter(F.col("p.window_s") == F.col("window_s"))
    names = ["title", "legend", SERIES, "phi", "ts"]
    summed = shared.select("p.title", "p.legend", f"p.{SERIES}", "p.phi", "ts", "value",
                           F.when(F.col("p.phi").isNotNull(), F.col("le")).alias("le"))
    summed = sum_rates(summed, ["title", "legend", SERIES, "phi", "le"], "value")
    # a panel without phi has one row per moment, whose value goes past the quantile
    plain = summed.withColumns({
        "plain": F.when(F.col("phi").isNull(), F.col("value")), "le": le_bound(F.col("le"))
    })
    bent = histogram_quantile(plain, [*names, "plain"], F.col("phi"), count="value")
    return bent.select(
        "title", "legend", SERIES, "ts",
        F.when(F.col("phi").isNull(), F.col("plain")).otherwise(F.col("quantile")).alias("value"),
    )


def _entry(panel: Panel) -> Column:
    """A panel as a struct, with the text of the labels it keeps of a series."""
    kept = F.concat_ws(",", *[F.concat(F.lit(f"{name}="), F.coalesce(F.col(name), F.lit(""))) for name in panel.by])
    return F.struct(
        F.lit(panel.title).alias("title"), F.lit(panel.legend).alias("legend"),
        F.lit(panel.window_s).cast("long").alias("window_s"), F.lit(panel.phi).cast("double").alias("phi"),
        (F.col(SERIES) if panel.shape == "rate" else kept if panel.by else F.lit("")).alias(SERIES),
    )
