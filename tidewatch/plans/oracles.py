"""The queries of ``registry`` as plain SQL over the same sample tables.

Written for brevity and independence, not for size: questions are joined to
anomalies and buckets by range, windows are plain, the error baseline is a
recursive query.
"""

from __future__ import annotations

from ..functions.text import BLANKS

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
FOUND = ["metric_value", "baseline_mean", "baseline_stddev", "z_score"]


def r(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5013) / 1e6"


def iso(ts: str) -> str:
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0"
        f" THEN '' ELSE strftime({ts}, '.%f') END || '+00:00')"
    )


def half_up(x: str, digits: int) -> str:
    """Formatting with true ties away from zero; other values print exactly."""
    scale = 10**digits
    grid = 2 ** (digits + 1)
    return (
        f"CASE WHEN {x} * {grid} = floor({x} * {grid}) THEN"
        f" printf('%.{digits}f', floor({x} * {scale} + 0.5) / {scale})"
        f" ELSE printf('%.{digits}f', {x}) END"
    )


LOGS = """log_events AS (
  SELECT event_id AS number, event_type AS kind,
    concat('00000000-0000-4000-8000-', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS event_id, ts, service,
    concat('/', service, '/', CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END) AS endpoint,
    CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARN' ELSE 'INFO' END AS level,
    CAST(status_code AS INT) AS status_code, value AS latency_ms,
    concat(service, ' handled ', event_type) AS message,
    concat('00000000-0000-4000-9000-', lpad(CAST(user_id AS VARCHAR), 12, '0')) AS trace_id,
    event_type = 'error' AND value > 100 AS anomaly_injected,
    ts + to_seconds(event_id % 900) AS ingested_at
  FROM (
    SELECT *, CASE user_id % 4 WHEN 0 THEN 'checkout' WHEN 1 THEN 'auth' WHEN 2 THEN 'payments' ELSE 'inventory' END AS service,
      CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 502 ELSE 503 END
           WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 404 ELSE 200 END AS status_code
    FROM events))"""
COLUMNS = ("event_id, ts, service, endpoint, level, status_code, latency_ms, message, trace_id,"
           " anomaly_injected, ingested_at")

ROLLUP = f"""{LOGS}, rollup AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, service, count(*) AS event_count,
    count(*) FILTER (WHERE level = 'ERROR') AS error_count,
    {r('avg(latency_ms)')} AS avg_latency_ms,
    {r('quantile_cont(latency_ms, 0.95)')} AS p95_latency_ms, max(latency_ms) AS max_latency_ms
  FROM log_events GROUP BY 1, 2)"""



def baseline(source: str) -> str:
    """Rollup rows with the statistics of the 60 hours before each."""
    return f"""SELECT *, count(*) OVER h AS history,
    coalesce(avg(p95_latency_ms) OVER h, 0) AS p95_mean,
    coalesce(stddev_samp(p95_latency_ms) OVER h, 0) AS p95_stddev,
    coalesce(avg(max_latency_ms) OVER h, 0) AS max_mean,
    coalesce(stddev_samp(max_latency_ms) OVER h, 0) AS max_stddev,
    error_count / event_count AS rate
  FROM {source}
  WINDOW h AS (PARTITION BY service ORDER BY bucket
    RANGE BETWEEN INTERVAL 60 HOURS PRECEDING AND INTERVAL 1 SECOND PRECEDING)"""


BASE = f"""{ROLLUP}, base AS (
  {baseline('rollup')})"""

EWMA = f"""{BASE}, numbered AS (
  SELECT service, bucket, rate, row_number() OVER (PARTITION BY service ORDER BY bucket) AS i
  FROM base WHERE history >= 2 AND event_count > 0),
ewma AS (
  SELECT service, bucket, rate, i, rate AS ewma FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.service, n.bucket, n.rate, n.i, 0.3::DOUBLE * e.rate + 0.7::DOUBLE * e.ewma
  FROM ewma e JOIN numbered n ON n.service = e.service AND n.i = e.i + 1)"""

GRADE = "CASE WHEN {z} >= 4.0 THEN 'critical' WHEN {z} >= 2.5 THEN 'warning' END"


def _latency(kind: str, metric: str, prefix: str, source: str = "base") -> str:
    z = f"({metric} - {prefix}_mean) / {prefix}_stddev"
    return f"""SELECT bucket AS bucket_ts, service, '{kind}' AS anomaly_type, {metric} AS metric_value,
    {prefix}_mean AS baseline_mean, {prefix}_stddev AS baseline_stddev, {z} AS z_score,
    {GRADE.format(z=z)} AS severity
  FROM {source} WHERE history >= 2 AND {prefix}_stddev > 0 AND {z} >= 2.5"""


def _burst(source: str = "ewma") -> str:
    z = "(rate - ewma) / greatest(ewma, 0.01)"
    return f"""SELECT bucket AS bucket_ts, service, 'error_burst' AS anomaly_type, rate AS metric_value,
    ewma AS baseline_mean, 0.0::DOUBLE AS baseline_stddev, {z} AS z_score,
    {GRADE.format(z=f'abs({z})')} AS severity
  FROM {source} WHERE abs({z}) >= 2.5"""


SPIKE = _latency("latency_spike", "p95_latency_ms", "p95")
OUTLIER = _latency("max_latency_outlier", "max_latency_ms", "max")
FINDINGS = f"""{EWMA}, findings AS (
  {SPIKE} UNION ALL {OUTLIER} UNION ALL {_burst()})"""
ROUNDED = ", ".join(f"{r(c)} AS {c}" for c in FOUND)
ANOMALIES = f"""{FINDINGS}, anomalies AS (
  SELECT sha256(service || '|' || strftime(bucket_ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || anomaly_type) AS id,
    bucket_ts + INTERVAL 2 HOURS AS detected_at, bucket_ts, service, anomaly_type, {ROUNDED}, severity
  FROM findings)"""
FEED_ORDER = "detected_at DESC, service, anomaly_type, bucket_ts"

REDELIVERED = f"""{LOGS}, redelivered AS (
  SELECT {COLUMNS} FROM log_events
  UNION ALL SELECT * REPLACE (message || ' (again)' AS message, ingested_at + INTERVAL 1 DAY AS ingested_at)
    FROM (SELECT {COLUMNS} FROM log_events)
  UNION ALL SELECT * REPLACE (ts + INTERVAL 1 SECOND AS ts)
    FROM (SELECT {COLUMNS} FROM log_events) WHERE level = 'ERROR'),
deduped AS (
  SELECT * EXCLUDE n FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id, ts ORDER BY ingested_at) AS n FROM redelivered)
  WHERE n = 1)"""

BODY = f"""CAST(json_object('event_id', event_id, 'timestamp', {iso('ts')}, 'service', service,
    'endpoint', endpoint, 'level', level, 'status_code', status_code, 'latency_ms', latency_ms,
    'message', message, 'trace_id', trace_id, 'anomaly_injected', anomaly_injected) AS VARCHAR)"""
MESSAGES = f"""{LOGS}, messages AS (
  SELECT *, number % 8 AS form, {BODY} AS body FROM log_events)"""
OUTCOME = """CASE WHEN form IN (1, 2) THEN 'malformed json' WHEN form = 5 THEN 'bad timestamp'
    WHEN form = 6 THEN 'trace_id is not a uuid' END"""

TIMESTAMPS = f"""{LOGS}, spelled AS (
  SELECT event_id, service, ts, epoch_us(ts) % 6 AS form,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS sec, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS mic
  FROM log_events),
parsed AS (
  SELECT event_id, service,
    CASE form WHEN 0 THEN mic || 'Z' WHEN 1 THEN mic || '789+05:30' WHEN 2 THEN sec || '-08:00'
      WHEN 3 THEN left(sec, 10) WHEN 4 THEN replace(mic, 'T', ' ') || 'Z' ELSE mic END AS timestamp,
    CASE form WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 330 MINUTES
      WHEN 2 THEN date_trunc('second', ts) + INTERVAL 8 HOURS END AS ts
  FROM spelled)"""

QUESTIONS = f"""asked AS (
  SELECT question_id, query, service,
    {AS_OF} - to_hours(CASE coalesce(lookback_hours, 0) WHEN 0 THEN 6 ELSE lookback_hours END) AS window_start,
    {AS_OF} AS window_end, lookback_hours
  FROM (
    SELECT conv_id * 1000 + turn AS question_id, text AS query,
      CASE conv_id % 5 WHEN 0 THEN 'checkout' WHEN 1 THEN 'auth' WHEN 2 THEN 'payments' WHEN 3 THEN 'inventory' END AS service,
      CAST(CASE conv_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 72 WHEN 3 THEN 720 END AS INT) AS lookback_hours
    FROM conversations WHERE role = 'user'))"""
ASKED_ANOMALIES = """asked_anomalies AS (
  SELECT * FROM (
    SELECT q.question_id, CAST(row_number() OVER (PARTITION BY q.question_id
        ORDER BY a.detected_at DESC, a.service, a.anomaly_type, a.bucket_ts) AS INTEGER) AS rank,
      a.* EXCLUDE (id, baseline_stddev)
    FROM asked q JOIN anomalies a
      ON a.detected_at >= q.window_start AND (q.service IS NULL OR a.service = q.service))
  WHERE rank <= 50)"""
ASKED_STATS = """asked_stats AS (
  SELECT q.question_id, b.service, CAST(sum(b.event_count) AS BIGINT) AS total_events,
    CAST(sum(b.error_count) AS BIGINT) AS total_errors, avg(b.p95_latency_ms) AS avg_p95_latency_ms,
    max(b.max_latency_ms) AS max_latency_ms
  FROM asked q JOIN rollup b
    ON b.bucket >= q.window_start AND (q.service IS NULL OR b.service = q.service)
  GROUP BY 1, 2)"""
CONTEXTS = f"{ANOMALIES}, {QUESTIONS}, {ASKED_ANOMALIES}, {ASKED_STATS}"
TEXTS = f"""{CONTEXTS}, stat_lines AS (
  SELECT question_id, 'Service stats:' || chr(10) || string_agg(
    '- ' || service || ': ' || total_events || ' events, '
    || printf('%.1f', CASE WHEN total_events > 0 THEN total_errors / total_events * 100 ELSE 0 END)
    || '% error rate, avg p95 latency ' || printf('%.0f', coalesce(avg_p95_latency_ms, 0))
    || 'ms, max latency ' || printf('%.0f', coalesce(max_latency_ms, 0)) || 'ms', chr(10) ORDER BY service)
    || chr(10) || chr(10) AS stats
  FROM asked_stats GROUP BY 1),
anomaly_lines AS (
  SELECT question_id, 'Detected anomalies (most recent first):' || chr(10) || string_agg(
    '- [' || upper(severity) || '] ' || service || ' at ' || {iso('bucket_ts')} || ': ' || anomaly_type
    || printf(', value=%.2f', metric_value) || printf(', baseline=%.2f', baseline_mean)
    || printf(', z_score=%.2f', z_score), chr(10) ORDER BY rank) AS found
  FROM asked_anomalies GROUP BY 1),
texts AS (
  SELECT q.question_id, q.query,
    'Time window: ' || {iso('window_start')} || ' to ' || {iso('window_end')} || chr(10) || chr(10)
    || coalesce(stats, '') || coalesce(found, 'No anomalies detected in this window.') AS context
  FROM asked q LEFT JOIN stat_lines USING (question_id) LEFT JOIN anomaly_lines USING (question_id))"""

STATS = """SELECT service, CAST(sum(event_count) AS BIGINT) AS total_events,
  CAST(sum(error_count) AS BIGINT) AS total_errors, avg(p95_latency_ms) AS avg_p95_latency_ms,
  max(max_latency_ms) AS max_latency_ms FROM rollup"""

COUNTER = f"""{LOGS}, counter AS (
  SELECT service, slot + INTERVAL 10 MINUTES AS ts,
    CAST(sum(n) OVER (PARTITION BY service, CAST(slot AS DATE) ORDER BY slot) AS DOUBLE) AS value
  FROM (SELECT service, time_bucket(INTERVAL '10 minutes', ts) AS slot, count(*) AS n
        FROM log_events GROUP BY 1, 2))"""
BOUNDS = [1, 10, 25, 50, 100, 200, 500]
LES = ", ".join(f"({b}::DOUBLE, '{b}')" for b in BOUNDS) + ", ('inf'::DOUBLE, '+Inf')"
HISTOGRAM = f"""{LOGS}, histogram AS (
  SELECT service, le, label, count(*) FILTER (WHERE latency_ms <= le) AS cumulative_count,
    {r('sum(latency_ms)')} AS total_sum, count(*) AS total_count
  FROM log_events, (VALUES {LES}) AS bounds(le, label) GROUP BY 1, 2, 3)"""
SEVERITY_COUNTER = f"""{ANOMALIES}, counter AS (
  SELECT service, anomaly_type, severity, ts,
    CAST(sum(n) OVER (PARTITION BY service, anomaly_type, severity ORDER BY ts) AS DOUBLE) AS value
  FROM (SELECT service, anomaly_type, severity, detected_at AS ts, count(*) AS n
        FROM anomalies GROUP BY 1, 2, 3, 4))"""
LATENCY_COUNTER = f"""{LOGS}, counter AS (
  SELECT service, le, label, hour + INTERVAL 1 HOUR AS ts,
    CAST(sum(n) OVER (PARTITION BY service, le ORDER BY hour) AS DOUBLE) AS value
  FROM (SELECT service, le, label, time_bucket(INTERVAL '1 hour', ts) AS hour,
          count(*) FILTER (WHERE latency_ms <= le) AS n
        FROM log_events, (VALUES {LES}) AS bounds(le, label) GROUP BY 1, 2, 3, 4))"""


def rates(series: str, hours: int) -> str:
    """Rates over windows of ``hours`` that end at every full hour, both edges included: plain as
    ``seen``, and stretched to the edges as ``rate``. An edge further away than 1.1 mean gaps
    between samples is approached by half a gap, and the start not beyond where the counter
    would have been zero."""
    return f"""windows AS (
  SELECT {series}, ts AS t, value, unnest(generate_series(
    date_trunc('hour', ts) + CASE WHEN ts = date_trunc('hour', ts) THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END,
    date_trunc('hour', ts) + INTERVAL {hours} HOUR, INTERVAL 1 HOUR)) AS ts FROM counter),
steps AS (
  SELECT *, lag(value) OVER (PARTITION BY {series}, ts ORDER BY t) AS prev FROM windows),
spans AS (
  SELECT {series}, ts, count(*) AS n, arg_min(value, t) AS v0,
    (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 AS sampled,
    (epoch_us(min(t)) - epoch_us(ts)) / 1e6 + {hours} * 3600 AS head,
    (epoch_us(ts) - epoch_us(max(t))) / 1e6 AS tail,
    sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) AS inc
  FROM steps GROUP BY {series}, ts HAVING count(*) >= 2),
edges AS (
  SELECT *, sampled / (n - 1) AS gap,
    CASE WHEN inc > 0 AND v0 >= 0 THEN sampled * v0 / inc ELSE 'inf'::DOUBLE END AS zero FROM spans),
rates AS (
  SELECT {series}, ts, inc / ({hours} * 3600) AS seen,
    inc * (sampled + least(CASE WHEN head < gap * 1.1 THEN head ELSE gap / 2 END, zero)
      + CASE WHEN tail < gap * 1.1 THEN tail ELSE gap / 2 END) / sampled / ({hours} * 3600) AS rate
  FROM edges)"""


def quantile(source: str, by: str, count: str, phi: float) -> str:
    """Histogram quantile per ``by`` from (by, le, count)."""
    return f"""SELECT {by}, min_by(CASE WHEN isinf(le) THEN pl
      WHEN c > pc THEN pl + (le - pl) * ({phi} * tot - pc) / (c - pc) ELSE pl END, le) AS value
  FROM (SELECT *, lag(c, 1, 0) OVER w AS pc, lag(le, 1, 0) OVER w AS pl,
          max(c) OVER (PARTITION BY {by}) AS tot
        FROM (SELECT {by}, le, CAST({count} AS DOUBLE) AS c FROM {source})
        WINDOW w AS (PARTITION BY {by} ORDER BY le))
  WHERE c >= {phi} * tot AND tot > 0 GROUP BY {by}"""


SERVICE_RATES = f"WITH {COUNTER}, {rates('service', 6)}"
SNAPSHOT = f"""{EWMA}, recent AS (
  SELECT * FROM rollup WHERE bucket >= TIMESTAMP '2024-01-05 18:30:00' - INTERVAL 60 HOURS
    AND bucket + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-05 18:30:00'),
current AS (SELECT service, max(bucket) AS bucket FROM recent GROUP BY 1),
past AS (
  SELECT r.service, count(*) AS history, avg(p95_latency_ms) AS p95_mean,
    coalesce(stddev_samp(p95_latency_ms), 0) AS p95_stddev, avg(max_latency_ms) AS max_mean,
    coalesce(stddev_samp(max_latency_ms), 0) AS max_stddev
  FROM recent r JOIN current c ON r.service = c.service AND r.bucket < c.bucket GROUP BY 1),
judged AS (
  SELECT r.*, p.* EXCLUDE service, e.rate, e.ewma
  FROM recent r JOIN current USING (service, bucket) JOIN past p USING (service)
  LEFT JOIN ewma e USING (service, bucket))
"""

NUMBER_TEXT = """CASE WHEN kind = 'error' THEN printf('-%.2f', latency_ms)
    WHEN kind = 'view' THEN printf('%.2f', latency_ms) WHEN kind IN ('click', 'signup') THEN NULL
    WHEN latency_ms > 50 THEN printf('%.2f', latency_ms) END"""
DEVIATION = "(latency_ms - 40) / 10"
AGE = """CASE WHEN s < 60 THEN CAST(s AS BIGINT) || 's' WHEN floor(s / 60) < 60
    THEN CAST(floor(s / 60) AS BIGINT) || 'm' ELSE CAST(floor(s / 3600) AS BIGINT) || 'h' END || ' ago'"""


def age(clock: str, ts: str) -> str:
    return AGE.replace("(s ", f"(floor((epoch_us({clock}) - epoch_us({ts})) / 1e6) ").replace(
        "WHEN s ", f"WHEN floor((epoch_us({clock}) - epoch_us({ts})) / 1e6) "
    )


FEED = f"""SELECT * FROM anomalies WHERE detected_at >= {AS_OF} - INTERVAL 168 HOURS
  ORDER BY {FEED_ORDER}"""
HEALTH = f"""health AS (SELECT *, CASE WHEN total_events > 0 THEN total_errors / total_events ELSE 0 END AS error_rate
  FROM ({STATS} WHERE bucket >= {AS_OF} - INTERVAL 168 HOURS GROUP BY service))"""
TRIM = f"trim({{}}, '{BLANKS}')"
REFRESHED = ("bucket >= TIMESTAMP '2024-01-20 11:00:00' AND bucket < TIMESTAMP '2024-01-29 10:00:00'")

ORACLES: dict[str, str] = {
    "src_log_events": f"WITH {LOGS} SELECT {COLUMNS} FROM log_events",
    "src_recent_buckets": f"WITH {ROLLUP} SELECT * FROM rollup WHERE bucket >= {AS_OF} - INTERVAL 60 HOURS",
    "sink_events_idempotent": f"WITH {REDELIVERED} SELECT * FROM deduped",
    "sink_anomalies": f"WITH RECURSIVE {ANOMALIES} SELECT * FROM anomalies",
    "sink_time_partitioned": f"""WITH {LOGS} SELECT event_id, ts, service, CAST(ts AS DATE) AS event_date
        FROM log_events WHERE ts >= {AS_OF} - INTERVAL 7 DAYS""",
    "sink_kafka_records": f"WITH {MESSAGES} SELECT service AS key, body AS value FROM messages",
    "src_kafka_logs": f"""WITH {LOGS} SELECT event_id, ts, service, endpoint, level, status_code, latency_ms,
        message, trace_id, anomaly_injected FROM log_events""",
    "st_delivery": f"""WITH {MESSAGES}, n AS (SELECT count(*) AS consumed,
          count(*) FILTER (WHERE form IN (1, 2, 5, 6)) AS rejected FROM messages)
        SELECT consumed, consumed - rejected AS accepted, rejected, consumed - rejected AS stored,
        rejected AS set_aside FROM n""",
    "obs_ingest_counts": f"""WITH {MESSAGES} SELECT coalesce({OUTCOME}, 'accepted') AS outcome,
        count(*) AS messages FROM messages GROUP BY 1""",
    "obs_pipeline_counts": f"""WITH RECURSIVE {ANOMALIES}, messages AS (
          SELECT service, number % 3 AS batch, number % 8 AS form FROM log_events),
        sizes AS (SELECT batch, count(*) FILTER (WHERE form IN (0, 3, 4, 7)) AS n FROM messages GROUP BY 1),
        written AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS batches FROM sizes)
        SELECT 'ingestion_events_consumed_total' AS metric, 'service=' || service AS series, count(*)::DOUBLE AS value
          FROM messages WHERE form NOT IN (1, 2) GROUP BY ALL
        UNION ALL SELECT 'ingestion_events_written_total', '', n FROM written
        UNION ALL SELECT 'ingestion_batch_size_sum', '', n FROM written
        UNION ALL SELECT 'ingestion_batch_size_count', '', batches FROM written
        UNION ALL SELECT 'ingestion_batch_flush_duration_seconds_count', '', batches FROM written
        UNION ALL SELECT 'ingestion_batch_size_bucket', 'le=' || label, count(*) FILTER (WHERE n <= le)::DOUBLE
          FROM sizes, (VALUES {LES}) AS bounds(le, label) GROUP BY ALL
        UNION ALL SELECT 'anomaly_detection_cycles_total', '', 1
        UNION ALL SELECT 'anomaly_buckets_fetched', '', (SELECT count(*) FROM rollup)::DOUBLE
        UNION ALL SELECT 'anomaly_detected_total',
          'anomaly_type=' || anomaly_type || ',service=' || service || ',severity=' || severity, count(*)::DOUBLE
          FROM anomalies GROUP BY ALL""",
    "proj_decode_json": f"""WITH {MESSAGES} SELECT number, event_id,
        CASE WHEN form = 5 THEN replace({iso('ts')}, 'T', ' ') ELSE {iso('ts')} END AS timestamp,
        service, endpoint, CASE WHEN form = 4 THEN '' ELSE level END AS level, status_code, latency_ms,
        message, CASE WHEN form = 6 THEN substr(trace_id, 10) ELSE trace_id END AS trace_id, anomaly_injected
        FROM messages WHERE form NOT IN (1, 2)""",
    "st_quarantine": f"""WITH {MESSAGES} SELECT CASE form WHEN 1 THEN body || [' tail', ',"a":1', ',"end":0',
          ',"message":{{}}', ']junk', ',{{"end":0}}]', '}}', ',{{"event_id":"a"}}'][number % 64 // 8 + 1]
        WHEN 2 THEN regexp_replace(body, '"status_code":([0-9]+)', '"status_code":"\\1"')
        WHEN 5 THEN regexp_replace(body, 'T(\\d\\d:\\d\\d:\\d\\d)', ' \\1')
        ELSE replace(body, '"trace_id":"00000000-', '"trace_id":"') END AS raw,
        {OUTCOME} AS reject_reason FROM messages WHERE form IN (1, 2, 5, 6)""",
    "st_ingest": f"""WITH {MESSAGES} SELECT event_id, ts, service, endpoint,
        CASE WHEN form = 4 THEN '' ELSE level END AS level, status_code, latency_ms, message, trace_id,
        anomaly_injected FROM messages WHERE form NOT IN (1, 2, 5, 6)""",
    "proj_parse_ts": f"WITH {TIMESTAMPS} SELECT * FROM parsed",
    "flt_valid_ts": f"WITH {TIMESTAMPS} SELECT * FROM parsed WHERE ts IS NOT NULL",
    "chk_constraints": f"""WITH {LOGS} SELECT event_id, CASE WHEN kind = 'view' THEN 'endpoint is null'
        WHEN kind = 'click' THEN 'trace_id is not a uuid' END AS reject_reason FROM log_events""",
    "chk_level_status": f"""WITH {LOGS} SELECT service, count(*) AS violations FROM (
        SELECT service, status_code, CASE WHEN latency_ms > 100 THEN 'ERROR' ELSE level END AS level FROM log_events)
        WHERE (status_code = 200 AND level = 'ERROR') OR (status_code >= 500 AND level <> 'ERROR') GROUP BY 1""",
    "proj_defaults": f"""WITH {LOGS} SELECT event_id, level = 'ERROR' AND anomaly_injected AS anomaly_injected,
        CASE WHEN level = 'WARN' THEN {AS_OF} ELSE ingested_at END AS ingested_at FROM log_events""",
    "flt_lookback": f"""WITH {LOGS} SELECT event_id, ts, service FROM log_events
        WHERE ts >= {AS_OF} - INTERVAL 72 HOURS""",
    "flt_optional_eq": f"""WITH {LOGS} SELECT w.wanted, count(*) AS n
        FROM (VALUES ('payments'), ('any')) w(wanted) JOIN log_events e
        ON w.wanted = 'any' OR e.service = w.wanted GROUP BY 1""",
    "flt_error_events": f"WITH {LOGS} SELECT event_id, ts, service FROM log_events WHERE level = 'ERROR'",
    "flt_injected_events": f"WITH {LOGS} SELECT event_id, ts, service FROM log_events WHERE anomaly_injected",
    "flt_service_range": f"""WITH {LOGS} SELECT event_id, ts, latency_ms FROM log_events
        WHERE service = 'checkout' AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'""",
    "flt_critical_anomalies": f"WITH RECURSIVE {ANOMALIES} SELECT * FROM anomalies WHERE severity = 'critical'",
    "join_anti_conflict": f"""WITH {REDELIVERED} SELECT event_id, ts, message FROM redelivered n
        WHERE NOT EXISTS (SELECT 1 FROM log_events o WHERE o.event_id = n.event_id AND o.ts = n.ts
          AND o.ts < TIMESTAMP '2024-01-16')""",
    "join_question_anomalies": f"WITH RECURSIVE {CONTEXTS} SELECT * FROM asked_anomalies",
    "join_question_stats": f"""WITH {ROLLUP}, {QUESTIONS}, {ASKED_STATS}
        SELECT * REPLACE ({r('avg_p95_latency_ms')} AS avg_p95_latency_ms) FROM asked_stats""",
    "agg_rollup_1min": f"WITH {ROLLUP} SELECT * FROM rollup",
    "agg_rollup_hot_groups": f"WITH {ROLLUP} SELECT * FROM rollup",
    "agg_count_filter": f"""WITH {LOGS} SELECT service, count(*) FILTER (WHERE level = 'ERROR') AS error_count
        FROM log_events GROUP BY 1""",
    "agg_percentile_cont": f"""WITH {LOGS} SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, service,
        {r('quantile_cont(latency_ms, 0.95)')} AS p95_latency_ms FROM log_events GROUP BY 1, 2""",
    "agg_avg_max_count": f"""WITH {LOGS} SELECT service, count(*) AS event_count,
        {r('avg(latency_ms)')} AS avg_latency_ms, max(latency_ms) AS max_latency_ms FROM log_events GROUP BY 1""",
    "agg_service_stats": f"""WITH {ROLLUP} SELECT * REPLACE ({r('avg_p95_latency_ms')} AS avg_p95_latency_ms)
        FROM ({STATS} GROUP BY service)""",
    "agg_mean_stddev": f"""WITH {ROLLUP} SELECT service, CAST(bucket AS DATE) AS day,
        {r('avg(p95_latency_ms)')} AS mean, {r('coalesce(stddev_samp(p95_latency_ms), 0)')} AS stddev
        FROM rollup GROUP BY 1, 2""",
    "agg_series": f"""WITH {ROLLUP} SELECT service, time_bucket(INTERVAL '7 days', bucket) AS chunk,
        CAST(row_number() OVER (PARTITION BY service, time_bucket(INTERVAL '7 days', bucket) ORDER BY bucket) - 1
          AS INTEGER) AS pos, bucket, event_count, error_count, p95_latency_ms, max_latency_ms FROM rollup""",
    "agg_dedupe_events": f"WITH {REDELIVERED} SELECT * FROM deduped",
    "agg_events_consumed": f"""WITH {MESSAGES} SELECT service, count(*) AS events_consumed FROM messages
        WHERE form NOT IN (1, 2) GROUP BY 1""",
    "agg_events_written": f"""WITH {REDELIVERED} SELECT (SELECT count(*) FROM redelivered) AS accepted,
        (SELECT count(*) FROM deduped) AS inserted""",
    "agg_anomaly_counts": f"""WITH RECURSIVE {ANOMALIES} SELECT service, anomaly_type, severity,
        count(*) AS anomalies FROM anomalies GROUP BY 1, 2, 3""",
    "agg_buckets_fetched": f"""WITH {ROLLUP} SELECT count(*) AS buckets_fetched FROM rollup
        WHERE bucket >= {AS_OF} - INTERVAL 60 HOURS""",
    "agg_histogram": f"""WITH {HISTOGRAM} SELECT service, label AS le, cumulative_count, total_sum, total_count
        FROM histogram""",
    "win_current_vs_history": f"""WITH {ROLLUP}, recent AS (SELECT * FROM rollup
          WHERE bucket >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 60 HOURS
            AND bucket + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-29 12:00:00'),
        last AS (SELECT service, max(bucket) AS bucket FROM recent GROUP BY 1)
        SELECT l.service, l.bucket, count(r.bucket) AS history,
          {r('coalesce(avg(p95_latency_ms), 0)')} AS p95_mean,
          {r('coalesce(stddev_samp(p95_latency_ms), 0)')} AS p95_stddev
        FROM last l LEFT JOIN recent r ON r.service = l.service AND r.bucket < l.bucket GROUP BY 1, 2""",
    "win_min_history": f"WITH {BASE} SELECT service, bucket, history, history >= 2 AS eligible FROM base",
    "win_baseline": f"""WITH {BASE} SELECT service, bucket, {r('p95_mean')} AS p95_mean,
        {r('p95_stddev')} AS p95_stddev, {r('max_mean')} AS max_mean, {r('max_stddev')} AS max_stddev FROM base""",
    "win_ewma": f"""WITH RECURSIVE {EWMA} SELECT service, bucket, {r('rate')} AS rate, {r('ewma')} AS ewma
        FROM ewma""",
    "det_latency_spike": f"WITH {BASE} SELECT * REPLACE ({ROUNDED}) FROM ({SPIKE})",
    "det_max_latency_outlier": f"WITH {BASE} SELECT * REPLACE ({ROUNDED}) FROM ({OUTLIER})",
    "det_error_burst": f"WITH RECURSIVE {EWMA} SELECT * REPLACE ({ROUNDED}) FROM ({_burst()})",
    "det_all": f"WITH RECURSIVE {ANOMALIES} SELECT * FROM anomalies",
    "det_snapshot": f"""WITH RECURSIVE {SNAPSHOT} SELECT * REPLACE ({ROUNDED}) FROM (
        {_latency('latency_spike', 'p95_latency_ms', 'p95', 'judged')} UNION ALL
        {_latency('max_latency_outlier', 'max_latency_ms', 'max', 'judged')} UNION ALL {_burst('judged')})""",
    "set_union_anomalies": f"""WITH RECURSIVE {FINDINGS} SELECT anomaly_type, count(*) AS findings
        FROM findings GROUP BY 1""",
    "top_anomaly_feed": f"WITH RECURSIVE {ANOMALIES} {FEED} LIMIT 50",
    "top_context_anomalies": f"""WITH RECURSIVE {ANOMALIES} SELECT * EXCLUDE (id, baseline_stddev) FROM anomalies
        WHERE detected_at >= {AS_OF} - INTERVAL 168 HOURS AND service = 'checkout' ORDER BY {FEED_ORDER} LIMIT 50""",
    "sort_series": f"WITH {ROLLUP} SELECT service, bucket, event_count FROM rollup ORDER BY 1, 2",
    "view_service_health": f"""WITH {ROLLUP}, {HEALTH} SELECT * REPLACE (
        {r('avg_p95_latency_ms')} AS avg_p95_latency_ms, {r('error_rate')} AS error_rate) FROM health""",
    "view_feed_lines": f"""WITH RECURSIVE {ANOMALIES} SELECT id, detected_at,
        {age(AS_OF, 'detected_at')} || ' ' || severity || ' ' || service || ' · ' || anomaly_type || ' · value='
        || {half_up('metric_value', 2)} || ' baseline=' || {half_up('baseline_mean', 2)} || ' z='
        || {half_up('z_score', 2)} AS line FROM ({FEED} LIMIT 30)""",
    "view_health_cards": f"""WITH {ROLLUP}, {HEALTH} SELECT service,
        CASE WHEN error_rate >= 0.3 THEN 'critical' WHEN error_rate >= 0.1 THEN 'warning' ELSE 'healthy' END AS status,
        format('{{:,}}', total_events) AS events, {half_up('(error_rate * 100)', 1)} || '%' AS error_rate_text,
        coalesce({half_up('avg_p95_latency_ms', 0)} || 'ms', '—') AS p95_latency,
        coalesce({half_up('max_latency_ms', 0)} || 'ms', '—') AS max_latency FROM health""",
    "fn_time_bucket": f"""WITH {LOGS} SELECT event_id, time_bucket(INTERVAL '1 minute', ts) AS minute,
        time_bucket(INTERVAL '7 minutes', ts) AS seven_minutes, time_bucket(INTERVAL '7 days', ts) AS week
        FROM log_events""",
    "fn_error_rate": f"""WITH {ROLLUP} SELECT service, bucket, CASE WHEN error_count > 0
        THEN {r('error_count / event_count')} ELSE 0 END AS rate FROM rollup""",
    "fn_error_pct": f"""WITH {ROLLUP} SELECT service, bucket, CASE WHEN error_count > 0
        THEN {r('error_count / event_count * 100')} ELSE 0 END AS rate FROM rollup""",
    "fn_burst_rate": f"""WITH {ROLLUP} SELECT service, bucket, CASE WHEN error_count > 0
        THEN {r('error_count / event_count')} END AS rate FROM rollup""",
    "fn_severity_directional": f"""WITH {LOGS} SELECT event_id, CASE WHEN kind = 'view' THEN NULL ELSE
        {GRADE.format(z=DEVIATION)} END AS severity FROM log_events""",
    "fn_severity_bidirectional": f"""WITH {LOGS} SELECT event_id, CASE WHEN kind = 'view' THEN NULL ELSE
        {GRADE.format(z=f'abs({DEVIATION})')} END AS severity FROM log_events""",
    "fn_ewma_z": f"""WITH {ROLLUP} SELECT service, bucket, {r('''(error_count / event_count - avg_latency_ms / 1000)
        / greatest(avg_latency_ms / 1000, 0.01)''')} AS z FROM rollup""",
    "fn_health_status": f"""WITH {ROLLUP} SELECT service, bucket, CASE
        WHEN error_count / event_count >= 0.3 THEN 'critical' WHEN error_count / event_count >= 0.1 THEN 'warning'
        ELSE 'healthy' END AS status FROM rollup""",
    "fn_level_from_status": f"WITH {LOGS} SELECT event_id, level FROM log_events",
    "fn_time_ago": f"""WITH {LOGS} SELECT event_id, {age(AS_OF, 'ts')} AS age,
        {age("(date_trunc('second', ingested_at) + to_seconds(status_code))", 'ts')} AS short_age FROM log_events""",
    "fn_positive_param": f"""WITH {LOGS} SELECT event_id, CASE WHEN CAST({NUMBER_TEXT} AS DOUBLE) > 0
        THEN CAST({NUMBER_TEXT} AS DOUBLE) ELSE 24 END AS parameter FROM log_events""",
    "fn_num_or_zero": f"""WITH {LOGS} SELECT event_id, coalesce(CAST({NUMBER_TEXT} AS DOUBLE), 0) AS number,
        CAST({NUMBER_TEXT} AS DOUBLE) AS nullable_number FROM log_events""",
    "fn_lookback_default": f"""WITH {QUESTIONS} SELECT question_id,
        CASE coalesce(lookback_hours, 0) WHEN 0 THEN 6 ELSE lookback_hours END AS hours FROM asked""",
    "fn_window_bounds": f"WITH {QUESTIONS} SELECT question_id, window_start, window_end FROM asked",
    "fn_fixed_format": f"""WITH {LOGS}, e AS (SELECT *, floor(latency_ms * 8) / 8 AS eighth FROM log_events)
        SELECT event_id, printf('%.2f', latency_ms / 3) AS two, printf('%.1f', latency_ms) AS one,
        printf('%.0f', 1 - latency_ms) AS none, printf('%.2f', eighth) AS tie_even,
        printf('%.2f', 10000000000000 + eighth) AS large, {half_up('eighth', 2)} AS tie_up, {half_up('eighth', 0)} AS tie_whole FROM e""",
    "fn_iso_ts": f"""WITH {LOGS} SELECT event_id, {iso('ts')} AS exact,
        {iso("date_trunc('second', ts)")} AS whole FROM log_events""",
    "fn_upper_severity": f"WITH RECURSIVE {ANOMALIES} SELECT id, upper(severity) AS severity FROM anomalies",
    "fn_normalize_question": f"""SELECT conv_id, turn, {TRIM.format('text')} AS question FROM conversations
        WHERE role <> 'system' AND {TRIM.format('text')} <> ''""",
    "ctx_retrieve": f"""WITH RECURSIVE {CONTEXTS} SELECT q.question_id, window_start, window_end,
        (SELECT count(*) FROM asked_anomalies a WHERE a.question_id = q.question_id) AS anomalies,
        (SELECT count(*) FROM asked_stats s WHERE s.question_id = q.question_id) AS services,
        CAST(coalesce((SELECT sum(total_events) FROM asked_stats s WHERE s.question_id = q.question_id), 0)
          AS BIGINT) AS events FROM asked q""",
    "ctx_is_empty": f"""WITH RECURSIVE {CONTEXTS} SELECT question_id,
        question_id NOT IN (SELECT question_id FROM asked_anomalies)
        AND question_id NOT IN (SELECT question_id FROM asked_stats) AS is_empty FROM asked""",
    "ctx_format": f"WITH RECURSIVE {TEXTS} SELECT question_id, context FROM texts",
    "ctx_prompt": f"""WITH RECURSIVE {TEXTS} SELECT question_id, context || chr(10) || chr(10) || 'Question: '
        || {TRIM.format('query')} || chr(10) || chr(10) || 'Answer:' AS prompt FROM texts
        WHERE {TRIM.format('query')} <> ''""",
    "st_dedupe": f"WITH {REDELIVERED} SELECT event_id, ts, service, message FROM deduped",
    "st_rollup": f"""WITH {ROLLUP} SELECT * FROM rollup
        WHERE bucket + INTERVAL 1 HOUR <= (SELECT max(ts) FROM log_events)""",
    "st_detect": f"""WITH RECURSIVE {ANOMALIES} SELECT * REPLACE ({AS_OF} AS detected_at) FROM anomalies""",
    "st_detect_late": f"""WITH {BASE}
        SELECT * REPLACE ({ROUNDED}) FROM ({SPIKE} UNION ALL {OUTLIER})""",
    "st_ewma_state": f"""WITH RECURSIVE {EWMA} SELECT service, bucket, {r('rate')} AS rate, {r('ewma')} AS ewma
        FROM ewma""",
    "st_ewma_late": f"""WITH RECURSIVE {EWMA} SELECT service, bucket, {r('rate')} AS rate, {r('ewma')} AS ewma
        FROM ewma""",
    "st_refresh_window": f"""WITH {ROLLUP} SELECT * REPLACE (CASE WHEN {REFRESHED} THEN error_count ELSE -1 END
        AS error_count) FROM rollup""",
    "st_backfill": f"WITH {ROLLUP} SELECT * FROM rollup WHERE bucket BETWEEN '2023-12-31' AND '2024-02-01'",
    "st_late_data": f"""WITH {LOGS} SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, service,
        count(*) AS late_events, max(epoch_us(ingested_at) - epoch_us(ts)) / 1e6 AS max_delay_s FROM log_events
        WHERE ingested_at - ts > INTERVAL 10 MINUTES GROUP BY 1, 2""",
    "ts_rate": f"{SERVICE_RATES} SELECT service, ts, {r('seen')} AS rate FROM rates",
    "ts_rate_extrapolated": f"{SERVICE_RATES} SELECT service, ts, {r('rate')} AS rate FROM rates",
    "ts_sum": f"{SERVICE_RATES} SELECT ts, {r('sum(rate)')} AS rate FROM rates GROUP BY 1",
    "ts_sum_by": f"""WITH RECURSIVE {SEVERITY_COUNTER}, {rates('service, anomaly_type, severity', 24)}
        SELECT ts, severity, {r('sum(rate)')} AS rate FROM rates GROUP BY 1, 2""",
    "ts_histogram_quantile": f"""WITH {HISTOGRAM}, a AS ({quantile('histogram', 'service', 'cumulative_count', 0.5)}),
        b AS ({quantile('histogram', 'service', 'cumulative_count', 0.95)})
        SELECT service, {r('a.value')} AS p50, {r('b.value')} AS p95 FROM a JOIN b USING (service)""",
    "ts_panels_sum": f"{SERVICE_RATES} SELECT ts, {r('sum(rate)')} AS value FROM rates GROUP BY 1",
    "ts_panels_rate": f"""{SERVICE_RATES} SELECT 'service=' || service AS series, ts, {r('rate')} AS value
        FROM rates""",
    "ts_panels_sum_by": f"""WITH RECURSIVE {SEVERITY_COUNTER}, {rates('service, anomaly_type, severity', 24)}
        SELECT ts, severity, {r('sum(rate)')} AS value FROM rates GROUP BY 1, 2""",
    "ts_panels_quantile": f"""WITH {LATENCY_COUNTER}, {rates('service, le', 24)}, summed AS (
          SELECT ts, le, sum(rate) AS rate FROM rates GROUP BY 1, 2)
        SELECT ts, {r('value')} AS value FROM ({quantile('summed', 'ts', 'rate', 0.95)})""",
}
ORACLES["ts_panels_all"] = " UNION ALL ".join(
    f"SELECT '{title}' AS title, '{legend}' AS legend, {series} AS series, ts, value FROM ({sql})"
    for title, legend, series, sql in (
        ("events ingested", "events written/s", "''", ORACLES["ts_panels_sum"]),
        ("questions", "questions/s", "series", ORACLES["ts_panels_rate"]),
        ("anomalies detected", "by severity", "'severity=' || severity", ORACLES["ts_panels_sum_by"]),
        ("batch size", "p95", "''", ORACLES["ts_panels_quantile"]),
        ("batch size", "p50", "''", ORACLES["ts_panels_quantile"].replace("0.95", "0.5")),
    )
)
