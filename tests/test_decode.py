from __future__ import annotations

import json

import pytest
from helpers import uuid
from pyspark.sql import functions as F

from tidewatch.operators import decode
from tidewatch.schemas import LOG_EVENTS

FULL = {
    "event_id": "abc-123", "timestamp": "2026-07-20T16:30:11.979003225Z", "service": "checkout",
    "endpoint": "/cart/checkout", "level": "ERROR", "status_code": 500, "latency_ms": 342.5,
    "message": "internal error", "trace_id": "trace-xyz", "anomaly_injected": True,
}
GOOD = FULL | {"event_id": uuid(1), "trace_id": uuid(2)}


def messages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_round_trip(spark):
    row = decode.decode(messages(spark, json.dumps(FULL))).first().asDict()
    assert row.pop("decode_error") is None
    row.pop("raw")
    assert row == FULL


def test_missing_fields_and_nulls_become_zero_values(spark):
    rows = decode.decode(messages(
        spark, '{"event_id":"a","status_code":200,"latency_ms":1.5}',
        '{"event_id":"a","status_code":200,"latency_ms":1.5,"level":null,"x":[1,{"y":2}]}',
    )).collect()
    for row in rows:
        assert row.decode_error is None
        assert (row.event_id, row.status_code, row.latency_ms) == ("a", 200, 1.5)
        assert (row.timestamp, row.level, row.trace_id, row.anomaly_injected) == ("", "", "", False)


@pytest.mark.parametrize(
    "text",
    ["not json", "[1]", '[{"event_id":"x"}]', "{'event_id':'q'}", '{"status_code":"500"}',
     '{"status_code":200.0}', '{"status_code":1e2}', '{"latency_ms":"NaN"}', '{"latency_ms":NaN}',
     '{"event_id":5}', '{"event_id":"t"} x', "null", "", '{"a":1},{"b":2}', '{"a":1}],[{"b":2}',
     '{"anomaly_injected":"true"}', '{"service":{"a":1}}', '{"status_code":99999999999}', "{", "7",
     '"text"', None,
     '{"event_id":"a"},"a":1', '{"event_id":"a"},"end":0', '{"x":1},"message":{"event_id":"a"}',
     '{"event_id":"a"}]junk', '{"event_id":"a"},{"end":0}]', '{"event_id":"a"},{"end":0}],"b":[1',
     '{"event_id":"a"},', '{"event_id":"a"}]', '{"event_id":"a"}]}', '{"message":1.0E400}', '{"message":-1.0E400}'],
)
def test_quarantined_messages(spark, text):
    assert decode.decode(messages(spark, text)).first().decode_error == decode.BAD_JSON


def test_integer_latency_is_a_number(spark):
    row = decode.decode(messages(spark, '{"latency_ms":3}')).first()
    assert (row.decode_error, row.latency_ms) == (None, 3.0)


def test_one_bad_row_does_not_take_the_batch(spark):
    texts = [
        json.dumps(GOOD),
        json.dumps(GOOD | {"timestamp": "not-a-timestamp"}),
        json.dumps(GOOD | {"timestamp": ""}),
        json.dumps(GOOD | {"trace_id": "trace-xyz"}),
        "broken",
    ]
    rows = decode.classify(messages(spark, *texts), "2026-07-20 17:00:00")
    reasons = [r.reject_reason for r in rows.collect()]
    assert reasons == [None, decode.BAD_TIMESTAMP, decode.BAD_TIMESTAMP,
                       "trace_id is not a uuid", decode.BAD_JSON]
    kept = decode.accepted(rows)
    assert kept.columns == LOG_EVENTS.fieldNames()
    row = kept.first()
    assert kept.count() == 1
    assert row.event_id == GOOD["event_id"]
    assert str(kept.select(F.col("ts").cast("string")).first()[0]) == "2026-07-20 16:30:11.979003"
    assert decode.quarantined(rows).count() == 4


def test_batch_of_only_bad_timestamps_keeps_nothing(spark):
    rows = decode.parse_timestamps(decode.decode(messages(
        spark, json.dumps(GOOD | {"timestamp": "not-a-timestamp"}),
        json.dumps(GOOD | {"timestamp": ""}),
    )))
    assert decode.with_valid_ts(rows).isEmpty()


def test_level_rule(spark):
    rows = spark.createDataFrame(
        [(200, "ERROR"), (200, "WARN"), (503, "INFO"), (503, "ERROR"), (401, "ERROR")],
        "status_code int, level string",
    )
    bad = decode.level_mismatches(rows).collect()
    assert {tuple(r) for r in bad} == {(200, "ERROR"), (503, "INFO")}


def test_text_is_parsed_once(spark):
    """The parsed message must not be copied into every field's expression."""
    plan = decode.decode(messages(spark, "{}"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_last_of_repeated_keys_counts(spark):
    row = decode.decode(messages(spark, '{"level":"a","level":"b"}')).first()
    assert (row.decode_error, row.level) == (None, "b")


def test_suspicious_text_that_is_fine(spark):
    for text in ('{"message":"\\"level\\": 5","extra":{"level":5}}', '{"message":"\\u0041"}'):
        assert decode.decode(messages(spark, text)).first().decode_error is None
    assert decode.decode(messages(spark, '{"\\u006cevel":5}')).first().decode_error == decode.BAD_JSON


def test_too_large_number(spark):
    assert decode.decode(messages(spark, '{"latency_ms":1e400}')).first().decode_error == decode.BAD_JSON
