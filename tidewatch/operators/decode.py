"""JSON messages to typed log events, with a reason for every row turned away."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import UUID_PATTERN, canonical_uuid
from ..functions.times import parse_rfc3339
from ..schemas import LOG_EVENT_JSON, LOG_EVENTS

ZERO = {"string": "", "int": 0, "double": 0.0, "boolean": False}

BAD_JSON = "malformed json"
BAD_TIMESTAMP = "bad timestamp"

TEXT_FIELDS = [f.name for f in LOG_EVENT_JSON.fields if isinstance(f.dataType, StringType)]
STRICT = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}
# What a text field reads as when its JSON value is a number, a boolean, an
# object or an array.
NOT_TEXT = r'^(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$|true$|false$|"?-?Infinity"?$|[{\[])'


def _frame(secret: str) -> StructType:
    """An array under a key that no sender knows: the message, then an end marker."""
    element = StructType([*LOG_EVENT_JSON.fields, StructField(secret, IntegerType())])
    return StructType([StructField(f"{secret}_array", ArrayType(element)), StructField("_corrupt", StringType())])


def _text_fields_hold_text(message: Column) -> Column:
    """Whether the JSON values of all text fields are texts, absent or null."""

    def check(parsed: Column) -> Column:
        kinds = [
            F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
            for name in TEXT_FIELDS
        ]
        good = F.lit(True)
        for kind in kinds:
            good = good & F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
        return parsed.isNotNull() & good

    return F.get(F.transform(F.array(F.try_parse_json(message)), check), F.lit(0))


def decode(messages: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed fields of every message plus ``decode_error`` (NULL when it decoded).

    Unknown keys are ignored, missing ones become zero values, a wrongly typed
    value turns the whole message away. Spark's reader is strict about all types
    but text, where it also takes numbers and objects; messages whose texts look
    like those are parsed again with types. ``keep`` names columns to carry along.
    """
    raw = F.col("raw")
    # Text after the message is a syntax error, or another element, or another member:
    # the array under the secret key is then not the message and the marker.
    secret = f"end_{uuid4().hex}"
    framed = F.concat(F.lit(f'{{"{secret}_array":['), raw, F.lit(f',{{"{secret}":0}}]}}'))
    texts = messages.select(*keep, F.col(value).cast("string").alias("raw"))
    # The one-element array is unnested so that the optimizer cannot merge the
    # steps and parse the text once per field.
    parsed = texts.select(
        *keep, "raw", F.explode(F.array(F.from_json(framed, _frame(secret), STRICT))).alias("f")
    )
    elements = F.col(f"f.{secret}_array")
    message = F.get(elements, 0)
    good = (
        F.col("f._corrupt").isNull()
        & (F.size(elements) == 2)
        & (F.get(elements, 1)[secret] == 0)
        & message.isNotNull()
        & (F.coalesce(F.abs(message["latency_ms"]), F.lit(0.0)) < F.lit(float("inf")))
    )
    doubtful = F.lit(False)
    for name in TEXT_FIELDS:
        doubtful = doubtful | F.coalesce(message[name].rlike(NOT_TEXT), F.lit(False))
    strict = F.when(doubtful, _text_fields_hold_text(raw)).otherwise(F.lit(True))
    fields = [
        F.coalesce(message[f.name], F.lit(ZERO[f.dataType.simpleString()])).alias(f.name)
        for f in LOG_EVENT_JSON.fields
    ]
    error = F.when(~F.coalesce(good & strict, F.lit(False)), BAD_JSON).alias("decode_error")
    return parsed.select(*keep, "raw", *fields, error)


def parse_timestamps(decoded: DataFrame) -> DataFrame:
    """Adds ``ts``; NULL where the timestamp text is not RFC 3339."""
    return decoded.withColumn("ts", parse_rfc3339(F.col("timestamp")))


def with_valid_ts(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("ts").isNotNull())


def _is_null(name: str) -> Column:
    return F.col(name).isNull()


def constraint_violation(columns: list[str]) -> Column:
    """First broken table constraint of a row as text, NULL for a good row."""
    checks = [F.when(_is_null(name), F.lit(f"{name} is null"))
              for name in LOG_EVENTS.fieldNames() if name in columns]
    checks += [F.when(~F.col(name).rlike(UUID_PATTERN), F.lit(f"{name} is not a uuid"))
               for name in ("event_id", "trace_id") if name in columns]
    return F.coalesce(*checks)


def apply_defaults(events: DataFrame, as_of) -> DataFrame:
    """Fills the two columns that have defaults: injected flag and arrival time."""
    arrived = F.lit(as_of).cast("timestamp")
    if "ingested_at" in events.columns:
        arrived = F.coalesce(F.col("ingested_at").cast("timestamp"), arrived)
    injected = F.lit(False)
    if "anomaly_injected" in events.columns:
        injected = F.coalesce(F.col("anomaly_injected"), F.lit(False))
    return events.withColumns({"anomaly_injected": injected, "ingested_at": arrived})


def classify(messages: DataFrame, as_of, value: str = "value",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Every message as a log event row plus ``reject_reason``.

    A message is turned away alone; it never takes its batch with it.
    """
    rows = apply_defaults(parse_timestamps(decode(messages, value, keep)), as_of)
    reason = F.coalesce(
        F.col("decode_error"),
        F.when(_is_null("ts"), F.lit(BAD_TIMESTAMP)),
        constraint_violation(rows.columns),
    )
    # The text is kept for rejected messages only, which keeps batches small.
    return rows.withColumn("reject_reason", reason).select(
        *keep, F.when(F.col("reject_reason").isNotNull(), F.col("raw")).alias("raw"),
        *LOG_EVENTS.fieldNames(), "reject_reason",
    )


def outcomes(classified: DataFrame) -> DataFrame:
    """(outcome, messages): how many were accepted, and turned away for each reason."""
    reason = F.coalesce("reject_reason", F.lit("accepted"))
    return classified.groupBy(reason.alias("outcome")).agg(F.count("*").alias("messages"))


def accepted(classified: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows that may enter the fact table, ids in canonical form."""
    ids = {name: canonical_uuid(F.col(name)) for name in ("event_id", "trace_id")}
    rows = classified.filter(F.col("reject_reason").isNull())
    return rows.withColumns(ids).select(*keep, *LOG_EVENTS.fieldNames())


def quarantined(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("reject_reason").isNotNull()).select(
        "raw", "reject_reason"
    )


def level_mismatches(events: DataFrame) -> DataFrame:
    """Rows whose level contradicts their status: a 200 logged as ERROR, or a
    5xx logged as anything else."""
    status, level = F.col("status_code"), F.col("level")
    return events.filter(
        ((status == 200) & (level == "ERROR")) | ((status >= 500) & (level != "ERROR"))
    )
