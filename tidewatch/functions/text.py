"""Text cleaning, lenient numbers and fixed-point formatting as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that a browser's String.trim removes.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

CANONICAL_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
UUID_PATTERN = (
    "^([0-9a-fA-F]{32}"
    "|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"
)

# Java also parses type suffixes such as 1.5f; those are not numbers here.
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|Infinity)$"

# Splits a double into two halves whose products with a small integer are exact.
SPLITTER = 134_217_729.0
# Beyond this the whole part is formatted by itself, as the scaled value leaves the exact integers.
FORMAT_LIMIT = 1e13
TWO_62, TWO_63, TWO_125 = 2.0**62, 2.0**63, 2.0**125


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def normalize_question(text: Column) -> Column:
    """Trimmed question, NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def number_or_null(text: Column) -> Column:
    """Decimal number in ``text``, blanks around it allowed."""
    digits = strip(text.cast("string"))
    return F.when(digits.rlike(NUMBER_PATTERN), digits.try_cast("double"))


def number_or_zero(text: Column) -> Column:
    """Number in ``text``; anything that is not a number counts as zero."""
    return F.coalesce(F.nanvl(number_or_null(text), F.lit(0.0)), F.lit(0.0))


def positive_or(text: Column, fallback: float) -> Column:
    """Finite positive number in ``text``, otherwise the fallback."""
    number = number_or_null(text)
    usable = (number > 0) & ~F.isnan(number) & (number < F.lit(float("inf")))
    return F.when(usable, number).otherwise(F.lit(float(fallback)))


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated form, NULL when the text is not a UUID.

    Texts that have that form already, the usual case, are passed on as they are.
    """
    digits = F.lower(F.replace(text, F.lit("-"), F.lit("")))
    parts = [F.substring(digits, start, size) for start, size in
             ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(text.rlike(CANONICAL_UUID), text).when(
        text.rlike(UUID_PATTERN), F.concat_ws("-", *parts)
    )


def _steps(size: Column, scale: float, ties: str, whole: Column | None = None) -> Column:
    """``size`` in steps of 1/scale, rounded on its exact binary value. ``whole`` is what was
    taken off before, which makes a tie odd or even where there are no decimals."""
    scaled = size * scale
    high = size * SPLITTER - (size * SPLITTER - size)
    error = (high * scale - scaled) + (size - high) * scale
    below = F.floor(scaled)
    excess = scaled - below - 0.5
    odd = F.pmod(below if whole is None or scale > 1 else whole, F.lit(2)) == 1
    tie_up = F.lit(True) if ties == "up" else odd
    up = (excess > 0) | ((excess == 0) & ((error > 0) | ((error == 0) & tie_up)))
    return below + up.cast("int")


def _large(size: Column, digits: int, ties: str) -> Column:
    """Text of a size from FORMAT_LIMIT up to 2^125, its whole part kept apart."""
    def split(v: Column) -> Column:
        whole = F.floor(v)
        return F.struct(whole.alias("whole"), (v - whole.cast("double")).alias("part"))

    def shown(v: Column) -> Column:
        steps = _steps(v["part"], float(10**digits), ties, v["whole"])
        carry = (steps >= 10**digits).cast("int")
        units = (v["whole"] + carry).cast("string")
        decimals = F.lpad((steps - carry * 10**digits).cast("string"), digits, "0")
        return F.concat(units, F.lit("."), decimals) if digits else units

    def halves(v: Column) -> Column:
        top = F.floor(v / TWO_62)
        bottom = (v - top.cast("double") * TWO_62).cast("long").cast("decimal(19,0)")
        high = (top.cast("decimal(19,0)") * F.lit(int(TWO_62)).cast("decimal(19,0)")).cast("decimal(38,0)")
        return F.concat((high + bottom).cast("string"), F.lit("." + "0" * digits if digits else ""))

    def bound(v: Column, use) -> Column:
        return F.get(F.transform(F.array(v), use), F.lit(0))

    return F.when(size < TWO_63, bound(bound(size, split), shown)).otherwise(bound(size, halves))


def fixed_point(value: Column, digits: int, ties: str = "even") -> Column:
    """``value`` with ``digits`` decimals, rounded on its exact binary value.

    Java's own formatter rounds the shortest decimal text instead, which turns
    1.005 (stored slightly below) into 1.01. Here a scaled value that lands on
    a half is decided by the rounding error of the scaling, and only a true
    tie falls to ``ties``: ``even`` or ``up`` (away from zero). Holds up to 2^125,
    where Java's formatter takes over with 17 digits and zeros. NULL stays NULL.
    """
    size = F.abs(value)
    pattern = f"%.{digits}f"
    rounded = _steps(size, float(10**digits), ties) / float(10**digits)
    text = (
        F.when(size < FORMAT_LIMIT, F.format_string(pattern, rounded))
        .when(size < TWO_125, _large(size, digits, ties))
        .otherwise(F.format_string(pattern, size))
    )
    return F.when(value < 0, F.concat(F.lit("-"), text)).when(value.isNotNull(), text)


def grouped_integer(value: Column) -> Column:
    """Integer with thousands separators."""
    return F.format_number(value.cast("long"), 0)
