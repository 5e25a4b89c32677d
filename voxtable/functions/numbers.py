"""Scalar functions for signals and lenient values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_round(x: Column, digits: int) -> Column:
    """x rounded as DuckDB does it: scaled as a double, to the nearest whole number, halves away from 0, and scaled back; 0 keeps its
    sign. Spark's own rounding goes by the decimal digits, so that 64.3109375 * 1e6 = 64310937.49999999 would go up."""
    scale = F.lit(10.0**digits)
    scaled = F.abs(x) * scale
    return F.when(scaled < float("inf"), F.signum(x) * F.round(scaled) / scale).otherwise(x)


def r6(c: Column | str) -> Column:
    return scaled_round(F.col(c) if isinstance(c, str) else c, 6)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def calibrated(p: Column, a: float = 5.0, b: float = 0.5) -> Column:
    """Logistic calibration sigmoid(a (p - b)), the exponent within 20 of 0."""
    return sigmoid(clamp(a * (p - F.lit(b)), -20.0, 20.0))


def or_default(x: Column, default: float) -> Column:
    """Missing and 0 are the default."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))


def to_int16(x: Column) -> Column:
    """Truncated, not rounded."""
    return (clamp(x, -1.0, 1.0) * 32767).cast("smallint")


def _kind_and_text(json: Column, path: str) -> tuple[Column, Column]:
    """The JSON type of a value and the value as text, both null where there is none."""
    found = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.schema_of_variant(found), F.get_json_object(json, path)


def lenient_double(json: Column, path: str) -> Column:
    """A JSON value as a double: numbers, strings that hold one, true and false as 1 and 0, else null."""
    kind, raw = _kind_and_text(json, path)
    numeric = raw.rlike(r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$")
    written = F.when(numeric, F.trim(raw).try_cast("double"))
    return F.when(kind == "BOOLEAN", (raw == "true").cast("double")).when(kind == "STRING", written).otherwise(raw.try_cast("double"))


def lenient_int(json: Column, path: str) -> Column:
    """As an int: whole numbers, 3.0 too, and strings of digits; booleans, fractions and other strings are null."""
    kind, raw = _kind_and_text(json, path)
    number = raw.try_cast("double")
    digits = F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("bigint"))
    whole = F.when(number == F.floor(number), raw.try_cast("decimal(38,10)").try_cast("bigint"))
    return F.when(kind == "BOOLEAN", None).when(kind == "STRING", digits).otherwise(F.coalesce(digits, whole))


def lenient_boolean(json: Column, path: str) -> Column:
    """As a boolean: true and false, the numbers 1 and 0, and the usual words for them."""
    kind, raw = _kind_and_text(json, path)
    word = F.lower(F.trim(raw))
    number = raw.try_cast("double")
    written = F.when(word.isin("true", "t", "1", "yes", "y"), True).when(word.isin("false", "f", "0", "no", "n"), False)
    return F.when(kind.isin("STRING", "BOOLEAN"), written).when(number == 1, True).when(number == 0, False)


def first_key(json: Column, *keys: str) -> Column:
    """The first key that has a value."""
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys])
