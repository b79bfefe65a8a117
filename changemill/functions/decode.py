"""Wire values of a change feed to Spark values, with built-in expressions only.

Feeds carry exact decimals as base64 of big-endian two's complement bytes, times as
microseconds, dates as days, binary as base64, and may hold zero dates from lenient sources;
what cannot be a value becomes null so that conformance can report it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def decimal_from_base64(text: Column, precision: int, scale: int) -> Column:
    """Two's complement of up to 16 bytes to DECIMAL(precision, scale); longer values are null.

    Eight bytes, enough for 18 digits, take the short way of one base conversion.
    """
    digits = F.hex(F.try_to_binary(text, F.lit("base64")))
    fill = F.when(F.left(digits, F.lit(1)) >= "8", "F").otherwise("0")
    size, result = F.length(digits), f"decimal({precision},{scale})"
    short = F.conv(F.lpad(digits, F.lit(16), fill), 16, -10).cast("decimal(20,0)")
    exact = F.lit(f"1E-{scale}").cast(f"decimal({scale + 1},{scale})")
    fits = (size <= 16) if scale <= 16 else F.lit(False)
    return (
        F.when((size > 0) & fits, (short * exact).try_cast(result))
        .when((size > 0) & (size <= 32), _wide_decimal(digits, scale).try_cast(result))
    )


def _wide_decimal(digits: Column, scale: int) -> Column:
    """Decimal text of up to 32 two's complement hex digits."""
    negative = F.left(digits, F.lit(1)) >= "8"
    wide = F.when(negative, F.lpad(digits, 32, "F")).otherwise(F.lpad(digits, 32, "0"))
    # -x is the bitwise complement plus one, so both halves are read as unsigned numbers.
    flipped = F.when(negative, F.translate(wide, "0123456789ABCDEF", "FEDCBA9876543210")).otherwise(wide)
    high, low = [F.conv(part, 16, 10).cast("decimal(20,0)") for part in (F.left(flipped, F.lit(16)), F.right(flipped, F.lit(16)))]
    two_64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    magnitude = F.try_add(F.try_multiply(high, two_64).try_cast("decimal(38,0)"), low)
    magnitude = F.try_add(magnitude, F.when(negative, F.lit(1)).otherwise(F.lit(0)).cast("decimal(1,0)")).cast("string")
    plain = F.lpad(magnitude, F.greatest(F.length(magnitude), F.lit(scale + 1)), F.lit("0"))
    return F.concat(
        F.when(negative, "-").otherwise(""),
        F.left(plain, F.length(plain) - scale), F.lit("."), F.right(plain, F.lit(scale)),
    )


def bytes_from_base64(text: Column) -> Column:
    return F.try_to_binary(text, F.lit("base64"))


def timestamp_from_micros(micros: Column) -> Column:
    """Zone-free timestamp, whatever the session time zone."""
    seconds = (micros.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return epoch() + F.make_dt_interval(secs=seconds)


def timestamp_from_millis(millis: Column) -> Column:
    return timestamp_from_micros(millis * F.lit(1000))


def utc_instant(zone_free: Column) -> Column:
    """Zone-free time taken as UTC: the instant that watermarks need, whatever the session zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch(), zone_free))


def zone_free(instant: Column) -> Column:
    """An instant as zone-free UTC time."""
    return timestamp_from_micros(F.unix_micros(instant))


def date_from_days(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def time_text(micros_of_day: Column) -> Column:
    """Microseconds of day as HH:mm:ss.SSSSSS."""
    seconds = F.floor(micros_of_day / F.lit(1000000)).cast("int")
    return F.format_string(
        "%02d:%02d:%02d.%06d",
        F.floor(seconds / 3600).cast("int"),
        (F.floor(seconds / 60) % 60).cast("int"),
        seconds % 60,
        micros_of_day % F.lit(1000000),
    )


def is_zero_date(text: Column) -> Column:
    return text.startswith("0000-00-00")


def timestamp_from_text(text: Column) -> Column:
    """Text to zone-free timestamp; zero dates and impossible dates become null."""
    return F.when(~is_zero_date(text), text.try_cast("timestamp_ntz"))
