"""Text normalisation as Column expressions (JVM side, inside codegen where Spark allows it)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it, plus the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"


def nfc(c: Column) -> Column:
    """Unicode NFC by the ICU library that Spark ships; plain ASCII skips the call. Null stays null."""
    return (
        F.when(c.rlike(r"[^\x00-\x7f]"), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False)))
        .otherwise(c)
    )


def letters_digits(c: Column) -> Column:
    """NFC, lower case, nothing but letters and digits. Null stays null, '' stays ''."""
    return F.regexp_replace(F.lower(nfc(c)), r"[^\p{L}\p{N}]+", "")


def squeeze(c: Column) -> Column:
    """Lower case, every run of white space one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), f"(?U){SPACE}+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def iso_micros(c: Column) -> Column:
    """Microseconds since 1970 UTC of ISO-8601 text; without zone it is UTC, a date is its midnight.

    Null for null and for text that is no time. Independent of the session's time zone.
    """
    s = strip(c)
    zoned = (
        F.when(s.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(s, F.lit("T00:00:00Z")))
        .when(s.rlike(r"(?i)(Z|[+-]\d\d:?\d\d)$"), s)
        .otherwise(F.concat(s, F.lit("Z")))
    )
    return F.unix_micros(zoned.try_cast("timestamp"))


def utc_text(micros: Column, pattern: str) -> Column:
    """Microseconds as text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone()), pattern)


def ntz_micros(c: Column) -> Column:
    """Microseconds of a timestamp column; one without zone means UTC."""
    return F.unix_micros(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).cast("timestamp"))
