"""Event times found in log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.functions.text import strip

# Where each log type keeps its time.
JSON_TIME = r'"time"\s*:\s*"([^"]+)"'
AUDIT_STAMP = r"audit\((\d+(?:\.\d+)?):(\d+)\)"
ISO = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?"
    r"(?:Z|[+-]\d{2}:\d{2})?)?$"
)


def iso_timestamp(text: Column) -> Column:
    """Timestamp of ISO text, NULL for anything else; naive text is UTC."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def json_timestamp(line: Column) -> Column:
    return iso_timestamp(F.regexp_extract(line, JSON_TIME, 1))


def audit_epoch(line: Column) -> Column:
    text = F.regexp_extract(line, AUDIT_STAMP, 1)
    return F.when(text != "", text.try_cast("double"))


def audit_serial(line: Column) -> Column:
    text = F.regexp_extract(line, AUDIT_STAMP, 2)
    return F.when(text != "", text.try_cast("long"))


def leading_timestamp(line: Column) -> Column:
    """Time in the first blank-separated token; classic `Mon d` stamps are skipped."""
    return iso_timestamp(F.split_part(strip(line), F.lit(" "), F.lit(1)))


def line_timestamp(line: Column, log_type: Column) -> Column:
    """Time of a line by log type; audit epochs are read to the microsecond."""
    audit = F.timestamp_micros(F.round(audit_epoch(line) * 1_000_000).cast("long"))
    return (
        F.when(log_type == "audit", audit)
        .when(log_type == "nextcloud", json_timestamp(line))
        .otherwise(leading_timestamp(line))
    )
