"""Masking of volatile tokens, one expression chain per log type."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.functions.text import lstrip, strip

# Patterns and placeholders that decide what is masked.
# (?U) makes \b, \d, \w and \s cover all of Unicode.
PATH = r"(?:/[^ \t\n\r\"']+)+"
IPV4 = r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
LONG_HEX = r"(?U)\b[0-9a-fA-F]{16,}\b"
HEX = r"(?U)\b0x[0-9a-fA-F]+\b"
NUMBER = r"(?U)\b\d+\b"
AUDIT_META = r"msg=audit\([^\)]*\):"
SYSLOG = (
    r"(?U)^((?:[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
    r"|(?:\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?))"
    r"\s+(\S+)\s+([^:]+):\s*(.*)$"
)
PROCESS_ID = r"(?U)^(.+?)\[\d+\]$"
DURATIONS = (r"(?U)\b\d+\.\d+s\b", r"(?U)\b\d+us\b", r"(?U)\b\d+ms\b")
QUERY_STRING = r"\?.*$"
USER_AT_HOST = r"'[^']+'@'[^']+'"
SQLSTATE = r"(?U)\bSQLSTATE\[[^\]]+\]\s*\[\d+\]"


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def mask_paths(text: Column) -> Column:
    return _chain(text, (PATH, "/PATH"))


def mask_ips(text: Column) -> Column:
    return _chain(text, (IPV4, "<IP>"))


def mask_hex(text: Column) -> Column:
    return _chain(text, (LONG_HEX, "<HEX>"), (HEX, "<HEX>"))


def mask_numbers(text: Column) -> Column:
    return _chain(text, (NUMBER, "<NUM>"))


def mask_generic(line: Column, *, aggressive: bool = False) -> Column:
    masked = mask_hex(mask_ips(mask_paths(strip(line))))
    return mask_numbers(masked) if aggressive else masked


def mask_audit(line: Column) -> Column:
    """Audit records carry so many counters that numbers are masked in every mode."""
    masked = _chain(strip(line), (AUDIT_META, r"msg=audit(<AUDIT_META>):"))
    return mask_numbers(mask_ips(mask_hex(mask_paths(masked))))


def parses_as_syslog(line: Column) -> Column:
    return strip(line).rlike(SYSLOG)


def mask_syslog(line: Column, *, aggressive: bool = False) -> Column:
    """Rebuild `<TS> <HOST> process: message`; other shapes get the generic mask."""
    bare = strip(line)
    process = F.regexp_extract(bare, SYSLOG, 3)
    process = F.when(
        strip(process).rlike(PROCESS_ID),
        F.concat(F.regexp_extract(strip(process), PROCESS_ID, 1), F.lit("[<PID>]")),
    ).otherwise(process)
    message = mask_hex(mask_ips(mask_paths(F.regexp_extract(bare, SYSLOG, 4))))
    message = _chain(message, *[(d, "<DUR>") for d in DURATIONS])
    if aggressive:
        message = mask_numbers(message)
    rebuilt = F.concat(F.lit("<TS> <HOST> "), process, F.lit(": "), message)
    return F.when(bare.rlike(SYSLOG), rebuilt).otherwise(
        mask_generic(line, aggressive=aggressive)
    )


def _member(record: Column, path: str) -> Column:
    """A member as text; JSON null reads 'None', a missing member is NULL."""
    value = F.try_variant_get(record, path, "variant")
    return F.when(F.is_variant_null(value), F.lit("None")).otherwise(
        F.try_variant_get(record, path, "string")
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` one time for all the places `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _compact(record: Column, aggressive: bool) -> Column:
    """The compact line of a parsed record, NULL when it is no JSON object."""

    def member(name: str, default: str) -> Column:
        return F.coalesce(_member(record, f"$.{name}"), F.lit(default))

    url = F.regexp_replace(member("url", "<URL>"), QUERY_STRING, "?<QS>")
    message = mask_hex(mask_paths(mask_ips(member("message", ""))))
    message = _chain(
        message,
        (USER_AT_HOST, "'<USER>'@'<HOST>'"),
        (SQLSTATE, "SQLSTATE[<STATE>][<CODE>]"),
    )
    failure = F.try_variant_get(record, "$.exception", "variant")
    failed = F.coalesce(F.schema_of_variant(failure).startswith("OBJECT"), F.lit(False))
    code = F.try_variant_get(record, "$.exception.Code", "string")
    code = F.lit("<CODE>") if aggressive else F.coalesce(code, F.lit("<CODE>"))
    exception = F.when(
        failed,
        F.concat(member("exception.Exception", "<EXC>"), F.lit("("), code, F.lit(")")),
    ).otherwise(F.lit("<NOEXC>"))
    composed = F.concat(
        F.lit("nextcloud app="), member("app", "<APP>"),
        F.lit(" level="), member("level", "<LEVEL>"),
        F.lit(" "), member("method", "<METHOD>"),
        F.lit(" "), url,
        F.lit(" exc="), exception,
        F.lit(" msg="), message,
    )
    if aggressive:
        composed = mask_numbers(composed)
    return F.when(F.schema_of_variant(record).startswith("OBJECT"), composed)


def mask_json_record(line: Column, *, aggressive: bool = False) -> Column:
    """One compact line from an application's JSON record; other text: generic mask."""
    parsed = F.try_parse_json(strip(line))
    compact = _once(parsed, lambda record: _compact(record, aggressive))
    return F.coalesce(compact, mask_generic(line, aggressive=aggressive))


def detect_line_type(line: Column) -> Column:
    """Log type from the content of one line."""
    head = lstrip(line)
    return (
        F.when(head.startswith("type=") & head.contains("msg=audit("), "audit")
        .when(
            head.startswith("{") & head.contains('"reqId"') & head.contains('"app"'),
            "nextcloud",
        )
        .when(head.rlike(SYSLOG), "syslog")
        .otherwise("generic")
    )


MODES = ("raw", "soft", "aggressive", "template")


def mask_line(line: Column, mode: str, log_type: Column | None = None) -> Column:
    """Mask by log type; `template` masks as `soft`, without a type it is detected."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    if mode == "raw":
        return line
    hard = mode == "aggressive"
    kind = detect_line_type(line) if log_type is None else log_type
    return (
        F.when(kind == "audit", mask_audit(line))
        .when(kind == "nextcloud", mask_json_record(line, aggressive=hard))
        .when(kind == "syslog", mask_syslog(line, aggressive=hard))
        .otherwise(mask_generic(line, aggressive=hard))
    )


def with_type_prefix(text: Column, log_type: Column) -> Column:
    return F.concat(F.lit("["), log_type, F.lit("] "), text)
