"""Key=value fields of audit records."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.functions.text import strip

# The keys each record type is read for.
PRESETS = {
    "execve": ("EXECVE", ("a0", "a1", "a2", "a3", "a4", "a5", "argc")),
    "path": ("PATH", ("name", "nametype")),
    "syscall": (
        "SYSCALL",
        ("syscall", "success", "exit", "comm", "exe", "auid", "uid", "tty", "key"),
    ),
    "sockaddr": ("SOCKADDR", ("saddr",)),
}


def preset(mode: str) -> tuple[str, tuple[str, ...]]:
    """Line pattern and keys of a record-type preset."""
    if mode not in PRESETS:
        raise ValueError(f"unknown record preset {mode!r}; known: {sorted(PRESETS)}")
    record, keys = PRESETS[mode]
    return rf"^type={record}\s+msg=audit\(", keys


def field(line: Column, key: str, *, ignore_case: bool = False, whole: bool = False) -> Column:
    """Raw value of the first `key=value`, NULL when absent.

    `whole` asks that a value ends at white space or at the end of the line.
    """
    flags = "(?iU)" if ignore_case else "(?U)"
    ending = r"(?=\s|$)" if whole else ""
    pattern = rf"{flags}\b{re.escape(key)}=(\"[^\"]*\"|\S+){ending}"
    value = F.regexp_extract(line, pattern, 1)
    return F.when(value != "", value)


def unquote(value: Column, quotes: str = "\"'") -> Column:
    """Drop one matching pair of outer quotes."""
    bare = strip(value)
    first, last = F.substring(bare, 1, 1), F.substring(bare, -1, 1)
    quoted = (F.length(bare) >= 2) & (first == last) & first.isin(*quotes)
    return F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def context_field(line: Column, key: str) -> Column:
    """A field with its double quotes removed."""
    return unquote(field(line, key), '"')


def field_columns(
    line: Column,
    keys: Sequence[str],
    *,
    ignore_case: bool = False,
    strip_quotes: bool = True,
) -> dict[str, Column]:
    """Value of each requested key, NULL when absent."""
    raw = {k: field(line, k, ignore_case=ignore_case, whole=True) for k in keys}
    return {k: unquote(v) for k, v in raw.items()} if strip_quotes else raw


def field_map(line: Column, keys: Sequence[str], **options: bool) -> Column:
    """Map of the requested keys that are present; absent keys have no entry."""
    pairs = [
        F.struct(F.lit(k).alias("key"), v.alias("value"))
        for k, v in field_columns(line, keys, **options).items()
    ]
    present = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
    return F.map_from_entries(present)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
