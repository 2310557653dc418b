"""Scans, catalogs, masks, fields and timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import fields, masking, text, timestamps
from loomtrace.queries.base import query
from loomtrace.session import scratch_path
from loomtrace.sources import catalog, lines
from loomtrace.sources.testviews import (
    V_EVENTS,
    V_LINES,
    V_LOGS,
    table,
    v_events,
    v_lines,
    v_logs,
)

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TRIM = rf"^{WS}+|{WS}+$"
IP = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"
PATH = r"""(?:/[^ \t\n\r"'']+)+"""


def sub(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{new}', 'g')"
    return expr


def q_strip(expr: str) -> str:
    return sub(expr, (TRIM, ""))


def q_paths(expr: str) -> str:
    return sub(expr, (PATH, "/PATH"))


def q_ips(expr: str) -> str:
    return sub(expr, (IP, "<IP>"))


def q_hex(expr: str) -> str:
    return sub(expr, (r"\b[0-9a-fA-F]{16,}\b", "<HEX>"), (r"\b0x[0-9a-fA-F]+\b", "<HEX>"))


def q_num(expr: str) -> str:
    return sub(expr, (r"\b[0-9]+\b", "<NUM>"))


def q_generic(expr: str, hard: bool = False) -> str:
    masked = q_hex(q_ips(q_paths(q_strip(expr))))
    return q_num(masked) if hard else masked


def q_audit(expr: str) -> str:
    meta = sub(q_strip(expr), (r"msg=audit\([^\)]*\):", "msg=audit(<AUDIT_META>):"))
    return q_num(q_ips(q_hex(q_paths(meta))))


SYSLOG = (
    r"^((?:[A-Z][a-z]{2}\s+[0-9]{1,2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2})"
    r"|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?))"
    r"\s+(\S+)\s+([^:]+):\s*(.*)$"
)


def q_syslog(expr: str, hard: bool = False) -> str:
    bare = q_strip(expr)
    process = sub(f"regexp_extract({bare}, '{SYSLOG}', 3)", (r"^\s*(.+?)\[[0-9]+\]\s*$", r"\1[<PID>]"))
    message = q_hex(q_ips(q_paths(f"regexp_extract({bare}, '{SYSLOG}', 4)")))
    message = sub(
        message, (r"\b[0-9]+\.[0-9]+s\b", "<DUR>"), (r"\b[0-9]+us\b", "<DUR>"), (r"\b[0-9]+ms\b", "<DUR>")
    )
    if hard:
        message = q_num(message)
    return (
        f"CASE WHEN regexp_matches({bare}, '{SYSLOG}') THEN '<TS> <HOST> ' || {process} || ': ' || {message} "
        f"ELSE {q_generic(expr, hard)} END"
    )


def q_json(expr: str, hard: bool = False) -> str:
    bare = q_strip(expr)

    def member(path: str, default: str) -> str:
        return (
            f"CASE WHEN json_type(json_extract(j, '$.{path}')) = 'NULL' THEN 'None' "
            f"ELSE coalesce(json_extract_string(j, '$.{path}'), '{default}') END"
        )

    url = f"regexp_replace({member('url', '<URL>')}, '\\?.*$', '?<QS>')"
    message = q_hex(q_paths(q_ips(member("message", ""))))
    message = f"regexp_replace({message}, '''[^'']+''@''[^'']+''', '''<USER>''@''<HOST>''', 'g')"
    message = sub(message, (r"\bSQLSTATE\[[^\]]+\]\s*\[[0-9]+\]", "SQLSTATE[<STATE>][<CODE>]"))
    code = "'<CODE>'" if hard else "coalesce(json_extract_string(j, '$.exception.Code'), '<CODE>')"
    exc = (
        f"CASE WHEN json_type(json_extract(j, '$.exception')) = 'OBJECT' THEN "
        f"{member('exception.Exception', '<EXC>')} || '(' || {code} || ')' ELSE '<NOEXC>' END"
    )
    body = (
        f"'nextcloud app=' || {member('app', '<APP>')} || ' level=' || {member('level', '<LEVEL>')} || ' ' || "
        f"{member('method', '<METHOD>')} || ' ' || {url} || ' exc=' || {exc} || ' msg=' || {message}"
    )
    if hard:
        body = q_num(f"({body})")
    return (
        f"(SELECT CASE WHEN json_type(j) = 'OBJECT' THEN {body} ELSE {q_generic(expr, hard)} END "
        f"FROM (SELECT CASE WHEN json_valid({bare}) THEN CAST({bare} AS JSON) END AS j))"
    )


def q_mask(expr: str, kind: str, hard: bool = False) -> str:
    return (
        f"CASE WHEN {kind} = 'audit' THEN {q_audit(expr)} WHEN {kind} = 'syslog' THEN {q_syslog(expr, hard)} "
        f"WHEN {kind} = 'nextcloud' THEN {q_json(expr, hard)} ELSE {q_generic(expr, hard)} END"
    )


# ---- catalogs ----


@query("s1_discover_actors", f"WITH {V_EVENTS} SELECT DISTINCT actor FROM v_events")
def discover_actors(spark, sf):
    return catalog.discover_actors(v_events(spark, sf))


@query(
    "s2_actor_groups",
    f"""WITH {V_EVENTS}, a AS (SELECT DISTINCT actor FROM v_events)
    SELECT actor, CASE WHEN contains(actor, 'GPT') THEN 'ai' ELSE 'human' END AS label,
           row_number() OVER (ORDER BY contains(actor, 'GPT'), actor) AS place FROM a""",
)
def actor_groups(spark, sf):
    return catalog.actor_groups(catalog.discover_actors(v_events(spark, sf)))


@query(
    "s3_dataset_names",
    """SELECT name AS dataset, count(*) AS n FROM (
      SELECT CASE doc_id % 4 WHEN 0 THEN 'WordPress' WHEN 1 THEN 'Nextcloud' WHEN 2 THEN 'WordPress' END AS name
      FROM documents) GROUP BY name""",
)
def dataset_names(spark, sf):
    docs = table(spark, sf, "documents")
    aliases = F.array(*[F.lit(a) for a in ("wp", "Nextcloud", "WORDPRESS", "other")])
    alias = F.element_at(aliases, (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.groupBy(catalog.dataset_name_column(alias).alias("dataset")).agg(
        F.count("*").alias("n")
    )


#: Events whose lines one task writes.
EVENTS_OF_A_FILE = 500_000


def written_logs(spark, sf):
    """All printed log lines as files, one folder per actor.

    A task writes a file per actor, so fewer and larger tasks write than print.
    """
    where = scratch_path(spark, "logs")
    files = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf, "events").count() // EVENTS_OF_A_FILE))
    logs = v_logs(spark, sf).select("actor", "log_type", "text").coalesce(files)
    for kind in ("audit", "syslog", "nextcloud", "unknown"):
        one = logs.where(F.col("log_type") == kind).select("actor", F.col("text").alias("value"))
        one.write.partitionBy("actor").text(f"{where}/{kind}")
    return where


@query(
    "s4_line_scan",
    f"""WITH {V_LOGS} SELECT log_type, actor, count(*) AS n, sum(length(text))::BIGINT AS chars,
      true AS numbered FROM v_logs GROUP BY ALL""",
)
def line_scan(spark, sf):
    """Log files written and read back: per log, lines and whether numbers run 1..n."""
    where = written_logs(spark, sf)
    scanned = lines.read_lines(spark, where)
    per_file = scanned.groupBy(
        "path",
        F.regexp_extract("path", r"/([a-z]+)/actor=[^/]+/", 1).alias("log_type"),
        F.regexp_extract("actor", "=(.*)$", 1).alias("actor"),
    ).agg(
        F.count("*").alias("n"),
        F.sum(F.length("text")).alias("chars"),
        ((F.min("line_no") == 1) & (F.max("line_no") == F.count("*"))
         & (F.count_distinct("line_no") == F.count("*"))).alias("numbered"),
    )
    return per_file.groupBy("log_type", "actor").agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.bool_and("numbered").alias("numbered")
    )


@query(
    "s5_log_type_of_file",
    """SELECT CASE WHEN contains(f, 'audit') THEN 'audit' WHEN contains(f, 'nextcloud') THEN 'nextcloud'
      WHEN contains(f, 'syslog') THEN 'syslog' ELSE 'unknown' END AS log_type, count(*) AS n
    FROM (SELECT lower(CASE page_id % 5 WHEN 0 THEN 'AUDIT' WHEN 1 THEN 'auth' WHEN 2 THEN 'nextcloud-audit'
      WHEN 3 THEN 'Syslog' ELSE 'nextcloud' END || page_id || '.log') AS f FROM pages) GROUP BY ALL""",
)
def log_type_of_file(spark, sf):
    stems = F.array(*[F.lit(s) for s in ("AUDIT", "auth", "nextcloud-audit", "Syslog", "nextcloud")])
    name = F.concat(
        F.element_at(stems, (F.col("page_id") % 5 + 1).cast("int")), F.col("page_id"), F.lit(".log")
    )
    pages = table(spark, sf, "pages").select(catalog.log_type_of_file(name).alias("log_type"))
    return pages.groupBy("log_type").agg(F.count("*").alias("n"))


@query(
    "s6_line_type",
    f"""WITH {V_LOGS} SELECT log_type, CASE
        WHEN starts_with(t, 'type=') AND contains(t, 'msg=audit(') THEN 'audit'
        WHEN starts_with(t, '{{') AND contains(t, '"reqId"') AND contains(t, '"app"') THEN 'nextcloud'
        WHEN regexp_matches(t, '{SYSLOG}') THEN 'syslog' ELSE 'generic' END AS detected, count(*) AS n
      FROM (SELECT log_type, ltrim(text) AS t FROM v_logs) GROUP BY ALL""",
)
def line_type(spark, sf):
    found = v_logs(spark, sf).select("log_type", masking.detect_line_type(F.col("text")).alias("detected"))
    return found.groupBy("log_type", "detected").agg(F.count("*").alias("n"))


@query(
    "s7_select_logs",
    f"""WITH {V_LOGS} SELECT actor, log_type, count(*) AS n FROM v_logs
      WHERE log_type IN ('audit', 'syslog') AND actor IN ('GPT0', 'H5') GROUP BY ALL""",
)
def select_logs(spark, sf):
    chosen = catalog.select_logs(v_logs(spark, sf), ["GPT0", "H5"], ["audit.log", "syslog"])
    return chosen.groupBy("actor", "log_type").agg(F.count("*").alias("n"))


@query(
    "s8_missing_logs",
    f"""WITH {V_LOGS}, r AS (SELECT CASE WHEN starts_with(actor, 'GPT') THEN 'WordPress' ELSE 'Nextcloud' END
        AS dataset, log_type FROM v_logs)
      SELECT dataset, log_type, count(*) AS n FROM r
      WHERE NOT (dataset = 'WordPress' AND log_type = 'nextcloud') GROUP BY ALL""",
)
def missing_logs(spark, sf):
    name = F.when(F.col("actor").startswith("GPT"), "WordPress").otherwise("Nextcloud")
    requests = v_logs(spark, sf).select(name.alias("dataset"), "log_type")
    return catalog.drop_missing_logs(requests).groupBy("dataset", "log_type").agg(F.count("*").alias("n"))


# ---- masks ----


def _masked(spark, sf, kind, mask):
    logs = v_logs(spark, sf)
    if kind:
        logs = logs.where(F.col("log_type") == kind)
    return logs.select("event_id", "line_no", mask(F.col("text")).alias("masked"))


def _mask_sql(kind: str, expr: str) -> str:
    return f"WITH {V_LOGS} SELECT event_id, line_no, {expr} AS masked FROM v_logs WHERE log_type = '{kind}'"


@query("n1_mask_paths", _mask_sql("unknown", q_paths("text")))
def mask_paths(spark, sf):
    return _masked(spark, sf, "unknown", masking.mask_paths)


@query("n2_mask_ips", _mask_sql("syslog", q_ips("text")))
def mask_ips(spark, sf):
    return _masked(spark, sf, "syslog", masking.mask_ips)


@query("n3_mask_hex", _mask_sql("unknown", q_hex("text")))
def mask_hex(spark, sf):
    return _masked(spark, sf, "unknown", masking.mask_hex)


@query("n4_mask_numbers", _mask_sql("audit", q_num("text")))
def mask_numbers(spark, sf):
    return _masked(spark, sf, "audit", masking.mask_numbers)


@query(
    "n5_mask_generic",
    f"""WITH {V_LINES} SELECT doc_id, pos::BIGINT AS pos, {q_generic('text')} AS soft,
        {q_generic('text', True)} AS hard FROM v_lines""",
)
def mask_generic(spark, sf):
    return v_lines(spark, sf).select(
        "doc_id",
        F.col("pos").cast("long").alias("pos"),
        masking.mask_generic(F.col("text")).alias("soft"),
        masking.mask_generic(F.col("text"), aggressive=True).alias("hard"),
    )


@query("n6_mask_audit", _mask_sql("audit", q_audit("text")))
def mask_audit(spark, sf):
    return _masked(spark, sf, "audit", masking.mask_audit)


@query("n7_mask_syslog", _mask_sql("syslog", q_syslog("text")))
def mask_syslog(spark, sf):
    return _masked(spark, sf, "syslog", masking.mask_syslog)


@query("n8_mask_json", _mask_sql("nextcloud", q_json("text")))
def mask_json(spark, sf):
    return _masked(spark, sf, "nextcloud", masking.mask_json_record)


@query(
    "n9_mask_by_type",
    f"""WITH {V_LOGS} SELECT log_type, event_id, line_no, {q_mask('text', 'log_type', True)} AS masked FROM v_logs""",
)
def mask_by_type(spark, sf):
    return v_logs(spark, sf).select(
        "log_type",
        "event_id",
        "line_no",
        masking.mask_line(F.col("text"), "aggressive", F.col("log_type")).alias("masked"),
    )


@query(
    "n10_type_prefix",
    f"WITH {V_LINES} SELECT doc_id, pos::BIGINT AS pos, '[' || log_type || '] ' || text AS text FROM v_lines",
)
def type_prefix(spark, sf):
    return v_lines(spark, sf).select(
        "doc_id",
        F.col("pos").cast("long").alias("pos"),
        masking.with_type_prefix(F.col("text"), F.col("log_type")).alias("text"),
    )


# ---- fields ----


@query(
    "n11_context_fields",
    f"""WITH {V_LOGS} SELECT line_no,
        trim(nullif(regexp_extract(text, '\\btty=("[^"]*"|\\S+)', 1), ''), '"') AS tty,
        trim(nullif(regexp_extract(text, '\\bexe=("[^"]*"|\\S+)', 1), ''), '"') AS exe,
        trim(nullif(regexp_extract(text, '\\bcomm=("[^"]*"|\\S+)', 1), ''), '"') AS comm
      FROM v_logs WHERE log_type = 'audit'""",
)
def context_fields(spark, sf):
    audit = v_logs(spark, sf).where(F.col("log_type") == "audit")
    return audit.select(
        "line_no", *[fields.context_field(F.col("text"), k).alias(k) for k in ("tty", "exe", "comm")]
    )


@query(
    "n12_row_fields",
    f"""WITH {V_LOGS} SELECT line_no,
        trim(nullif(regexp_extract(text, '\\ba0=("[^"]*"|\\S+)(\\s|$)', 1), ''), '"') AS a0,
        trim(nullif(regexp_extract(text, '\\ba1=("[^"]*"|\\S+)(\\s|$)', 1), ''), '"') AS a1,
        trim(nullif(regexp_extract(text, '\\bargc=("[^"]*"|\\S+)(\\s|$)', 1), ''), '"') AS argc
      FROM v_logs WHERE log_type = 'audit' AND regexp_matches(text, '^type=EXECVE\\s+msg=audit\\(')""",
)
def row_fields(spark, sf):
    pattern, keys = fields.preset("execve")
    audit = v_logs(spark, sf).where((F.col("log_type") == "audit") & F.col("text").rlike(pattern))
    rows = audit.select("line_no", fields.field_map(F.col("text"), keys).alias("m"))
    return rows.select("line_no", *[F.col("m")[k].alias(k) for k in ("a0", "a1", "argc")])


PRESET_KEYS = [(m, k) for m in fields.PRESETS for k in fields.preset(m)[1]]


@query(
    "n13_record_presets",
    f"WITH {V_LOGS}, a AS (SELECT text FROM v_logs WHERE log_type = 'audit') "
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS preset, '{k}' AS key, count(*) AS n FROM a
        WHERE regexp_matches(text, '{fields.preset(m)[0]}')
          AND regexp_matches(text, '\\b{k}=("[^"]*"|\\S+)(\\s|$)') HAVING count(*) > 0"""
        for m, k in PRESET_KEYS
    ),
)
def record_presets(spark, sf):
    """How often each preset's keys occur in its records: one scan for all presets."""
    audit = v_logs(spark, sf).where(F.col("log_type") == "audit")
    found = F.array(
        *[
            F.struct(
                F.lit(m).alias("preset"),
                F.when(
                    F.col("text").rlike(fields.preset(m)[0]),
                    F.map_keys(fields.field_map(F.col("text"), fields.preset(m)[1])),
                ).alias("keys"),
            )
            for m in fields.PRESETS
        ]
    )
    rows = audit.select(F.inline(found)).select("preset", F.explode("keys").alias("key"))
    return rows.groupBy("preset", "key").agg(F.count("*").alias("n"))


# ---- actors and scalars ----


@query(
    "n14_anonymize",
    f"""WITH {V_EVENTS}, a AS (SELECT actor, min(event_id) AS place FROM v_events GROUP BY actor)
      SELECT actor, place, CASE WHEN contains(lower(actor), 'gpt') THEN actor ELSE 'Human ' ||
        row_number() OVER (PARTITION BY contains(lower(actor), 'gpt') ORDER BY place) END AS display FROM a""",
)
def anonymize(spark, sf):
    first = v_events(spark, sf).groupBy("actor").agg(F.min("event_id").alias("place"))
    return catalog.anonymize(first)


@query(
    "n15_pick_actors",
    f"""WITH {V_EVENTS}, a AS (SELECT DISTINCT actor FROM v_events),
      r AS (SELECT actor, row_number() OVER (PARTITION BY contains(actor, 'GPT') ORDER BY actor) AS k FROM a),
      p AS (SELECT actor FROM r WHERE k <= CASE WHEN contains(actor, 'GPT') THEN 2 ELSE 3 END)
      SELECT actor, count(*) AS n FROM v_events WHERE actor IN (SELECT actor FROM p) GROUP BY actor""",
)
def pick_actors(spark, sf):
    events = v_events(spark, sf)
    chosen = catalog.pick_actors(catalog.discover_actors(events), n_humans=3, n_ais=2)
    return events.join(chosen, "actor", "left_semi").groupBy("actor").agg(F.count("*").alias("n"))


@query(
    "n15_named_actors",
    f"""WITH {V_EVENTS} SELECT actor, count(*) AS n FROM v_events WHERE actor IN ('H5', 'GPT1', 'H8') GROUP BY actor""",
)
def named_actors(spark, sf):
    events = v_events(spark, sf)
    chosen = catalog.named_actors(catalog.discover_actors(events), ["H8", "GPT1", "H5", "nobody"])
    return events.join(F.broadcast(chosen), "actor", "left_semi").groupBy("actor").agg(F.count("*").alias("n"))


@query(
    "n16_safe_numbers",
    """SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
        CASE WHEN TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) <> 0
          THEN value / TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS ratio,
        TRY_CAST(event_type AS DOUBLE) AS junk FROM events""",
)
def safe_numbers(spark, sf):
    events = table(spark, sf, "events")
    k = text.to_finite(F.get_json_object("props", "$.k"))
    return events.select(
        "event_id",
        k.alias("k"),
        text.safe_divide(F.col("value"), k).alias("ratio"),
        text.to_finite(F.col("event_type")).alias("junk"),
    )


@query(
    "n18_normalize_bundle",
    f"""SELECT doc_id, {q_strip(sub("replace(replace(text || ' ', chr(13) || chr(10), chr(10)), chr(13), chr(10))",
        (r"(?m)[ \t]+$", "")))} AS text, CASE WHEN length(text) <= 80 THEN text
        ELSE substr(text, 1, 80) || chr(10) || '…(truncated)…' END AS clipped FROM documents""",
)
def normalize_bundle(spark, sf):
    padded = F.concat(F.col("text"), F.lit(" "))
    return table(spark, sf, "documents").select(
        "doc_id",
        text.normalize_bundle(padded).alias("text"),
        text.clip_text(F.col("text"), 80).alias("clipped"),
    )


# ---- times ----


def _stamps(spark, sf, kind, stamp):
    logs = v_logs(spark, sf).where(F.col("log_type") == kind)
    found = logs.select("event_id", F.unix_micros(stamp(F.col("text"))).alias("micros"))
    return found.where(F.col("micros").isNotNull())


@query(
    "d1_json_time",
    f"""WITH {V_LOGS} SELECT event_id, epoch_us(ts) AS micros FROM v_logs WHERE log_type = 'nextcloud'""",
)
def json_time(spark, sf):
    return _stamps(spark, sf, "nextcloud", timestamps.json_timestamp)


@query(
    "d2_audit_time",
    f"""WITH {V_LOGS}, l AS (SELECT actor, line_no,
        CAST(regexp_extract(text, 'audit\\(([0-9]+(?:\\.[0-9]+)?):([0-9]+)\\)', 1) AS DOUBLE) AS epoch,
        CAST(regexp_extract(text, 'audit\\(([0-9]+(?:\\.[0-9]+)?):([0-9]+)\\)', 2) AS BIGINT) AS serial
        FROM v_logs WHERE log_type = 'audit')
      SELECT actor, serial, arg_min(epoch, line_no) AS epoch FROM l GROUP BY ALL""",
)
def audit_time(spark, sf):
    audit = v_logs(spark, sf).where(F.col("log_type") == "audit")
    found = audit.select(
        "actor",
        "line_no",
        timestamps.audit_epoch(F.col("text")).alias("epoch"),
        timestamps.audit_serial(F.col("text")).alias("serial"),
    ).where(F.col("serial").isNotNull())
    return found.groupBy("actor", "serial").agg(F.min_by("epoch", "line_no").alias("epoch"))


@query(
    "d3_leading_time",
    f"""WITH {V_LOGS} SELECT event_id, epoch_us(ts) AS micros FROM v_logs WHERE log_type = 'syslog'""",
)
def leading_time(spark, sf):
    return _stamps(spark, sf, "syslog", timestamps.leading_timestamp)


@query(
    "d4_time_by_type",
    f"""WITH {V_LOGS} SELECT log_type, count(*) AS n, count(m) AS stamped, min(m) AS first, max(m) AS last
      FROM (SELECT log_type, CASE log_type WHEN 'audit' THEN epoch_us(ts) // 1000 * 1000
        WHEN 'unknown' THEN NULL ELSE epoch_us(ts) END AS m FROM v_logs) GROUP BY ALL""",
)
def time_by_type(spark, sf):
    found = v_logs(spark, sf).select(
        "log_type",
        F.unix_micros(timestamps.line_timestamp(F.col("text"), F.col("log_type"))).alias("m"),
    )
    return found.groupBy("log_type").agg(
        F.count("*").alias("n"),
        F.count("m").alias("stamped"),
        F.min("m").alias("first"),
        F.max("m").alias("last"),
    )
