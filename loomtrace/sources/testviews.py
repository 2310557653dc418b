"""Log-shaped views over the given tables, once for Spark and once as SQL text.

No logs are shipped with the tables, so documents stand in for free text lines,
events for timed records, and events printed in each log format for raw log lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Places that a line number leaves for the lines of one document; an array has fewer.
PLACES = 1 << 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; times are UTC whatever zone the session came with."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task: documents, and events with their printed lines.
DOCUMENTS, EVENTS = 500, 20_000


def spread(scan: DataFrame, key: str, rows: int) -> DataFrame:
    """Deal a scan by its key: all cores get work, and no task more than about `rows` rows.

    The number of tasks grows with the table, and what is grouped by the key afterwards
    stays in its task.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(max(cores, -(-scan.count() // rows)), key)


def event_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for work on printed events, as `spread` deals them."""
    n = table(spark, sf_dir, "events").count()
    return max(spark.sparkContext.defaultParallelism, -(-n // EVENTS))


def _actor(number: Column) -> Column:
    return F.when(number < 4, F.concat(F.lit("GPT"), number)).otherwise(
        F.concat(F.lit("H"), number)
    )


def _documents(spark: SparkSession, sf_dir: str, dealt: bool) -> DataFrame:
    scan = table(spark, sf_dir, "documents")
    return spread(scan, "doc_id", DOCUMENTS) if dealt else scan


def v_lines(spark: SparkSession, sf_dir: str, *, dealt: bool = True) -> DataFrame:
    """Text lines of documents: 4 + 4 actors, the language as log type.

    Who lays the lines out anew takes them as they are read, not `dealt`.
    """
    source = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return _documents(spark, sf_dir, dealt).select(
        _actor(source % 8).alias("actor"),
        F.col("lang").alias("log_type"),
        "doc_id",
        F.posexplode(F.split("text", "\n")).alias("pos", "text"),
    )


def v_documents(spark: SparkSession, sf_dir: str, *, dealt: bool = True) -> DataFrame:
    """Whole documents as examples, with the actors of `v_lines`."""
    source = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return _documents(spark, sf_dir, dealt).select(
        F.col("doc_id").alias("example_id"), "text", _actor(source % 8).alias("actor")
    )


V_LINES = """
v_lines AS (
  SELECT CASE WHEN k < 4 THEN 'GPT' || k ELSE 'H' || k END AS actor, log_type, doc_id,
         pos - 1 AS pos, text
  FROM (SELECT CAST(regexp_extract(source, '[0-9]+') AS INT) % 8 AS k, lang AS log_type,
               doc_id, unnest(string_split(text, chr(10))) AS text,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents))"""


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an actor: 4 + 6 actors."""
    return table(spark, sf_dir, "events").select(
        _actor(F.col("user_id") % 10).alias("actor"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("token"),
        "value",
        "user_id",
        "props",
    )


V_EVENTS = """
v_events AS (
  SELECT CASE WHEN user_id % 10 < 4 THEN 'GPT' || (user_id % 10)
              ELSE 'H' || (user_id % 10) END AS actor,
         event_id, ts, event_type AS token, value, user_id, props
  FROM events)"""


def v_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event printed as audit SYSCALL and EXECVE, syslog, JSON and free text.

    `line_no` numbers the lines of one actor's log by (event, record).
    """
    e = spread(v_events(spark, sf_dir), "event_id", EVENTS)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    epoch = F.concat(
        F.floor(F.unix_micros("ts") / 1_000_000).cast("string"),
        F.lit("."),
        F.lpad(F.floor(F.unix_micros("ts") / 1000) % 1000, 3, "0"),
    )
    num = F.col("event_id").cast("string")
    usr = F.col("user_id").cast("string")
    audit_id = F.concat(F.lit(" msg=audit("), epoch, F.lit(":"), num, F.lit("): "))
    tty = F.when(F.col("token") == "view", "(none)").otherwise(F.concat(F.lit("pts"), usr))
    syscall = F.concat(
        F.lit("type=SYSCALL"), audit_id,
        F.lit("arch=c000003e syscall=59 success=yes exit=0 auid="), usr,
        F.lit(" uid="), F.col("user_id") % 3,
        F.lit(" tty="), tty,
        F.lit(' comm="'), F.col("token"),
        F.lit('" exe="/usr/bin/'), F.col("token"), F.lit('" key="cmd"'),
    )
    second = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(' a1="/srv/'), usr, F.lit('"')))
    execve = F.concat(
        F.lit("type=EXECVE"), audit_id, F.lit('argc=2 a0="'), F.col("token"), F.lit('"'),
        F.coalesce(second, F.lit("")),
    )
    syslog = F.concat(
        stamp, F.lit("+00:00 web"), F.col("user_id") % 4, F.lit(" "), F.col("token"),
        F.lit("["), num, F.lit("]: done in "), F.col("user_id"), F.lit("ms for 10.0."),
        F.col("user_id") % 256, F.lit(".7 file /srv/"), usr, F.lit("/x.php code "),
        F.floor("value"), F.lit(" id 0xdeadbeef"),
    )
    record = F.concat(
        F.lit('{"reqId":"r'), num, F.lit('","level":'), F.col("user_id") % 4,
        F.lit(',"time":"'), stamp, F.lit('+00:00","app":"'), F.col("token"),
        F.lit('","method":"GET","url":"/index.php/'), F.col("token"), F.lit("?id="), num,
        F.lit('","message":"user \'u'), usr, F.lit("'@'h' from 10.1.2."),
        F.col("user_id") % 256, F.lit(' read /data/x took 12"'),
        F.when(
            F.col("token") == "error",
            F.concat(F.lit(',"exception":{"Exception":"Err","Code":'), F.col("user_id") % 7, F.lit("}")),
        ).otherwise(F.lit("")),
        F.when(F.col("event_id") % 50 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    free = F.concat(
        F.lit("  worker "), usr, F.lit(" key 0123456789abcdef0123 saw 192.168.1.300 and 8.8.8.8 at /var/lib/"),
        F.col("token"), F.lit(" n="), num,
    )
    kinds = [
        ("audit", 0, syscall), ("audit", 1, execve), ("syslog", 0, syslog),
        ("nextcloud", 0, record), ("unknown", 0, free),
    ]
    lines = F.array(
        *[
            F.struct(F.lit(t).alias("log_type"), F.lit(i).alias("part"), x.alias("text"))
            for t, i, x in kinds
        ]
    )
    return e.select("actor", "event_id", "ts", F.inline(lines)).select(
        "actor",
        "log_type",
        (F.col("event_id") * 2 + F.col("part") + 1).alias("line_no"),
        "text",
        "event_id",
        "ts",
    )


V_LOGS = (
    V_EVENTS
    + """,
v_parts AS (
  SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp,
         CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' ||
           lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') AS ep,
         CASE WHEN token = 'view' THEN '(none)' ELSE 'pts' || user_id END AS tty
  FROM v_events),
v_logs AS (
  SELECT actor, 'audit' AS log_type, event_id * 2 + 1 AS line_no,
    'type=SYSCALL msg=audit(' || ep || ':' || event_id || '): arch=c000003e syscall=59 success=yes exit=0 auid='
    || user_id || ' uid=' || (user_id % 3) || ' tty=' || tty || ' comm="' || token
    || '" exe="/usr/bin/' || token || '" key="cmd"' AS text, event_id, ts FROM v_parts
  UNION ALL
  SELECT actor, 'audit', event_id * 2 + 2,
    'type=EXECVE msg=audit(' || ep || ':' || event_id || '): argc=2 a0="' || token || '"'
    || CASE WHEN event_id % 2 = 0 THEN ' a1="/srv/' || user_id || '"' ELSE '' END, event_id, ts FROM v_parts
  UNION ALL
  SELECT actor, 'syslog', event_id * 2 + 1,
    stamp || '+00:00 web' || (user_id % 4) || ' ' || token || '[' || event_id || ']: done in ' || user_id
    || 'ms for 10.0.' || (user_id % 256) || '.7 file /srv/' || user_id || '/x.php code '
    || CAST(floor(value) AS BIGINT) || ' id 0xdeadbeef', event_id, ts FROM v_parts
  UNION ALL
  SELECT actor, 'nextcloud', event_id * 2 + 1,
    '{"reqId":"r' || event_id || '","level":' || (user_id % 4) || ',"time":"' || stamp || '+00:00","app":"' || token
    || '","method":"GET","url":"/index.php/' || token || '?id=' || event_id || '","message":"user ''u' || user_id
    || '''@''h'' from 10.1.2.' || (user_id % 256) || ' read /data/x took 12"'
    || CASE WHEN token = 'error' THEN ',"exception":{"Exception":"Err","Code":' || (user_id % 7) || '}' ELSE '' END
    || CASE WHEN event_id % 50 = 0 THEN '' ELSE '}' END, event_id, ts FROM v_parts
  UNION ALL
  SELECT actor, 'unknown', event_id * 2 + 1,
    '  worker ' || user_id || ' key 0123456789abcdef0123 saw 192.168.1.300 and 8.8.8.8 at /var/lib/'
    || token || ' n=' || event_id, event_id, ts FROM v_parts)"""
)


def v_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as truth and toxicity as prediction, one run per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(
            F.col("lang").alias("run_id"),
            F.lit("test").alias("part"),
            F.col("doc_id").alias("example_id"),
            F.when(F.col("quality") == 1, "human").otherwise("ai").alias("y_true"),
            F.when(F.col("toxic") == 1, "human").otherwise("ai").alias("y_pred"),
        )
    )


V_PRED = """
v_pred AS (
  SELECT d.lang AS run_id, 'test' AS part, l.doc_id AS example_id,
         CASE WHEN quality = 1 THEN 'human' ELSE 'ai' END AS y_true,
         CASE WHEN toxic = 1 THEN 'human' ELSE 'ai' END AS y_pred
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def v_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns: the role as class, the conversation as group."""
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role").isin("user", "assistant"))
        .select(
            (F.col("conv_id") * PLACES + F.col("turn")).alias("example_id"),
            F.when(F.col("role") == "assistant", "ai").otherwise("human").alias("label"),
            F.col("conv_id").cast("string").alias("group"),
            F.col("turn").alias("pos"),
            "text",
        )
    )


V_CHAT = f"""
v_chat AS (
  SELECT conv_id * {PLACES} + turn AS example_id,
         CASE WHEN role = 'assistant' THEN 'ai' ELSE 'human' END AS label,
         CAST(conv_id AS VARCHAR) AS "group", turn AS pos, text
  FROM conversations WHERE role IN ('user', 'assistant'))"""


def v_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in two classes: label below 5 is `ai`."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") < 5, "ai").otherwise("human").alias("label"),
        "embedding",
    )


V_EMB = """
v_emb AS (
  SELECT vec_id AS id, CASE WHEN label < 5 THEN 'ai' ELSE 'human' END AS label, embedding
  FROM embeddings)"""
