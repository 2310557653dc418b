"""Windows, gaps, audit events, complexity and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import fields
from loomtrace.functions.timestamps import line_timestamp
from loomtrace.operators import audit, sequences, templates, timing, windows
from loomtrace.operators import groupstats as gs
from loomtrace.plans import complexity, load
from loomtrace.plans.ordered import along
from loomtrace.queries.base import query
from loomtrace.queries.groups import R, rounded
from loomtrace.queries.sources import q_mask
from loomtrace.sources import catalog
from loomtrace.sources.testviews import (
    PLACES,
    V_CHAT,
    V_EVENTS,
    V_LINES,
    V_LOGS,
    event_tasks,
    v_chat,
    v_events,
    v_lines,
    v_logs,
)


def numbered_lines(spark, sf):
    """Document lines with a line number that follows (doc_id, pos)."""
    return v_lines(spark, sf).withColumn("line_no", F.col("doc_id") * PLACES + F.col("pos"))


POSITIONED = f"""{V_LINES},
pl AS (SELECT actor, log_type, doc_id * {PLACES} + pos AS line_no, text,
         row_number() OVER (PARTITION BY actor, log_type ORDER BY doc_id, pos) - 1 AS p FROM v_lines)"""


def window_sql(size: int, stride: int, keep: bool, sep: str, source: str = "pl", text: str = "text") -> str:
    having = "" if keep else f"HAVING count(*) = {size}"
    return f"""w AS (SELECT DISTINCT actor, log_type, unnest(range(0, m + 1, {stride})) AS s
          FROM (SELECT actor, log_type, max(p) AS m FROM {source} GROUP BY ALL)),
      c AS (SELECT w.actor, w.log_type, s // {stride} AS "window", count(*) AS n, min(line_no) AS line_no,
          string_agg({text}, '{sep}' ORDER BY p) AS text
        FROM w JOIN {source} x ON x.actor = w.actor AND x.log_type = w.log_type AND p >= s AND p < s + {size}
        GROUP BY w.actor, w.log_type, s {having})"""


@query(
    "w1_line_windows",
    f"""WITH {POSITIONED}, {window_sql(4, 2, False, ' <EOL> ')} SELECT actor, log_type, "window", n, line_no, text FROM c""",
)
def line_windows(spark, sf):
    return windows.line_windows(
        numbered_lines(spark, sf), ["actor", "log_type"], ["line_no"], size=4, stride=2,
    )


@query(
    "w1_line_windows_with_tail",
    f"""WITH {POSITIONED}, {window_sql(5, 7, True, ' <EOL> ')} SELECT actor, log_type, "window", n, line_no, text FROM c""",
)
def line_windows_with_tail(spark, sf):
    return windows.line_windows(
        numbered_lines(spark, sf), ["actor", "log_type"], ["line_no"], size=5, stride=7,
        drop_last=False,
    )


MERGED = f"""{V_LOGS},
tim AS (SELECT actor, log_type, line_no, text, CASE WHEN log_type <> 'unknown' AND NOT starts_with(text, 'type=EXECVE') THEN
          CASE WHEN log_type = 'audit' THEN date_trunc('millisecond', ts) ELSE ts END END AS t FROM v_logs),
asf AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY actor, log_type ORDER BY line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS as_of FROM tim),
mrg AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY as_of NULLS FIRST, log_type, line_no) - 1 AS p FROM asf)"""


@query(
    "w6_cross_file_windows",
    f"""WITH {MERGED}, w AS (SELECT actor, unnest(range(0, max(p) + 1, 3)) AS s FROM mrg GROUP BY actor)
      SELECT w.actor, s // 3 AS "window", arg_min(log_type, p) AS file, arg_min(line_no, p) AS line_no, count(*) AS n,
        string_agg(text, ' <EOL> ' ORDER BY p) AS text
      FROM w JOIN mrg ON mrg.actor = w.actor AND p >= s AND p < s + 5 GROUP BY w.actor, s HAVING count(*) = 5""",
)
def cross_file_windows(spark, sf):
    """Windows over all logs of an actor. EXECVE records and free text have no time of their own."""
    rows = v_logs(spark, sf).drop("ts", "event_id")
    bare = F.col("text").startswith("type=EXECVE")
    timed = rows.withColumn("ts", F.when(~bare, line_timestamp(F.col("text"), F.col("log_type"))))
    return windows.cross_file_windows(timed, size=5, stride=3, file="log_type")


IDS = f"""{V_EVENTS},
pl AS (SELECT actor, 'event' AS log_type, event_id AS line_no, dense_rank() OVER (ORDER BY token) AS cid,
         row_number() OVER (PARTITION BY actor ORDER BY ts, event_id) - 1 AS p FROM v_events)"""


def event_ids(spark, sf):
    """Event types as template ids: their place in the sorted type list."""
    events = v_events(spark, sf)
    listed = events.agg(F.array_sort(F.collect_set("token")).alias("kinds"))
    cid = F.array_position("kinds", F.col("token")).cast("long")
    return events.join(F.broadcast(listed)).select(
        "actor", F.lit("event").alias("log_type"), F.col("event_id").alias("line_no"), "ts", cid.alias("cid")
    )


@query(
    "w2_id_windows",
    f"""WITH {IDS}, {window_sql(10, 5, False, ' ', text="'CID' || cid")} SELECT actor, log_type, "window", n, line_no, text FROM c""",
)
def id_windows(spark, sf):
    return windows.id_windows(
        event_ids(spark, sf), ["actor", "log_type"], ["ts", "line_no"], size=10, stride=5,
    )


@query(
    "w3_motifs",
    f"""WITH {IDS}, {window_sql(3, 1, False, ' ', text='cid::VARCHAR')}
      SELECT actor, 3::BIGINT AS size, 1::BIGINT AS stride, text AS token, count(*) AS cnt FROM c GROUP BY ALL""",
)
def motifs(spark, sf):
    placed = along(
        event_ids(spark, sf), ["actor"], ["ts", "line_no"]
    ).positions()
    return sequences.motif_counts(placed.frame(), ["actor"], [(3, 1)])


GAPS = f"""{V_LOGS},
tms AS (SELECT actor, log_type, line_no, event_id, CASE WHEN log_type = 'audit' THEN epoch_us(ts) // 1000 * 1000
          ELSE epoch_us(ts) END AS m FROM v_logs WHERE log_type <> 'unknown'),
evt AS (SELECT actor, log_type, m, min(line_no) AS tie FROM tms GROUP BY actor, log_type, event_id, m),
gap AS (SELECT actor, log_type, row_number() OVER w - 2 AS gap_pos,
          CAST((m - lag(m) OVER w) / 1000000.0::DOUBLE AS FLOAT) AS gap, lag(m) OVER w AS before FROM evt
        WINDOW w AS (PARTITION BY actor, log_type ORDER BY m, tie)),
gps AS (SELECT actor, log_type, gap_pos, gap FROM gap WHERE before IS NOT NULL)"""


def log_gaps(spark, sf):
    tasks = event_tasks(spark, sf)
    return timing.gaps(
        timing.event_times(v_logs(spark, sf), tasks=tasks), ["actor", "log_type"], tasks=tasks
    )


@query("i1_gaps", f"WITH {GAPS} SELECT actor, log_type, gap_pos, round(gap::DOUBLE, 6) AS gap FROM gps")
def gaps(spark, sf):
    found = log_gaps(spark, sf)
    return found.select("actor", "log_type", "gap_pos", F.round(F.col("gap").cast("double"), 6).alias("gap"))


@query(
    "i2_gap_transform",
    f"""WITH {GAPS} SELECT actor, log_type, gap_pos,
        round(log10((greatest(0.0, least(gap, 3600.0))::FLOAT + 1e-6::FLOAT)::DOUBLE)::FLOAT::DOUBLE, 5) AS value
      FROM gps""",
)
def gap_transform(spark, sf):
    found = log_gaps(spark, sf)
    value = timing.transform_gap(F.col("gap"), unit="log10_seconds", clip_max=3600.0, epsilon=1e-6)
    return found.select("actor", "log_type", "gap_pos", F.round(value.cast("double"), 5).alias("value"))


@query(
    "w4_gap_windows",
    f"""WITH {GAPS}, pl AS (SELECT actor, log_type, gap_pos AS p, gap_pos AS line_no, gap FROM gps),
      w AS (SELECT DISTINCT actor, log_type, unnest(range(0, m + 1, 5)) AS s
          FROM (SELECT actor, log_type, max(p) AS m FROM pl GROUP BY ALL))
      SELECT w.actor, w.log_type, s // 5 AS "window", count(*) AS n, round(sum(gap::DOUBLE), 3) AS total,
        round(max(CASE WHEN p = s THEN gap END)::DOUBLE, 6) AS first
      FROM w JOIN pl ON pl.actor = w.actor AND pl.log_type = w.log_type AND p >= s AND p < s + 10
      GROUP BY w.actor, w.log_type, s HAVING count(*) = 10""",
)
def gap_windows(spark, sf):
    cut = windows.gap_windows(
        log_gaps(spark, sf), ["actor", "log_type"], size=10, stride=5, tasks=event_tasks(spark, sf)
    )
    total = F.aggregate("gaps", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return cut.select(
        "actor", "log_type", "window", "n", F.round(total, 3).alias("total"),
        F.round(F.get("gaps", F.lit(0)).cast("double"), 6).alias("first"),
    )


BUNDLE_TEXT = r"regexp_replace(regexp_replace(string_agg(text, chr(10) ORDER BY p), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')"


@query(
    "w5_bundles",
    f"""WITH {V_CHAT}, pl AS (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY example_id) - 1 AS p FROM v_chat)
      SELECT label, p // 5 AS "window", count(*) AS n, {BUNDLE_TEXT} AS text FROM pl GROUP BY label, p // 5""",
)
def bundles(spark, sf):
    return windows.bundle_texts(v_chat(spark, sf), ["label"], ["example_id"], size=5)


@query(
    "w5_sliding_bundles",
    f"""WITH {V_CHAT}, pl AS (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY example_id) - 1 AS p FROM v_chat),
      w AS (SELECT DISTINCT label, unnest(range(0, m + 1, 2)) AS s FROM (SELECT label, max(p) AS m FROM pl GROUP BY ALL))
      SELECT w.label, s // 2 AS "window", count(*) AS n, {BUNDLE_TEXT} AS text FROM w JOIN pl ON pl.label = w.label
        AND p >= s AND p < s + 3 GROUP BY w.label, s HAVING count(*) = 3""",
)
def sliding_bundles(spark, sf):
    return windows.bundle_texts(
        v_chat(spark, sf), ["label"], ["example_id"], size=3, stride=2, strategy="sliding", drop_last=True
    )


def _gap_parts(spark, sf):
    """Gap windows of every length up to 8; GPT0 and H4 are held out."""
    cut = windows.gap_windows(
        log_gaps(spark, sf), ["actor", "log_type"], size=8, drop_last=False, tasks=event_tasks(spark, sf)
    )
    return cut.withColumn("part", F.when(F.col("actor").isin("GPT0", "H4"), "test").otherwise("train"))


@query(
    "i3_padded_gaps",
    f"""WITH {GAPS}, c AS (SELECT actor, log_type, gap_pos // 8 AS "window", list(gap ORDER BY gap_pos) AS g FROM gps GROUP BY ALL),
      l AS (SELECT max(len(g)) AS m FROM c WHERE actor NOT IN ('GPT0', 'H4'))
      SELECT actor, log_type, "window", m AS length, round(coalesce(g[8], 0)::DOUBLE, 6) AS last,
        round(list_sum(g)::DOUBLE, 1) AS total FROM c, l""",
)
def padded_gaps(spark, sf):
    rows = _gap_parts(spark, sf)
    fixed = timing.pad_arrays(rows, "gaps", timing.padded_length(rows, "gaps"))
    total = F.aggregate("gaps", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return fixed.select(
        "actor", "log_type", "window", F.size("gaps").cast("long").alias("length"),
        F.round(F.element_at("gaps", -1).cast("double"), 6).alias("last"), F.round(total, 1).alias("total"),
    )


EXAMPLE_LABEL = "CASE WHEN contains(actor, 'GPT') THEN 'ai' ELSE 'human' END"


@query(
    "s9_examples_lines",
    f"""WITH {V_LOGS}, pl AS (SELECT actor, log_type, line_no, '[' || log_type || '] ' || {q_mask('text', 'log_type')} AS text,
        row_number() OVER (PARTITION BY actor, log_type ORDER BY line_no) - 1 AS p FROM v_logs),
      {window_sql(2, 1, False, ' <EOL> ')} SELECT actor, log_type, line_no, n, text, {EXAMPLE_LABEL} AS label FROM c""",
)
def examples_lines(spark, sf):
    logs = v_logs(spark, sf)
    labels = gs.true_assignment(catalog.discover_actors(v_events(spark, sf)))
    config = load.LoadConfig(preprocess="soft", window="lines", size=2, stride=1)
    return load.examples(logs, labels, config, tasks=event_tasks(spark, sf))


@query("s9_examples_ids")
def examples_ids(spark, sf):
    """Windows over mined template ids of every log."""
    labels = gs.true_assignment(catalog.discover_actors(v_events(spark, sf)))
    config = load.LoadConfig(preprocess="soft", window="cids", size=20, stride=10, type_prefix=False)
    found = load.examples(v_logs(spark, sf), labels, config)
    return found.select("actor", "log_type", "label", "line_no", "n", "text")


# ---- audit ----


def audit_lines(spark, sf):
    return v_logs(spark, sf).where(F.col("log_type") == "audit")


BUNDLES = f"""{V_EVENTS},
bnd AS (SELECT actor, epoch_us(ts) // 1000 / 1000.0::DOUBLE AS ts, event_id AS serial, 2::BIGINT AS n_lines,
          true AS has_execve, CASE WHEN token = 'view' THEN '(none)' ELSE 'pts' || user_id END AS tty,
          '/usr/bin/' || token AS exe, token AS comm, token = 'click' AS matched FROM v_events),
kpt AS (SELECT * FROM bnd WHERE has_execve AND tty <> '(none)'),
clu AS (SELECT *, sum(fresh) OVER (PARTITION BY actor ORDER BY ts, serial) AS cluster FROM (
          SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY actor ORDER BY ts, serial) <= 600.0 THEN 0 ELSE 1 END AS fresh FROM kpt)),
cls AS (SELECT actor, cluster::BIGINT AS cluster, min(ts) AS start, count(*) AS n_events, bool_or(matched) AS matched FROM clu GROUP BY ALL),
dlt AS (SELECT * FROM (SELECT actor, cluster, start - lag(start) OVER w AS delta, lag(matched) OVER w AS after_match
          FROM cls WINDOW w AS (PARTITION BY actor ORDER BY cluster)) WHERE delta IS NOT NULL)"""
GAP = 600.0


def event_bundles(spark, sf):
    return audit.bundles(audit_lines(spark, sf), command="/usr/bin/click")


def event_clusters(spark, sf):
    return audit.clusters(
        audit.interactive(event_bundles(spark, sf)), window=GAP
    )


@query("a1_event_ids", f"WITH {BUNDLES} SELECT actor, ts, serial, count(*) AS n FROM bnd, (VALUES (1), (2)) v(i) GROUP BY ALL")
def audit_event_ids(spark, sf):
    found = audit.with_event_id(audit_lines(spark, sf).drop("ts"))
    return found.groupBy("actor", "ts", "serial").agg(F.count("*").alias("n"))


@query(
    "a2_bundle_lines",
    f"""WITH {V_LOGS} SELECT actor, event_id AS serial, row_number() OVER (PARTITION BY actor, event_id ORDER BY line_no) - 1 AS place,
        line_no, text FROM v_logs WHERE log_type = 'audit'""",
)
def bundle_lines(spark, sf):
    found = audit.bundle_lines(audit_lines(spark, sf).drop("ts"))
    return found.select("actor", "serial", "place", "line_no", "text")


@query("a3_bundles", f"WITH {BUNDLES} SELECT actor, ts, serial, n_lines, has_execve, tty, exe, comm FROM bnd")
def audit_bundles(spark, sf):
    return event_bundles(spark, sf).drop("matched")


@query("a4_interactive", f"WITH {BUNDLES} SELECT actor, ts, serial, tty FROM kpt")
def interactive_bundles(spark, sf):
    return audit.interactive(event_bundles(spark, sf)).select("actor", "ts", "serial", "tty")


@query("a5_command_match", f"WITH {BUNDLES} SELECT actor, matched, count(*) AS n FROM bnd GROUP BY ALL")
def command_match(spark, sf):
    return event_bundles(spark, sf).groupBy("actor", "matched").agg(F.count("*").alias("n"))


@query("a6_clusters", f"WITH {BUNDLES} SELECT actor, cluster, start, n_events, matched FROM cls")
def time_clusters(spark, sf):
    return event_clusters(spark, sf)


@query("a7_cluster_deltas", f"WITH {BUNDLES} SELECT actor, cluster, round(delta, 3) AS delta FROM dlt")
def cluster_deltas(spark, sf):
    found = audit.cluster_deltas(event_clusters(spark, sf))
    return found.select("actor", "cluster", F.round("delta", 3).alias("delta"))


@query(
    "a8_delay_after_command",
    f"""WITH {BUNDLES} SELECT actor, count(*) AS n, round(avg(delta), 5) AS mean_delay, round(median(delta), 3) AS median_delay
      FROM dlt WHERE after_match GROUP BY actor""",
)
def delay_after_command(spark, sf):
    found = audit.cluster_deltas(event_clusters(spark, sf))
    return found.where("after_match").groupBy("actor").agg(
        F.count("*").alias("n"),
        F.round(F.avg("delta"), 5).alias("mean_delay"),
        F.round(F.median("delta"), 3).alias("median_delay"),
    )


@query(
    "a9_timing_summary",
    f"""WITH {BUNDLES} SELECT b.actor, count(*) AS total_bundles, count(*) FILTER (tty <> '(none)') AS kept_bundles,
        max(k) AS num_clusters FROM bnd b JOIN (SELECT actor, count(*) AS k FROM cls GROUP BY actor) c ON c.actor = b.actor GROUP BY b.actor""",
)
def timing_summary(spark, sf):
    return audit.timing_summary(event_bundles(spark, sf), window=GAP)


@query(
    "a10_log_histogram",
    f"""WITH {BUNDLES}, s AS (SELECT log10(min(delta)) AS lo, (log10(max(delta)) - log10(min(delta))) / 49 AS st FROM dlt WHERE delta > 0),
      h AS (SELECT actor, least(floor((log10(delta) - lo) / st), 48)::BIGINT AS bin, lo, st, count(*) AS n FROM dlt, s WHERE delta > 0 GROUP BY ALL)
      SELECT actor, bin, n, round(pow(10, lo + st * bin), 6) AS "left", round(n / (sum(n) OVER (PARTITION BY actor)
        * (pow(10, lo + st * (bin + 1)) - pow(10, lo + st * bin))), {R}) AS density FROM h""",
)
def log_histogram(spark, sf):
    deltas = audit.cluster_deltas(event_clusters(spark, sf))
    bins = audit.log_histogram(deltas)
    return bins.select("actor", "bin", "n", F.round("left", 6).alias("left"), F.round("density", R).alias("density"))


EXEC_ROWS = f"""{V_EVENTS}, ev AS (SELECT actor, token AS a0, '2' AS argc, CASE WHEN event_id % 2 = 0 THEN '/srv/' || user_id END AS a1 FROM v_events)"""


def execve_rows(spark, sf):
    pattern, keys = fields.preset("execve")
    return audit.audit_rows(audit_lines(spark, sf), pattern, keys)


@query("a11_value_counts", f"WITH {EXEC_ROWS} SELECT actor, a1 AS item, count(*) AS cnt FROM ev WHERE a0 = 'view' AND a1 IS NOT NULL GROUP BY ALL")
def value_counts(spark, sf):
    return audit.value_counts(execve_rows(spark, sf), "a1", given=("a0", "view"))


@query("a12_pair_counts", f"WITH {EXEC_ROWS} SELECT actor, a0 || ' | ' || a1 AS item, count(*) AS cnt FROM ev WHERE a1 IS NOT NULL GROUP BY ALL")
def pair_counts(spark, sf):
    return audit.pair_counts(execve_rows(spark, sf), "a0", "a1")


@query("a13_presence_patterns", f"WITH {EXEC_ROWS} SELECT actor, CASE WHEN a1 IS NULL THEN 'a0 | argc' ELSE 'a0 | a1 | argc' END AS item, count(*) AS cnt FROM ev GROUP BY ALL")
def presence_patterns(spark, sf):
    return audit.presence_patterns(execve_rows(spark, sf), ["a0", "a1", "a2", "argc"])


@query(
    "a14_distribution",
    f"""WITH {EXEC_ROWS} SELECT actor, a0 AS item, count(*) AS cnt,
        round(count(*) / sum(count(*)) OVER (PARTITION BY actor), {R}) AS prob FROM ev GROUP BY actor, a0""",
)
def field_distribution(spark, sf):
    return rounded(audit.distribution(audit.value_counts(execve_rows(spark, sf), "a0")), "prob")


@query(
    "a15_top_items",
    f"""WITH {EXEC_ROWS}, n AS (SELECT actor, a1 AS item, count(*) AS cnt FROM ev WHERE a1 IS NOT NULL GROUP BY ALL),
      v AS (SELECT item FROM n GROUP BY item ORDER BY sum(cnt) DESC, item LIMIT 10),
      t AS (SELECT actor, sum(cnt) AS tot FROM n GROUP BY actor)
      SELECT t.actor, v.item, coalesce(cnt, 0)::BIGINT AS cnt, round(coalesce(cnt, 0) / tot, {R}) AS prob
      FROM t CROSS JOIN v LEFT JOIN n ON n.actor = t.actor AND n.item = v.item""",
)
def top_items(spark, sf):
    return rounded(audit.top_items(audit.value_counts(execve_rows(spark, sf), "a1"), 10), "prob")


# ---- C: complexity ----

WORD_FREQ = f"""{V_LINES},
x AS (SELECT actor, token, count(*)::DOUBLE AS c FROM (SELECT actor, unnest(regexp_split_to_array(text, '\\s+')) AS token FROM v_lines)
      WHERE token <> '' GROUP BY ALL)"""


def word_profile(spark, sf):
    from loomtrace.operators.distributions import word_counts

    return sequences.profile(word_counts(v_lines(spark, sf)), ["actor"])


@query(
    "c1_gini",
    f"""WITH {WORD_FREQ}, r AS (SELECT actor, c, row_number() OVER (PARTITION BY actor ORDER BY c) AS i FROM x)
      SELECT actor, round(2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1) / count(*), {R}) AS gini FROM r GROUP BY actor""",
)
def gini(spark, sf):
    return rounded(word_profile(spark, sf).select("actor", "gini"), "gini")


KURTOSIS = """(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3))) * m4 / ((m2 / (n - 1)) * (m2 / (n - 1)))
  - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))"""


@query(
    "c2_kurtosis",
    f"""WITH {WORD_FREQ}, y AS (SELECT actor, c FROM x UNION ALL SELECT actor, c FROM x),
      a AS (SELECT actor, avg(c) AS mu, count(*)::DOUBLE AS n FROM y GROUP BY actor),
      m AS (SELECT actor, max(n) AS n, sum((c - mu) ** 2) AS m2, sum((c - mu) ** 4) AS m4 FROM y JOIN a USING (actor) GROUP BY actor)
      SELECT actor, round({KURTOSIS}, 6) AS kurtosis FROM m""",
)
def kurtosis(spark, sf):
    found = word_profile(spark, sf)
    return found.select("actor", F.round("kurtosis", 6).alias("kurtosis"))


@query(
    "c3_entropy",
    f"""WITH {WORD_FREQ}, p AS (SELECT actor, c / sum(c) OVER (PARTITION BY actor) AS p FROM x)
      SELECT actor, round(-sum(p * log2(p)), {R}) AS entropy FROM p GROUP BY actor""",
)
def entropy(spark, sf):
    return rounded(word_profile(spark, sf).select("actor", "entropy"), "entropy")


@query(
    "c4_mean_abs_deviation",
    f"""WITH {WORD_FREQ}, a AS (SELECT actor, avg(c) AS mu FROM x GROUP BY actor)
      SELECT actor, round(avg(abs(c - mu)), {R}) AS mad FROM x JOIN a USING (actor) GROUP BY actor""",
)
def mean_abs_deviation(spark, sf):
    return rounded(word_profile(spark, sf).select("actor", "mad"), "mad")


@query(
    "c5_gated_profile",
    f"""WITH {V_EVENTS}, x AS (SELECT user_id, token, count(*)::DOUBLE AS c FROM v_events GROUP BY ALL),
      y AS (SELECT user_id, c FROM x UNION ALL SELECT user_id, c FROM x),
      a AS (SELECT user_id, avg(c) AS mu, count(*)::DOUBLE AS n, sum(c) / 2 AS s FROM y GROUP BY user_id),
      m AS (SELECT user_id, max(n) AS n, max(s) AS s, sum((c - mu) ** 2) AS m2, sum((c - mu) ** 4) AS m4 FROM y JOIN a USING (user_id) GROUP BY user_id)
      SELECT user_id, s::BIGINT AS n_rows, (n / 2)::BIGINT AS n_distinct,
        CASE WHEN s >= 70 AND n / 2 >= 3 AND n >= 4 AND m2 > 0 THEN round({KURTOSIS}, 6) END AS kurtosis FROM m""",
)
def gated_profile(spark, sf):
    counts = v_events(spark, sf).groupBy("user_id", "token").agg(F.count("*").alias("cnt"))
    found = sequences.profile(counts, ["user_id"], min_rows=70)
    return found.select("user_id", "n_rows", "n_distinct", F.round("kurtosis", 6).alias("kurtosis"))


def _scalar_sql(source: str, suffix: str, distinct: int) -> str:
    """Per-actor scalars over `source` (actor, token, cnt) named with a suffix.

    Below 20 rows there are none, and below `distinct` items no kurtosis.
    """
    s = suffix
    return f"""
r{s} AS (SELECT actor, cnt::DOUBLE AS c, row_number() OVER (PARTITION BY actor ORDER BY cnt) AS i,
        sum(cnt) OVER (PARTITION BY actor) AS s, avg(cnt) OVER (PARTITION BY actor) AS mu FROM {source}),
q{s} AS (SELECT actor, 2.0::DOUBLE * count(*) AS n, 2 * sum((c - mu) ** 2) AS m2, 2 * sum((c - mu) ** 4) AS m4,
        2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1) / count(*) AS gini,
        -sum(c / s * log2(c / s)) AS entropy, avg(abs(c - mu)) AS mad, sum(c) AS total FROM r{s} GROUP BY actor),
k{s} AS (SELECT actor, CASE WHEN total >= 20 THEN gini END AS gini, CASE WHEN total >= 20 THEN entropy END AS entropy,
        CASE WHEN total >= 20 THEN mad END AS mad,
        CASE WHEN total >= 20 AND n >= 2 * {distinct} AND m2 > 0 THEN {KURTOSIS} END AS kurtosis FROM q{s})"""


def _pairs_named(source: str, suffix: str) -> str:
    from loomtrace.queries.groups import pair_sql

    return f"d{suffix} AS (SELECT * FROM (WITH cnt AS (SELECT * FROM {source}), {pair_sql()} SELECT * FROM dst))"


def profile_sql(size: int, stride: int) -> str:
    cells = ", ".join(
        f"round(abs(x.{c} - y.{c}), 6) AS {c}, round(abs(v.{c} - w.{c}), 6) AS {c}_seq" for c in sequences.SCALARS
    )
    return f"""SELECT * FROM (WITH {IDS}, {window_sql(size, stride, False, ' ', text='cid::VARCHAR')},
      ci AS (SELECT actor, cid AS token, count(*) AS cnt FROM pl GROUP BY ALL),
      cs AS (SELECT actor, text AS token, count(*) AS cnt FROM c GROUP BY ALL),
      {_scalar_sql('ci', '1', 3)}, {_scalar_sql('cs', '2', 4)}, {_pairs_named('ci', '1')}, {_pairs_named('cs', '2')}
      SELECT {size}::BIGINT AS size, {stride}::BIGINT AS stride, d1.actor_1, d1.actor_2, {cells},
        round(d1.l1, 6) AS l1, round(d1.js, 6) AS js, round(d2.l1, 6) AS l1_seq, round(d2.js, 6) AS js_seq
      FROM d1 JOIN d2 USING (actor_1, actor_2) JOIN k1 x ON x.actor = d1.actor_1 JOIN k1 y ON y.actor = d1.actor_2
      JOIN k2 v ON v.actor = d1.actor_1 JOIN k2 w ON w.actor = d1.actor_2)"""


def event_profiles(spark, sf, settings):
    return complexity.pairwise_complexity(
        event_ids(spark, sf), ["ts", "line_no"], settings=settings
    )


def _rounded_profiles(found):
    return found.withColumns({c: F.round(c, 6) for c in (*complexity.ID_METRICS, *complexity.SEQ_METRICS)})


@query("c6_pair_profiles", profile_sql(3, 1))
def pair_profiles(spark, sf):
    return _rounded_profiles(event_profiles(spark, sf, [(3, 1)]))


@query("c7_complexity_sweep", "\nUNION ALL BY NAME\n".join(profile_sql(s, t) for s, t in complexity.SWEEP))
def complexity_sweep(spark, sf):
    return _rounded_profiles(event_profiles(spark, sf, complexity.SWEEP))


@query(
    "c8_incomplete_metrics",
    f"""WITH {V_EVENTS}, c AS (SELECT actor, token, count(*) AS n FROM v_events GROUP BY ALL),
      v AS (SELECT DISTINCT token FROM c), a AS (SELECT DISTINCT actor FROM c)
      SELECT token AS metric, actor FROM v, a WHERE token = 'error'""",
)
def incomplete_metrics(spark, sf):
    """Pairs scored per event type; `error` pairs with GPT0 are left undefined."""
    events = v_events(spark, sf)
    counts = events.groupBy(F.col("token").alias("metric"), "actor").agg(F.count("*").alias("n"))
    from loomtrace.operators.distributions import actor_pairs

    pairs = actor_pairs(counts, ["metric"])
    undefined = (F.col("metric") == "error") & (F.col("actor_1") == "GPT0")
    distance = F.when(~undefined, F.abs(F.col("n_1") - F.col("n_2")).cast("double"))
    return gs.incomplete_metrics(pairs.withColumn("distance", distance), ["metric"])


# ---- T: templates ----


def masked_logs(spark, sf):
    config = load.LoadConfig(preprocess="template")
    return load.masked_lines(v_logs(spark, sf), config)


EXACT = f"""{V_LOGS},
m AS (SELECT actor, log_type, line_no, {q_mask('text', 'log_type')} AS text FROM v_logs),
d AS (SELECT log_type, text, count(*) AS cnt, min((actor, line_no)) AS first FROM m GROUP BY ALL)"""


# The lines of a leaf (type, length, first three tokens) are so alike here that they are one
# cluster, so its template has a wildcard wherever they differ.
LEAF_TOKEN = """CASE WHEN n <= {i} THEN '' WHEN regexp_matches(tk[{i}], '[0-9]') THEN '<*>' ELSE tk[{i}] END"""
MINED = f"""{EXACT},
tks AS (SELECT *, len(tk) AS n FROM (SELECT log_type, text, cnt, first,
          list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS tk FROM d)),
lvs AS (SELECT *, {", ".join(LEAF_TOKEN.format(i=i) + f" AS t{i}" for i in (1, 2, 3))} FROM tks),
cel AS (SELECT log_type, n, t1, t2, t3, unnest(tk) AS token, generate_subscripts(tk, 1) AS i FROM lvs),
plc AS (SELECT log_type, n, t1, t2, t3, i, CASE WHEN count(DISTINCT token) > 1 THEN '<*>' ELSE min(token) END AS token FROM cel GROUP BY ALL),
txt AS (SELECT log_type, n, t1, t2, t3, string_agg(token, ' ' ORDER BY i) AS template FROM plc GROUP BY ALL),
brn AS (SELECT log_type, n, t1, t2, t3, min(first) AS born, sum(cnt)::BIGINT AS cnt FROM lvs GROUP BY ALL),
tpl AS (SELECT *, row_number() OVER (PARTITION BY log_type ORDER BY born) AS cid FROM brn JOIN txt USING (log_type, n, t1, t2, t3))"""


@query("t1_templates", f"WITH {MINED} SELECT log_type, cid, template, cnt FROM tpl")
def mined_templates(spark, sf):
    """Templates of every log type with the published settings."""
    mined = templates.mine_templates(masked_logs(spark, sf), ["actor", "line_no"])
    return templates.template_dictionary(mined)


@query(
    "t2_exact_templates",
    f"""WITH {EXACT} SELECT log_type, row_number() OVER (PARTITION BY log_type ORDER BY first) AS cid,
        regexp_replace(trim(text), '\\s+', ' ', 'g') AS template, cnt FROM d""",
)
def exact_templates(spark, sf):
    """With similarity 1 a template is a distinct masked line."""
    mined = templates.mine_templates(masked_logs(spark, sf), ["actor", "line_no"], similarity=1.0)
    return templates.template_dictionary(mined)


@query(
    "t3_template_texts",
    f"""WITH {EXACT} SELECT actor, log_type, line_no, regexp_replace(trim(text), '\\s+', ' ', 'g') AS template FROM m""",
)
def template_texts(spark, sf):
    masked = masked_logs(spark, sf)
    mined = templates.mine_templates(masked, ["actor", "line_no"], similarity=1.0)
    return templates.assign_templates(masked, mined).select("actor", "log_type", "line_no", "template")
