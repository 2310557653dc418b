"""Distributions, pair distances, class structure, null labelings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import distributions as dist
from loomtrace.operators import groupstats as gs
from loomtrace.operators import nulls, ranktests
from loomtrace.plans import one_gram
from loomtrace.queries.base import query
from loomtrace.sources import catalog
from loomtrace.sources.testviews import V_EVENTS, V_LINES, v_events, v_lines

R = 9  # decimals kept of computed doubles


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, R) for c in columns})


# The event types of an actor as its tokens.
EVENT_COUNTS = f"""{V_EVENTS},
cnt AS (SELECT actor, token, count(*) AS cnt FROM v_events GROUP BY ALL)"""

WORD_SPLIT = "unnest(regexp_split_to_array(text, '\\s+'))"
WORD_COUNTS = f"""{V_LINES},
cnt AS (SELECT actor, token, count(*) AS cnt FROM (SELECT actor, {WORD_SPLIT} AS token FROM v_lines) WHERE token <> '' GROUP BY ALL)"""
CHAR_COUNTS = f"""{V_LINES},
cnt AS (SELECT actor, token, sum(n)::BIGINT AS cnt FROM (
   SELECT actor, token, count(*) AS n FROM (SELECT actor, unnest(string_split(text, '')) AS token FROM v_lines)
   WHERE token <> '' GROUP BY ALL
   UNION ALL SELECT actor, chr(10), count(*) - 1 FROM v_lines GROUP BY actor) GROUP BY ALL)"""


def pair_sql(min_count: int = 1) -> str:
    """Dense pair distances over `cnt`: an independent way to the same numbers."""
    return f"""
act AS (SELECT DISTINCT actor FROM cnt),
prs AS (SELECT a.actor AS actor_1, b.actor AS actor_2 FROM act a JOIN act b ON a.actor < b.actor),
voc AS (SELECT DISTINCT token FROM cnt),
cel AS (SELECT actor_1, actor_2, coalesce(x.cnt, 0) AS c1, coalesce(y.cnt, 0) AS c2
        FROM prs CROSS JOIN voc LEFT JOIN cnt x ON x.actor = actor_1 AND x.token = voc.token
        LEFT JOIN cnt y ON y.actor = actor_2 AND y.token = voc.token
        WHERE coalesce(x.cnt, 0) + coalesce(y.cnt, 0) >= {min_count}),
tot AS (SELECT actor_1, actor_2, sum(c1) AS t1, sum(c2) AS t2 FROM cel GROUP BY ALL),
shr AS (SELECT actor_1, actor_2, t1, t2, c1 / nullif(t1, 0) AS p, c2 / nullif(t2, 0) AS q FROM cel JOIN tot USING (actor_1, actor_2)),
dst AS (SELECT actor_1, actor_2, sum(abs(coalesce(p, 0) - coalesce(q, 0))) AS l1,
          CASE WHEN min(t1) > 0 AND min(t2) > 0 THEN
          sqrt(greatest(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END)
             + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0)) END AS js
        FROM shr GROUP BY ALL)"""


def event_counts(spark, sf):
    return v_events(spark, sf).groupBy("actor", "token").agg(F.count("*").alias("cnt"))


def event_distances(spark, sf):
    """Distances over event types, long form, config column `metric`."""
    return dist.long_distances(dist.pair_distances(event_counts(spark, sf)))


def event_actors(spark, sf):
    return catalog.discover_actors(v_events(spark, sf))


# ---- G: token counts and distances ----


@query("g1_char_tokens", f"WITH {CHAR_COUNTS} SELECT token, sum(cnt)::BIGINT AS cnt FROM cnt GROUP BY token")
def char_tokens(spark, sf):
    counts = dist.char_counts(v_lines(spark, sf))
    return counts.groupBy("token").agg(F.sum("cnt").alias("cnt"))


@query("g2_token_counts", f"WITH {WORD_COUNTS} SELECT * FROM cnt")
def token_counts(spark, sf):
    return dist.word_counts(v_lines(spark, sf))


@query(
    "g3_probabilities",
    f"WITH {WORD_COUNTS} SELECT actor, token, cnt, (sum(cnt) OVER (PARTITION BY actor))::BIGINT AS total, "
    f"round(cnt / sum(cnt) OVER (PARTITION BY actor), {R}) AS prob FROM cnt",
)
def probabilities(spark, sf):
    return rounded(dist.probabilities(dist.word_counts(v_lines(spark, sf))), "prob")


@query("g4_l1_distance", f"WITH {WORD_COUNTS}, {pair_sql()} SELECT actor_1, actor_2, round(l1, {R}) AS l1 FROM dst")
def l1_distance(spark, sf):
    pairs = dist.pair_distances(dist.word_counts(v_lines(spark, sf)))
    return rounded(pairs.drop("js"), "l1")


@query("g5_js_distance", f"WITH {CHAR_COUNTS}, {pair_sql()} SELECT actor_1, actor_2, round(js, {R}) AS js FROM dst")
def js_distance(spark, sf):
    pairs = dist.pair_distances(dist.char_counts(v_lines(spark, sf)))
    return rounded(pairs.drop("l1"), "js")


@query(
    "g5_min_count_distance",
    f"WITH {WORD_COUNTS}, {pair_sql(4)} SELECT actor_1, actor_2, round(l1, {R}) AS l1, round(js, {R}) AS js FROM dst",
)
def min_count_distance(spark, sf):
    return rounded(dist.pair_distances(dist.word_counts(v_lines(spark, sf)), min_count=4), "l1", "js")


def _difference_sql(order: str, min_count: int) -> str:
    return f"""WITH {WORD_COUNTS}, t AS (SELECT token, sum(CASE WHEN actor = 'GPT0' THEN cnt ELSE 0 END)::BIGINT AS cnt_1,
        sum(CASE WHEN actor = 'H4' THEN cnt ELSE 0 END)::BIGINT AS cnt_2 FROM cnt WHERE actor IN ('GPT0', 'H4') GROUP BY token
        HAVING sum(cnt) >= {min_count}),
      p AS (SELECT token, cnt_1, cnt_2, cnt_1 / sum(cnt_1) OVER () AS p_1, cnt_2 / sum(cnt_2) OVER () AS p_2 FROM t)
      SELECT token, cnt_1, cnt_2, round(p_1, {R}) AS p_1, round(p_2, {R}) AS p_2, round(p_1 - p_2, {R}) AS delta
      FROM p ORDER BY round({order}, 12) DESC, token LIMIT 20"""


@query("g6_token_differences", _difference_sql("abs(p_1 - p_2)", 1))
def token_differences(spark, sf):
    top = dist.token_differences(dist.word_counts(v_lines(spark, sf)), "GPT0", "H4")
    return rounded(top, "p_1", "p_2", "delta")


@query("g7_token_comparison", _difference_sql("p_1 + p_2", 3))
def token_comparison(spark, sf):
    top = dist.token_differences(
        dist.word_counts(v_lines(spark, sf)), "GPT0", "H4", min_count=3, order="sum"
    )
    return rounded(top, "p_1", "p_2", "delta")


@query(
    "g8_all_pairs",
    f"""WITH {EVENT_COUNTS}, {pair_sql()} SELECT actor_1, actor_2, round(l1, {R}) AS l1, round(js, {R}) AS js FROM dst""",
)
def all_pairs(spark, sf):
    return rounded(dist.pair_distances(event_counts(spark, sf), event_actors(spark, sf)), "l1", "js")


def _sweep_part(mode: str, counts: str) -> str:
    body = f"WITH {counts}, {pair_sql()} SELECT actor_1, actor_2, l1, js FROM dst"
    return "\nUNION ALL\n".join(
        f"SELECT '{mode}' AS mode, actor_1, actor_2, '{m}' AS metric, round({m}, {R}) AS distance FROM ({body})"
        for m in ("l1", "js")
    )


@query("g9_one_gram_sweep", _sweep_part("word", WORD_COUNTS) + "\nUNION ALL\n" + _sweep_part("char", CHAR_COUNTS))
def one_gram_sweep(spark, sf):
    return rounded(one_gram.one_gram_distances(v_lines(spark, sf)), "distance")


# ---- P: labelings and class structure ----

ACTORS = """
lab AS (SELECT actor, CASE WHEN contains(actor, 'GPT') THEN 'ai' ELSE 'human' END AS label
        FROM (SELECT DISTINCT actor FROM cnt))"""
# All subsets of four actors in lexicographic order, the observed one left out.
SUBSETS = ACTORS + """,
sub AS (SELECT row_number() OVER (ORDER BY a.actor, b.actor, c.actor, d.actor) - 1 AS idx,
          [a.actor, b.actor, c.actor, d.actor] AS ai
        FROM lab a JOIN lab b ON a.actor < b.actor JOIN lab c ON b.actor < c.actor JOIN lab d ON c.actor < d.actor
        WHERE NOT (a.label = 'ai' AND b.label = 'ai' AND c.label = 'ai' AND d.label = 'ai')),
asg AS (SELECT idx, actor, CASE WHEN list_contains(ai, actor) THEN 'ai' ELSE 'human' END AS label
        FROM sub CROSS JOIN lab)"""
LONG = """
lng AS (SELECT actor_1, actor_2, 'l1' AS metric, l1 AS distance FROM dst
        UNION ALL SELECT actor_1, actor_2, 'js', js FROM dst)"""


def labelled_sql(assignments: str) -> str:
    return f"""
lbl AS (SELECT p.*, x.idx, x.label AS label_1, y.label AS label_2,
          CASE WHEN x.label <> y.label THEN 'ai_human' WHEN x.label = 'ai' THEN 'ai_ai' ELSE 'human_human' END AS pair_class
        FROM lng p JOIN {assignments} x ON x.actor = p.actor_1
        JOIN {assignments} y ON y.actor = p.actor_2 AND y.idx = x.idx)"""


TRUE = """
tru AS (SELECT -1::BIGINT AS idx, actor, label FROM lab)"""

SUMMARY = """
smr AS (SELECT metric, idx, """ + ", ".join(
    f"count(distance) FILTER (pair_class = '{c}') AS {c}_n, avg(distance) FILTER (pair_class = '{c}') AS {c}_mean, "
    f"median(distance) FILTER (pair_class = '{c}') AS {c}_median, "
    f"CASE WHEN count(distance) FILTER (pair_class = '{c}') > 0 THEN "
    f"coalesce(stddev_samp(distance) FILTER (pair_class = '{c}'), 0) END AS {c}_std"
    for c in gs.CLASSES
) + " FROM lbl GROUP BY ALL)"

SILHOUETTE = """
mir AS (SELECT metric, idx, actor_1 AS actor, label_1 AS label, label_1 = label_2 AS same, distance FROM lbl
        UNION ALL SELECT metric, idx, actor_2, label_2, label_1 = label_2, distance FROM lbl),
sab AS (SELECT metric, idx, actor, label, avg(distance) FILTER (same) AS a, avg(distance) FILTER (NOT same) AS b
        FROM mir GROUP BY ALL),
sil AS (SELECT metric, idx, actor, label, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0
          ELSE (b - a) / greatest(a, b) END AS s FROM sab),
sls AS (SELECT metric, idx, avg(s) AS silhouette_overall_mean, avg(s) FILTER (label = 'ai') AS silhouette_ai_mean,
          avg(s) FILTER (label = 'human') AS silhouette_human_mean FROM sil GROUP BY ALL)"""

# U by direct comparison of all value pairs.
U_TESTS = """
uts AS (SELECT x.metric, x.idx, y.pair_class AS within, count(*) AS nm,
          sum(CASE WHEN x.distance > y.distance THEN 1.0 WHEN x.distance = y.distance THEN 0.5 ELSE 0 END) AS u
        FROM lbl x JOIN lbl y ON x.metric = y.metric AND x.idx = y.idx AND x.pair_class = 'ai_human'
          AND y.pair_class <> 'ai_human' GROUP BY ALL)"""

EVENT_LONG = f"{EVENT_COUNTS}, {pair_sql()}, {LONG}"


@query("p1_true_labels", f"WITH {EVENT_COUNTS}, {ACTORS} SELECT -1::BIGINT AS idx, actor, label FROM lab")
def true_labels(spark, sf):
    return gs.true_assignment(event_actors(spark, sf))


@query(
    "p2_shuffled_labels",
    f"""WITH {EVENT_COUNTS}, {ACTORS}, r AS (SELECT actor, row_number() OVER (ORDER BY md5(actor || '|7'), actor) AS k FROM lab)
      SELECT 7::BIGINT AS idx, actor, CASE WHEN k <= (SELECT count(*) FROM lab WHERE label = 'ai') THEN 'ai' ELSE 'human' END
      AS label FROM r""",
)
def shuffled_labels(spark, sf):
    return gs.shuffled_assignment(event_actors(spark, sf), 7)


@query("p3_null_labelings", f"WITH {EVENT_COUNTS}, {SUBSETS} SELECT idx, actor, label FROM asg")
def null_labelings(spark, sf):
    return gs.indexed_assignments(event_actors(spark, sf))


@query(
    "p4_labeling_count",
    f"""WITH {EVENT_COUNTS}, {SUBSETS} SELECT count(*) AS n, (SELECT count(*) FROM lab) AS actors,
        (SELECT count(*) FROM lab WHERE label = 'ai') AS ais FROM sub""",
)
def labeling_count(spark, sf):
    return gs.labeling_counts(event_actors(spark, sf)).withColumnRenamed("mine", "ais")


@query(
    "p5_human_labelings",
    f"""WITH {WORD_COUNTS}, {ACTORS},
      sub AS (SELECT row_number() OVER (ORDER BY a.actor, b.actor, c.actor, d.actor) - 1 AS idx,
          [a.actor, b.actor, c.actor, d.actor] AS hs
        FROM lab a JOIN lab b ON a.actor < b.actor JOIN lab c ON b.actor < c.actor JOIN lab d ON c.actor < d.actor
        WHERE NOT (a.label = 'human' AND b.label = 'human' AND c.label = 'human' AND d.label = 'human'))
      SELECT idx, actor, CASE WHEN list_contains(hs, actor) THEN 'human' ELSE 'ai' END AS label FROM sub CROSS JOIN lab""",
)
def human_labelings(spark, sf):
    return gs.indexed_assignments(catalog.discover_actors(v_lines(spark, sf)), side="human")


@query(
    "p6_pair_classes",
    f"""WITH {EVENT_LONG}, {ACTORS}, {TRUE}, {labelled_sql('tru')}
      SELECT metric, actor_1, actor_2, pair_class, round(distance, {R}) AS distance FROM lbl""",
)
def pair_classes(spark, sf):
    labelled = gs.label_pairs(event_distances(spark, sf), gs.true_assignment(event_actors(spark, sf)))
    return rounded(labelled.select("metric", "actor_1", "actor_2", "pair_class", "distance"), "distance")


SUMMARY_COLUMNS = [f"{c}_{s}" for c in gs.CLASSES for s in ("n", "mean", "median", "std")]
SIL_COLUMNS = [f"silhouette_{s}_mean" for s in ("overall", "ai", "human")]


def _rounded_list(columns):
    return ", ".join(c if c.endswith("_n") else f"round({c}, {R}) AS {c}" for c in columns)


@query(
    "p7_class_summary",
    f"""WITH {EVENT_LONG}, {ACTORS}, {TRUE}, {labelled_sql('tru')}, {SUMMARY}
      SELECT metric, {_rounded_list(SUMMARY_COLUMNS)} FROM smr""",
)
def class_summary(spark, sf):
    labelled = gs.label_pairs(event_distances(spark, sf), gs.true_assignment(event_actors(spark, sf)))
    wide = gs.class_summary(labelled, ["metric"])
    return rounded(wide, *[c for c in SUMMARY_COLUMNS if not c.endswith("_n")])


@query(
    "p8_cliffs_delta",
    f"""WITH {EVENT_LONG}, {SUBSETS}, {labelled_sql('asg')}, {U_TESTS}
      SELECT metric, idx, 'ai_human_vs_' || within AS test, u::DOUBLE AS u,
        round(2 * u / nm - 1, {R}) AS cliffs_delta FROM uts""",
)
def cliffs_delta(spark, sf):
    labelled = gs.label_pairs(event_distances(spark, sf), gs.indexed_assignments(event_actors(spark, sf)))
    tests = gs.separation_tests(labelled, ["metric", "idx"])
    return rounded(tests.select("metric", "idx", "test", "u", "cliffs_delta"), "cliffs_delta")


# Number of ways to reach each rank sum with six of 6 + 16 ranks: the exact U distribution.
U_COUNTS = """
ways(k, j, s, w) AS (
  SELECT 0, 0, 0, 1.0::DOUBLE
  UNION ALL
  SELECT k, j, s, sum(w) FROM (
    SELECT k + 1 AS k, j, s, w FROM ways WHERE k < 22
    UNION ALL SELECT k + 1, j + 1, s + k + 1, w FROM ways WHERE k < 22 AND j < 6) GROUP BY k, j, s),
law AS (SELECT s - 21 AS u, w / sum(w) OVER () AS pr FROM ways WHERE k = 22 AND j = 6)"""


@query(
    "p9_mann_whitney",
    f"""WITH RECURSIVE {WORD_COUNTS}, {pair_sql()}, {LONG}, {ACTORS}, {TRUE}, {labelled_sql('tru')}, {U_TESTS}, {U_COUNTS}
      SELECT metric, 'ai_human_vs_' || within AS test, u::DOUBLE AS u, round(least(1.0, 2 * (SELECT sum(pr) FROM law
        WHERE law.u >= greatest(uts.u, nm - uts.u))), {R}) AS p_value FROM uts""",
)
def mann_whitney(spark, sf):
    """Exact two-sided p for 16 against 6 pairs."""
    lines = v_lines(spark, sf)
    pairs = dist.long_distances(dist.pair_distances(dist.word_counts(lines)))
    labelled = gs.label_pairs(pairs, gs.true_assignment(catalog.discover_actors(lines)))
    tests = ranktests.with_mann_whitney_p(gs.separation_tests(labelled, ["metric"]))
    return rounded(tests.select("metric", "test", "u", "p_value"), "p_value")


@query(
    "p10_silhouette",
    f"""WITH {EVENT_LONG}, {SUBSETS}, {labelled_sql('asg')}, {SILHOUETTE}
      SELECT metric, idx, {_rounded_list(SIL_COLUMNS)} FROM sls""",
)
def silhouette(spark, sf):
    labelled = gs.label_pairs(event_distances(spark, sf), gs.indexed_assignments(event_actors(spark, sf)))
    return rounded(gs.silhouette_summary(labelled, ["metric", "idx"]), *SIL_COLUMNS)


U_COLUMNS = [f"mw_{t}_{s}" for t in gs.TESTS for s in ("u", "cliffs_delta")]
U_WIDE = ", ".join(
    f"max(u) FILTER (within = '{w}')::DOUBLE AS mw_{t}_u, max(2 * u / nm - 1) FILTER (within = '{w}') AS mw_{t}_cliffs_delta"
    for t, w in gs.TESTS.items()
)
REPORT_COLUMNS = [*SUMMARY_COLUMNS, *SIL_COLUMNS, *U_COLUMNS]


def report_sql(assignments: str) -> str:
    return f"""{labelled_sql(assignments)}, {SUMMARY}, {SILHOUETTE}, {U_TESTS},
      utw AS (SELECT metric, idx, {U_WIDE} FROM uts GROUP BY ALL),
      rep AS (SELECT * FROM smr JOIN sls USING (metric, idx) JOIN utw USING (metric, idx))"""


@query(
    "p11_group_report",
    f"""WITH {EVENT_LONG}, {ACTORS}, {TRUE}, {report_sql('tru')} SELECT metric, idx, {_rounded_list(REPORT_COLUMNS)} FROM rep""",
)
def observed_group_report(spark, sf):
    """The whole statistics row for the observed labels."""
    report = gs.group_report(
        event_distances(spark, sf), gs.true_assignment(event_actors(spark, sf)), ["metric"], p_values=False
    )
    kept = report.select("metric", "idx", *REPORT_COLUMNS)
    return rounded(kept, *[c for c in REPORT_COLUMNS if not c.endswith("_n")])


@query(
    "p11_null_report",
    f"""WITH {EVENT_LONG}, {SUBSETS}, {report_sql('asg')} SELECT metric, idx, {_rounded_list(REPORT_COLUMNS)} FROM rep""",
)
def null_group_report(spark, sf):
    """All null labelings of all distances in one job."""
    report = one_gram.null_report(
        event_distances(spark, sf), ["metric"], event_actors(spark, sf), p_values=False
    )
    kept = report.select("metric", "idx", *REPORT_COLUMNS)
    return rounded(kept, *[c for c in REPORT_COLUMNS if not c.endswith("_n")])


@query(
    "p12_pair_check",
    f"""WITH {EVENT_LONG} SELECT metric, 1::BIGINT AS missing, 1::BIGINT AS unknown_actors, 0::BIGINT AS repeated,
        0::BIGINT AS undefined FROM lng WHERE actor_1 <> 'GPT0' OR actor_2 <> 'GPT1' GROUP BY metric
      HAVING count(*) = 44""",
)
def pair_check(spark, sf):
    """A table without one pair, checked against a catalog without one actor and with a new one."""
    pairs = event_distances(spark, sf).where("actor_1 <> 'GPT0' OR actor_2 <> 'GPT1'")
    actors = event_actors(spark, sf)
    renamed = actors.select(F.when(F.col("actor") == "H9", "X9").otherwise(F.col("actor")).alias("actor"))
    return gs.check_pairs(pairs, renamed, ["metric"])


@query(
    "p13_humans_first",
    f"""WITH {EVENT_COUNTS}, {ACTORS} SELECT actor, label, row_number() OVER (ORDER BY label = 'ai', actor) AS place FROM lab""",
)
def humans_first(spark, sf):
    ordered = gs.humans_first(catalog.actor_groups(event_actors(spark, sf)))
    return ordered.select("actor", "label", "place")


# ---- H: null evaluation ----

SERIES = """
ser AS (SELECT metric, idx, unnest(['silhouette', 'cliffs_delta_mean', 'normalized_mean_difference']) AS separation,
          unnest([silhouette_overall_mean, (mw_ai_human_vs_ai_ai_cliffs_delta + mw_ai_human_vs_human_human_cliffs_delta) / 2,
            (ai_human_mean - (ai_ai_mean + human_human_mean) / 2)
              / nullif(ai_human_mean + (ai_ai_mean + human_human_mean) / 2, 0)]) AS value FROM rep)"""
NULL_SERIES = f"{EVENT_LONG}, {SUBSETS}, {report_sql('asg')}, {SERIES}"


def null_stats(spark, sf):
    return one_gram.null_report(
        event_distances(spark, sf), ["metric"], event_actors(spark, sf), p_values=False
    )


def null_series(spark, sf):
    return nulls.metric_series(null_stats(spark, sf), ["metric", "idx"])


@query("h1_metric_series", f"WITH {NULL_SERIES} SELECT metric, idx, separation, round(value, {R}) AS value FROM ser")
def metric_series(spark, sf):
    return rounded(null_series(spark, sf), "value")


@query(
    "h2_best_rows",
    f"""WITH {NULL_SERIES}, k AS (SELECT metric, idx, separation, round(value, {R}) AS value FROM ser)
      SELECT metric, separation, value, idx FROM k
      QUALIFY row_number() OVER (PARTITION BY metric, separation ORDER BY value DESC, idx) = 1""",
)
def best_rows(spark, sf):
    return nulls.best_rows(rounded(null_series(spark, sf), "value"), ["metric", "separation"], "idx")


@query(
    "h3_mean_values",
    f"WITH {NULL_SERIES} SELECT metric, separation, round(avg(value), {R}) AS value FROM ser GROUP BY ALL",
)
def mean_values(spark, sf):
    return rounded(nulls.mean_values(null_series(spark, sf), ["metric", "separation"]), "value")


OBSERVED = f"""{EVENT_LONG}, {ACTORS}, {TRUE}, {report_sql('tru')}, {SERIES}"""


def _p_sql(tail: str) -> str:
    hit = {
        "right": "n.value >= o.value",
        "left": "n.value <= o.value",
        "two-sided": "abs(n.value - m.value) >= abs(o.value - m.value)",
    }[tail]
    return f"""WITH nul AS (SELECT * FROM (WITH {NULL_SERIES} SELECT metric, separation, round(value, {R}) AS value FROM ser)),
      obs AS (SELECT * FROM (WITH {OBSERVED} SELECT metric, separation, round(value, {R}) AS value FROM ser)),
      mea AS (SELECT metric, separation, avg(value) AS value FROM nul GROUP BY ALL)
      SELECT metric, separation, max(o.value) AS observed, count(*) AS n_null,
        round((1 + count(*) FILTER ({hit})) / (count(*) + 1), {R}) AS p_value, round(1 / (count(*) + 1), {R}) AS floor
      FROM nul n JOIN obs o USING (metric, separation) JOIN mea m USING (metric, separation) GROUP BY ALL"""


def _significance(spark, sf, tail):
    observed = gs.group_report(
        event_distances(spark, sf), gs.true_assignment(event_actors(spark, sf)), ["metric"], p_values=False
    )
    seen = rounded(nulls.metric_series(observed, ["metric"]), "value")
    drawn = rounded(null_series(spark, sf), "value")
    found = nulls.empirical_p(drawn, seen, ["metric", "separation"], tail=tail)
    return rounded(found, "p_value", "floor")


@query("h4_empirical_p_right", _p_sql("right"))
def empirical_p_right(spark, sf):
    return _significance(spark, sf, "right")


@query("h4_empirical_p_left", _p_sql("left"))
def empirical_p_left(spark, sf):
    return _significance(spark, sf, "left")


@query("h4_empirical_p_two_sided", _p_sql("two-sided"))
def empirical_p_two_sided(spark, sf):
    return _significance(spark, sf, "two-sided")


@query(
    "h5_null_summary",
    f"""WITH {NULL_SERIES} SELECT metric, separation, count(*) AS n, round(avg(value), {R}) AS mean,
        round(coalesce(stddev_samp(value), 0), {R}) AS std, round(min(value), {R}) AS min,
        round(median(value), {R}) AS median, round(max(value), {R}) AS max
      FROM ser WHERE value IS NOT NULL GROUP BY ALL""",
)
def null_summary(spark, sf):
    found = nulls.null_summary(null_series(spark, sf), ["metric", "separation"])
    return rounded(found, "mean", "std", "min", "median", "max")
