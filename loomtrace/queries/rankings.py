"""Statistics files, ranking of configurations and of result series, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import ranking, ranktests
from loomtrace.queries.base import query
from loomtrace.queries.groups import (
    ACTORS,
    EVENT_LONG,
    R,
    SUBSETS,
    TRUE,
    event_actors,
    event_distances,
    null_stats,
    report_sql,
    rounded,
)
from loomtrace.operators import groupstats as gs
from loomtrace.plans import one_gram
from loomtrace.session import scratch_path
from loomtrace.sources import catalog, results
from loomtrace.sources.testviews import V_EVENTS, V_LINES, table, v_events, v_lines

NULLS = f"{EVENT_LONG}, {SUBSETS}, {report_sql('asg')}"
SCORED = f"""{NULLS},
sco AS (SELECT metric, idx, ai_human_mean - greatest(ai_ai_mean, human_human_mean) AS mean_separation,
          (ai_human_mean - greatest(ai_ai_mean, human_human_mean)) / nullif(greatest(ai_ai_mean, human_human_mean), 0) AS normalized_mean_separation,
          silhouette_overall_mean AS silhouette_overall,
          (mw_ai_human_vs_ai_ai_cliffs_delta + mw_ai_human_vs_human_human_cliffs_delta) / 2 AS cliffs_delta_mean,
          least(mw_ai_human_vs_ai_ai_cliffs_delta, mw_ai_human_vs_human_human_cliffs_delta) AS cliffs_delta_min FROM rep)"""
SCORES = ("mean_separation", "normalized_mean_separation", "silhouette_overall", "cliffs_delta_mean", "cliffs_delta_min")


def scored(spark, sf):
    """Every null labeling as a configuration to rank."""
    return ranking.derived_scores(null_stats(spark, sf))


# ---- S: files ----


@query(
    "s10_statistics_scan",
    f"""WITH {EVENT_LONG}, {ACTORS}, {TRUE}, {report_sql('tru')} SELECT 'one_gram' AS approach, metric AS distance_name, metric AS parameter,
        10::BIGINT AS labels, round(silhouette_overall_mean, {R}) AS silhouette, round(ai_human_mean, {R}) AS ai_human_mean FROM rep""",
)
def statistics_scan(spark, sf):
    """Statistics rows written in two appends and read back."""
    path = scratch_path(spark, "statistics")
    actors = event_actors(spark, sf)
    names = actors.agg(F.array_sort(F.collect_set("actor")).alias("names"))
    report = one_gram.observed_report(event_distances(spark, sf), ["metric"], actors).join(F.broadcast(names))
    rows = results.statistics_rows(
        report, approach="one_gram", distance_name=F.col("metric"), labels=F.col("names"),
        hyperparameters=F.struct(F.col("metric").alias("parameter")),
    )
    for name in ("l1", "js"):
        results.append_statistics(rows.where(F.col("distance_name") == name), path)
    found = results.read_statistics(spark, path)
    return found.select(
        "approach",
        "distance_name",
        F.col("hyperparameters")["parameter"].alias("parameter"),
        F.size("ordered_labels").cast("long").alias("labels"),
        F.round("silhouette_overall_mean", R).alias("silhouette"),
        F.round("ai_human_mean", R).alias("ai_human_mean"),
    )


SERIES_SQL = f"""{V_EVENTS},
res AS (SELECT 'tfidf_' || token || '_nested_60_1' AS source, user_id AS outer_i, round(avg(value), 10) AS test_f1_macro FROM v_events GROUP BY ALL)"""


def result_series(spark, sf):
    """Result series: event types are models, users outer splits, the mean value the score."""
    return (
        v_events(spark, sf)
        .groupBy(F.concat(F.lit("tfidf_"), "token", F.lit("_nested_60_1")).alias("source"), F.col("user_id").alias("outer_i"))
        .agg(F.round(F.avg("value"), 10).alias("test_f1_macro"))
    )


@query("s11_result_scan", f"WITH {SERIES_SQL} SELECT source, outer_i, test_f1_macro FROM res")
def result_scan(spark, sf):
    """Result series written one folder each, read back by glob and name."""
    path = scratch_path(spark, "results")
    series = result_series(spark, sf).withColumn("folder", F.col("source"))
    series.write.partitionBy("folder").option("header", "true").csv(path)
    found = results.read_results(spark, path, "test_f1_macro", name="nested")
    name = F.regexp_extract("source", "=(.*)$", 1)
    return found.select(name.alias("source"), "outer_i", "test_f1_macro")


@query("s14_result_sink", f"WITH {SERIES_SQL} SELECT source, count(*) AS n, round(sum(test_f1_macro), 6) AS total FROM res GROUP BY source")
def result_sink(spark, sf):
    path = scratch_path(spark, "sorted")
    results.write_results(result_series(spark, sf), path)
    back = spark.read.option("header", "true").csv(path)
    return back.groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("test_f1_macro").cast("double")), 6).alias("total")
    )


@query(
    "s15_aggregated_views",
    f"""WITH {V_LINES}, l AS (SELECT actor, log_type AS experiment, CASE WHEN contains(actor, 'GPT') THEN 'ai' ELSE 'human' END AS label, text FROM v_lines)
      SELECT actor, experiment, label, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM l
      GROUP BY GROUPING SETS ((actor), (experiment, label), (label))""",
)
def aggregated_views(spark, sf):
    """Per actor, per experiment and class, and per class, in one pass."""
    lines = v_lines(spark, sf).withColumn("label", catalog.class_label(F.col("actor")))
    named = lines.withColumnRenamed("log_type", "experiment")
    sets = [[F.col("actor")], [F.col("experiment"), F.col("label")], [F.col("label")]]
    grouped = named.groupingSets(sets, "actor", "experiment", "label")
    return grouped.agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(
    "n17_model_labels",
    """WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'results/tfidf_svm_nested_' || doc_id || '.csv' WHEN 1 THEN 'knn_60_nested_x.csv'
        WHEN 2 THEN 'audit_nb_nested_7.csv' WHEN 3 THEN 'dummy_stratified.csv' ELSE 'my-model_v2_nested_.csv' END AS file FROM documents)
      SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'TF-IDF + SVM' WHEN 1 THEN 'kNN' WHEN 2 THEN 'Audit NB' WHEN 3 THEN 'Dummy (stratified)'
        ELSE 'My Model V2' END AS label FROM f""",
)
def model_labels(spark, sf):
    names = F.array(
        F.concat(F.lit("results/tfidf_svm_nested_"), "doc_id", F.lit(".csv")),
        F.lit("knn_60_nested_x.csv"),
        F.lit("audit_nb_nested_7.csv"),
        F.lit("dummy_stratified.csv"),
        F.lit("my-model_v2_nested_.csv"),
    )
    file = F.get(names, (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select("doc_id", results.model_label(file).alias("label"))


# ---- R: ranking ----


@query("r1_derived_scores", f"WITH {SCORED} SELECT metric, idx, " + ", ".join(f"round({c}, {R}) AS {c}" for c in SCORES) + " FROM sco")
def derived_scores(spark, sf):
    return rounded(scored(spark, sf).select("metric", "idx", *SCORES), *SCORES)


HARD = """ai_human_mean > ai_ai_mean AND ai_human_mean > human_human_mean AND silhouette_overall_mean > 0
  AND mw_ai_human_vs_ai_ai_cliffs_delta > 0 AND mw_ai_human_vs_human_human_cliffs_delta > 0"""


@query("r2_hard_filter", f"WITH {NULLS} SELECT metric, idx FROM rep WHERE {HARD}")
def hard_filter(spark, sf):
    return ranking.hard_filter(null_stats(spark, sf)).select("metric", "idx")


DEDUP = f"""{SCORED},
dup AS (SELECT metric, idx, round(normalized_mean_separation, 1) AS normalized_mean_separation, round(silhouette_overall, 1) AS silhouette_overall,
          round(cliffs_delta_mean, 1) AS cliffs_delta_mean FROM sco)"""


def coarse(spark, sf):
    """Scores cut to one decimal, so that many coincide."""
    rows = scored(spark, sf).select("metric", "idx", *ranking.CORE)
    return rows.withColumns({c: F.round(c, 1) for c in ranking.CORE})


@query(
    "r3_drop_duplicates",
    f"""WITH {DEDUP} SELECT * FROM dup QUALIFY row_number() OVER (PARTITION BY normalized_mean_separation, silhouette_overall, cliffs_delta_mean
        ORDER BY metric, idx) = 1""",
)
def drop_duplicates(spark, sf):
    return ranking.drop_duplicates(coarse(spark, sf), ["metric", "idx"])


@query(
    "r4_min_max",
    f"WITH {SCORED} SELECT metric, idx, " + ", ".join(
        f"round(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), {R}) AS {c}_norm" for c in ranking.CORE
    ) + " FROM sco",
)
def min_max(spark, sf):
    scaled = ranking.min_max(scored(spark, sf).select("metric", "idx", *ranking.CORE))
    names = [f"{c}_norm" for c in ranking.CORE]
    return rounded(scaled.select("metric", "idx", *names), *names)


RANKED = ", ".join(
    f"(rank() OVER (ORDER BY {c} DESC))::DOUBLE AS {c}_rank, ({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) AS {c}_norm"
    for c in ranking.CORE
)


@query(
    "r5_competition_ranks",
    f"WITH {DEDUP} SELECT metric, idx, " + ", ".join(f"(rank() OVER (ORDER BY {c} DESC))::DOUBLE AS {c}_rank" for c in ranking.CORE) + " FROM dup",
)
def competition_ranks(spark, sf):
    return ranking.competition_ranks(coarse(spark, sf)).select("metric", "idx", *[f"{c}_rank" for c in ranking.CORE])


COMPOSITE = f"""{DEDUP}, rnk AS (SELECT metric, idx, {RANKED} FROM dup),
cmp AS (SELECT metric, idx, 0.2::DOUBLE * normalized_mean_separation_norm + 0.3::DOUBLE * silhouette_overall_norm + 0.5::DOUBLE * cliffs_delta_mean_norm AS composite_score,
  0.2::DOUBLE * normalized_mean_separation_rank + 0.3::DOUBLE * silhouette_overall_rank + 0.5::DOUBLE * cliffs_delta_mean_rank AS rank_aggregate_score FROM rnk)"""


@query("r6_composite", f"WITH {COMPOSITE} SELECT metric, idx, round(composite_score, {R}) AS composite_score, round(rank_aggregate_score, {R}) AS rank_aggregate_score FROM cmp")
def composite(spark, sf):
    found = ranking.composite(coarse(spark, sf))
    return rounded(found.select("metric", "idx", "composite_score", "rank_aggregate_score"), "composite_score", "rank_aggregate_score")


@query(
    "r7_top_rows",
    f"WITH {COMPOSITE} SELECT metric, idx, round(rank_aggregate_score, {R}) AS rank_aggregate_score FROM cmp ORDER BY round(rank_aggregate_score, 12), metric, idx LIMIT 10",
)
def top_rows(spark, sf):
    top = ranking.top_rows(
        ranking.composite(coarse(spark, sf)), "rank_aggregate_score", 10, order=["metric", "idx"], ascending=True
    )
    return rounded(top.select("metric", "idx", "rank_aggregate_score"), "rank_aggregate_score")


@query(
    "r8_rank_series",
    f"""WITH {SERIES_SQL}, m AS (SELECT source, avg(test_f1_macro) AS mean, count(*) AS n FROM res GROUP BY source)
      SELECT source, round(mean, {R}) AS mean, n, row_number() OVER (ORDER BY round(mean, 12) DESC, source) AS position FROM m""",
)
def rank_series(spark, sf):
    return rounded(ranking.rank_series(result_series(spark, sf), "source", "test_f1_macro"), "mean")


@query(
    "r9_series_quartiles",
    f"""WITH {SERIES_SQL} SELECT source, count(*) AS n, min(test_f1_macro) AS min, round(quantile_cont(test_f1_macro, 0.25), 6) AS q1,
        round(quantile_cont(test_f1_macro, 0.5), 6) AS median, round(quantile_cont(test_f1_macro, 0.75), 6) AS q3,
        max(test_f1_macro) AS max, round(avg(test_f1_macro), 6) AS mean FROM res GROUP BY source""",
)
def series_quartiles(spark, sf):
    found = ranking.series_quartiles(result_series(spark, sf), "source", "test_f1_macro")
    return found.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "mean")})


COMMON = f"""{SERIES_SQL}, ok AS (SELECT outer_i FROM res GROUP BY outer_i HAVING count(*) = 5), fin AS (SELECT * FROM res WHERE outer_i IN (SELECT outer_i FROM ok)),
top AS (SELECT source FROM fin GROUP BY source ORDER BY round(avg(test_f1_macro), 12) DESC, source LIMIT 3),
dif AS (SELECT a.source AS "left", b.source AS "right", a.test_f1_macro - b.test_f1_macro AS diff FROM fin a JOIN fin b ON a.outer_i = b.outer_i AND a.source < b.source
  WHERE a.source IN (SELECT source FROM top) AND b.source IN (SELECT source FROM top)),
mag AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY "left", "right", round(abs(diff), 12)) - 1) / 2 AS r FROM dif WHERE diff <> 0
  WINDOW w AS (PARTITION BY "left", "right" ORDER BY round(abs(diff), 12)))"""


@query(
    "r10_signed_rank",
    f"""WITH {COMMON} SELECT "left", "right", count(*) AS n, (SELECT count(*) FROM dif d WHERE d."left" = m."left" AND d."right" = m."right" AND diff = 0) AS zeros,
        least(sum(CASE WHEN diff > 0 THEN r ELSE 0 END), sum(CASE WHEN diff < 0 THEN r ELSE 0 END)) AS w FROM mag m GROUP BY "left", "right" """,
)
def signed_rank(spark, sf):
    """Paired comparison of the three best series over the splits all series have."""
    found = result_series(spark, sf)
    full = found.groupBy("outer_i").agg(F.count("*").alias("n")).where("n = 5").select("outer_i")
    runs = found.join(full, "outer_i")
    best = ranking.rank_series(runs, "source", "test_f1_macro").where("position <= 3")
    names = [r["source"] for r in best.collect()]
    diffs = ranktests.paired_differences(runs, "source", "outer_i", "test_f1_macro", names)
    return ranktests.signed_rank(diffs, ["left", "right"]).select("left", "right", "n", "zeros", "w")


@query("r10_signed_rank_p")
def signed_rank_p(spark, sf):
    found = result_series(spark, sf)
    full = found.groupBy("outer_i").agg(F.count("*").alias("n")).where("n = 5").select("outer_i")
    runs = found.join(full, "outer_i")
    names = [r["source"] for r in ranking.rank_series(runs, "source", "test_f1_macro").where("position <= 3").collect()]
    diffs = ranktests.paired_differences(runs, "source", "outer_i", "test_f1_macro", names)
    return ranktests.with_signed_rank_p(ranktests.signed_rank(diffs, ["left", "right"]))


@query(
    "r11_best_result",
    f"""WITH {SERIES_SQL}, b AS (SELECT outer_i, avg(test_f1_macro) AS m FROM res GROUP BY outer_i)
      SELECT outer_i, round(m, 6) AS test_f1_macro FROM b ORDER BY round(m, 6) DESC, outer_i LIMIT 1""",
)
def best_result(spark, sf):
    means = result_series(spark, sf).groupBy("outer_i").agg(F.round(F.avg("test_f1_macro"), 6).alias("test_f1_macro"))
    return ranking.best_result(means, "test_f1_macro")


@query("p11_report_with_p")
def report_with_p(spark, sf):
    """The observed report with its Mann-Whitney p-values."""
    return gs.group_report(
        event_distances(spark, sf), gs.true_assignment(event_actors(spark, sf)), ["metric"]
    )
