"""Splits, features, models, scores, neighbours and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import attribution, evaluation, features, models, neighbours, splits
from loomtrace.operators import timing, windows
from loomtrace.plans import leave_out, moments, nested
from loomtrace.plans.ordered import along
from loomtrace.queries.base import query
from loomtrace.queries.behaviour import GAPS, log_gaps
from loomtrace.queries.groups import R, rounded
from loomtrace.session import anchor
from loomtrace.sources import catalog
from loomtrace.sources.testviews import (
    PLACES,
    V_CHAT,
    V_EMB,
    V_EVENTS,
    V_LINES,
    V_PRED,
    event_tasks,
    v_chat,
    v_documents,
    v_emb,
    v_events,
    v_lines,
    v_pred,
)

# ---- K: splits ----


def labelled_events(spark, sf):
    return v_events(spark, sf).select(
        F.col("event_id").alias("example_id"),
        "actor",
        catalog.class_label(F.col("actor")).alias("label"),
        F.col("user_id").alias("group"),
        "token",
    )


LABELLED = f"""{V_EVENTS},
lev AS (SELECT event_id AS example_id, actor, CASE WHEN contains(actor, 'GPT') THEN 'ai' ELSE 'human' END AS label,
          user_id AS "group", token FROM v_events)"""
PART = """CASE WHEN actor IN ('H4', 'GPT0') THEN 'val' WHEN actor IN ('H5', 'GPT1') THEN 'test' ELSE 'train' END"""


@query(
    "k1_fixed_split",
    f"""WITH {LABELLED} SELECT {PART} AS part, label, count(*) AS n FROM lev GROUP BY ALL""",
)
def fixed_split(spark, sf):
    split = splits.fixed_split(labelled_events(spark, sf), ["H4", "GPT0"], ["H5", "GPT1"])
    return split.groupBy("part", "label").agg(F.count("*").alias("n"))


@query(
    "k2_random_split",
    f"""WITH {LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(example_id || '|42'), example_id) - 1 AS p,
        count(*) OVER (PARTITION BY label) AS n FROM lev),
      s AS (SELECT *, floor(n * 0.2::DOUBLE + 0.5) AS a FROM r),
      t AS (SELECT *, floor((n - a) * (0.1::DOUBLE / (1.0::DOUBLE - 0.2::DOUBLE)) + 0.5) AS b FROM s)
      SELECT example_id, label, CASE WHEN p < a THEN 'test' WHEN p < a + b THEN 'val' ELSE 'train' END AS part FROM t""",
)
def random_split(spark, sf):
    return splits.random_split(labelled_events(spark, sf)).select("example_id", "label", "part")


@query(
    "k3_group_split",
    f"""WITH {LABELLED}, g AS (SELECT DISTINCT "group" FROM lev),
      r AS (SELECT "group", row_number() OVER (ORDER BY md5("group" || '|42'), "group") - 1 AS p, count(*) OVER () AS n FROM g),
      s AS (SELECT *, ceil(n * 0.2::DOUBLE) AS a FROM r),
      t AS (SELECT *, ceil((n - a) * (0.1::DOUBLE / (1.0::DOUBLE - 0.2::DOUBLE))) AS b FROM s)
      SELECT "group", CASE WHEN p < a THEN 'test' WHEN p < a + b THEN 'val' ELSE 'train' END AS part, count(*) AS n
      FROM t JOIN lev USING ("group") GROUP BY ALL""",
)
def group_split(spark, sf):
    split = splits.group_split(labelled_events(spark, sf))
    return split.groupBy("group", "part").agg(F.count("*").alias("n"))


@query(
    "k4_class_pairs",
    f"""WITH {LABELLED}, a AS (SELECT DISTINCT actor, label FROM lev)
      SELECT h.actor AS human, g.actor AS ai FROM a h JOIN a g ON h.label = 'human' AND g.label = 'ai'""",
)
def class_pairs(spark, sf):
    return splits.class_pairs(catalog.discover_actors(v_events(spark, sf)))


OUTER = """out AS (SELECT vh.actor AS val_human, va.actor AS val_ai, th.actor AS test_human, ta.actor AS test_ai
  FROM act vh JOIN act va ON vh.label = 'human' AND va.label = 'ai' JOIN act th ON th.label = 'human' AND th.actor <> vh.actor
  JOIN act ta ON ta.label = 'ai' AND ta.actor <> va.actor)"""


@query(
    "k5_outer_splits",
    f"WITH {LABELLED}, act AS (SELECT DISTINCT actor, label FROM lev), {OUTER} SELECT * FROM out",
)
def outer_splits(spark, sf):
    return splits.outer_splits(catalog.discover_actors(v_events(spark, sf))).drop("outer_i")


SIZES = f"""{LABELLED}, act AS (SELECT DISTINCT actor, label FROM lev), {OUTER},
siz AS (SELECT val_human, val_ai, test_human, test_ai,
  count(*) FILTER (actor NOT IN (val_human, val_ai, test_human, test_ai)) AS n_train,
  count(*) FILTER (actor IN (val_human, val_ai)) AS n_val, count(*) FILTER (actor IN (test_human, test_ai)) AS n_test
  FROM out CROSS JOIN lev GROUP BY ALL)"""


def split_counts(spark, sf):
    """Rows per outer split and part, from rows per actor: events are counted once."""
    events = labelled_events(spark, sf)
    actors = catalog.discover_actors(events)
    table_ = splits.outer_splits(actors)
    parts = splits.split_parts(table_, actors)
    per_actor = events.groupBy("actor").agg(F.count("*").alias("n"))
    sums = [F.sum(F.when(F.col("part") == p, F.col("n"))).alias(f"n_{p}") for p in splits.PARTS]
    counted = parts.join(per_actor, "actor").groupBy("outer_i").agg(*sums)
    return table_.join(counted, "outer_i").drop("outer_i")


@query(
    "k6_size_gates",
    f"WITH {SIZES} SELECT * FROM siz WHERE n_train >= 200 AND n_val >= 2000 AND n_test >= 100",
)
def size_gates(spark, sf):
    sizes = split_counts(spark, sf)
    return sizes.where("n_train >= 200 AND n_val >= 2000 AND n_test >= 100")


@query(
    "k7_split_profile",
    f"""WITH {LABELLED} SELECT part, count(*) AS n, count(*) FILTER (label = 'ai') AS n_ai,
        count(*) FILTER (label = 'human') AS n_human, count(DISTINCT "group") AS n_groups
      FROM (SELECT *, {PART} AS part FROM lev) GROUP BY part""",
)
def split_profile(spark, sf):
    split = splits.fixed_split(labelled_events(spark, sf), ["H4", "GPT0"], ["H5", "GPT1"])
    return splits.split_profile(split)


@query(
    "k8_selection",
    f"""WITH {V_EVENTS}, s AS (SELECT actor, user_id AS candidate, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS v,
        avg(CASE WHEN event_id % 2 = 1 THEN value END) AS t FROM v_events GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY round(v, 1) DESC, candidate) AS r FROM s WHERE v IS NOT NULL)
      SELECT actor, candidate, round(v, 1) AS val_score, round(t, 1) AS test_score FROM k WHERE r = 1""",
)
def selection(spark, sf):
    """Candidates are users, an actor's mean value on even events is the validation score."""
    part = F.when(F.col("event_id") % 2 == 0, "val").otherwise("test")
    scored = (
        v_events(spark, sf)
        .groupBy("actor", F.col("user_id").alias("candidate"), part.alias("part"))
        .agg(F.round(F.avg("value"), 1).alias("f1_macro"))
    )
    return splits.select_candidates(scored, ["actor"])


# ---- F: features ----

WORDS = r"regexp_extract_all(lower(text), '[\pL\pM\pN_]{2,}')"


def documents(spark, sf, *, dealt=True):
    """Documents as examples: the actor from the source, two actors held out for each part."""
    rows = v_documents(spark, sf, dealt=dealt)
    rows = rows.withColumn("label", catalog.class_label(F.col("actor")))
    return splits.fixed_split(rows, ["GPT0", "H4"], ["GPT1", "H5"])


DOCS = """
doc AS (SELECT doc_id AS example_id, text, CASE WHEN k < 4 THEN 'GPT' || k ELSE 'H' || k END AS actor,
          CASE WHEN k < 4 THEN 'ai' ELSE 'human' END AS label,
          CASE WHEN k IN (0, 4) THEN 'val' WHEN k IN (1, 5) THEN 'test' ELSE 'train' END AS part
        FROM (SELECT *, CAST(regexp_extract(source, '[0-9]+') AS INT) % 8 AS k FROM documents))"""
TOKENS = f"""{DOCS},
tok AS (SELECT example_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT example_id, {WORDS} AS w FROM doc)),
one AS (SELECT example_id, t AS term FROM tok)"""
BIGRAMS = """
two AS (SELECT * FROM one UNION ALL SELECT a.example_id, a.t || ' ' || b.t FROM tok a JOIN tok b
          ON a.example_id = b.example_id AND b.i = a.i + 1)"""


def tfidf_sql(source: str, low: int = 2, sublinear: bool = True) -> str:
    local = "1 + ln(tf)" if sublinear else "tf"
    return f"""
cts AS (SELECT example_id, term, count(*) AS tf FROM {source} GROUP BY ALL),
ntr AS (SELECT count(*) AS n FROM doc WHERE part = 'train'),
voc AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(n) AS n FROM cts JOIN doc USING (example_id), ntr
        WHERE part = 'train' GROUP BY term HAVING count(*) >= {low} AND count(*) <= 0.95 * max(n)),
raw AS (SELECT example_id, term, ({local}) * (ln((1 + n) / (1 + df)) + 1) AS w FROM cts JOIN voc USING (term)),
wts AS (SELECT example_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY example_id)) AS weight FROM raw)"""


WORD1 = features.TextFeatures()
WORD2 = features.TextFeatures(ngrams=(1, 2))
CHAR35 = features.TextFeatures(analyzer="char", ngrams=(3, 5), lowercase=False)


@query("f1_word_ngrams", f"WITH {TOKENS}, {BIGRAMS} SELECT example_id, term, count(*) AS tf FROM two GROUP BY ALL")
def word_ngrams(spark, sf):
    return features.term_counts(documents(spark, sf), WORD2)


CHAR_TERMS = """
chr_ AS (SELECT example_id, regexp_replace(text, '[\\t-\\r ][\\t-\\r ]+', ' ', 'g') AS s FROM doc),
grm AS (SELECT example_id, n, substr(s, i, n) AS term FROM (
  SELECT example_id, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM chr_, (VALUES (3), (4), (5)) v(n)))"""


@query(
    "f2_char_ngrams",
    f"WITH {DOCS}, {CHAR_TERMS} SELECT example_id, length(term)::BIGINT AS n, count(*) AS total, count(DISTINCT term) AS kinds "
    "FROM grm GROUP BY ALL",
)
def char_ngrams(spark, sf):
    counts = features.term_counts(documents(spark, sf), CHAR35)
    return counts.groupBy("example_id", F.length("term").cast("long").alias("n")).agg(
        F.sum("tf").alias("total"), F.count("*").alias("kinds")
    )


def text_counts(spark, sf, spec):
    """Documents and their terms, which are made again wherever they are read.

    Cells take many times the room of the texts. Documents are dealt by their key, so that
    nothing of them is shuffled but sums.
    """
    docs = documents(spark, sf)
    return docs, features.term_counts(docs, spec)


def text_features(spark, sf, spec, *, pinned=True):
    """Term counts are read for the vocabulary, the weights and the models, so words are pinned."""
    docs, counts = text_counts(spark, sf, spec)
    counts = anchor(counts) if pinned else counts
    train = docs.where("part = 'train'").select("example_id", "label")
    n_train = train.agg(F.count("*").alias("n"))
    vocab = anchor(features.vocabulary(counts.join(train, "example_id", "left_semi"), n_train, spec))
    return docs, train, counts, vocab


@query(
    "f3_vocabulary",
    f"WITH {TOKENS}, {tfidf_sql('one')} SELECT term, df, cf, n FROM voc ORDER BY cf DESC, term LIMIT 500",
)
def vocabulary(spark, sf):
    spec = features.TextFeatures(max_features=500)
    return text_features(spark, sf, spec)[3]


@query(
    "f4_tfidf",
    f"WITH {TOKENS}, {BIGRAMS}, {tfidf_sql('two')} SELECT example_id, term, round(weight, {R}) AS weight FROM wts",
)
def tfidf(spark, sf):
    _, _, counts, vocab = text_features(spark, sf, WORD2)
    return rounded(features.tfidf(counts, vocab, WORD2), "weight")


@query(
    "f5_presence",
    f"WITH {TOKENS}, {BIGRAMS}, {tfidf_sql('two')} SELECT example_id, term, 1.0::DOUBLE AS weight FROM raw",
)
def presence(spark, sf):
    _, _, counts, vocab = text_features(spark, sf, WORD2)
    return features.presence(counts, vocab, WORD2)


def padded_windows(spark, sf):
    """Gap windows of up to five of every log as examples, zeros behind the short ones.

    Two actors are held out for each part. Examples count along (actor, log_type, window).
    """
    tasks = event_tasks(spark, sf)
    cut = windows.gap_windows(log_gaps(spark, sf), ["actor", "log_type"], size=5, drop_last=False, tasks=tasks)
    rows = along(cut.select("actor", "log_type", "window", "gaps"), [], ["actor", "log_type", "window"], ranges=tasks)
    rows = rows.positions("example_id").frame().withColumn("label", catalog.class_label(F.col("actor")))
    split = splits.fixed_split(rows, ["GPT0", "H4"], ["GPT1", "H5"])
    return timing.pad_arrays(split, "gaps", timing.padded_length(split, "gaps"))


WINDOWS = f"""{GAPS},
wdw AS (SELECT *, row_number() OVER (ORDER BY actor, log_type, w) - 1 AS example_id
        FROM (SELECT actor, log_type, gap_pos // 5 AS w, count(*) AS n FROM gps GROUP BY ALL)),
prt AS (SELECT *, CASE WHEN contains(actor, 'GPT') THEN 'ai' ELSE 'human' END AS label,
          CASE WHEN actor IN ('GPT0', 'H4') THEN 'val' WHEN actor IN ('GPT1', 'H5') THEN 'test' ELSE 'train' END AS part FROM wdw),
win AS (SELECT example_id, label, part, i, coalesce(gap, 0)::DOUBLE AS x
        FROM prt CROSS JOIN (SELECT unnest(range((SELECT max(n) FROM prt WHERE part = 'train'))) AS i)
        LEFT JOIN gps g ON g.actor = prt.actor AND g.log_type = prt.log_type AND gap_pos = 5 * w + i)"""


@query(
    "f6_standard_scaling",
    f"""WITH {WINDOWS}, f AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM win WHERE part = 'train' GROUP BY i)
      SELECT example_id, i, round((x - mu) / sd, 6) AS x FROM win JOIN f USING (i)""",
)
def standard_scaling(spark, sf):
    scaled = features.standard_scaled(padded_windows(spark, sf), "gaps")
    cells = scaled.select("example_id", F.posexplode("gaps").alias("i", "x"))
    return cells.select("example_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(
    "f7_char_ids",
    f"""WITH {DOCS}, l AS (SELECT least(512, floor(quantile_cont(length(text), 0.95)))::BIGINT AS len FROM doc WHERE part = 'train'),
      c AS (SELECT example_id, part, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM doc),
      a AS (SELECT c, row_number() OVER (ORDER BY c) + 1 AS id FROM (SELECT DISTINCT c FROM c WHERE part = 'train' AND c <> '')),
      e AS (SELECT example_id, i, coalesce(id, 1) AS id FROM c LEFT JOIN a USING (c) WHERE i <= (SELECT len FROM l))
      SELECT example_id, (SELECT len FROM l) AS length, sum(id)::BIGINT AS total, sum(id * i)::BIGINT AS weighted FROM e GROUP BY example_id""",
)
def char_ids(spark, sf):
    docs = documents(spark, sf)
    train = docs.where("part = 'train'")
    coded = features.char_ids(docs, features.alphabet(train), features.train_length(train))
    zero = F.lit(0).cast("long")
    places = F.transform("ids", lambda x, i: x.cast("long") * (i + 1))
    return coded.select(
        "example_id",
        F.size("ids").cast("long").alias("length"),
        F.aggregate("ids", zero, lambda s, x: s + x).alias("total"),
        F.aggregate(places, zero, lambda s, x: s + x).alias("weighted"),
    )


@query(
    "f8_class_weights",
    f"""WITH {V_CHAT} SELECT label, count(*) AS n, round((SELECT count(*) FROM v_chat) / count(*), {R}) AS class_weight
      FROM v_chat GROUP BY label""",
)
def class_weights(spark, sf):
    return rounded(features.class_weights(v_chat(spark, sf)), "class_weight")


# ---- M: models ----


@query(
    "m1_majority",
    f"""WITH {DOCS}, m AS (SELECT label FROM doc WHERE part = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
      SELECT part, label AS y_true, (SELECT label FROM m) AS y_pred, count(*) AS n FROM doc GROUP BY ALL""",
)
def majority(spark, sf):
    found = models.predict_majority(documents(spark, sf))
    return found.groupBy("part", F.col("label").alias("y_true"), "y_pred").agg(F.count("*").alias("n"))


@query(
    "m1_stratified",
    f"""WITH {DOCS}, s AS (SELECT count(*) FILTER (label = 'ai') / count(*) AS sh FROM doc WHERE part = 'train')
      SELECT example_id, CASE WHEN ('0x' || substr(md5(example_id || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < sh
        THEN 'ai' ELSE 'human' END AS y_pred FROM doc, s""",
)
def stratified(spark, sf):
    return models.predict_stratified(documents(spark, sf)).select("example_id", "y_pred")


ALPHAS = (0.01, 0.1, 1.0)
BAYES_SQL = {
    "multinomial": ("ln((s_ai + a) / (t_ai + a * v))", "ln((s_human + a) / (t_human + a * v))", "ln(n_ai / (n_ai + n_human))",
                    "ln(n_human / (n_ai + n_human))"),
    "complement": ("-ln((s_human + a) / (t_human + a * v))", "-ln((s_ai + a) / (t_ai + a * v))", "0", "0"),
}


def bayes_sql(kind: str, weight: str = "weight") -> str:
    grid = ", ".join(f"({a}::DOUBLE)" for a in ALPHAS)
    head = f"""
sms AS (SELECT term, sum(CASE WHEN label = 'ai' THEN {weight} ELSE 0 END) AS s_ai,
          sum(CASE WHEN label = 'human' THEN {weight} ELSE 0 END) AS s_human
        FROM wts JOIN doc USING (example_id) WHERE part = 'train' GROUP BY term),
alp AS (SELECT * FROM (VALUES {grid}) g(a)),
cnt AS (SELECT count(*) FILTER (label = 'ai') AS n_ai, count(*) FILTER (label = 'human') AS n_human FROM doc WHERE part = 'train'),
fit AS (SELECT *, sum(s_ai) OVER (PARTITION BY a) AS t_ai, sum(s_human) OVER (PARTITION BY a) AS t_human,
          count(*) OVER (PARTITION BY a) AS v FROM sms, alp, cnt)"""
    if kind == "bernoulli":
        return head + """,
mod AS (SELECT a, term, ln((s_ai + a) / (n_ai + 2 * a)) AS p_ai, ln((s_human + a) / (n_human + 2 * a)) AS p_human, n_ai, n_human FROM fit),
mo2 AS (SELECT *, p_ai - ln(1 - exp(p_ai)) AS w_ai, p_human - ln(1 - exp(p_human)) AS w_human FROM mod),
bas AS (SELECT a, max(ln(n_human / n_ai)) + sum(ln(1 - exp(p_human)) - ln(1 - exp(p_ai))) AS b FROM mo2 GROUP BY a),
prd AS (SELECT d.example_id, b.a, b.b + coalesce(g, 0) AS score FROM doc d CROSS JOIN bas b LEFT JOIN (
          SELECT example_id, a, sum(w_human - w_ai) AS g FROM wts JOIN mo2 USING (term) GROUP BY ALL) x
          ON x.example_id = d.example_id AND x.a = b.a)"""
    w_ai, w_human, b_ai, b_human = BAYES_SQL[kind]
    return head + f""",
mo2 AS (SELECT a, term, {w_ai} AS w_ai, {w_human} AS w_human FROM fit),
bas AS (SELECT a, {b_human} - ({b_ai}) AS b FROM alp, cnt),
prd AS (SELECT d.example_id, b.a, b.b + coalesce(g, 0) AS score FROM doc d CROSS JOIN bas b LEFT JOIN (
          SELECT example_id, a, sum({weight} * (w_human - w_ai)) AS g FROM wts JOIN mo2 USING (term) GROUP BY ALL) x
          ON x.example_id = d.example_id AND x.a = b.a)"""


PREDICTED = """SELECT a AS alpha, example_id, round(score, 6) AS score, CASE WHEN round(score, 9) > 0 THEN 'human' ELSE 'ai' END AS y_pred FROM prd"""


def bayes_model(spark, sf, kind):
    docs, train, counts, vocab = text_features(spark, sf, WORD1)
    weights = anchor(features.tfidf(counts, vocab, WORD1))
    model = models.fit_bayes(
        weights.join(train, "example_id"), train, kind=kind, alphas=ALPHAS, vocab=vocab
    )
    return docs, weights, model


def bayes_predictions(spark, sf, kind):
    docs, weights, model = bayes_model(spark, sf, kind)
    found = models.predict_bayes(model, weights, docs, binary=kind == "bernoulli")
    return found.withColumn("score", F.round("score", 6))


@query("m6_multinomial_bayes", f"WITH {TOKENS}, {tfidf_sql('one')}, {bayes_sql('multinomial')} {PREDICTED}")
def multinomial_bayes(spark, sf):
    return bayes_predictions(spark, sf, "multinomial")


@query("m6_complement_bayes", f"WITH {TOKENS}, {tfidf_sql('one')}, {bayes_sql('complement')} {PREDICTED}")
def complement_bayes(spark, sf):
    return bayes_predictions(spark, sf, "complement")


@query("m6_bernoulli_bayes", f"WITH {TOKENS}, {tfidf_sql('one')}, {bayes_sql('bernoulli', '1.0::DOUBLE')} {PREDICTED}")
def bernoulli_bayes(spark, sf):
    return bayes_predictions(spark, sf, "bernoulli")


@query(
    "m7_gaussian_bayes",
    f"""WITH {WINDOWS}, f AS (SELECT i, avg(x) FILTER (label = 'ai') AS ma, avg(x) FILTER (label = 'human') AS mh,
        var_pop(x) FILTER (label = 'ai') AS va, var_pop(x) FILTER (label = 'human') AS vh, var_pop(x) AS vv
        FROM win WHERE part = 'train' GROUP BY i),
      p AS (SELECT ln(count(*) FILTER (label = 'human') / count(*) FILTER (label = 'ai')) AS pr FROM win WHERE part = 'train'),
      m AS (SELECT i, ma, mh, va + 1e-9::DOUBLE * (SELECT max(vv) FROM f) AS va, vh + 1e-9::DOUBLE * (SELECT max(vv) FROM f) AS vh FROM f)
      SELECT example_id, part, label, round((SELECT pr FROM p) + sum(-0.5 * ln(2 * pi() * vh) - 0.5 * (x - mh) ** 2 / vh
        + 0.5 * ln(2 * pi() * va) + 0.5 * (x - ma) ** 2 / va), 6) AS score FROM win JOIN m USING (i) GROUP BY example_id, part, label""",
)
def gaussian_bayes(spark, sf):
    found = models.gaussian_bayes(padded_windows(spark, sf), "gaps")
    return found.select("example_id", "part", "label", F.round("score", 6).alias("score"))


NEAR = """
tst AS (SELECT example_id, list(x ORDER BY i) AS v FROM win WHERE part <> 'train' GROUP BY example_id),
trn AS (SELECT example_id, label, list(x ORDER BY i) AS v FROM win WHERE part = 'train' GROUP BY ALL),
dst AS (SELECT t.example_id, label, b.example_id AS nb, list_distance(t.v, b.v) AS d FROM tst t CROSS JOIN trn b),
rnk AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY d, nb) AS r FROM dst),
vot AS (SELECT example_id, k, label, sum(w) AS w FROM (SELECT *, 1.0 AS w FROM rnk, (VALUES (3), (7)) g(k) WHERE r <= k) GROUP BY ALL)"""


@query(
    "m8_nearest_neighbours",
    f"""WITH {WINDOWS}, {NEAR} SELECT example_id AS id, k::BIGINT AS k, label AS y_pred FROM vot
      QUALIFY row_number() OVER (PARTITION BY example_id, k ORDER BY w DESC, label) = 1""",
)
def nearest_neighbours(spark, sf):
    return _votes(spark, sf, "uniform")


def _votes(spark, sf, weights):
    rows = padded_windows(spark, sf).select(
        F.col("example_id").alias("id"),
        F.transform("gaps", lambda x: x.cast("double")).alias("vector"),
        "label",
        "part",
    )
    return neighbours.knn_vote(
        rows.where("part <> 'train'"), rows.where("part = 'train'"), [3, 7], weights=weights
    )


# A neighbour counts 1 / distance; those at distance 0 decide alone.
WEIGHED = """
nbr AS (SELECT example_id, k, label, d, min(d) OVER (PARTITION BY example_id, k) = 0 AS touch FROM rnk, (VALUES (3), (7)) g(k) WHERE r <= k),
wvt AS (SELECT example_id, k, label, sum(CASE WHEN touch THEN CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 0 END ELSE 1 / d END) AS w
        FROM nbr GROUP BY ALL)"""


@query(
    "m8_distance_weights",
    f"""WITH {WINDOWS}, {NEAR}, {WEIGHED} SELECT example_id AS id, k::BIGINT AS k, label AS y_pred FROM wvt
      QUALIFY row_number() OVER (PARTITION BY example_id, k ORDER BY round(w, 9) DESC, label) = 1""",
)
def distance_weights(spark, sf):
    return _votes(spark, sf, "distance")


def _linear(spark, sf, candidate):
    """Held-out scores of a linear model over TF-IDF words."""
    docs, counts = text_counts(spark, sf, WORD1)
    found = nested.text_predictions(docs, counts, WORD1, [(0, candidate)])
    return evaluation.scores(found, ("candidate", "part"))


@query("m2_linear_svm")
def linear_svm(spark, sf):
    return _linear(spark, sf, models.Candidate("svm", {"C": 1.0}))


@query("m3_logistic_regression")
def logistic_regression(spark, sf):
    return _linear(spark, sf, models.Candidate("logreg", {"C": 1.0}))


@query("m4_sgd_objective")
def sgd_objective(spark, sf):
    return _linear(spark, sf, models.Candidate("sgd_log", {"alpha": 1e-4}))


@query("m4_sgd_hinge")
def sgd_hinge(spark, sf):
    return _linear(spark, sf, models.Candidate("sgd_hinge", {"alpha": 1e-4}))


@query("m5_ridge")
def ridge(spark, sf):
    return _linear(spark, sf, models.Candidate("ridge", {"alpha": 1.0}))


@query("m9_random_forest")
def random_forest(spark, sf):
    rows = models.dense_rows(padded_windows(spark, sf), "gaps")
    found = models.predict_linear(rows, models.Candidate("rf"))
    named = found.select(F.lit("rf").alias("run_id"), "part", F.col("label").alias("y_true"), "y_pred")
    return evaluation.scores(named)


@query("m10_timing_grid")
def timing_grid(spark, sf):
    """All candidates of the timing grid in one table."""
    grid = list(enumerate(models.timing_candidates()))
    rows = padded_windows(spark, sf)
    found = nested.timing_predictions(rows, "gaps", grid)
    return evaluation.scores(found, ("candidate", "part"))


def text_views(spark, sf):
    """Whole documents and their lines as examples, which the evaluation deals to its blocks."""
    docs = documents(spark, sf, dealt=False).select("example_id", "actor", "label", "text")
    lines = v_lines(spark, sf, dealt=False).select(
        (F.col("doc_id") * PLACES + F.col("pos")).alias("example_id"),
        "actor",
        catalog.class_label(F.col("actor")).alias("label"),
        "text",
    )
    return {"documents": docs, "lines": lines}


def counted_grid(keep=lambda spec: True):
    """The counted models of the text grid: guesses and naive Bayes."""
    every = [(features.TextFeatures(**spec), c) for spec, c in models.text_candidates() if c.model in leave_out.COUNTED]
    return [(spec, c) for spec, c in every if c.model.startswith("dummy") or keep(spec)]


NESTED_WORDS = f"""{V_LINES}, {DOCS},
ex AS (SELECT 0 AS v, example_id AS id, actor, label, text FROM doc UNION ALL
  SELECT 1, doc_id * {PLACES} + pos, actor, CASE WHEN contains(actor, 'GPT') THEN 'ai' ELSE 'human' END, text FROM v_lines),
act AS (SELECT DISTINCT actor, label FROM ex),
{OUTER},
fld AS (SELECT DISTINCT least(val_human, test_human) || '|' || greatest(val_human, test_human) || '|' || least(val_ai, test_ai) || '|' || greatest(val_ai, test_ai) AS f FROM out),
tra AS (SELECT f, actor, label, contains('|' || f || '|', '|' || actor || '|') AS held FROM fld, act),
siz AS (SELECT v, actor, count(*) AS n FROM ex GROUP BY ALL),
ntr AS (SELECT v, f, sum(n)::BIGINT AS n, sum(CASE WHEN label = 'ai' THEN n ELSE 0 END) AS n_ai, sum(CASE WHEN label = 'human' THEN n ELSE 0 END) AS n_human
  FROM siz JOIN tra USING (actor) WHERE NOT held GROUP BY ALL),
cts AS (SELECT v, id, actor, label, term, count(*) AS tf FROM (SELECT v, id, actor, label, unnest({WORDS}) AS term FROM ex) GROUP BY ALL),
dfs AS (SELECT v, actor, term, count(*) AS df FROM cts GROUP BY ALL),
voc AS (SELECT v, f, term, ln((1 + max(n)) / (1 + sum(df))) + 1 AS idf FROM dfs JOIN tra USING (actor) JOIN ntr USING (v, f) WHERE NOT held
  GROUP BY ALL HAVING sum(df) >= 2 AND sum(df) <= 0.95 * max(n)),
raw AS (SELECT v, f, id, actor, label, term, (1 + ln(tf)) * idf AS x FROM cts JOIN voc USING (v, term)),
len AS (SELECT v, f, id, sqrt(sum(x * x)) AS l FROM raw GROUP BY ALL),
wts AS (SELECT raw.*, x / l AS w, held FROM raw JOIN len USING (v, f, id) JOIN (SELECT f, actor, held FROM tra) USING (f, actor)),
sms AS (SELECT v, f, term, sum(CASE WHEN label = 'ai' THEN w ELSE 0 END) AS s_ai, sum(CASE WHEN label = 'human' THEN w ELSE 0 END) AS s_human
  FROM wts WHERE NOT held GROUP BY ALL),
fit AS (SELECT *, sum(s_ai) OVER (PARTITION BY v, f) AS t_ai, sum(s_human) OVER (PARTITION BY v, f) AS t_human, count(*) OVER (PARTITION BY v, f) AS size FROM sms),
alp AS (SELECT * FROM (VALUES (0, 0.01::DOUBLE), (1, 0.1::DOUBLE), (2, 1.0::DOUBLE)) g(j, a)),
odd AS (SELECT v, f, term, j, ln((s_human + a) / (t_human + a * size)) - ln((s_ai + a) / (t_ai + a * size)) AS o FROM fit, alp),
gns AS (SELECT v, f, id, j, sum(w * o) AS g FROM wts JOIN odd USING (v, f, term) WHERE held GROUP BY ALL),
hld AS (SELECT v, f, id, actor, n, n_ai, ln(n_human / n_ai) AS prior, n_human > n_ai AS most FROM ex JOIN tra USING (actor) JOIN ntr USING (v, f) WHERE held),
prd AS (SELECT v, f, actor, 8 * v AS cand, most AS human FROM hld
  UNION ALL SELECT v, f, actor, 8 * v + 1, ('0x' || substr(md5(id || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= n_ai / n FROM hld
  UNION ALL SELECT v, f, actor, 8 * v + 2 + 2 * j + c, round(coalesce(g, 0) + CASE WHEN c = 0 THEN prior ELSE 0 END, 9) > 0
    FROM hld CROSS JOIN alp CROSS JOIN (VALUES (0), (1)) k(c) LEFT JOIN gns USING (v, f, id, j)),
pn AS (SELECT v, f, actor, cand, count(*) FILTER (human) AS nh, count(*) AS n FROM prd GROUP BY ALL),
prt AS (SELECT val_human, val_ai, test_human, test_ai, unnest(['val', 'val', 'test', 'test']) AS part, unnest([val_human, val_ai, test_human, test_ai]) AS actor,
  least(val_human, test_human) || '|' || greatest(val_human, test_human) || '|' || least(val_ai, test_ai) || '|' || greatest(val_ai, test_ai) AS f FROM out),
sca AS (SELECT val_human, val_ai, test_human, test_ai, f, v, cand, part, sum(n) AS n, sum(CASE WHEN contains(actor, 'GPT') THEN 0 ELSE n END) AS n_h,
  sum(nh) AS p_h, sum(CASE WHEN contains(actor, 'GPT') THEN 0 ELSE nh END) AS h_h, sum(CASE WHEN contains(actor, 'GPT') THEN n - nh ELSE 0 END) AS h_a
  FROM prt JOIN pn USING (f, actor) GROUP BY ALL),
f1 AS (SELECT *, round((2 * h_h / (n_h + p_h) + 2 * h_a / (2 * n - n_h - p_h)) / 2, 9) AS f1 FROM sca),
bst AS (SELECT val_human, val_ai, test_human, test_ai, f, v, cand, max(f1) FILTER (part = 'val') AS val_f1_macro, max(f1) FILTER (part = 'test') AS test_f1_macro,
  max(n) FILTER (part = 'val') AS n_val, max(n) FILTER (part = 'test') AS n_test FROM f1 GROUP BY ALL)"""


@query(
    "k8_nested_words",
    f"""WITH {NESTED_WORDS}
      SELECT val_human, val_ai, test_human, test_ai, ntr.n AS n_train, CASE WHEN v = 0 THEN 'documents' ELSE 'lines' END AS selected_view,
        CASE WHEN cand % 8 = 0 THEN 'dummy_most_frequent' WHEN cand % 8 = 1 THEN 'dummy_stratified' WHEN cand % 2 = 0 THEN 'mnb' ELSE 'cnb' END AS selected_model,
        cand::BIGINT AS selected_candidate, val_f1_macro, test_f1_macro
      FROM bst JOIN ntr USING (v, f) WHERE ntr.n >= 200 AND n_val >= 100 AND n_test >= 100
      QUALIFY row_number() OVER (PARTITION BY val_human, val_ai, test_human, test_ai ORDER BY val_f1_macro DESC, cand) = 1""",
)
def nested_words(spark, sf):
    """All outer splits over two views of the documents: single words, guesses and naive Bayes."""
    grid = counted_grid(lambda spec: spec.ngrams == (1, 1))
    return leave_out.nested_splits(text_views(spark, sf), grid).drop("outer_i")


@query("k8_nested_text")
def nested_text(spark, sf):
    """All outer splits over two views, with every counted word model of the text grid."""
    return leave_out.nested_splits(text_views(spark, sf), counted_grid(lambda spec: spec.analyzer == "word"))


@query("k8_nested_chars")
def nested_chars(spark, sf):
    """All outer splits over whole documents, with every counted character model of the text grid."""
    views = {"documents": text_views(spark, sf)["documents"]}
    return leave_out.nested_splits(views, counted_grid(lambda spec: spec.analyzer == "char"))


def gap_views(spark, sf, sizes):
    """Gap windows of several sizes as examples, short last ones kept."""
    gaps, tasks = log_gaps(spark, sf), event_tasks(spark, sf)
    views = {}
    for size in sizes:
        cut = windows.gap_windows(gaps, ["actor", "log_type"], size=size, drop_last=False, tasks=tasks)
        rows = along(cut.select("actor", "log_type", "window", "gaps"), [], ["actor", "log_type", "window"], ranges=tasks)
        views[f"w{size}"] = rows.positions("example_id").frame().withColumn("label", catalog.class_label(F.col("actor")))
    return views


@query("k8_nested_timing")
def nested_timing(spark, sf):
    """All outer splits over gap windows of three sizes, with the whole timing grid."""
    return moments.nested_dense(gap_views(spark, sf, (5, 10, 25)), models.timing_candidates())


# ---- E: scores ----

CELLS = f"""{V_PRED}, cel AS (SELECT run_id, part, y_true, y_pred, count(*) AS n FROM v_pred GROUP BY ALL),
lbl AS (SELECT run_id, part, label, sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits FROM (
  SELECT run_id, part, y_true AS label, n AS t, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS h FROM cel
  UNION ALL SELECT run_id, part, y_pred, 0, n, 0 FROM cel) GROUP BY ALL),
cls AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1 FROM lbl),
scr AS (SELECT run_id, part, sum(support)::BIGINT AS n, sum(hits) / sum(support) AS accuracy, avg(recall) FILTER (support > 0) AS balanced_accuracy,
  coalesce((sum(hits) * sum(support) - sum(support * predicted)) / nullif(sqrt((sum(support) ** 2 - sum(predicted * predicted))::DOUBLE)
    * sqrt((sum(support) ** 2 - sum(support * support))::DOUBLE), 0), 0) AS mcc,
  (sum(hits) / sum(support) - sum(support * predicted) / sum(support) ** 2) / (1 - sum(support * predicted) / sum(support) ** 2) AS cohen_kappa,
  avg(precision) AS precision_macro, sum(precision * support) / sum(support) AS precision_weighted,
  avg(recall) AS recall_macro, sum(recall * support) / sum(support) AS recall_weighted,
  avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted FROM cls GROUP BY ALL)"""


@query(
    "e1_confusion",
    f"""WITH {CELLS}, g AS (SELECT DISTINCT run_id, part, a AS y_true, b AS y_pred FROM cel, (VALUES ('ai'), ('human')) x(a), (VALUES ('ai'), ('human')) y(b))
      SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN cel USING (run_id, part, y_true, y_pred)""",
)
def confusion(spark, sf):
    return evaluation.confusion(v_pred(spark, sf), labels=["human", "ai"])


SCORES = ("accuracy", "balanced_accuracy", "mcc", "cohen_kappa", "precision_macro", "precision_weighted", "recall_macro",
          "recall_weighted", "f1_macro", "f1_weighted")


def _score_sql(columns):
    return f"WITH {CELLS} SELECT run_id, part, n, " + ", ".join(f"round({c}, {R}) AS {c}" for c in columns) + " FROM scr"


def _scores(spark, sf, columns):
    found = evaluation.scores(v_pred(spark, sf)).select("run_id", "part", "n", *columns)
    return rounded(found, *columns)


@query("e2_accuracy", _score_sql(SCORES[:2]))
def accuracy(spark, sf):
    return _scores(spark, sf, SCORES[:2])


@query("e3_agreement", _score_sql(SCORES[2:4]))
def agreement(spark, sf):
    return _scores(spark, sf, SCORES[2:4])


@query("e4_averages", _score_sql(SCORES[4:]))
def averages(spark, sf):
    return _scores(spark, sf, SCORES[4:])


@query(
    "e5_per_class",
    f"""WITH {CELLS} SELECT run_id, part, label, support, predicted, hits, round(precision, {R}) AS precision, round(recall, {R}) AS recall,
        round(f1, {R}) AS f1 FROM cls""",
)
def per_class(spark, sf):
    found = evaluation.per_class(evaluation.confusion(v_pred(spark, sf)))
    return rounded(found, "precision", "recall", "f1")


@query(
    "e6_leaderboard",
    f"""WITH {CELLS} SELECT run_id, round(f1_macro, {R}) AS f1_macro, round(f1_weighted, {R}) AS f1_weighted, round(accuracy, {R}) AS accuracy
      FROM scr ORDER BY f1_macro DESC, run_id LIMIT 3""",
)
def leaderboard(spark, sf):
    top = evaluation.leaderboard(evaluation.scores(v_pred(spark, sf)), top_k=3)
    return rounded(top, "f1_macro", "f1_weighted", "accuracy")


@query(
    "e7_run_summary",
    f"""WITH {CELLS}, l AS (SELECT unnest(['f1_macro', 'balanced_accuracy']) AS metric, unnest([f1_macro, balanced_accuracy]) AS v FROM scr)
      SELECT metric, count(*) AS n, round(avg(v), {R}) AS mean, round(median(v), {R}) AS median, round(stddev_pop(v), {R}) AS std FROM l GROUP BY metric""",
)
def run_summary(spark, sf):
    found = evaluation.run_summary(evaluation.scores(v_pred(spark, sf)), ["f1_macro", "balanced_accuracy"])
    return rounded(found, "mean", "median", "std")


# ---- V: retrieval ----

EMB_PART = "CASE WHEN substr(md5(id || '|42'), 1, 1) < '4' THEN 'test' ELSE 'train' END"
NORMED = f"""{V_EMB},
nrm AS (SELECT id, label, {EMB_PART} AS part, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-12)) AS v
        FROM v_emb)"""
FOUND = f"""{NORMED},
sim AS (SELECT q.id AS query, b.label, b.id AS neighbour, list_dot_product(q.v, b.v) AS score
        FROM nrm q JOIN nrm b ON q.part = 'test' AND b.part = 'train'),
top AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, neighbour) AS rank FROM sim QUALIFY rank <= 5),
agg AS (SELECT query AS id, avg(score) FILTER (label = 'ai') AS a, avg(score) FILTER (label = 'human') AS h FROM top GROUP BY query)"""


def normalized_vectors(spark, sf):
    """Normalized embeddings; hash parts serve as bank (train) and queries (test)."""
    vectors = v_emb(spark, sf)
    mixed = F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("42"))), 1, 1)
    part = F.when(mixed < "4", "test").otherwise("train")
    return vectors.select("id", "label", part.alias("part"), neighbours.l2_normalized("embedding").alias("vector"))


def retrieved(spark, sf):
    rows = normalized_vectors(spark, sf)
    return neighbours.nearest(rows.where("part = 'test'"), rows.where("part = 'train'"), 5)


@query(
    "v1_normalized",
    f"WITH {NORMED} SELECT id, label, round(v[1], {R}) AS first, round(list_dot_product(v, v), {R}) AS length FROM nrm",
)
def normalized(spark, sf):
    rows = normalized_vectors(spark, sf)
    return rows.select(
        "id", "label", F.round(F.get("vector", F.lit(0)), R).alias("first"),
        F.round(neighbours.dot(F.col("vector"), F.col("vector")), R).alias("length"),
    )


@query(
    "v2_cosine",
    f"""WITH {NORMED}, c AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM nrm),
      m AS (SELECT label, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS a FROM c GROUP BY ALL) GROUP BY label)
      SELECT id, label, round(list_dot_product(v, c), 6) AS similarity FROM nrm JOIN m USING (label)""",
)
def cosine(spark, sf):
    """Similarity of every vector with the centre of its class."""
    rows = normalized_vectors(spark, sf)
    cells = rows.select("label", F.posexplode("vector").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg("x").alias("a"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("c"))
    centre = listed.select("label", F.transform("c", lambda s: s["a"]).alias("centre"))
    similarity = neighbours.dot(F.col("vector"), F.col("centre"))
    return rows.join(centre, "label").select("id", "label", F.round(similarity, 6).alias("similarity"))


@query("v3_top_neighbours", f"WITH {FOUND} SELECT query, label, neighbour, rank, round(score, 6) AS score FROM top")
def top_neighbours(spark, sf):
    return retrieved(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "v4_class_scores",
    f"WITH {FOUND} SELECT id, round(a, 6) AS score_ai, round(h, 6) AS score_human FROM agg",
)
def class_scores(spark, sf):
    rows = normalized_vectors(spark, sf).where("part = 'test'").select("id")
    found = neighbours.class_scores(rows, retrieved(spark, sf))
    return found.select("id", F.round("score_ai", 6).alias("score_ai"), F.round("score_human", 6).alias("score_human"))


@query(
    "v5_decisions",
    f"""WITH {FOUND} SELECT id, label, round(a - h, 6) AS score, CASE WHEN a - h >= 0 THEN 'ai' ELSE 'human' END AS y_pred,
        abs(a - h) < 0.05 AS needs_review FROM agg JOIN nrm USING (id)""",
)
def decisions(spark, sf):
    rows = normalized_vectors(spark, sf).where("part = 'test'").select("id", "label")
    found = neighbours.class_scores(rows, retrieved(spark, sf), margin=0.05)
    return found.select("id", "label", F.round("score", 6).alias("score"), "y_pred", "needs_review")


# ---- X: attribution ----


def chosen_bayes(spark, sf):
    """The multinomial model with alpha 0.1, its features and its predictions."""
    docs, weights, model = bayes_model(spark, sf, "multinomial")
    model = models.Bayes(model.terms.where("alpha = 0.1"), model.base.where("alpha = 0.1"))
    return docs, weights, model


EVIDENCE = f"""{TOKENS}, {tfidf_sql('one')}, {bayes_sql('multinomial')},
wgt AS (SELECT term, w_human - w_ai AS w FROM mo2 WHERE a = 0.1),
evi AS (SELECT example_id, term, w * weight AS e FROM wts JOIN wgt USING (term)),
pr1 AS (SELECT example_id, score, CASE WHEN round(score, 9) > 0 THEN 'human' ELSE 'ai' END AS y_pred FROM prd WHERE a = 0.1),
rk AS (SELECT example_id, term, CASE WHEN y_pred = 'human' THEN e ELSE -e END AS s FROM evi JOIN pr1 USING (example_id)),
tpk AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY round(s, 12) DESC, term) AS rank FROM rk QUALIFY rank <= 3)"""


@query("x1_term_weights", f"WITH {EVIDENCE} SELECT term, round(w, {R}) AS w FROM wgt")
def term_weights(spark, sf):
    _, _, model = chosen_bayes(spark, sf)
    return rounded(attribution.bayes_weights(model).drop("alpha"), "w")


def explained(spark, sf):
    """Documents, their evidence and their three heaviest terms.

    The vocabulary is bounded, so its weights go to the documents' cells and not these to
    them. What is read more than once is pinned: cells, model and predictions.
    """
    docs, weights, model = chosen_bayes(spark, sf)
    model = models.Bayes(F.broadcast(anchor(model.terms)), model.base)
    evidence = attribution.contributions(weights, attribution.bayes_weights(model).drop("alpha"))
    predictions = anchor(models.predict_bayes(model, weights, docs))
    return docs, evidence, attribution.top_features(evidence, predictions)


@query(
    "x2_top_features",
    f"""WITH {EVIDENCE} SELECT d.example_id, coalesce(rank, 1) AS rank, coalesce(term, '<NO_FEATURES>') AS term, round(coalesce(s, 0), {R}) AS score
      FROM doc d LEFT JOIN tpk t ON t.example_id = d.example_id""",
)
def top_features(spark, sf):
    return rounded(explained(spark, sf)[2], "score")


@query(
    "x3_decision_values",
    f"WITH {EVIDENCE} SELECT d.example_id, round(coalesce(sum(e), 0) + 0.25, {R}) AS decision FROM doc d LEFT JOIN evi e ON e.example_id = d.example_id GROUP BY d.example_id",
)
def decision_values(spark, sf):
    docs, evidence, _ = explained(spark, sf)
    return rounded(attribution.decision_values(evidence, docs, intercept=0.25), "decision")


CHAR3 = features.TextFeatures(analyzer="char", ngrams=(3, 3), lowercase=False)
CHAR_HITS = f"""{DOCS},
sps AS (SELECT example_id, regexp_replace(text, '[\\t-\\r ][\\t-\\r ]+', ' ', 'g') AS s FROM doc),
one AS (SELECT example_id, substr(s, i, 3) AS term FROM (SELECT example_id, s, unnest(range(1, length(s) - 1)) AS i FROM sps)),
{tfidf_sql('one')},
tpk AS (SELECT example_id, term, row_number() OVER (PARTITION BY example_id ORDER BY round(weight, 12) DESC, term) AS rank FROM wts QUALIFY rank <= 3),
pos AS (SELECT example_id, lower(substr(text, i, 3)) AS g, i - 1 AS start FROM (SELECT example_id, text, unnest(range(1, length(text) - 1)) AS i FROM doc)),
hit AS (SELECT t.example_id, t.rank, t.term, start, start + 3 AS "end" FROM tpk t JOIN pos p ON p.example_id = t.example_id AND g = lower(t.term)
  QUALIFY row_number() OVER (PARTITION BY t.example_id, t.rank ORDER BY start) <= 6)"""


@query("x4_char_spans", f"WITH {CHAR_HITS} SELECT * FROM hit")
def char_spans(spark, sf):
    """Places of the three heaviest character trigrams of every document."""
    docs, _, counts, vocab = text_features(spark, sf, CHAR3, pinned=False)
    weights = features.tfidf(counts, vocab, CHAR3).withColumn("evidence", F.col("weight"))
    top = attribution.top_features(weights, docs.select("example_id", F.lit("human").alias("y_pred")))
    return attribution.char_spans(docs, top, lengths=[3])


WORD_HITS = f"""{EVIDENCE},
pcs AS (SELECT example_id, generate_subscripts(p, 1) AS no, unnest(p) AS piece FROM (
  SELECT example_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS p FROM doc)),
plc AS (SELECT *, sum(length(piece)) OVER (PARTITION BY example_id ORDER BY no) AS e FROM pcs),
arr AS (SELECT example_id, list(lower(piece) ORDER BY no) AS ws, list(e - length(piece) ORDER BY no) AS ss, list(e ORDER BY no) AS es FROM plc
  WHERE regexp_matches(piece, '^[A-Za-z0-9_]+$') GROUP BY example_id),
pat AS (SELECT t.*, regexp_extract_all(lower(term), '[A-Za-z0-9_]+') AS ps FROM tpk t),
cnd AS (SELECT example_id, rank, term, ps, ws, ss, es, unnest(range(1, len(ws) - len(ps) + 2)) AS i FROM pat JOIN arr USING (example_id) WHERE len(ps) > 0),
hit AS (SELECT example_id, rank, term, ss[i]::BIGINT AS start, es[i + len(ps) - 1]::BIGINT AS "end" FROM cnd WHERE ws[i:i + len(ps) - 1] = ps
  QUALIFY row_number() OVER (PARTITION BY example_id, rank ORDER BY i) <= 6)"""


@query("x4_word_spans", f"""WITH {WORD_HITS} SELECT * FROM hit""")
def word_spans(spark, sf):
    docs, _, top = explained(spark, sf)
    return attribution.word_spans(docs, top)


@query(
    "x5_non_overlapping",
    f"""WITH RECURSIVE {WORD_HITS}, s AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY start, rank, start - "end") AS k FROM hit),
      w AS (SELECT *, "end" AS last, true AS ok FROM s WHERE k = 1
        UNION ALL SELECT s.*, CASE WHEN s.start >= w.last THEN s."end" ELSE w.last END, s.start >= w.last
        FROM w JOIN s ON s.example_id = w.example_id AND s.k = w.k + 1)
      SELECT example_id, rank, term, start, "end" FROM w WHERE ok""",
)
def non_overlapping(spark, sf):
    docs, _, top = explained(spark, sf)
    return attribution.non_overlapping(attribution.word_spans(docs, top))


@query(
    "x6_sampled_examples",
    f"WITH {DOCS} SELECT example_id, actor, label FROM doc ORDER BY md5(example_id || '|42'), example_id LIMIT 25",
)
def sampled_examples(spark, sf):
    return attribution.sample_examples(documents(spark, sf), 25).select("example_id", "actor", "label")
