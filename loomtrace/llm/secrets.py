"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least LEAST_CHARS characters that keys are made of. Features
of a candidate: its length; how often the kind of character changes; how likely its
letters follow each other in the dictionary; how much of it dictionary words cover; signs
of a path or address; and the words before it. The forest learns from labelled findings
and gives each candidate a probability; below THRESHOLD it is no secret.

The dictionary is the DICTIONARY most frequent words of the corpus, counted over all
texts. Labelled findings are (doc_id, word_index, candidate, label) rows; at most
PER_CLASS of each label train the forest. Where none have been reviewed,
``assigned_findings`` labels by evidence that is no feature. Secrets are known key
formats, runs of three kinds of characters with high entropy, and mixed runs with
entropy that a credential name is set to, quoted or not. False positives are words and
paths, numbers, and digests that no credential name is set to. All else is doubtful: it
has no label and only gets a score. Secrets train once more without their context, so that
neither quotes nor a name are needed.

All of it is columns, joins and Spark ML. Shuffled: word counts combined per task, and
the findings by document. Candidates stay with their text until they are a few fields.

Defined results: null and empty texts have no candidates. Rows that repeat a doc_id have
their candidates each. Without labelled findings of both kinds there is nothing to learn:
all candidates get the one label there is, or 0 if there is none.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CHARS, THRESHOLD = 16, 0.5
DICTIONARY, PER_CLASS = 512, 2000
TREES, DEPTH, SEED = 32, 6, 11

WORD_BREAK = r"[\x20\x09-\x0D]+"
CANDIDATE = rf"[A-Za-z0-9+/_=.\-]{{{LEAST_CHARS},}}"
CREDENTIAL = r"(token|secret|passw|pwd|passphrase|api_?key|access_?key|auth|credential|bearer|private)"
KNOWN = (
    r"(AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|npm_|hf_|[sr]k_(live|test)_|sk-|xox[abeoprs]-|SG\.|dop_v1_|shpat_|eyJ[\w\-]+\.eyJ)[\w.\-]{16,}"
    r"|hooks\.slack\.com/services/\w"
)
SET_TO = CREDENTIAL + r"[\w.\-]*[\"'`\]]*\s*(:=|=>|==?|:|\s(is|was))\s*[\"'`]*$"
IN_URL = r"://[^/\s:@]*:$"
DIGEST = r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"
EMBEDDED = r"(data:|base64,|sha(1|256|384|512)[\-:])"
LEAST_BITS, HEX_BITS, SLACK_BITS = 4.5, 3.0, 0.6
HARMLESS = r"(sha|commit|hash|md5|digest|uuid|guid|checksum|card|account|phone|order|isbn|version|revision)"
NEIGHBOURS = 3

FEATURES = (
    "length",
    "digits",
    "capitals",
    "marks",
    "changes",
    "distinct",
    "follows",
    "covered",
    "slashes",
    "is_path",
    "is_address",
    "credential_near",
    "harmless_near",
    "assigned",
    "quoted",
)
CONTEXT = ("credential_near", "harmless_near", "assigned", "quoted")


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> list[tuple[str, int]]:
    """The most frequent words of 3 to 12 letters, with their counts."""
    word = F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")
    counts = docs.select(word).filter(F.length("word").between(3, 12)).groupBy("word").count()
    rows = counts.orderBy(F.col("count").desc(), "word").limit(most).collect()
    return [(r["word"], r["count"]) for r in rows]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, word_index, candidate, word, near) of every row, near being the words before."""
    words = docs.select("doc_id", F.split("text", WORD_BREAK).alias("words"))
    long = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.length(x["w"]) >= LEAST_CHARS)
    found = words.select("doc_id", "words", F.explode(F.filter(long, lambda x: x["w"].rlike(CANDIDATE))).alias("at"))
    before = F.slice("words", F.greatest(F.col("at.i") - NEIGHBOURS, F.lit(0)) + 1, F.least(F.col("at.i"), F.lit(NEIGHBOURS)))
    found = found.select("doc_id", F.col("at.i").alias("word_index"), F.col("at.w").alias("word"), F.array_join(before, " ").alias("near"))
    runs = F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), 1)
    # Of name=value, the value is the candidate if it is long enough by itself.
    every = F.explode(F.transform(runs, lambda r: F.regexp_replace(r, f"^.*=(?=[^=]{{{LEAST_CHARS},}}=*$)", ""))).alias("candidate")
    return found.select("doc_id", "word_index", every, "word", F.lower("near").alias("near"))


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")) / F.length(text)


def with_features(found: DataFrame, known: list[tuple[str, int]]) -> DataFrame:
    text = F.col("candidate")
    low = F.lower(text)
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "+/_=.-", "......")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    words = sorted((w for w, _ in known), key=lambda w: (-len(w), w))
    left = F.regexp_replace(low, "|".join(words), "") if words else low
    near = F.col("near")
    lead = F.lower(F.expr("substring_index(word, candidate, 1)"))
    is_set = lead.rlike(r"[=:]") | near.rlike(r"([=:]|:=|=>|\bis)$")
    return (
        found.withColumn("length", F.length(text).cast("double"))
        .withColumn("digits", _share(text, "0-9"))
        .withColumn("capitals", _share(text, "A-Z"))
        .withColumn("marks", _share(text, r"+/_=.\-"))
        .withColumn("changes", (runs - 1) / F.length(text))
        .withColumn("distinct", F.size(F.array_distinct(F.split(text, ""))) / F.least(F.length(text), F.lit(36)))
        .withColumn("follows", _transitions(low, known))
        .withColumn("covered", 1 - F.length(left) / F.length(text))
        .withColumn("slashes", F.length(F.regexp_replace(text, "[^/]", "")).cast("double"))
        .withColumn("is_path", text.rlike(r"(/[\w.\-]+){2,}|\.[a-z]{1,4}$").cast("double"))
        .withColumn("is_address", F.col("word").rlike(r"://|@|^www\.").cast("double"))
        .withColumn("credential_near", (near.rlike(CREDENTIAL) | lead.rlike(CREDENTIAL)).cast("double"))
        .withColumn("harmless_near", (near.rlike(HARMLESS) | lead.rlike(HARMLESS)).cast("double"))
        .withColumn("assigned", is_set.cast("double"))
        .withColumn("quoted", F.col("word").rlike("^\\S*[\"'`]").cast("double"))
    )


def _transitions(text: Column, known: list[tuple[str, int]]) -> Column:
    """Mean log odds of the letter pairs of the text in the dictionary; other pairs count as unseen."""
    pairs: dict[str, int] = {}
    for word, n in known:
        for k in range(len(word) - 1):
            pairs[word[k : k + 2]] = pairs.get(word[k : k + 2], 0) + n
    total = sum(pairs.values()) + 26 * 26
    unseen = math.log(26 * 26 / total)
    odds = F.create_map(*(F.lit(x) for p, n in sorted(pairs.items()) for x in (p, math.log((n + 1) * 26 * 26 / total)))) if pairs else F.create_map(F.lit(""), F.lit(0.0))
    places = F.sequence(F.lit(1), F.length(text) - 1)
    summed = F.aggregate(places, F.lit(0.0), lambda s, i: s + F.coalesce(odds[F.substring(text, i, F.lit(2))], F.lit(unseen)))
    return summed / (F.length(text) - 1)


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - share(c) * F.coalesce(F.log2(share(c)), F.lit(0.0)))


def _is_words(text: Column) -> Column:
    """Words, or a path, host or name made of words and short numbers."""
    pieces = F.filter(F.split(text, r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])"), lambda p: p != "")
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    vowels = F.length(F.regexp_replace(text, "[^AEIOUYaeiouy]", ""))
    plain = F.forall(pieces, lambda p: p.rlike("^([A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}$|^[0-9]{1,4}$"))
    spoken = (vowels >= 0.25 * letters) & ~text.rlike("(?i)[bcdfghjklmnpqrstvwxz]{7}")
    return plain & spoken & (letters >= 3.5 * F.size(pieces))


def assigned_findings(featured: DataFrame) -> DataFrame:
    """Labels from the corpus itself; doubtful candidates have none and are left out."""
    text = F.col("candidate")
    lead = F.concat_ws(" ", "near", F.lower(F.expr("substring_index(word, candidate, 1)")))
    embedded = lead.rlike(EMBEDDED) | F.lower(text).rlike("^sha(1|256|384|512)-")
    named = lead.rlike(SET_TO) | (lead.rlike(IN_URL) & F.col("word").rlike("://[^/\\s]*@"))
    is_hex, has_digit = text.rlike("^[0-9a-fA-F]+$"), text.rlike("[0-9]")
    has_lower, has_upper = text.rlike("[a-z]"), text.rlike("[A-Z]")
    least = F.when(is_hex, HEX_BITS).otherwise(F.least(F.lit(LEAST_BITS), F.log2(F.length(text)) - SLACK_BITS))
    marked = featured.withColumn("_words", _is_words(text)).withColumn("_dense", _entropy(text) >= least)
    digest, words = text.rlike(DIGEST), F.col("_words")
    mixed = (has_digit & (has_lower | has_upper)) | (has_lower & has_upper)
    three = has_digit & has_lower & has_upper & ~is_hex & ~embedded
    is_secret = ~words & (text.rlike(KNOWN) | (F.col("_dense") & ((named & mixed) | (three & ~text.rlike("[./].*[./]")))))
    is_harmless = ~named & (words | embedded | digest | text.rlike(r"^[0-9+/_=.\-]*$"))
    labelled = marked.withColumn("label", F.when(is_secret, 1.0).when(is_harmless, 0.0)).drop("_words", "_dense").dropna(subset=["label"])
    # Digests are told apart by their context alone and keep it.
    bare = labelled.filter((F.col("label") > 0) & ~digest)
    return labelled.unionByName(bare.withColumns({c: F.lit(0.0) for c in CONTEXT}))


def fit(labelled: DataFrame, per_class: int = PER_CLASS) -> PipelineModel | float:
    """A forest from featured candidates with a label, or the one label there is."""
    order = (F.xxhash64("doc_id", "word_index", "candidate"), "doc_id", "word_index", "candidate", *CONTEXT)
    rows = labelled.select("doc_id", "word_index", "candidate", "label", *FEATURES)
    picked = [rows.filter(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0.0, 1.0)]
    sample = picked[0].unionByName(picked[1]).coalesce(1).cache()
    try:
        there = {r["label"] for r in sample.select("label").distinct().collect()}
        if there != {0.0, 1.0}:
            return max(there, default=0.0)
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        forest = RandomForestClassifier(
            featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_label"
        )
        return PipelineModel([vectors, forest.fit(vectors.transform(sample))])
    finally:
        sample.unpersist()


def scored(featured: DataFrame, model: PipelineModel | float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, word_index, candidate, score, is_secret) of every candidate."""
    if isinstance(model, float):
        rows = featured.withColumn("score", F.lit(model))
    else:
        rows = model.transform(featured).withColumn("score", vector_to_array("_probability")[1])
    score = F.round("score", 6)
    return rows.select("doc_id", "word_index", "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """All candidates of all rows with their scores; findings as in the module's docstring."""
    featured = with_features(candidates(docs), dictionary(docs))
    if findings is None:
        labelled = assigned_findings(featured)
    else:
        keys = ["doc_id", "word_index", "candidate"]
        labels = findings.select(*keys, F.col("label").cast("double").alias("label")).dropna().dropDuplicates(keys)
        labelled = featured.join(labels, keys)
    return scored(featured, fit(labelled))
