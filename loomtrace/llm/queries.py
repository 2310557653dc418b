"""The registered queries of the pipeline operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import exact, jaccard, katz, lines, merkle, mixing, passages, pieces, quality, secrets, sharding, toxicity, variants

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op5_substring_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ),
    every AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    p AS (
        SELECT doc_id, i, n,
               string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run
        FROM every
    ),
    w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM p WHERE i <= n - 19),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM w WHERE nth > 1),
    gone_of AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
    kept AS (
        SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS text
        FROM every e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i
        GROUP BY e.doc_id
    )
    SELECT d.doc_id, len(d.ws) AS n_words, coalesce(g.n, 0) AS n_removed,
           sha256(coalesce(k.text, '')) AS kept_sha256
    FROM d LEFT JOIN gone_of g ON g.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
    """,
)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside repeated windows of 20 words, of all documents."""
    return passages.repeat_digests(_documents(spark, sf_dir))


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and content verdict of all documents."""
    docs = _documents(spark, sf_dir)
    return quality.verdicts(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query(
    "op9_line_dedup",
    r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM documents
    ),
    k AS (
        SELECT doc_id, i, line,
               translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM l
    ),
    common AS (
        SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ),
    marked AS (
        SELECT k.*, c.key IS NOT NULL AND c.stays <> k.doc_id AS gone FROM k LEFT JOIN common c ON c.key = k.key
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of all documents when lines common to five documents stay in one."""
    return lines.digests(_documents(spark, sf_dir))


@query(
    "op8_ngram_jaccard_join",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
        FROM documents
    ),
    words AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    runs AS (
        SELECT doc_id, n, i,
               string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s
        FROM words
    ),
    sets AS (SELECT DISTINCT doc_id, s FROM runs WHERE i <= greatest(n - 4, 1)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
        FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
    ),
    links AS (
        SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)
    ),
    reach AS (
        SELECT a AS doc_id, b AS other FROM links
        UNION
        SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
    ),
    least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
    FROM d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
    """,
)
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 75 % shingle similarity."""
    return jaccard.link_components(_documents(spark, sf_dir))


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add-one and Katz log10 probabilities of all documents."""
    return katz.scores(_documents(spark, sf_dir))


@query("op10_source_mixing")
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mixture(_documents(spark, sf_dir))


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal counts, equal texts together."""
    return sharding.document_shards(_documents(spark, sf_dir))


@query(
    "op2_exact_dedup",
    """
    WITH d AS (
        SELECT doc_id,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for each group of equal texts, beside every document."""
    return exact.groups(_documents(spark, sf_dir))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of the piece ids of every document, and whether they decode to its text."""
    model = pieces.load_model()
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = pieces.decode(pieces.encode(docs, model), model)
    n_tokens = F.coalesce(F.size("ids"), F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        F.when(F.col("ids").isNull(), 0).otherwise(n_tokens).alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"),
    )


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents, with the forest's score and verdict."""
    return secrets.scan(_documents(spark, sf_dir))


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of all documents, learned from labels outside the held-out fold."""
    docs = _documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: DuckDB has no crc32: the table by its rule, and the sum over a list of bytes.
_CRC_SQL = """
    crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(
            list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    )"""


def _crc_of(text: str) -> str:
    """SQL for the crc32 of a text in Latin-1, beside the row of ``crc``."""
    bytes_of = f"""flatten(list_transform(list_transform(string_split({text}, ''), lambda c: unicode(c)),
        lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))"""
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {bytes_of}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


@query(
    "op13_spelling_variants",
    rf"""
    WITH RECURSIVE {_CRC_SQL},
    runs AS (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents
    ),
    pairs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
    hashed AS (SELECT run, n, {_crc_of("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM pairs, crc),
    spelt AS (
        SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM hashed
    ),
    v AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cuts AS (
        SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, unnest(range(length(word))) AS i FROM v)
    ),
    near AS (
        SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT c.word, v.word FROM cuts c JOIN v ON v.word = c.rest
        UNION SELECT v.word, c.word FROM cuts c JOIN v ON v.word = c.rest
    ),
    best AS (
        SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n
        FROM (SELECT near.word, other, v.n FROM near JOIN v ON v.word = near.other) GROUP BY word
    ),
    rows AS (
        SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form,
               CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n
        FROM v LEFT JOIN best ON best.word = v.word
    ),
    climb AS (
        SELECT word, coalesce(form, word) AS root FROM rows
        UNION SELECT c.word, r.form FROM climb c JOIN rows r ON r.word = c.root AND r.form IS NOT NULL
    ),
    ends AS (SELECT c.word, c.root FROM climb c JOIN rows r ON r.word = c.root AND r.form IS NULL)
    SELECT r.word, r.form, e.root, r.n, r.n_near, r.form_n FROM rows r JOIN ends e ON e.word = r.word
    """,
)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every long word of all documents."""
    return variants.variants(_documents(spark, sf_dir))


@query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE {_CRC_SQL},
    d AS (
        SELECT doc_id, source, lang, n_chars, text,
               CASE WHEN {_crc_of("doc_id::VARCHAR")} % 3 = 0
                    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
        FROM documents, crc
    ),
    f AS (
        SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
        FROM d
    ),
    l AS (
        SELECT doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered,
               dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx
        FROM f
    ),
    nodes AS (
        SELECT 0 AS level, tree, idx, leaf AS digest FROM l
        UNION ALL
        SELECT level + 1, tree, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes
        GROUP BY level, tree, idx // 8 HAVING idx // 8 > 0 OR count(*) > 1
    ),
    subroots AS (SELECT tree, arg_max(digest, level) AS subroot FROM nodes GROUP BY tree),
    top AS (
        SELECT 0 AS level, tree AS idx, subroot AS digest FROM subroots
        UNION ALL
        SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM top
        GROUP BY level, idx // 8 HAVING idx // 8 > 0 OR count(*) > 1
    ),
    every AS (
        SELECT level, tree, idx, digest FROM nodes
        UNION ALL
        SELECT level + 100, -1, idx, digest FROM top
    ),
    way AS (
        SELECT doc_id, l.tree, l.idx, lv AS level, l.tree AS at_tree, l.idx // (8 ** lv)::BIGINT AS place FROM l, (SELECT DISTINCT level AS lv FROM nodes)
        UNION ALL
        SELECT doc_id, l.tree, l.idx, lv + 100, -1, l.tree // (8 ** lv)::BIGINT FROM l, (SELECT DISTINCT level AS lv FROM top)
    ),
    runs AS (SELECT level, tree, idx // 8 AS run, string_agg(digest, '' ORDER BY idx) AS kids FROM every GROUP BY level, tree, idx // 8 HAVING idx // 8 > 0 OR count(*) > 1),
    steps AS (
        SELECT w.tree, w.idx, row_number() OVER (PARTITION BY w.tree, w.idx ORDER BY w.level) AS step, place % 8 AS pos, kids
        FROM way w JOIN runs r ON r.level = w.level AND r.tree = at_tree AND r.run = place // 8
    ),
    climb AS (
        SELECT tree, idx, 0 AS step, tampered AS folded, '' AS siblings FROM l
        UNION ALL
        SELECT c.tree, c.idx, c.step + 1, sha256(left(kids, 64 * pos) || folded || substr(kids, 64 * pos + 65)),
               siblings || left(kids, 64 * pos) || substr(kids, 64 * pos + 65)
        FROM climb c JOIN steps s ON s.tree = c.tree AND s.idx = c.idx AND s.step = c.step + 1
    ),
    ends AS (SELECT tree, idx, arg_max(folded, step) AS folded, arg_max(siblings, step) AS siblings FROM climb GROUP BY tree, idx)
    SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
    FROM l JOIN subroots USING (tree) JOIN ends USING (tree, idx), (SELECT arg_max(digest, level) AS root FROM top)
    """,
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document under one root."""
    return merkle.manifest(_documents(spark, sf_dir))
