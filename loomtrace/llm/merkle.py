"""A Merkle manifest of a dataset, and a proof for every row by a recursive query.

Each row is a leaf: the SHA-256 of its fields. Per ``lang``, leaves ascend by doc_id and
runs of 8 nodes become one, level by level, until one is left; these subroots, by lang,
become the root in the same way. Every run built is stored as a node row that names its
parent: (level, first) is its key, ``kids`` are the digests of its run, ``up_level``,
``up_first``, ``up_pos`` say which run its own digest is in, and where.

The climb is one Spark recursive query over these rows. A leaf starts with its tampered
digest; a step joins the run it is in, appends the siblings there, folds its digest with
them and goes on to the parent, up to the root. All siblings are the stored ones, so a
leaf verifies only if it is the one that was built.

How it runs. Leaves are laid out by range in the order of the trees, so no language is one
task, and numbered across ranges. A level is a grouped job over the level below. High runs
are on the way of all leaves under them, so their rows are repeated once per chunk of 512
leaves and joined on the chunk too: no key has more than 512 leaves. Above a chunk all its
leaves have the same siblings, so only its first leaf takes them along, and the others get
them from it at the end. Levels and the result of the climb are checkpointed; the driver
sees the root and the sizes of levels.

Defined results: a null field is ``-``; a null doc_id sorts first, is not tampered, and
null lang is the first tree. Equal ids are ordered by their leaves, so rows that repeat
stand side by side and each has its proof. A tree of one leaf has that leaf as its
subroot, one tree has its subroot as the root, and a proof without siblings is the digest
of nothing. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from loomtrace.llm.exact import lowered
from loomtrace.plans.ordered import Along, along
from loomtrace.session import anchor

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT, TAMPER_EVERY = 8, 3
#: Nodes of a level that one task writes.
NODES_PER_TASK = 50_000
#: Leaves that meet in one key of the climb, at most: 8 to the power of 3.
CHUNK = FAN_OUT**3
#: Levels of the tree over the subroots count from here.
TOP = 100
UP = ("up_level", "up_first", "up_pos")
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

_CLIMB = """
    WITH RECURSIVE climb (g, chunk, step, level, first, pos, folded, shared, siblings, subroot) AS (
        SELECT g, chunk, 0, level, first, pos, tampered, false, X'', CAST(NULL AS BINARY) FROM {leaves}
        UNION ALL
        SELECT c.g, c.chunk, c.step + 1, n.up_level, n.up_first, n.up_pos,
               unhex(sha2(lower(hex(concat(left(n.kids, 32 * c.pos), c.folded, substr(n.kids, 32 * c.pos + 33)))), 256)),
               n.level > {low},
               CASE WHEN n.level <= {low} OR c.g = c.chunk THEN concat(left(n.kids, 32 * c.pos), substr(n.kids, 32 * c.pos + 33)) ELSE X'' END,
               CASE WHEN n.level = {top} AND c.g = c.chunk THEN substr(n.kids, 32 * c.pos + 1, 32) END
        FROM climb c JOIN {nodes} n ON n.level = c.level AND n.first = c.first AND n.chunk = c.chunk
    )
    SELECT g, chunk, step, folded, shared, siblings, subroot FROM climb
"""


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: str | Column = "text") -> Column:
    """The digest of a row's fields, with this text."""
    text = F.col(text) if isinstance(text, str) else text
    return _digest(F.concat(*[_field(text if c == "text" else F.col(c)) for c in FIELDS]))


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered, g, tree, idx: leaves numbered over all, and in their tree.

    A tree is called by the number of its first leaf.
    """
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER_EVERY)) == 0
    rows = docs.select(
        "doc_id", "lang", leaf().alias("leaf"), F.when(changed & F.col("text").isNotNull(), leaf(lowered(F.col("text")))).alias("tampered")
    )
    # pinned, as ranges are sampled first and texts are to be hashed once
    rows = anchor(rows.withColumn("tampered", F.coalesce("tampered", "leaf")))
    laid = along(rows, ["lang"], ["doc_id", "leaf", "tampered"]).positions("idx")
    every = Along(laid.df, (), (F.col("lang"), *laid.order)).positions("g")
    return anchor(every.frame().select("doc_id", "leaf", "tampered", "g", (F.col("g") - F.col("idx")).alias("tree"), "idx"))


def _runs(nodes: DataFrame) -> DataFrame:
    """Runs of nodes (tree, idx, digest, n_leaves): their kids, digest and leaves."""
    kids = F.array_sort(F.collect_list(F.struct("idx", "digest")))
    made = nodes.groupBy("tree", F.floor(F.col("idx") / FAN_OUT).alias("run")).agg(kids.alias("_kids"), F.sum("n_leaves").alias("n_leaves"))
    made = made.withColumn("kids", F.aggregate("_kids", F.lit(b""), lambda all, kid: F.concat(all, kid["digest"])))
    # runs fill up from the left: a first run of one node is a tree that is complete
    return made.select("tree", "run", "n_leaves", "kids", _digest(_hex(F.col("kids"))).alias("digest"), ((F.col("run") == 0) & (F.size("_kids") == 1)).alias("complete"))


def levels(nodes: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """All runs (level, tree, run, kids, n_leaves), and the trees (tree, level, digest, n_leaves)."""
    runs, trees, level, n = None, None, 0, nodes.count()
    while True:
        made = anchor(_runs(nodes).coalesce(1 + n // NODES_PER_TASK))
        ended = made.filter("complete").select("tree", F.lit(level).alias("level"), F.col("kids").alias("digest"), "n_leaves")
        trees = ended if trees is None else trees.unionByName(ended)
        more = made.filter("NOT complete")
        n = more.count()
        if n == 0:
            return runs, trees
        level += 1
        built = more.select(F.lit(level).alias("level"), "tree", "run", "kids", "n_leaves")
        runs = built if runs is None else runs.unionByName(built)
        nodes = more.select("tree", F.col("run").alias("idx"), "digest", "n_leaves")


def _chunked(rows: DataFrame, start: Column, last: Column) -> DataFrame:
    """Each row once per chunk from ``start`` on; long spans are dealt out in parts."""
    part = F.lit(CHUNK * CHUNK).cast("long")
    parts = rows.withColumn("_part", F.explode(F.sequence(start, last, part))).withColumn("_last", F.least(last, F.col("_part") + part - 1))
    return parts.repartition("_part").withColumn("chunk", F.explode(F.sequence("_part", "_last", F.lit(CHUNK).cast("long")))).drop("_part", "_last")


class Manifest:
    """The levels built over a table: leaves, node rows, trees and the root (None if empty)."""

    def __init__(self, docs: DataFrame):
        self.leaves = numbered(docs)
        runs, trees = levels(self.leaves.select("tree", "idx", F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("n_leaves")))
        self.trees = anchor(along(trees, [], ["tree"]).positions("nth").frame())
        top, roots = levels(self.trees.select(F.lit(0).alias("tree"), F.col("nth").alias("idx"), "digest", "n_leaves"))
        found: Row | None = roots.select(_hex(F.col("digest")).alias("root")).first()
        self.root = found.root if found else None
        self.nodes = self._linked(runs, top)

    def _above(self, tree: Column, level: Column, run: Column) -> list[Column]:
        """Key of the run that node ``run`` of a level is in, and its place there."""
        width = F.pow(F.lit(float(FAN_OUT)), level + 1).cast("long")
        up = F.floor(run / FAN_OUT)
        return [(level + 1).cast("int").alias("up_level"), (tree + up * width).alias("up_first"), (run % FAN_OUT).cast("int").alias("up_pos")]

    def _over(self, nth: Column) -> list[Column]:
        """The same for the subroot of a tree; null where it is the only one."""
        only = F.lit(self._n_trees == 1)
        over = [F.lit(TOP + 1), F.floor(nth / FAN_OUT), (nth % FAN_OUT).cast("int")]
        return [F.when(~only, c).alias(a) for c, a in zip(over, UP, strict=True)]

    def _linked(self, runs: DataFrame | None, top: DataFrame | None) -> DataFrame | None:
        """The node rows of all runs, once per chunk of leaves under them."""
        self._n_trees = self.trees.count()
        rows = []
        if runs is not None:
            width = F.pow(F.lit(float(FAN_OUT)), F.col("level")).cast("long")
            keyed = runs.withColumn("first", F.col("tree") + F.col("run") * width)
            below = self._above(F.col("tree"), F.col("level"), F.col("run"))
            # only the first run of a level can be its tree's subroot
            heads = keyed.filter("run = 0").join(self.trees.select("tree", "level", "nth"), ["tree", "level"], "left")
            over = [F.when(F.col("nth").isNull(), b).otherwise(o).alias(a) for b, o, a in zip(below, self._over(F.col("nth")), UP, strict=True)]
            kept = ["level", "tree", "first", "n_leaves", "kids"]
            linked = keyed.filter("run > 0").select(*kept, *below).unionByName(heads.select(*kept, *over))
            start = F.col("first") - (F.col("first") - F.col("tree")) % CHUNK
            low = linked.filter(F.col("n_leaves") <= CHUNK).withColumn("chunk", start)
            high = _chunked(linked.filter(F.col("n_leaves") > CHUNK), start, F.col("first") + F.col("n_leaves") - 1)
            rows += [x.select("level", "first", "chunk", "kids", *UP) for x in (low, high)]
        if top is not None:
            chunks = _chunked(self.trees, F.col("tree"), F.col("tree") + F.col("n_leaves") - 1).select("nth", "chunk")
            last = top.agg(F.max("level")).first()[0]
            for level in range(1, last + 1):
                runs_of = top.filter(F.col("level") == level).select("run", "kids")
                under = chunks.select("chunk", F.floor(F.col("nth") / FAN_OUT**level).alias("run"))
                up = (F.lit(TOP + level + 1), F.floor(F.col("run") / FAN_OUT), (F.col("run") % FAN_OUT).cast("int"))
                up = [F.when(F.lit(level < last), c).alias(a) for c, a in zip(up, UP, strict=True)]
                rows.append(under.join(runs_of, "run").select(F.lit(TOP + level).alias("level"), F.col("run").alias("first"), "chunk", "kids", *up))
        if not rows:
            return None
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        return anchor(every)

    def started(self) -> DataFrame:
        """Leaves with their chunk and the run they are in."""
        chunk = (F.col("g") - F.col("idx") % CHUNK).alias("chunk")
        kept = ["g", chunk, "tampered"]
        inner = self._above(F.col("tree"), F.lit(0), F.col("idx"))
        many = self.leaves.filter("idx > 0").select(*kept, *inner)
        lone = self.trees.filter("level = 0").select("tree", "nth")
        heads = self.leaves.filter("idx = 0").join(lone, "tree", "left")
        ends = [F.when(F.col("nth").isNull(), b).otherwise(o).alias(a) for b, o, a in zip(inner, self._over(F.col("nth")), UP, strict=True)]
        rows = many.unionByName(heads.select(*kept, *ends))
        return rows.withColumnsRenamed({"up_level": "level", "up_first": "first", "up_pos": "pos"})

    def climbed(self) -> DataFrame:
        """g, proof_sha256, folded_root, subroot: what each leaf's climb came to."""
        spark = self.leaves.sparkSession
        before = spark.conf.get(_ROW_LIMIT)
        leaves = self.started()
        nodes = self.nodes if self.nodes is not None else spark.createDataFrame([], "level int, first long, chunk long, kids binary, up_level int, up_first long, up_pos int")
        try:
            # the climb has as many rows as leaves have levels
            spark.conf.set(_ROW_LIMIT, "-1")
            low = round(math.log(CHUNK, FAN_OUT))
            rows = spark.sql(_CLIMB, leaves=leaves, nodes=nodes, top=TOP + 1, low=low).repartition("chunk")
            own, upper = (F.array_sort(F.collect_list(F.when(x, F.struct("step", "siblings")))) for x in (~F.col("shared"), F.col("shared") & (F.col("g") == F.col("chunk"))))
            ended = rows.groupBy("chunk", "g").agg(own.alias("_own"), upper.alias("_upper"), F.max_by("folded", "step").alias("folded"), F.max("subroot").alias("subroot"))
            alike = Window.partitionBy("chunk")
            upper = F.max(F.when(F.col("g") == F.col("chunk"), _joined("_upper"))).over(alike)
            proof = F.sha2(_hex(F.concat(_joined("_own"), "_above")).cast("binary"), 256)
            ended = ended.withColumn("_above", upper).withColumn("subroot", F.max("subroot").over(alike))
            return anchor(ended.select("g", proof.alias("proof_sha256"), _hex(F.col("folded")).alias("folded_root"), _hex(F.col("subroot")).alias("subroot")))
        finally:
            spark.conf.set(_ROW_LIMIT, before)


def _joined(way: str) -> Column:
    return F.aggregate(way, F.lit(b""), lambda all, at: F.concat(all, at["siblings"]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    built = Manifest(docs)
    root = F.lit(built.root).cast("string")
    rows = built.leaves.select("g", "doc_id", _hex(F.col("leaf")).alias("leaf")).join(built.climbed(), "g")
    return rows.select(
        "doc_id", "leaf", F.coalesce("subroot", root).alias("subroot"), root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
