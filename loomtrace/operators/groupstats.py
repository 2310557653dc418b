"""Class structure of pair distances, for the true labels and for null labelings.

Distances do not depend on labels, so all labelings are scored in one job:
pairs join assignments on the actors, then everything is grouped by (config, idx).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.ranktests import rank_sums, with_mann_whitney_p
from loomtrace.session import anchor
from loomtrace.sources.catalog import class_label, is_ai

TRUE_IDX = -1
CLASSES = ("ai_ai", "ai_human", "human_human")
LONGEST = 2**63 - 1


def n_assignments(n_actors: int, n_ai: int, *, exclude_true: bool = True) -> int:
    """Number of labelings that keep the class sizes."""
    if not 0 < n_ai < n_actors:
        raise ValueError("need at least one actor in each class")
    return comb(n_actors, n_ai) - int(exclude_true)


def true_assignment(actors: DataFrame, marker: str = "GPT") -> DataFrame:
    """The observed labels, as labeling -1."""
    return actors.select(
        F.lit(TRUE_IDX).cast("long").alias("idx"),
        "actor",
        class_label(F.col("actor"), marker).alias("label"),
    )


def roster(actors: DataFrame, *, marker: str = "GPT", side: str = "ai") -> DataFrame:
    """One row: all actors by name, each with whether it has label `side` (`mine`)."""
    ai = is_ai(F.col("actor"), marker)
    mine = ai if side == "ai" else ~ai
    named = actors.select("actor").distinct().select(F.struct("actor", mine.alias("mine")).alias("cell"))
    return named.agg(F.array_sort(F.collect_list("cell")).alias("roster"))


def labeling_counts(actors: DataFrame, *, marker: str = "GPT", side: str = "ai") -> DataFrame:
    """One row: actors, how many have label `side`, and the other labelings of these sizes."""
    mine = F.size(F.filter("roster", lambda c: c["mine"])).cast("long")
    sized = roster(actors, marker=marker, side=side).select(F.size("roster").cast("long").alias("actors"), mine.alias("mine"))
    # C(n, k) as the product of (n - k + i) / i, whole after every step.
    ways = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.col("mine")),
        F.lit(1).cast("decimal(38,0)"),
        lambda acc, i: (acc * (F.col("actors") - F.col("mine") + i) / i).cast("decimal(38,0)"),
    )
    return sized.select((ways - 1).cast("long").alias("n"), "actors", "mine")


def _ways_table(n: int, k: int) -> Column:
    """C(a, b) at place a * (k + 1) + b, for a < n and b <= k."""
    return F.array(*[F.lit(min(comb(a, b), LONGEST)).cast("long") for a in range(n) for b in range(k + 1)])


def _ways_after(place: Column, left: Column, n: int, k: int) -> Column:
    """Subsets of the places after this one that hold one member less than is left."""
    at = (F.lit(n - 1) - place) * (k + 1) + left - 1
    return F.when(left > 0, F.get(F.col("_ways"), at)).otherwise(F.lit(0).cast("long"))


def _unranked(number: Column, n: int, k: int) -> Column:
    """Which places the subset of this number has, in lexicographic order of subsets."""
    start = F.struct(
        number.alias("rest"), F.lit(k).alias("left"), F.array().cast("array<boolean>").alias("picked")
    )

    def step(state: Column, place: Column) -> Column:
        ways = _ways_after(place, state["left"], n, k)
        take = state["rest"] < ways
        return F.struct(
            F.when(take, state["rest"]).otherwise(state["rest"] - ways).alias("rest"),
            (state["left"] - take.cast("int")).alias("left"),
            F.concat(state["picked"], F.array(take)).alias("picked"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)["picked"]


def _ranked(n: int, k: int) -> Column:
    """The number of the roster's own subset."""
    start = F.struct(F.lit(0).cast("long").alias("rank"), F.lit(k).alias("left"))

    def step(state: Column, place: Column) -> Column:
        mine = F.get(F.col("roster"), place)["mine"]
        ways = _ways_after(place, state["left"], n, k)
        return F.struct(
            (state["rank"] + F.when(mine, 0).otherwise(ways)).alias("rank"),
            (state["left"] - mine.cast("int")).alias("left"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)["rank"]


def _labelled(picked: DataFrame, side: str) -> DataFrame:
    """(idx, actor, label) from (idx, roster, picked)."""
    other = "human" if side == "ai" else "ai"
    cells = F.explode(F.arrays_zip("roster.actor", "picked"))
    long = picked.select("idx", cells.alias("cell"))
    label = F.when(F.col("cell.picked"), side).otherwise(other)
    return long.select("idx", F.col("cell.actor").alias("actor"), label.alias("label"))


def indexed_assignments(
    actors: DataFrame,
    *,
    marker: str = "GPT",
    side: str = "ai",
    indices: Sequence[int] | None = None,
    exclude_true: bool = True,
) -> DataFrame:
    """Labelings in lexicographic order of the subset that gets label `side`.

    A labeling is made from its number where its rows are, so any number of labelings is
    a distributed range; only the two class sizes come to the driver. `indices` picks
    some of them.
    """
    spark = actors.sparkSession
    listed = roster(actors, marker=marker, side=side)
    sizes = listed.select(F.size("roster").alias("n"), F.size(F.filter("roster", lambda c: c["mine"])).alias("k")).first()
    n, k = sizes["n"], sizes["k"]
    total = n_assignments(n, k, exclude_true=exclude_true)
    if total > LONGEST:
        raise ValueError(f"{total} labelings cannot be numbered: use sampled_assignments")
    if indices is None:
        chosen = spark.range(total).withColumnRenamed("id", "idx")
    else:
        wanted = sorted(set(indices))
        if wanted and not (0 <= wanted[0] and wanted[-1] < total):
            raise ValueError(f"labeling index out of range 0..{total - 1}")
        chosen = spark.createDataFrame([(i,) for i in wanted], "idx long")
    table = listed.withColumn("_ways", _ways_table(n, k))
    table = table.withColumn("_true", _ranked(n, k) if exclude_true else F.lit(None).cast("long"))
    number = F.col("idx") + F.coalesce((F.col("idx") >= F.col("_true")).cast("long"), F.lit(0))
    joined = chosen.join(F.broadcast(table))
    return _labelled(joined.select("idx", "roster", _unranked(number, n, k).alias("picked")), side)


def sampled_assignments(actors: DataFrame, n: int, *, marker: str = "GPT", seed: int = 42) -> DataFrame:
    """`n` random labelings that keep the class sizes; equal seeds give equal draws.

    In each, the first actors by a hash of actor, labeling and seed become `ai`.
    """
    spark = actors.sparkSession
    joined = spark.range(n).withColumnRenamed("id", "idx").join(F.broadcast(roster(actors, marker=marker)))
    mixed = F.transform(
        "roster", lambda c: F.struct(F.md5(F.concat_ws("|", c["actor"], F.col("idx"), F.lit(str(seed)))), c["actor"])
    )
    k = F.size(F.filter("roster", lambda c: c["mine"]))
    first = F.transform(F.slice(F.array_sort(mixed), F.lit(1), k), lambda x: x["actor"])
    picked = joined.withColumn("_first", first).withColumn(
        "picked", F.transform("roster.actor", lambda a: F.array_contains("_first", a))
    )
    return _labelled(picked, "ai")


def shuffled_assignment(actors: DataFrame, seed: int, marker: str = "GPT") -> DataFrame:
    """One random labeling without leaving Spark: the first actors by hash become `ai`."""
    ai = is_ai(F.col("actor"), marker)
    mixed = F.md5(F.concat_ws("|", "actor", F.lit(str(seed))))
    everyone = Window.partitionBy(F.lit(1))
    ranked = actors.select(
        "actor",
        F.row_number().over(everyone.orderBy(mixed, "actor")).alias("_rank"),
        F.sum(ai.cast("int")).over(everyone).alias("_n_ai"),
    )
    return ranked.select(
        F.lit(seed).cast("long").alias("idx"),
        "actor",
        F.when(F.col("_rank") <= F.col("_n_ai"), "ai").otherwise("human").alias("label"),
    )


def label_pairs(pairs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Pairs once per labeling, with both labels and the pair class."""

    def side(i: int) -> DataFrame:
        return assignments.select(
            "idx", F.col("actor").alias(f"actor_{i}"), F.col("label").alias(f"label_{i}")
        )

    labelled = pairs.join(side(1), "actor_1").join(side(2), ["idx", "actor_2"])
    one, two = F.col("label_1"), F.col("label_2")
    return labelled.withColumn(
        "pair_class",
        F.when(one != two, "ai_human").when(one == "ai", "ai_ai").otherwise("human_human"),
    )


def _spread(value: Column, inside: Column) -> Column:
    """Sample standard deviation, 0 for a single value."""
    n = F.count(F.when(inside, value))
    return F.when(
        n > 0, F.coalesce(F.stddev_samp(F.when(inside, value)), F.lit(0.0))
    )


def class_summary(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean, median and standard deviation of the three pair classes, wide."""
    d = F.col("distance")
    cells = []
    for name in CLASSES:
        inside = F.col("pair_class") == name
        chosen = F.when(inside, d)
        cells += [
            F.count(chosen).alias(f"{name}_n"),
            F.avg(chosen).alias(f"{name}_mean"),
            F.median(chosen).alias(f"{name}_median"),
            _spread(d, inside).alias(f"{name}_std"),
        ]
    return labelled.groupBy(*keys).agg(*cells)


def silhouettes(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Silhouette of every actor under every labeling; a one-actor class scores 0."""
    ends = F.array(
        *[
            F.struct(
                F.col(f"actor_{i}").alias("actor"), F.col(f"label_{i}").alias("label")
            )
            for i in (1, 2)
        ]
    )
    mirrored = labelled.select(
        *keys, "distance", (F.col("label_1") == F.col("label_2")).alias("same"), F.inline(ends)
    )
    sums = mirrored.groupBy(*keys, "actor", "label").agg(
        F.avg(F.when(F.col("same"), F.col("distance"))).alias("a"),
        F.avg(F.when(~F.col("same"), F.col("distance"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    value = F.when(a.isNull() | b.isNull() | (F.greatest(a, b) == 0), 0.0).otherwise(
        (b - a) / F.greatest(a, b)
    )
    return sums.select(*keys, "actor", "label", value.alias("silhouette"))


def silhouette_summary(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    per_actor = silhouettes(labelled, keys)
    s = F.col("silhouette")
    return per_actor.groupBy(*keys).agg(
        F.avg(s).alias("silhouette_overall_mean"),
        F.avg(F.when(F.col("label") == "ai", s)).alias("silhouette_ai_mean"),
        F.avg(F.when(F.col("label") == "human", s)).alias("silhouette_human_mean"),
    )


TESTS = {"ai_human_vs_ai_ai": "ai_ai", "ai_human_vs_human_human": "human_human"}


def separation_tests(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U and Cliff's delta of cross-class against each within-class sample, long form."""
    roles = F.array(
        *[
            F.struct(
                F.lit(test).alias("test"),
                F.when(F.col("pair_class") == "ai_human", "x")
                .when(F.col("pair_class") == within, "y")
                .alias("side"),
            )
            for test, within in TESTS.items()
        ]
    )
    samples = labelled.select(*keys, F.col("distance").alias("value"), F.inline(roles))
    return rank_sums(samples.where(F.col("side").isNotNull()), [*keys, "test"])


def check_pairs(pairs: DataFrame, actors: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """What is wrong with a pair table: unknown actors, missing, repeated or NULL pairs."""
    ends = F.array(F.col("actor_1"), F.col("actor_2"))
    known = actors.select("actor").distinct()
    unknown = (
        pairs.select(*group, F.explode(ends).alias("actor"))
        .distinct()
        .join(known, "actor", "left_anti")
        .groupBy(*group)
        .agg(F.count("*").alias("unknown_actors"))
    )
    low, high = F.least("actor_1", "actor_2"), F.greatest("actor_1", "actor_2")
    per_pair = pairs.groupBy(*group, low.alias("a"), high.alias("b")).agg(
        F.count("*").alias("n"), F.bool_or(F.col("distance").isNull()).alias("empty")
    )
    facts = per_pair.groupBy(*group).agg(
        F.count("*").alias("pairs"),
        F.count(F.when(F.col("n") > 1, 1)).alias("repeated"),
        F.count(F.when(F.col("empty"), 1)).alias("undefined"),
    )
    n = known.agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("expected"))
    joined = facts.join(unknown, list(group), "left") if group else facts.join(unknown)
    return joined.join(F.broadcast(n)).select(
        *group,
        (F.col("expected") - F.col("pairs")).alias("missing"),
        F.coalesce("unknown_actors", F.lit(0)).alias("unknown_actors"),
        "repeated",
        "undefined",
    )


def group_report(
    pairs: DataFrame,
    assignments: DataFrame,
    keys: Sequence[str],
    *,
    p_values: bool = True,
) -> DataFrame:
    """One row per (config, labeling): class summaries, silhouettes and both tests.

    Undefined pairs are expected to be gone (`drop_incomplete`). Pairs are few but come
    from a whole scan, and three summaries read them, so they are pinned.
    """
    by = [*keys, "idx"]
    labelled = label_pairs(anchor(pairs), assignments)
    tests = separation_tests(labelled, by)
    if p_values:
        tests = with_mann_whitney_p(tests)
    else:
        tests = tests.withColumn("p_value", F.lit(None).cast("double"))
    cells = []
    for test in TESTS:
        for source, name in (("u", "u"), ("p_value", "p"), ("cliffs_delta", "cliffs_delta")):
            cell = F.max(F.when(F.col("test") == test, F.col(source)))
            cells.append(cell.alias(f"mw_{test}_{name}"))
    wide = tests.groupBy(*by).agg(*cells)
    return (
        class_summary(labelled, by)
        .join(silhouette_summary(labelled, by), by)
        .join(wide, by, "left")
    )


def incomplete_metrics(distances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Configurations with an undefined pair, and the actors such pairs touch."""
    ends = F.array(F.col("actor_1"), F.col("actor_2"))
    undefined = distances.where(F.col("distance").isNull() | F.isnan("distance"))
    return undefined.select(*keys, F.explode(ends).alias("actor")).distinct()


def drop_incomplete(distances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distances of the configurations in which every pair is defined."""
    bad = incomplete_metrics(distances, keys).select(*keys).distinct()
    return distances.join(bad, list(keys), "left_anti")


def humans_first(rows: DataFrame, actor: str = "actor", marker: str = "GPT") -> DataFrame:
    """Display order: humans, then AI actors, each by name."""
    return rows.orderBy(is_ai(F.col(actor), marker), actor)
