"""Train, validation and test parts, and the selection that uses them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.plans.ordered import along
from loomtrace.sources.catalog import is_ai

PARTS = ("train", "val", "test")
SHUFFLE_SEED = 42  # fixed value: decides the order of the outer splits

# Smallest usable parts, for classic models and for neural or retrieval ones.
MIN_ROWS = {"train": 200, "val": 100, "test": 100}
MIN_ROWS_LARGE = {"train": 400, "val": 100, "test": 100}


def fixed_split(
    examples: DataFrame,
    val: Sequence[str],
    test: Sequence[str],
    *,
    group: str = "actor",
) -> DataFrame:
    """Give named groups to validation and test and the rest to training."""
    val, test = [str(v) for v in val], [str(t) for t in test]
    both = sorted(set(val) & set(test))
    if both:
        raise ValueError(f"groups in validation and test: {both}")
    name = F.col(group).cast("string")
    part = F.when(name.isin(*val), "val").when(name.isin(*test), "test").otherwise("train")
    return examples.withColumn("part", part)


def require_parts(split: DataFrame) -> DataFrame:
    """The split itself, or an error naming the empty parts."""
    seen = {r["part"] for r in split.select("part").distinct().collect()}
    empty = [p for p in PARTS if p not in seen]
    if empty:
        raise ValueError(f"empty parts: {empty}")
    return split


def _sides(actors: DataFrame, marker: str) -> DataFrame:
    """One row with the sorted names of both classes."""
    ai = is_ai(F.col("actor"), marker)
    return actors.agg(
        F.array_sort(F.collect_set(F.when(~ai, F.col("actor")))).alias("_humans"),
        F.array_sort(F.collect_set(F.when(ai, F.col("actor")))).alias("_ais"),
    )


def class_pairs(actors: DataFrame, marker: str = "GPT") -> DataFrame:
    """Every human with every AI actor, as (human, ai)."""
    humans = actors.where(~is_ai(F.col("actor"), marker)).select(F.col("actor").alias("human")).distinct()
    joined = humans.join(F.broadcast(_sides(actors, marker)))
    return joined.select("human", F.explode("_ais").alias("ai"))


def outer_splits(
    actors: DataFrame, *, limit: int | None = None, seed: int = SHUFFLE_SEED, marker: str = "GPT"
) -> DataFrame:
    """All choices of a human and an AI actor for validation and two others for test.

    (outer_i, val_human, val_ai, test_human, test_ai), numbered from 0 in hash order;
    `limit` keeps the first ones. Both classes are small, so their names are broadcast,
    and every validation pair makes its splits where it is.
    """
    val = class_pairs(actors, marker).select(F.col("human").alias("val_human"), F.col("ai").alias("val_ai"))
    both = val.join(F.broadcast(_sides(actors, marker)))
    human = F.explode(F.filter("_humans", lambda h: h != F.col("val_human"))).alias("test_human")
    ai = F.explode(F.filter("_ais", lambda a: a != F.col("val_ai"))).alias("test_ai")
    every = both.select("val_human", "val_ai", "_ais", human).select("val_human", "val_ai", "test_human", ai)
    names = ["val_human", "val_ai", "test_human", "test_ai"]
    mixed = F.md5(F.concat_ws("|", *names, F.lit(str(seed))))
    placed = along(every.withColumn("_mixed", mixed), [], ["_mixed", *names]).positions("outer_i").frame()
    kept = placed if limit is None else placed.where(F.col("outer_i") < limit)
    return kept.select("outer_i", *names)


def split_parts(splits: DataFrame, actors: DataFrame) -> DataFrame:
    """(outer_i, actor, part) for every split and actor: small, made once."""
    name = F.col("actor")
    part = (
        F.when(name.isin(F.col("val_human"), F.col("val_ai")), "val")
        .when(name.isin(F.col("test_human"), F.col("test_ai")), "test")
        .otherwise("train")
    )
    listed = actors.agg(F.collect_set("actor").alias("_actors"))
    every = splits.join(F.broadcast(listed)).select("*", F.explode("_actors").alias("actor"))
    return every.select("outer_i", "actor", part.alias("part"))


def _mixed(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def _rounded(value: Column) -> Column:
    return F.floor(value + 0.5)


def random_split(
    examples: DataFrame,
    *,
    id_column: str = "example_id",
    label: str | None = "label",
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Split rows in hash order, within each class when `label` is given.

    The validation share is meant of the whole, so it is rescaled for the rest that
    remains after the test part.
    """
    keys = [] if label is None else [label]
    mixed = examples.withColumn("_mixed", _mixed(id_column, seed))
    placed = along(mixed, keys, ["_mixed", id_column]).positions("_pos").frame()
    sizes = examples.groupBy(*keys).agg(F.count("*").alias("_n"))
    n_test = _rounded(F.col("_n") * test_size)
    n_val = _rounded((F.col("_n") - n_test) * (val_size / (1.0 - test_size)))
    part = (
        F.when(F.col("_pos") < n_test, "test")
        .when(F.col("_pos") < n_test + n_val, "val")
        .otherwise("train")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    sizes = F.broadcast(sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_n"))  # one row per class
    joined = placed.join(sizes, same).drop(*[f"_of_{k}" for k in keys]) if keys else placed.join(sizes)
    return joined.withColumn("part", part).drop("_mixed", "_pos", "_n")


def group_split(
    examples: DataFrame,
    *,
    group: str = "group",
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Split whole groups in hash order."""
    groups = examples.select(group).distinct().withColumn("_mixed", _mixed(group, seed))
    placed = along(groups, [], ["_mixed", group]).positions("_pos").frame()
    total = groups.agg(F.count("*").alias("_n"))
    n_test = F.ceil(F.col("_n") * test_size)
    n_val = F.ceil((F.col("_n") - n_test) * (val_size / (1.0 - test_size)))
    part = (
        F.when(F.col("_pos") < n_test, "test")
        .when(F.col("_pos") < n_test + n_val, "val")
        .otherwise("train")
    )
    parts = placed.join(F.broadcast(total)).select(group, part.alias("part"))
    return examples.join(parts, group)


def part_sizes(split: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per part, one row per key."""
    counts = [F.count(F.when(F.col("part") == p, 1)).alias(f"n_{p}") for p in PARTS]
    return split.groupBy(*keys).agg(*counts)


def large_enough(
    split: DataFrame, keys: Sequence[str], minimum: dict[str, int] = MIN_ROWS
) -> DataFrame:
    """Keys whose parts all reach their minimum size."""
    sizes = part_sizes(split, keys)
    for part, least in minimum.items():
        sizes = sizes.where(F.col(f"n_{part}") >= least)
    return sizes


def split_profile(
    split: DataFrame, keys: Sequence[str] = (), *, label: str = "label", group: str = "group"
) -> DataFrame:
    """Rows, class counts and distinct groups of every part."""
    return split.groupBy(*keys, "part").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col(label) == "ai", 1)).alias("n_ai"),
        F.count(F.when(F.col(label) == "human", 1)).alias("n_human"),
        F.count_distinct(group).alias("n_groups"),
    )


def select_candidates(
    scores: DataFrame,
    keys: Sequence[str],
    *,
    metric: str = "f1_macro",
    order: str = "candidate",
) -> DataFrame:
    """The candidate with the best validation score and its test score.

    Input (keys.., order, part, metric). The first candidate wins among equals.
    """
    wide = scores.groupBy(*keys, order).agg(
        F.max(F.when(F.col("part") == "val", F.col(metric))).alias("val_score"),
        F.max(F.when(F.col("part") == "test", F.col(metric))).alias("test_score"),
    )
    valid = wide.where(F.col("val_score").isNotNull() & ~F.isnan("val_score"))
    rank = F.struct(F.col("val_score"), (-F.col(order)).alias("_early"))
    return valid.groupBy(*keys).agg(
        F.max_by(order, rank).alias(order),
        F.max("val_score").alias("val_score"),
        F.max_by("test_score", rank).alias("test_score"),
    )
