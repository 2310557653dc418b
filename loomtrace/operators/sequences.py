"""Complexity of count distributions over template ids and id windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.distributions import pair_distances
from loomtrace.operators.windows import swept_windows
from loomtrace.plans.ordered import along
from loomtrace.session import anchor

SCALARS = ("gini", "kurtosis", "entropy", "mad")


def profile(
    counts: DataFrame,
    keys: Sequence[str],
    *,
    min_rows: int = 20,
    min_distinct: int = 3,
    gated: bool = True,
) -> DataFrame:
    """Gini, excess kurtosis, entropy (bits) and mean absolute deviation of counts.

    The kurtosis is the bias-corrected one of the frequency list followed by its mirror
    image, so every frequency counts twice. With gates, keys with too few rows get no
    metrics and keys with too few distinct items no kurtosis.

    Work is done on (count value, how many items have it). A key of N rows has at most
    sqrt(2 N) distinct count values.
    """
    keys = list(keys)
    x, m = F.col("x").cast("double"), F.col("m")
    cells = counts.groupBy(*keys, F.col("cnt").alias("x")).agg(F.count("*").alias("m"))
    ranked = along(cells, keys, ["x"]).running_sum(m, "_upto").frame()
    everyone = Window.partitionBy(*keys)
    sized = ranked.select(
        "*",
        F.sum(m).over(everyone).alias("u"),
        F.sum(x * m).over(everyone).alias("s"),
    )
    before = F.col("_upto") - m
    d = x - F.col("s") / F.col("u")
    share = x / F.col("s")
    sums = sized.groupBy(*keys).agg(
        F.max("u").alias("u"),
        F.max("s").alias("s"),
        F.sum(x * (m * before + m * (m + 1) / 2)).alias("ix"),
        F.sum(2 * m * d * d).alias("m2"),
        F.sum(2 * m * d * d * d * d).alias("m4"),
        F.sum(-m * share * F.log2(share)).alias("entropy"),
        (F.sum(m * F.abs(d)) / F.max("u")).alias("mad"),
    )
    # a product of three sizes outgrows a long from a million items on
    u, s, n = F.col("u"), F.col("s"), 2 * F.col("u").cast("double")
    gini = 2 * F.col("ix") / (u * s) - (u + 1) / u
    s2 = F.col("m2") / (n - 1)
    first = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3))
    last = 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    kurtosis = F.when((n >= 4) & (s2 > 0), first * F.col("m4") / (s2 * s2) - last)
    enough = (s >= min_rows) if gated else F.lit(True)
    varied = (u >= min_distinct) if gated else F.lit(True)
    return sums.select(
        *keys,
        s.cast("long").alias("n_rows"),
        u.alias("n_distinct"),
        F.when(enough, gini).alias("gini"),
        F.when(enough & varied, kurtosis).alias("kurtosis"),
        F.when(enough, F.col("entropy")).alias("entropy"),
        F.when(enough, F.col("mad")).alias("mad"),
    )


def id_counts(ids: DataFrame, keys: Sequence[str], cid: str = "cid") -> DataFrame:
    return ids.groupBy(*keys, F.col(cid).cast("string").alias("token")).agg(
        F.count("*").alias("cnt")
    )


def motif_counts(
    positioned: DataFrame,
    keys: Sequence[str],
    settings: Sequence[tuple[int, int]],
    *,
    cid: str = "cid",
) -> DataFrame:
    """Counts of whole id windows, for every (size, stride) setting in one job."""
    cut = swept_windows(positioned, keys, cid, settings)
    motif = F.array_join(F.transform("items", lambda c: c.cast("string")), " ")
    return cut.groupBy(*keys, "size", "stride", motif.alias("token")).agg(
        F.count("*").alias("cnt")
    )


def pair_profiles(
    counts: DataFrame,
    actors: DataFrame,
    group: Sequence[str] = (),
    *,
    suffix: str = "",
    min_distinct: int = 3,
) -> DataFrame:
    """All pairs: absolute differences of the four scalars plus L1 and JS distance.

    Counts come from a whole scan and are read for the scalars, totals and pairs, so they
    are pinned.
    """
    counts = anchor(counts)
    scalars = actors.join(
        profile(counts, [*group, "actor"], min_distinct=min_distinct), [*group, "actor"], "left"
    )
    pairs = pair_distances(counts, actors, group)

    def side(i: int) -> DataFrame:
        return scalars.select(
            *group,
            F.col("actor").alias(f"actor_{i}"),
            *[F.col(c).alias(f"{c}_{i}") for c in SCALARS],
        )

    both = pairs.join(side(1), [*group, "actor_1"]).join(side(2), [*group, "actor_2"])
    return both.select(
        *group,
        "actor_1",
        "actor_2",
        *[F.abs(F.col(f"{c}_1") - F.col(f"{c}_2")).alias(f"{c}{suffix}") for c in SCALARS],
        F.col("l1").alias(f"l1{suffix}"),
        F.col("js").alias(f"js{suffix}"),
    )
