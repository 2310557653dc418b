"""Token counts per actor and distances between all actor pairs.

Distributions stay long, (group.., actor, token, cnt). Tokens are counted before
anything is shuffled, and a pair costs only the tokens both actors share: with S the
shared tokens, p and q the probabilities and m their mean,

    L1  = 2 - 2 * sum_S min(p, q)
    JSD = [(1 - sum_S p) ln 2 + sum_S p ln(p / m)
         + (1 - sum_S q) ln 2 + sum_S q ln(q / m)] / 2,   distance = sqrt(JSD).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.text import characters, words

LN2 = math.log(2.0)


def word_counts(
    lines: DataFrame, keys: Sequence[str] = ("actor",), text: str = "text"
) -> DataFrame:
    """Counts of white-space separated words."""
    tokens = lines.select(*keys, F.explode(words(F.col(text))).alias("token"))
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("cnt"))


def char_counts(
    lines: DataFrame, keys: Sequence[str] = ("actor",), text: str = "text"
) -> DataFrame:
    """Counts of characters; the line ends between lines count as characters too.

    Lines are cut at blanks and equal pieces are counted first, so that characters
    are listed once per distinct piece instead of once per line.
    """
    pieces = F.split(F.col(text), " ")
    cut = lines.select(*keys, pieces.alias("_pieces"))
    counted = (
        cut.select(*keys, F.explode("_pieces").alias("_piece"))
        .groupBy(*keys, "_piece")
        .agg(F.count("*").alias("cnt"))
    )
    inside = counted.select(*keys, F.explode(characters(F.col("_piece"))).alias("token"), "cnt")
    between = F.array(
        F.struct(F.lit(" ").alias("token"), F.sum(F.size("_pieces") - 1).alias("cnt")),
        F.struct(F.lit("\n").alias("token"), (F.count("*") - 1).alias("cnt")),
    )
    marks = cut.groupBy(*keys).agg(between.alias("_marks")).select(*keys, F.inline("_marks"))
    merged = inside.unionByName(marks.where(F.col("cnt") > 0)).groupBy(*keys, "token")
    return merged.agg(F.sum("cnt").alias("cnt"))


def token_counts(
    lines: DataFrame, mode: str, keys: Sequence[str] = ("actor",), text: str = "text"
) -> DataFrame:
    if mode == "word":
        return word_counts(lines, keys, text)
    if mode == "char":
        return char_counts(lines, keys, text)
    raise ValueError(f"mode must be 'word' or 'char', got {mode!r}")


def totals(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*group, "actor").agg(F.sum("cnt").alias("total"))


def probabilities(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts with each token's share of its actor; one total per actor is broadcast."""
    keys = [*group, "actor"]
    return counts.join(F.broadcast(totals(counts, group)), keys).withColumn(
        "prob", F.col("cnt") / F.col("total")
    )


def _spread(left: DataFrame, right: DataFrame, on: Sequence[str], tasks: int) -> DataFrame:
    """Join a side named actor_1 with a side named actor_2, keeping actor_1 < actor_2.

    The rows of one key go to `tasks` tasks: the left row to one of them by its actor,
    the right row to all of them.
    """
    if tasks > 1 or not on:
        slot = F.pmod(F.xxhash64("actor_1"), F.lit(tasks))
        left = left.withColumn("_slot", slot)
        slots = F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))
        right = right.withColumn("_slot", F.explode(slots))
        on = [*on, "_slot"]
    joined = left.join(right, list(on)).where(F.col("actor_1") < F.col("actor_2"))
    return joined.drop("_slot")


def _side(df: DataFrame, keys: Sequence[str], columns: Sequence[str], i: int) -> DataFrame:
    return df.select(
        *keys,
        F.col("actor").alias(f"actor_{i}"),
        *[F.col(c).alias(f"{c}_{i}") for c in columns],
    )


def actor_pairs(actors: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """All unordered actor pairs of a group, one row each, with each side's columns."""
    keep = [c for c in actors.columns if c not in (*group, "actor")]
    tasks = int(actors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (_side(actors, group, keep, i) for i in (1, 2))
    return _spread(left, right, list(group), tasks)


def _shared(
    counts: DataFrame, group: Sequence[str], columns: Sequence[str], tasks: int
) -> DataFrame:
    """Rows of the tokens two actors share; one token's pairs are made by `tasks` tasks."""
    keys = [*group, "token"]
    left, right = (_side(counts, keys, columns, i) for i in (1, 2))
    return _spread(left, right, keys, tasks)


def _divergence(sum_p: Column, sum_q: Column, kl_p: Column, kl_q: Column) -> Column:
    jsd = 0.5 * ((1 - sum_p) * LN2 + kl_p) + 0.5 * ((1 - sum_q) * LN2 + kl_q)
    return F.sqrt(F.greatest(jsd, F.lit(0.0)))


def pair_distances(
    counts: DataFrame,
    actors: DataFrame | None = None,
    group: Sequence[str] = (),
    *,
    min_count: int = 1,
    tasks_per_token: int = 1,
) -> DataFrame:
    """L1 and Jensen-Shannon distance of every actor pair of every group.

    `actors` (group.., actor) names the actors to compare, silent ones included;
    pairs with a silent side get NULL distances. With `min_count` above 1 a pair's
    vocabulary keeps the tokens whose pooled count reaches it, and shares are taken
    over that vocabulary. A token used by n actors makes n * (n - 1) / 2 rows that are
    summed where they arise; `tasks_per_token` spreads them when n is in the thousands.
    """
    size = totals(counts, group)
    if actors is None:
        listed = size
    else:
        listed = actors.select(*group, "actor").join(size, [*group, "actor"], "left")
    if min_count > 1:
        return _filtered_distances(counts, listed, group, min_count, tasks_per_token)
    keys = [*group, "actor_1", "actor_2"]
    # One row per actor, and every pair of actors is listed below.
    shares = counts.join(F.broadcast(size), [*group, "actor"]).select(
        *group, "actor", "token", (F.col("cnt") / F.col("total")).alias("p")
    )
    p, q = F.col("p_1"), F.col("p_2")
    mid = (p + q) / 2
    sums = _shared(shares, group, ["p"], tasks_per_token).groupBy(*keys).agg(
        F.sum(F.least(p, q)).alias("both"),
        F.sum(p).alias("sp"),
        F.sum(q).alias("sq"),
        F.sum(p * F.log(p / mid)).alias("kp"),
        F.sum(q * F.log(q / mid)).alias("kq"),
    )
    grid = actor_pairs(listed, group).join(sums, keys, "left").na.fill(
        0.0, ["both", "sp", "sq", "kp", "kq"]
    )
    heard = F.col("total_1").isNotNull() & F.col("total_2").isNotNull()
    return grid.select(
        *keys,
        F.when(heard, F.greatest(2 - 2 * F.col("both"), F.lit(0.0))).alias("l1"),
        F.when(heard, _divergence(*[F.col(c) for c in ("sp", "sq", "kp", "kq")])).alias("js"),
    )


def _filtered_distances(
    counts: DataFrame, listed: DataFrame, group: Sequence[str], k: int, tasks: int
) -> DataFrame:
    keys = [*group, "actor_1", "actor_2"]
    alone = counts.groupBy(*group, "actor").agg(
        F.sum(F.when(F.col("cnt") >= k, F.col("cnt")).otherwise(0)).alias("big")
    )
    sides = listed.join(alone, [*group, "actor"], "left")
    c1, c2 = F.col("cnt_1"), F.col("cnt_2")
    shared = _shared(counts, group, ["cnt"], tasks).where(c1 + c2 >= k)
    extra = shared.groupBy(*keys).agg(
        F.sum(F.when(c1 < k, c1).otherwise(0)).alias("x1"),
        F.sum(F.when(c2 < k, c2).otherwise(0)).alias("x2"),
    )
    grid = (
        actor_pairs(sides, group)
        .join(extra, keys, "left")
        .na.fill(0, ["x1", "x2"])
        .withColumn("t1", F.col("big_1") + F.col("x1"))
        .withColumn("t2", F.col("big_2") + F.col("x2"))
    )
    sized = shared.join(F.broadcast(grid.select(*keys, "t1", "t2")), keys)
    p, q = c1 / F.col("t1"), c2 / F.col("t2")
    mid = (p + q) / 2
    sums = sized.groupBy(*keys).agg(
        F.sum(F.abs(p - q)).alias("gap"),
        F.sum(p).alias("sp"),
        F.sum(q).alias("sq"),
        F.sum(p * F.log(p / mid)).alias("kp"),
        F.sum(q * F.log(q / mid)).alias("kq"),
    )
    full = grid.join(sums, keys, "left").na.fill(0.0, ["gap", "sp", "sq", "kp", "kq"])
    heard = F.col("total_1").isNotNull() & F.col("total_2").isNotNull()
    one = F.when(F.col("t1") > 0, 1.0).otherwise(0.0)
    two = F.when(F.col("t2") > 0, 1.0).otherwise(0.0)
    l1 = F.col("gap") + (one - F.col("sp")) + (two - F.col("sq"))
    js = _divergence(*[F.col(c) for c in ("sp", "sq", "kp", "kq")])
    both = heard & (F.col("t1") > 0) & (F.col("t2") > 0)
    return full.select(
        *keys,
        F.when(heard, F.greatest(l1, F.lit(0.0))).alias("l1"),
        F.when(both, js).alias("js"),
    )


def long_distances(pairs: DataFrame, metrics: Sequence[str] = ("l1", "js")) -> DataFrame:
    """Wide distances as one row per (pair, metric)."""
    rest = [c for c in pairs.columns if c not in metrics]
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("distance")) for m in metrics]
    )
    return pairs.select(*rest, F.inline(cells))


ORDERS = ("absdiff", "file1", "file2", "sum")


def token_differences(
    counts: DataFrame,
    actor_1: str,
    actor_2: str,
    *,
    top_k: int = 20,
    min_count: int = 1,
    order: str = "absdiff",
) -> DataFrame:
    """The top tokens by difference (or share) between two actors."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, got {order!r}")
    pair = counts.where(F.col("actor").isin(actor_1, actor_2))
    table = pair.groupBy("token").agg(
        F.sum(F.when(F.col("actor") == actor_1, F.col("cnt")).otherwise(0)).alias("cnt_1"),
        F.sum(F.when(F.col("actor") == actor_2, F.col("cnt")).otherwise(0)).alias("cnt_2"),
    )
    kept = table.where(F.col("cnt_1") + F.col("cnt_2") >= min_count)
    sums = kept.agg(F.sum("cnt_1").alias("t1"), F.sum("cnt_2").alias("t2"))
    p1 = F.coalesce(F.col("cnt_1") / F.nullif(F.col("t1"), F.lit(0)), F.lit(0.0))
    p2 = F.coalesce(F.col("cnt_2") / F.nullif(F.col("t2"), F.lit(0)), F.lit(0.0))
    rows = kept.join(F.broadcast(sums)).select(
        "token", "cnt_1", "cnt_2", p1.alias("p_1"), p2.alias("p_2"), (p1 - p2).alias("delta")
    )
    rank = {
        "absdiff": F.abs("delta"),
        "file1": F.col("p_1"),
        "file2": F.col("p_2"),
        "sum": F.col("p_1") + F.col("p_2"),
    }[order]
    return rows.orderBy(F.round(rank, 12).desc(), "token").limit(top_k)


def require_tokens(counts: DataFrame, actors: Sequence[str]) -> None:
    """Error unless each of the actors has at least one token."""
    seen = {
        r["actor"]
        for r in counts.where(F.col("actor").isin(*actors)).select("actor").distinct().collect()
    }
    silent = sorted(set(actors) - seen)
    if silent:
        raise ValueError(f"no tokens for {silent}")
