"""Sequence complexity of actors: ids, motifs, all-pairs profiles, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.distributions import long_distances
from loomtrace.operators.sequences import SCALARS, id_counts, motif_counts, pair_profiles
from loomtrace.plans.ordered import along

# The (window size, stride) settings of the sweep.
SWEEP = ((1, 1), (3, 1), (5, 2), (10, 2), (25, 5))
ID_METRICS = (*SCALARS, "l1", "js")
SEQ_METRICS = tuple(f"{m}_seq" for m in ID_METRICS)


def pairwise_complexity(
    ids: DataFrame,
    order: Sequence[str],
    *,
    group: Sequence[str] = (),
    settings: Sequence[tuple[int, int]] = SWEEP,
    cid: str = "cid",
) -> DataFrame:
    """Twelve distances per pair and setting; a silent actor or one without windows: NULL."""
    group = list(group)
    keys = [*group, "actor"]
    actors = ids.select(*keys).distinct()
    on_ids = pair_profiles(id_counts(ids, keys, cid), actors, group)
    placed = along(ids.select(*keys, cid, *order), keys, order).positions().frame()
    listed = F.array(
        *[
            F.struct(F.lit(s).cast("long").alias("size"), F.lit(t).cast("long").alias("stride"))
            for s, t in settings
        ]
    )
    swept = actors.select(*keys, F.inline(listed))
    motifs = motif_counts(placed, keys, settings, cid=cid)
    on_motifs = pair_profiles(
        motifs, swept, [*group, "size", "stride"], suffix="_seq", min_distinct=4
    )
    return on_motifs.join(on_ids, [*group, "actor_1", "actor_2"]).select(
        *group, "size", "stride", "actor_1", "actor_2", *ID_METRICS, *SEQ_METRICS
    )


def sweep_distances(profiles: DataFrame) -> DataFrame:
    """The swept sequence metrics in long form, ready for a group report."""
    kept = profiles.drop(*ID_METRICS)
    return long_distances(kept, SEQ_METRICS)
