"""Datasets, actors and their log files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dataset names, log files and which dataset has which log.
DATASET_ALIASES = {"nextcloud": "Nextcloud", "wordpress": "WordPress", "wp": "WordPress"}
LOG_KEYS = ("audit", "auth", "nextcloud", "syslog")
MISSING_LOGS = (("WordPress", "nextcloud"),)


def dataset_name(alias: str) -> str:
    """Canonical dataset name of an alias."""
    known = DATASET_ALIASES.get(alias.strip().lower())
    if known is None:
        raise ValueError(f"unknown dataset {alias!r}; known: {sorted(DATASET_ALIASES)}")
    return known


def dataset_name_column(alias: Column) -> Column:
    """Canonical name, NULL when the alias is unknown."""
    pairs = [F.lit(x) for item in DATASET_ALIASES.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(alias)))


def is_ai(actor: Column, marker: str = "GPT", *, ignore_case: bool = False) -> Column:
    if ignore_case:
        return F.lower(actor).contains(marker.lower())
    return actor.contains(marker)


def class_label(actor: Column, marker: str = "GPT", *, ignore_case: bool = False) -> Column:
    return F.when(is_ai(actor, marker, ignore_case=ignore_case), "ai").otherwise("human")


def discover_actors(lines: DataFrame, actor: str = "actor") -> DataFrame:
    """The distinct actors of a table."""
    return lines.select(actor).distinct()


def actors_from_paths(lines: DataFrame, path: str = "path") -> DataFrame:
    """Actors named by the folder that holds each file."""
    return lines.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("actor")
    ).distinct()


def actor_groups(actors: DataFrame, marker: str = "GPT") -> DataFrame:
    """Actors with their class and their place in analysis order (humans first)."""
    return actors.select(
        "actor",
        class_label(F.col("actor"), marker).alias("label"),
        F.row_number()
        .over(Window.orderBy(is_ai(F.col("actor"), marker), "actor"))
        .cast("long")
        .alias("place"),
    )


def log_key(name: str) -> str:
    """Key of a log with or without its `.log` ending."""
    key = name[: -len(".log")] if name.endswith(".log") else name
    if key not in LOG_KEYS:
        raise KeyError(f"unknown log {name!r}; known: {LOG_KEYS}")
    return key


def select_logs(
    lines: DataFrame, actors: Sequence[str] | None = None, logs: Sequence[str] | None = None
) -> DataFrame:
    """Lines of some actors and logs; both are partition columns, so files are pruned."""
    out = lines
    if actors is not None:
        out = out.where(F.col("actor").isin(*actors))
    if logs is not None:
        out = out.where(F.col("log_type").isin(*[log_key(n) for n in logs]))
    return out


def resolve_logs(dataset: str, log_type: str = "all") -> list[str]:
    """Log types to load for a dataset; asking for one it lacks is an error."""
    name = dataset_name(dataset)
    valid = [k for k in ("audit", "nextcloud", "syslog") if (name, k) not in MISSING_LOGS]
    if log_type == "all":
        return valid
    if log_key(log_type) not in valid:
        raise ValueError(f"{name} has no {log_type} log; it has {valid}")
    return [log_key(log_type)]


def drop_missing_logs(requests: DataFrame) -> DataFrame:
    """Requests (dataset, log_type) without the combinations that do not exist."""
    absent = requests.sparkSession.createDataFrame(
        list(MISSING_LOGS), "dataset string, log_type string"
    )
    return requests.join(F.broadcast(absent), ["dataset", "log_type"], "left_anti")


def anonymize(actors: DataFrame, *, place: str = "place") -> DataFrame:
    """Display names: humans become `Human 1..n` by place, AI actors keep theirs."""
    ai = is_ai(F.col("actor"), "gpt", ignore_case=True)
    number = F.row_number().over(Window.partitionBy(ai).orderBy(place))
    return actors.withColumn(
        "display",
        F.when(ai, F.col("actor")).otherwise(
            F.concat(F.lit("Human "), number.cast("string"))
        ),
    )


def pick_actors(
    actors: DataFrame, *, n_humans: int, n_ais: int, marker: str = "GPT"
) -> DataFrame:
    """The first humans and the first AI actors in catalog order."""
    ai = is_ai(F.col("actor"), marker)
    rank = F.row_number().over(Window.partitionBy(ai).orderBy("actor"))
    quota = F.when(ai, n_ais).otherwise(n_humans)
    return actors.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")


def named_actors(actors: DataFrame, names: Sequence[str]) -> DataFrame:
    """The actors of a list; a name that is not there gives no row."""
    return actors.where(F.col("actor").isin(*names))


def log_type_of_file(name: Column) -> Column:
    """Coarse log type from a file name; the first hit wins."""
    low = F.lower(name)
    return (
        F.when(low.contains("audit"), "audit")
        .when(low.contains("nextcloud"), "nextcloud")
        .when(low.contains("syslog"), "syslog")
        .otherwise("unknown")
    )
