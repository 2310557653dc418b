"""Registered queries, one module per family."""

from importlib import import_module

FAMILIES = (
    "sources",
    "groups",
    "behaviour",
    "learning",
    "rankings",
    "streams",
)


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"loomtrace.queries.{family}")
