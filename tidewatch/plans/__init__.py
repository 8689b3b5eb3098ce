"""Registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = [
    "filters",
    "canonical",
    "landing",
    "metrics",
    "tracks",
    "bitemporal",
    "quality",
    "resolution",
    "areas",
    "fusion",
    "texts",
    "streams",
]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
