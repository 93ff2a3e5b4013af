"""All registered queries of the engine and the SQL they are held against."""

from importlib import import_module

from .base import ORACLE_SQL, QUERIES

FAMILIES = ("scans", "filters", "joins", "aggregates", "sequences", "texts", "content", "leakage", "selection", "statistics", "streams", "integrity", "exports")
for family in FAMILIES:
    import_module(f"{__package__}.{family}")

__all__ = ["ORACLE_SQL", "QUERIES"]
