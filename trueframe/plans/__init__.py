"""Named queries: each binds the given tables to one operator."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = (
    "scans", "metrics", "ranking", "comparison", "gates", "timeline", "shots",
    "corpus", "joins", "checks", "contract", "policy", "text", "vectors", "streams",
)

for _name in MODULES:
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
