"""Every operator as a query on the test tables, each with plain SQL that must agree with it."""

from importlib import import_module

from workload.base import ORACLES, QUERIES

for _part in ("sources", "shapes", "joins", "profiles", "quality", "concepts", "segments",
              "series", "findings", "trust", "alerts", "privacy", "results"):
    import_module(f"workload.{_part}")

__all__ = ["QUERIES", "ORACLES"]
