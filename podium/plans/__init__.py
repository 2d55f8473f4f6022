"""Registered queries: operators bound to the given tables, each beside its oracle SQL."""

from importlib import import_module

MODULES = ("events", "leaderboards", "scalars", "rescoring", "enrichment", "identity", "pages", "marts", "trophies", "audits")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"podium.plans.{name}")
