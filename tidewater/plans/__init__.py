"""Registered queries, their SQL counterparts, and the ingestion job."""

from importlib import import_module

MODULES = ("cleaning", "preparation", "retrieval", "monitoring", "metadata", "governing", "tables", "ingest", "streams")


def load_all() -> None:
    """Import the modules whose import registers queries."""
    for name in MODULES:
        import_module(f"tidewater.plans.{name}")
