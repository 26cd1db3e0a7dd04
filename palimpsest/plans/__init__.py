"""Stand-in relations and the registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("retrieval", "versions", "answer", "rates", "logs", "library", "diff", "documents", "pages", "texts", "streams")


def load_all():
    from palimpsest.plans.registry import REGISTRY

    for name in MODULES:
        import_module(f"palimpsest.plans.{name}")
    return REGISTRY
