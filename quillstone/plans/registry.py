"""Every query of the engine by name, with its oracle text."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("quillstone.plans.profiles", "quillstone.plans.graphs", "quillstone.plans.entities", "quillstone.plans.coverages", "quillstone.plans.texts", "quillstone.plans.bundles", "quillstone.plans.sessions", "quillstone.plans.material", "quillstone.plans.more", "quillstone.plans.merges", "quillstone.plans.records", "quillstone.plans.stats")


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(m), what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
