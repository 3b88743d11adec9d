"""Training-corpus operators. Nothing outside this subpackage imports it.

queries() and oracle_sql() collect what the modules register; each module holds the
general operator, the thin opN_ query and, where SQL can express it, the DuckDB text.
Modules load when asked for, so that a Python worker loads only the one it runs.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "exact_dedup",
    "simhash_vp",
    "separator_scan",
    "quality",
    "line_dedup",
    "html_main",
    "url_trees",
    "langid",
    "bpe",
    "packing",
    "source_divergence",
    "vector_codes",
    "substring_fm",
)


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), what).items()}


def queries() -> dict:
    """Name -> callable(spark, sf_dir) of every operator here."""
    return _all("QUERIES")


def oracle_sql() -> dict:
    """Name -> DuckDB SQL, for the operators that SQL can express."""
    return _all("ORACLE")
