"""Every query of the library with its SQL counterpart."""

from __future__ import annotations

from peakloom.plans import evaluation, mapping, search, spectral, tables

MODULES = (evaluation, spectral, tables, search, mapping)


def queries() -> dict:
    """Query name -> callable of (spark, sf_dir)."""
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL."""
    return {name: text for m in MODULES for name, text in m.SQL.items()}
