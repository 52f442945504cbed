"""Every query of the library: name -> f(spark, sf_dir), and its DuckDB SQL."""

from __future__ import annotations

from .plans import feeds, layout, live, scoring, state, store, web, writes  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
