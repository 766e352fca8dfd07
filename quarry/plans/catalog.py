"""All queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from quarry.plans import code, graphs, review, search, service

QUERIES = {**search.Q, **graphs.Q, **service.Q, **review.Q, **code.Q}
ORACLE = {**search.SQL, **graphs.SQL, **service.SQL, **review.SQL, **code.SQL}
