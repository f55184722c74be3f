"""All panel queries by inventory id: name to (query, SQL for the same rows)."""

from __future__ import annotations

from tidepanel.plans import books_sql, cross, derived_sql, factors_sql, inference_sql, lots_sql, parity_sql, selection_sql, signals_sql, streams, tables_sql, windows

TABLE = {**windows.TABLE, **cross.TABLE, **tables_sql.TABLE, **streams.TABLE, **signals_sql.TABLE, **derived_sql.TABLE, **books_sql.TABLE, **lots_sql.TABLE, **inference_sql.TABLE, **selection_sql.TABLE, **parity_sql.TABLE, **factors_sql.TABLE}
