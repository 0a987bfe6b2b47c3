"""All registered queries and their SQL."""

from __future__ import annotations

from tidewick.queries import formulas, gates, identity, operations, orders, preparation, streams

MODULES = (formulas, preparation, gates, operations, orders, identity, streams)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
flagship = formulas.entry_frame
