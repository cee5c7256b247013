"""All queries of the library outside the training-data operators."""

from __future__ import annotations

from tessera.plans import marts, ops, pages, registry, reports

QUERIES = {**marts.QUERIES, **ops.QUERIES, **registry.QUERIES, **pages.QUERIES, **reports.QUERIES}
ORACLE_SQL = {**marts.ORACLE_SQL, **ops.ORACLE_SQL, **registry.ORACLE_SQL, **pages.ORACLE_SQL, **reports.ORACLE_SQL}
