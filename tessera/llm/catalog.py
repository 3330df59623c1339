"""All registered queries of this subpackage."""

from __future__ import annotations

from tessera.llm import queries as _queries


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict:
    return dict(_queries.ORACLES)
