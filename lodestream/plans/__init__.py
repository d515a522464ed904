"""Registered queries of the engine and their SQL."""

from . import agent, kv, sensor, streams, vector

MODULES = (sensor, vector, kv, agent, streams)


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
