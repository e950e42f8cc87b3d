"""Registered queries: each runs library operators over the given tables and has the SQL of the
same question where SQL can put it."""

from airlattice.registry import levels, rasters, regions, stations, tiles

MODULES = (tiles, rasters, stations, regions, levels)


def queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
