"""Queries over the given tables, each with the SQL that must agree with it."""

from registry import catalog, comparing, graphs, joins, lineage, logs, outcomes, profiles, shaping, sources, specs, timed, transforms

MODULES = (profiles, catalog, joins, transforms, outcomes, specs, lineage, logs, sources, timed, shaping, comparing, graphs)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
