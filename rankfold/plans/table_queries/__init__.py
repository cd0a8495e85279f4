"""The operators run over the given tables, each beside the SQL it must agree with."""

from rankfold.plans.table_queries import boards, dates, listing, matching, ranking, registry, rules, runs, shipped, text

_MODULES = (text, dates, listing, boards, matching, ranking, rules, registry, runs, shipped)


def all_queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
