"""The registered queries and their reference SQL."""

from . import prep, scoring, slices, statistics, tables, timeline, whole_profile

_MODULES = (tables, statistics, timeline, scoring, prep, slices, whole_profile)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
