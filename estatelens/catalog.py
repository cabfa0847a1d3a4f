"""The library's queries over the driver's tables, with the SQL of each."""

from __future__ import annotations

from estatelens.plans import changes, core, dashboard, evidence, graphs, readers, texts

_MODULES = (core, dashboard, changes, evidence, graphs, readers, texts)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
