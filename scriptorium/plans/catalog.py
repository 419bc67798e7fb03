"""All queries of the library, by name, with the SQL that checks them."""

from __future__ import annotations

from scriptorium.plans import answers, jobs, metadata, records, reporting, texts, transitions, vocabularies

_MODULES = [reporting, jobs, records, texts, vocabularies, metadata, transitions, answers]

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
