"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, divergence, exact, langid, pieces, pii, secrets, sharding, simhash, substrings, toxicity, vectorcodes

_MODULES = (simhash, langid, exact, decontam, pii, substrings, pieces, toxicity, secrets, chat, divergence, vectorcodes, sharding)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
