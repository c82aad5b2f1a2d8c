"""Registered queries and their oracle SQL."""

from __future__ import annotations

from annalist.plans import evaluation, indexed, intake, judgments, ledger, lives, relations, retrieval, service, streams, texts

MODULES = [retrieval, texts, relations, ledger, evaluation, judgments, lives, service, streams, indexed, intake]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
