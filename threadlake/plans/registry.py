"""Registered queries over the bound test tables, with their SQL."""

from __future__ import annotations

from threadlake.plans import queries_archive, queries_reader, queries_scalar

QUERIES = queries_archive.QUERIES | queries_reader.QUERIES | queries_scalar.QUERIES
SQL = queries_archive.SQL | queries_reader.SQL | queries_scalar.SQL
