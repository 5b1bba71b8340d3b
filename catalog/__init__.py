"""Checked queries over the supplied tables, one module per group of operators."""

from __future__ import annotations

import importlib

MODULES = ["graph", "walk", "records", "vectors", "questions", "dialogue", "reports", "text", "links", "ingestion"]

for _name in MODULES:
    importlib.import_module(f"catalog.{_name}")
