"""Corpus operators for training data; nothing else in the library imports this subpackage.

Each module keeps one operator: a general function on DataFrames, and the query opN_<name> that applies it to its table.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("warc", "line_rules", "compress_quality", "packing", "token_files", "licenses", "minhash", "word_table", "attention_lm", "ann", "hard_negatives", "reply_trees", "fill_middle")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in import_module(f"{__name__}.{m}").SQL.items()}
