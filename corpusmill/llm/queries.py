"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import chunking, language, lookalike, main_text, mixing, packing, repeated_lines, residue, spam

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (spam, main_text, repeated_lines, lookalike, residue, chunking, packing, mixing, language):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
