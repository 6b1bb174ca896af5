"""Conditions as SQL text, so that a long word list is one expression to build.

Each condition is made of plain ``contains`` / ``startswith`` / comparison
terms, which Spark can push to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable


def text_literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def contains_any(name: str, words: Iterable[str]) -> str:
    """True if the column holds one of the words; NULL text stays NULL."""
    return _joined(" OR ", (f"contains({name}, {text_literal(word)})" for word in words))


def contains_none(name: str, words: Iterable[str]) -> str:
    """True if the column holds none of the words; NULL text stays NULL."""
    return _joined(" AND ", (f"NOT contains({name}, {text_literal(word)})" for word in words))


def starts_with_any(name: str, prefixes: Iterable[str]) -> str:
    return _joined(" OR ", (f"startswith({name}, {text_literal(prefix)})" for prefix in prefixes))


def starts_with_none(name: str, prefixes: Iterable[str]) -> str:
    return _joined(" AND ", (f"NOT startswith({name}, {text_literal(prefix)})" for prefix in prefixes))


def all_of(conditions: Iterable[str]) -> str:
    return _joined(" AND ", conditions)


def _joined(operator: str, terms: Iterable[str]) -> str:
    return "(" + operator.join(terms) + ")"
