"""Printed documents for queries: text as SQL expressions, which both engines evaluate over the same table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of(key: str, *texts: str) -> str:
    """The text of a document's layout: the one at key modulo their number; NULL for a layout without it."""
    return f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


def said(text: str) -> str:
    """A text that is the same in all documents."""
    return "'" + text.replace("'", "''") + "'"


def column(text: str) -> Column:
    return F.expr(text)


def unnested(texts: list[str]) -> str:
    """DuckDB: the texts as rows, with their places from 0."""
    return f"unnest([{', '.join(texts)}]) AS text, unnest(range(0, {len(texts)})) AS line"
