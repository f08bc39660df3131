"""Document tables for tests, with further columns whose names clash with the operators' own."""

from __future__ import annotations


def documents(spark, rows):
    """``rows`` (doc_id, text) as a stored-like table with extra columns."""
    wide = [(doc, text, "en", "s", 0, "x", 1, "y") for doc, text in rows]
    return spark.createDataFrame(
        wide, "doc_id long, text string, lang string, source string, n_chars long, key string, row long, component string"
    ).coalesce(2)
