"""Text clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters, combining marks, digits, underscore and white space of any script stay.
NON_WORD = r"[^\p{L}\p{M}\p{N}_\s]+"


def remove_non_word_characters(column: Column | str) -> Column:
    """Strip punctuation and symbols; NULL stays NULL."""
    return F.regexp_replace(column, NON_WORD, "")
