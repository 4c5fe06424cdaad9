"""Native text expressions shared by the operators: ASCII lower case, word arrays, rolling gram hashes."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of digits, ASCII letters and anything beyond ASCII (after A-Z went to lower case).
LETTER_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs without ASCII white space.
SPACED_WORDS = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts that are pure ASCII take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def gram_hashes(w: str, k: int) -> Column:
    """For each place of the word array column ``w``, the hash of the ``k`` words that begin there.

    Near the end, where fewer than ``k`` words are left, the hash covers those that are left.
    """
    more = "".join(f", get({w}, i + {j})" for j in range(1, k))
    return F.expr(f"transform({w}, (x, i) -> xxhash64(x{more}))")


def joined(values: Column) -> Column:
    """Distinct strings, sorted and comma-joined; empty string for none."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")
