"""Column expressions shared by the operators of this folder."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WHITE = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. For all-ASCII rows ``lower`` does the same and is much faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, with underscores appended until it clashes with none of ``taken`` (any case)."""
    low = {c.lower() for c in taken}
    while wish.lower() in low:
        wish += "_"
    return wish


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once (a lambda over an array of one element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
