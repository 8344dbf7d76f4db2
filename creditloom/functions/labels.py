"""Text expressions: predicates on descriptions, label clean-up, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_safe(col: Column, text: str) -> Column:
    """Case-sensitive substring test; null counts as no match."""
    return F.coalesce(col.contains(text), F.lit(False))


def normalize_label(col: Column, suffix: str = "_expenses") -> Column:
    """Drop the suffix wherever it occurs, then first letter upper and the rest lower."""
    bare = F.replace(col, F.lit(suffix), F.lit(""))
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substring(bare, 2, 1 << 30)))


def padded_id(prefix: str, number: Column, width: int = 5) -> Column:
    """Prefix and number padded with zeros; a longer number keeps all its digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def postcode_flag(postcode: Column) -> Column:
    """1 where the first digit is even, else 0."""
    return (F.substring(postcode, 1, 1).cast("int") % 2 == 0).cast("int")
