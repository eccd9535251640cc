"""Object names: ``schema.table`` qualification and dotted-suffix splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SCHEMA = "public"


def split_name(name: str) -> tuple[str, str]:
    """``'s.t'`` -> ``('s', 't')``; a bare ``'t'`` lives in the default schema."""
    if "." in name:
        schema, table = name.split(".", 1)
        return schema, table
    return DEFAULT_SCHEMA, name


def qualify(name: str) -> str:
    schema, table = split_name(name)
    return f"{schema}.{table}"


def name_suffixes(name: Column) -> Column:
    """Array of the full name and every dotted suffix, longest tail last:
    ``lake.trips.fare`` -> ``[lake.trips.fare, fare, trips.fare]``."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    # suffix k (k = 1..n-1) is the last k parts joined by dots
    tails = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                        lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    return F.when(n > 1, F.concat(F.array(name), tails)).otherwise(F.array(name))


def signed_text(d: Column) -> Column:
    """``+3``, ``+0``, ``-2``."""
    return F.when(d >= 0, F.concat(F.lit("+"), d.cast("string"))).otherwise(d.cast("string"))
