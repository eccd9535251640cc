"""As-of join: each point in time with the last entry of its key up to then.

A window over a key would sort all of a key's rows in one task. Here time is cut into buckets: the last entry of each (key,
bucket) is a partial aggregate; a window over these few rows carries it on to later buckets; and a window inside each (key, bucket) finds
the last entry before a point among that bucket's own. The bucket's width follows from the number of entries, so a window's
rows stay near ``ROWS`` however many entries a key has, unless their times are the same.

Points before the first entry of their key, of a key without entries, or without a time have no entry (NULL). NULL keys match
NULL keys. Entries without a time match nothing. Of entries at the same time the one that is largest by ``order`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 10_000


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def as_of(points: DataFrame, entries: DataFrame, by: Sequence[str], at: str, time: str, order: str, rows: int = ROWS) -> DataFrame:
    """The columns of ``points`` and ``entry``, a struct of the entry's columns other than ``by``."""
    by = list(by)
    payload = F.struct(*[F.col(c) for c in entries.columns if c not in by])
    e = entries.where(F.col(time).isNotNull()).select(*by, _micros(time).alias("__t"), F.struct(
        _micros(time).alias("t"), F.col(order).alias("o"), payload.alias("entry")).alias("__e"))
    span = e.agg(F.min("__t").alias("a"), F.max("__t").alias("b"), F.count("*").alias("n")).first()
    start, buckets = span.a or 0, max(1, -(-span.n // rows))
    width = max(1, ((span.b or 0) - start) // buckets + 1)
    place = F.floor((F.col("__t") - F.lit(start)) / F.lit(width))
    place = F.least(F.greatest(place, F.lit(-1)), F.lit(buckets + 1)).cast("int").alias("__bucket")
    e = e.select("*", place)
    p = points.where(F.col(at).isNotNull()).select(F.struct(*points.columns).alias("__p"), *by, _micros(at).alias("__t")).select("*", place)

    last = e.groupBy(*by, "__bucket").agg(F.max("__e").alias("__last"))
    ends = last.unionByName(p.select(*by, "__bucket").distinct(), allowMissingColumns=True)
    ends = ends.groupBy(*by, "__bucket").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "__bucket", F.last("__last", ignorenulls=True).over(before).alias("__carried"))

    both = e.unionByName(p, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "__bucket").orderBy("__t", F.col("__p").isNotNull(), "__e").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__own", F.last("__e", ignorenulls=True).over(inside)).where("__p is not null")
    on = [F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "__bucket"]]
    found = found.alias("f").join(carried.alias("c"), on, "left")
    found = found.select("f.__p.*", F.coalesce("f.__own", "c.__carried")["entry"].alias("entry"))
    return found.unionByName(points.where(F.col(at).isNull()), allowMissingColumns=True)
