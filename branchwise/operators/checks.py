"""Constraint checks over a namespace: primary key, unique, not null, foreign key, check.

All checks run as distributed aggregates and come back as one DataFrame
``[table, constraint_name, type, violations]`` (one row per constraint; 0 = holds):

* PRIMARY KEY / UNIQUE: ``groupBy(key).count()`` (partial aggregation on every task, so a hot
  key collapses before the shuffle) -> rows sharing a key with another row; a primary key also
  counts rows with a NULL key part; a UNIQUE key ignores rows with a NULL part, as SQL does.
* NOT NULL and CHECK: one conditional count per constraint, all in a single scan of the table.
  A CHECK fails only when its predicate is false (NULL passes, as in SQL).
* FOREIGN KEY: child key values are pre-aggregated to (value, count) before the anti join with
  the parent's key set, so a child value held by a third of all rows is one row in the join.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.local import local_frame
from ..functions.names import qualify
from ..sources.spec import TableSpec, pkey_name
from .fingerprint import union_all

RESULT_SCHEMA = "table string, constraint_name string, type string, violations long"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _row(table: str, name: str, kind: str, agg: DataFrame, col: str = "violations") -> DataFrame:
    return agg.select(F.lit(table).alias("table"), F.lit(name).alias("constraint_name"), F.lit(kind).alias("type"),
                      F.coalesce(F.col(col), F.lit(0)).cast("long").alias("violations"))


def check_key(df: DataFrame, cols: list[str], primary: bool) -> DataFrame:
    """One-row DF[violations]: rows whose key is shared (+ NULL-key rows for a primary key)."""
    # One grouped count; NULL key parts group together, so they are counted in the same pass.
    counts = df.groupBy(*[F.col(_q(c)) for c in cols]).count()
    any_null = reduce(lambda a, b: a | b, [F.col(_q(c)).isNull() for c in cols])
    bad = F.when(any_null, F.col("count") if primary else F.lit(0)).when(F.col("count") > 1, F.col("count"))
    return counts.agg(F.sum(bad).alias("violations"))


def check_foreign_key(child: DataFrame, cols: list[str], parent: DataFrame, ref_cols: list[str]) -> DataFrame:
    """One-row DF[violations]: child rows with a non-NULL key the parent lacks."""
    names = [f"__fk_{i}" for i in range(len(cols))]
    present = reduce(lambda a, b: a & b, [F.col(_q(c)).isNotNull() for c in cols])
    values = (child.filter(present).groupBy(*[F.col(_q(c)).alias(n) for c, n in zip(cols, names)])
              .agg(F.count(F.lit(1)).alias("n")))
    refs = parent.select(*[F.col(_q(c)).alias(n + "_ref") for c, n in zip(ref_cols, names)])
    cond = reduce(lambda a, b: a & b, [values[n] == refs[n + "_ref"] for n in names])
    return values.join(refs, cond, "left_anti").agg(F.sum("n").alias("violations"))


def check_rows(df: DataFrame, not_null: list[str], checks: Mapping[str, str]) -> DataFrame:
    """One-row DF with one count column per NOT NULL column and per CHECK, from one scan."""
    aggs = [F.count_if(F.col(_q(c)).isNull()).alias(f"nn_{i}") for i, c in enumerate(not_null)]
    aggs += [F.count_if(~F.coalesce(F.expr(p), F.lit(True))).alias(f"ck_{i}") for i, p in enumerate(checks.values())]
    return df.agg(*aggs)


def check_constraints(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec],
                      spark: SparkSession | None = None, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """All declared constraints of all tables as one DataFrame (one job when collected).

    Foreign keys look into ``parents`` (default: ``tables``), so the rows to check may be fewer than those that
    can be referenced. A foreign key whose parent isn't there is broken by every row with a key, and by itself.
    """
    parts: list[DataFrame] = []
    by_q = {qualify(n): df for n, df in (tables if parents is None else parents).items()}
    for name in sorted(tables):
        df = tables[name]
        spec = specs.get(name) or specs.get(qualify(name))
        if spec is None:
            continue
        tq = qualify(name)
        tbl = tq.split(".", 1)[1]
        if spec.primary_key:
            parts.append(_row(tq, pkey_name(tbl), "PRIMARY KEY", check_key(df, spec.primary_key, True)))
        for cname, cols in spec.unique.items():
            parts.append(_row(tq, cname, "UNIQUE", check_key(df, cols, False)))
        for cname, fk in spec.foreign_keys.items():
            parent = by_q.get(qualify(fk.ref_table))
            if parent is None:
                held = reduce(lambda a, b: a & b, [F.col(_q(c)).isNotNull() for c in fk.columns])
                lost = df.agg(F.greatest(F.count_if(held), F.lit(1)).alias("violations"))
                parts.append(_row(tq, cname, "FOREIGN KEY", lost))
                continue
            parts.append(_row(tq, cname, "FOREIGN KEY", check_foreign_key(df, fk.columns, parent, fk.ref_columns)))
        nn = [c for c in spec.not_null if c not in spec.primary_key]
        if nn or spec.checks:
            agg = check_rows(df, nn, spec.checks)
            named = [(f"{tbl}_{c}_not_null", "NOT NULL", f"nn_{i}") for i, c in enumerate(nn)]
            named += [(cname, "CHECK", f"ck_{i}") for i, cname in enumerate(spec.checks)]
            # One scan, unpivoted into one row per constraint.
            rows = F.explode(F.array(*[F.struct(F.lit(n).alias("constraint_name"), F.lit(k).alias("type"),
                                                F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations"))
                                       for n, k, c in named]))
            parts.append(agg.select(F.lit(tq).alias("table"), rows.alias("r")).select("table", "r.*"))
    if not parts:
        spark = spark or SparkSession.getActiveSession()
        return local_frame(spark, [], RESULT_SCHEMA)
    return union_all(parts)
