"""Append-only change log: append entries, read them in order, find the newest entry per object.

Log columns: branch, id, event_time, command_tag, object_type, schema_name, object_identity,
command. Entries come from our own schema operations or from a schema diff
(:func:`entries_from_changes`); nothing parses SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.local import local_frame
from ..functions.names import name_suffixes
from ..llm.spelling import filters, held, points, polynomial, powers
from .asof import as_of

LOG_SCHEMA = ("branch string, id long, event_time timestamp, command_tag string, object_type string, "
              "schema_name string, object_identity string, command string")

#: Characters that are looked up first, at every place of a command, and characters of commands worked on at once.
START, TOGETHER = 4, 1 << 17

NAME_PATTERN = r"[A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z_][A-Za-z0-9_$]*)*"

_TAGS = {  # (object_kind, change_type) -> command tag
    ("table", "added"): "CREATE TABLE", ("table", "removed"): "DROP TABLE",
    ("column", "added"): "ALTER TABLE", ("column", "removed"): "ALTER TABLE", ("column", "modified"): "ALTER TABLE",
    ("index", "added"): "CREATE INDEX", ("index", "removed"): "DROP INDEX", ("index", "modified"): "CREATE INDEX",
    ("constraint", "added"): "ALTER TABLE", ("constraint", "removed"): "ALTER TABLE",
    ("constraint", "modified"): "ALTER TABLE",
}


def empty_log(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [], LOG_SCHEMA)


def entries_from_changes(changes: DataFrame, branch: str, event_time=None) -> DataFrame:
    """Log rows for a set of schema changes (one per change, in report order, ids from 1).

    ``event_time`` defaults to the current timestamp. The command is a SQL-like statement built
    from the change values (column adds and drops carry the column's definition).
    """
    tag = F.lit(None).cast("string")
    for (k, t), v in _TAGS.items():
        tag = F.when((F.col("object_kind") == k) & (F.col("change_type") == t), F.lit(v)).otherwise(tag)
    col_name = F.element_at(F.split("object_name", r"\."), -1)
    kind, ct = F.col("object_kind"), F.col("change_type")
    command = (
        F.when((kind == "table") & (ct == "added"),
               F.format_string("CREATE TABLE %s (%s)", "object_name", F.coalesce("new_value", F.lit(""))))
        .when((kind == "table") & (ct == "removed"), F.format_string("DROP TABLE %s", "object_name"))
        .when((kind == "column") & (ct == "added"),
              F.format_string("ALTER TABLE %s ADD COLUMN %s %s", "parent", col_name, "new_value"))
        .when((kind == "column") & (ct == "removed"),
              F.format_string("ALTER TABLE %s DROP COLUMN %s", "parent", col_name))
        .when((kind == "column") & (F.col("change_rank") == 0),
              F.format_string("ALTER TABLE %s ALTER COLUMN %s TYPE %s", "parent", col_name, "new_value"))
        .when((kind == "column") & (F.col("change_rank") == 1),
              F.format_string("ALTER TABLE %s ALTER COLUMN %s %s NOT NULL", "parent", col_name,
                              F.when(F.col("new_value") == "true", F.lit("DROP")).otherwise(F.lit("SET"))))
        .when(kind == "column",
              F.format_string("ALTER TABLE %s ALTER COLUMN %s SET DEFAULT %s", "parent", col_name,
                              F.coalesce("new_value", F.lit("NULL"))))
        .when((kind == "index") & (ct == "removed"), F.format_string("DROP INDEX %s", "object_name"))
        .when(kind == "index", F.col("new_value"))
        .when(ct == "removed", F.format_string("ALTER TABLE %s DROP CONSTRAINT %s", "parent",
                                               F.element_at(F.split("object_name", r"\."), -1)))
        .otherwise(F.format_string("ALTER TABLE %s ADD CONSTRAINT %s %s", "parent",
                                   F.element_at(F.split("object_name", r"\."), -1), "new_value")))
    identity = F.when(kind.isin("table", "index", "constraint"), F.col("object_name")).otherwise(F.col("parent"))
    # A change list has one row per changed object, so one ordered window numbers it; a log is never numbered again.
    w = Window.orderBy("group_rank", "object_name", "change_rank", "detail")
    return changes.select(
        F.lit(branch).alias("branch"), F.row_number().over(w).cast("long").alias("id"),
        (F.current_timestamp() if event_time is None else F.lit(event_time).cast("timestamp")).alias("event_time"),
        tag.alias("command_tag"),
        F.when(kind == "column", F.lit("table column")).otherwise(kind).alias("object_type"),
        F.element_at(F.split("object_name", r"\."), 1).alias("schema_name"),
        F.when(kind == "column", F.col("object_name")).otherwise(identity).alias("object_identity"),
        command.alias("command"))


def append(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries appended after the log's last id (per branch)."""
    last = log.groupBy("branch").agg(F.max("id").alias("_last"))
    e = entries.join(last, "branch", "left")
    e = e.withColumn("id", F.col("id") + F.coalesce("_last", F.lit(0))).drop("_last")
    return log.unionByName(e.select(*log.columns))


def read_log(log: DataFrame, branch: str | None = None) -> DataFrame:
    """Entries ordered by id; NULL schema, identity and command read as ''."""
    df = log if branch is None else log.filter(F.col("branch") == branch)
    return df.select("branch", "id", "event_time", "command_tag", "object_type",
                     F.coalesce("schema_name", F.lit("")).alias("schema_name"),
                     F.coalesce("object_identity", F.lit("")).alias("object_identity"),
                     F.coalesce("command", F.lit("")).alias("command")).orderBy("branch", "id")


def _mentions(command) -> Column:
    """The dotted names in a command and every run of their parts: ``a.b.c`` gives a, a.b, a.b.c, b, b.c, c."""
    names = F.regexp_extract_all(command, F.lit(NAME_PATTERN), F.lit(0))
    places = lambda p: F.sequence(F.lit(1), F.size(p))
    runs = lambda p: F.flatten(F.transform(places(p), lambda a: F.transform(
        F.sequence(a, F.size(p)), lambda b: F.array_join(F.slice(p, a, b - a + 1), "."))))
    return F.array_distinct(F.flatten(F.transform(names, lambda n: runs(F.split(n, r"\.")))))


def containing(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """Each entry (branch, id, command) with each ``ref`` of ``refs`` that is a part of its command: DF[branch, id, command, ref].

    Each task looks up every place of its commands, as hashes of that many characters, in broadcast Bloom filters of the refs, one for each length (at most
    16 MB): first the ``START`` characters there, as the start of any ref, and where these are one, the parts of each ref's length. What the filters
    hold is joined to the refs, so only parts of commands that are a ref are shuffled, however long the log and the list of refs are.
    Entries without a branch or an id are left out.
    """
    refs = refs.where("ref <> ''").select(F.col("ref").alias("word")).distinct()
    starts = refs.where(F.char_length("word") > START).select(F.substring("word", 1, START).alias("word")).distinct()
    lengths = sorted(r.n for r in refs.select(F.char_length("word").alias("n")).distinct().collect())  # a row for each length
    shard, blocks, _ = filters(refs.unionByName(starts).distinct())
    shared = entries.sparkSession.sparkContext.broadcast((lengths, shard, blocks))
    inverse = pow(int(powers(1)[1]), -1, 1 << 64)

    def probe(batches):
        lengths, shard, blocks = shared.value
        down = np.ones(1, np.uint64)
        for batch in batches:
            commands, at = batch.column("command").to_pylist(), 0
            while at < len(commands):
                end, size = at, 0
                while end < len(commands) and size < TOGETHER:
                    size += len(commands[end])
                    end += 1
                chars = points("".join(commands[at:end]))
                if len(down) <= len(chars):
                    down = np.full(2 * len(chars) + 1, inverse, np.uint64)
                    down[0] = 1
                    down = np.multiply.accumulate(down)
                value = polynomial(chars)
                first = np.concatenate(([0], np.cumsum([len(c) for c in commands[at:end]]))).astype(np.int64)
                entry = np.repeat(np.arange(end - at), np.diff(first))
                rest = first[entry + 1] - np.arange(len(chars))  # characters from here to the command's end
                part = lambda place, n: (value[place + n] - value[place]) * down[place]
                begun = np.flatnonzero(rest >= START)
                if START in shard:
                    begun = begun[held(part(begun, START), shard[START], blocks)]
                found: set[tuple[int, str]] = set()
                for n in lengths:
                    place = np.flatnonzero(rest >= n) if n < START else begun[rest[begun] >= n]
                    place = place[held(part(place, n), shard[n], blocks)]
                    for e, k in zip(entry[place].tolist(), (place - first[entry[place]]).tolist()):
                        found.add((e, commands[at + e][k:k + n]))
                rows = pa.array([at + e for e, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.take(rows).columns, pa.array([r for _, r in found], pa.string())],
                                                 names=["branch", "id", "command", "ref"])
                at = end

    entries = entries.select("branch", "id", "command").where("branch is not null and id is not null and command <> ''")
    types = {f.name: f.dataType.simpleString() for f in entries.schema}
    hits = entries.mapInArrow(probe, f"branch {types['branch']}, id {types['id']}, command string, ref string")
    return hits.join(refs.select(F.col("word").alias("ref")), "ref", "left_semi").select("branch", "id", "command", "ref")


def newest_change(log: DataFrame, objects: DataFrame, match: str = "exact") -> DataFrame:
    """Newest log entry per branch and object name: DF[branch, object_name, id, command].

    ``objects`` has object_name, and branch if an object is to be looked up in one branch's log only.
    ``match='exact'``: the entry's identity equals the name.
    ``match='loose'``: also an entry whose command names the object by its full name or a dotted suffix. Names
    are taken out of the commands, so both are equi joins however long the log is.
    ``match='contains'``: as loose, but any part of the command's text will do; see ``containing``.
    Objects without a match are left out.
    """
    if match not in ("exact", "loose", "contains"):
        raise ValueError("match must be 'exact', 'loose' or 'contains'")
    keys = ["branch", "object_name"] if "branch" in objects.columns else ["object_name"]
    objs = objects.select(*keys).distinct()
    entries = log.select("branch", "id", "object_identity", "command")
    on = ["branch", "ref"] if "branch" in keys else ["ref"]
    refs = objs.select(*keys, F.explode(name_suffixes(F.col("object_name"))).alias("ref")).filter("ref <> ''")
    found = objs.withColumn("ref", F.col("object_name")).join(entries.withColumnRenamed("object_identity", "ref"), on)
    found = found.select("branch", "object_name", "id", "command")
    if match == "loose":
        named = entries.select("branch", "id", "command", F.explode(_mentions(F.col("command"))).alias("ref"))
        found = found.unionByName(refs.join(named, on).select("branch", "object_name", "id", "command"))
    elif match == "contains":
        hits = containing(entries, refs).groupBy("branch", "ref").agg(F.max("id").alias("id"), F.max_by("command", "id").alias("command"))
        found = found.unionByName(refs.join(hits, on).select("branch", "object_name", "id", "command"))
    return found.groupBy("branch", "object_name").agg(F.max("id").alias("id"), F.max_by("command", "id").alias("command"))


def log_as_of(log: DataFrame, points: DataFrame, by: Sequence[str] = ("branch",)) -> DataFrame:
    """For each point (the columns ``by`` and ``at``, a time) the newest entry of the log up to then, by time and id.

    DF[columns of points, id, event_time, object_identity, command]; the last four are NULL where the log has none.
    """
    entries = log.select(*by, "id", "event_time", *[c for c in ("object_identity", "command") if c not in by])
    found = as_of(points, entries, by, "at", "event_time", "id")
    return found.select(*points.columns, *[F.col(f"entry.{c}").alias(c) for c in entries.columns if c not in by])


def status_lines(log: DataFrame, branch: str) -> DataFrame:
    """``tag type identity`` per entry (the status report)."""
    return read_log(log, branch).select(
        "id", F.concat_ws(" ", "command_tag", "object_type", "object_identity").alias("line"))


def log_lines(log: DataFrame, branch: str, verbose: bool = False) -> DataFrame:
    """``time  tag identity`` per entry, plus the command when verbose."""
    r = read_log(log, branch)
    line = F.format_string("  %s  %s %s", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"),
                           "command_tag", "object_identity")
    if verbose:
        line = F.when(F.col("command") != "", F.concat(line, F.lit("\n           "), F.col("command"))).otherwise(line)
    return r.select("id", line.alias("line"))
