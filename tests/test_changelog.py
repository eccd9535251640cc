import random

from pyspark.sql import functions as F

from branchwise.operators import changelog as L
from branchwise.operators.asof import as_of

LOG = "branch string, id long, event_time timestamp, command_tag string, object_type string, schema_name string, object_identity string, command string"


def test_contains_finds_what_a_search_of_every_entry_finds(spark):
    rnd = random.Random(3)
    names = ["shop.items", "shop.it", "a.b.c", "x", "ab", "lake.trips.fare", "é.ü", "shop.items_old", "zz.none", "a%b.c_d", "😀.t"]
    bits = ["items", "shop", ".", "it", "x", "ab", "a", "b", "c", " ", "fare", "trips", "ü", "é", "_old", "%", "c_d", "😀", "t"]
    rows = [(rnd.choice("mn"), k, None, "T", "table", "s", rnd.choice([*names, None]),
             rnd.choice([None, "", "".join(rnd.choices(bits, k=rnd.randint(1, 9)))])) for k in range(400)]
    log = spark.createDataFrame(rows, LOG).repartition(4)

    def suffixes(name):
        parts = name.split(".")
        return {name, *(".".join(parts[k:]) for k in range(1, len(parts)))} - {""}

    def plainly(objects):
        out = {}
        for branch, k, *_, ident, command in rows:
            for own, name in objects:
                if own in (None, branch) and (ident == name or any(s in (command or "") for s in suffixes(name))):
                    out[branch, name] = max(out.get((branch, name), (-1, None)), (k, command), key=lambda x: x[0])
        return out

    objects = spark.createDataFrame([(n,) for n in names], "object_name string")
    got = {(r.branch, r.object_name): (r.id, r.command) for r in L.newest_change(log, objects, "contains").collect()}
    assert got == plainly([(None, n) for n in names])
    own = [("m", names[0]), ("n", names[3]), ("m", names[5]), ("o", names[0])]
    got = {(r.branch, r.object_name): (r.id, r.command)
           for r in L.newest_change(log, spark.createDataFrame(own, "branch string, object_name string"), "contains").collect()}
    assert got == plainly(own)
    assert L.newest_change(log, objects.limit(0), "contains").count() == 0
    assert L.newest_change(log.limit(0), objects, "contains").count() == 0


def test_contains_writes_no_index_and_hands_on_only_what_is_a_ref(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: (_ for _ in ()).throw(AssertionError("a table is written")))
    # every command has every run of three characters of many refs, so that any run of three finds nearly all pairs
    log = spark.range(3000).select(F.lit("b").alias("branch"), "id", F.concat(F.lit("alter table s.t"), F.col("id") % 40, F.lit(" 0123 1230 2301 3012 ü😀")).alias("command"))
    log = log.withColumn("object_identity", F.lit(None).cast("string")).repartition(3)
    names = ["s.t7", "s.t39", "x.t3012301230123", "ü😀", "q", *(f"s.t{k}" for k in range(100, 3000))]
    objects = spark.createDataFrame([(n,) for n in names], "object_name string")
    got = {(r.object_name, r.id) for r in L.newest_change(log, objects, "contains").collect()}
    assert got == {("s.t7", 2967 + 0), ("s.t39", 2999), ("ü😀", 2999)}


def test_contains_has_no_nested_loop(spark):
    log = spark.range(50).select(F.lit("b").alias("branch"), "id", F.concat(F.lit("x"), "id").alias("object_identity"), F.concat(F.lit("alter t"), "id").alias("command"))
    objects = spark.range(50).select(F.concat(F.lit("s.t"), "id").alias("object_name"))
    plan = L.newest_change(log, objects, "contains")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_against_a_search(spark):
    rnd = random.Random(4)
    entries = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(60)]), k, f"e{k}") for k in range(300)]
    points = [(k, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(-5, 80)])) for k in range(200)]
    at = lambda c: F.timestamp_seconds(F.col(c) * 1000)
    e = spark.createDataFrame(entries, "branch string, t long, id long, note string").withColumn("event_time", at("t")).drop("t").repartition(3)
    p = spark.createDataFrame(points, "point long, branch string, t long").withColumn("at", at("t")).drop("t").repartition(3)
    want = {}
    for k, branch, t in points:
        older = [(et, n, note) for b, et, n, note in entries if b == branch and t is not None and et is not None and et <= t]
        want[k] = max(older)[1:] if older else (None, None)
    for rows in (5, 10_000):
        got = as_of(p, e, ["branch"], "at", "event_time", "id", rows).collect()
        assert len(got) == len(points)
        assert {r.point: (r.entry.id, r.entry.note) if r.entry else (None, None) for r in got} == want
    assert as_of(p, e.limit(0), ["branch"], "at", "event_time", "id").where("entry is not null").count() == 0
    assert as_of(p.limit(0), e, ["branch"], "at", "event_time", "id").count() == 0


def test_log_as_of(spark):
    log = spark.createDataFrame([("dev", 1, "2024-01-01 10:00:00", "CREATE a"), ("dev", 2, "2024-01-02 10:00:00", "ALTER a")],
                                "branch string, id long, event_time string, command string")
    log = log.withColumn("event_time", F.to_timestamp("event_time")).withColumn("object_identity", F.lit("s.a"))
    points = spark.createDataFrame([("x", "dev", "2024-01-01 12:00:00"), ("y", "dev", "2023-01-01 00:00:00")], "name string, branch string, at string")
    got = {r.name: (r.id, r.command) for r in L.log_as_of(log, points.withColumn("at", F.to_timestamp("at"))).collect()}
    assert got == {"x": (1, "CREATE a"), "y": (None, None)}
