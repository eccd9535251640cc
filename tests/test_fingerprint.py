import hashlib
import math

from pyspark.sql import functions as F

from branchwise.functions.names import name_suffixes, signed_text
from branchwise.functions.rowtext import row_text
from branchwise.operators.datadiff import compare_data, format_data_changes
from branchwise.operators.fingerprint import fingerprint, fingerprint_all

EMPTY = hashlib.md5(b"0").hexdigest()


def test_quoting_keeps_null_and_empty_apart(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (1, "a,b"), (1, 'a"b'), (1, "a\\b"), (1, " "), (1, "a")],
                               "id int, s string")
    texts = [r.t for r in df.select(row_text(df).alias("t")).collect()]
    assert texts == ["(1,)", '(1,"")', '(1,"a,b")', '(1,"a""b")', '(1,"a\\\\b")', '(1," ")', "(1,a)"]
    assert len(set(texts)) == 7


def test_count_and_digest_of_two_rows(spark):
    items = spark.createDataFrame([(11, "kettle"), (12, "lamp")], "id int, name string")
    r = fingerprint(items).collect()[0]
    assert r.row_count == 2 and len(r.checksum) == 32 and r.checksum != EMPTY


def test_empty_table_sentinel(spark):
    r = fingerprint(spark.createDataFrame([], "id int")).collect()[0]
    assert (r.row_count, r.checksum) == (0, EMPTY)


def test_order_and_partitioning_do_not_matter(spark):
    df = spark.range(300).select("id", F.format_string("sku %05d", "id").alias("code"),
                                 (F.sqrt("id") * 3).alias("val"))
    a = fingerprint(df).collect()[0]
    b = fingerprint(df.repartition(7, "val").orderBy(F.desc("id"))).collect()[0]
    assert a == b


def test_duplicates_count_and_single_edit_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    dup = df.unionByName(df.filter("id = 1"))
    edited = spark.createDataFrame([(1, "a"), (2, "c")], "id int, s string")
    fps = {n: fingerprint(d).collect()[0].checksum for n, d in (("df", df), ("dup", dup), ("ed", edited))}
    assert len(set(fps.values())) == 3


def test_exact_sum_matches_python(spark):
    df = spark.range(1000).select(F.concat(F.lit("row-"), "id").alias("payload"))
    got = fingerprint(df).collect()[0].checksum
    total = 0
    for i in range(1000):
        h = int(hashlib.md5(f"(row-{i})".encode()).hexdigest()[:16], 16)
        total += h - (1 << 64) if h >= 1 << 63 else h
    assert got == hashlib.md5(str(total).encode()).hexdigest()


def test_fingerprint_all_keeps_empty_tables_and_skips_unlisted(spark):
    t = {"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([], "x int"),
         "other.c": spark.createDataFrame([(2,)], "x int")}
    rows = {(r.schema, r.table): (r.row_count, r.checksum) for r in fingerprint_all(t).collect()}
    assert rows[("public", "b")] == (0, EMPTY) and rows[("other", "c")][0] == 1
    only = fingerprint_all(t, only=["public.a"]).collect()
    assert [(r.table, r.row_count) for r in only] == [("a", 1)]


def test_compare_data_rules(spark):
    base = spark.createDataFrame([("public", "sites", 41, "d1"), ("public", "trips", 30, "d2"),
                                  ("public", "gone", 0, EMPTY)], "schema string, table string, row_count long, checksum string")
    cur = spark.createDataFrame([("public", "sites", 41, "d1"), ("public", "trips", 27, "d3"),
                                 ("public", "fresh", 0, EMPTY), ("public", "full", 3, "zz")],
                                "schema string, table string, row_count long, checksum string")
    r = {x.table: (x.base_rows, x.curr_rows, x.has_change) for x in compare_data(base, cur).collect()}
    assert r == {"sites": (41, 41, False), "trips": (30, 27, True), "gone": (0, 0, True),
                 "fresh": (0, 0, False), "full": (0, 3, True)}
    text = format_data_changes(compare_data(base, cur))
    assert text.startswith("Data changes (3 tables modified):")
    assert "  ~ public.trips (30 -> 27 rows, -3)" in text
    assert format_data_changes(compare_data(base, base)) == "No data changes."


def test_suffixes_and_signed_text(spark):
    df = spark.createDataFrame([("public.sites.code",), ("sites",), ("public.sites",), ("",)], "n string")
    got = [r.s for r in df.select(name_suffixes(F.col("n")).alias("s")).collect()]
    assert got == [["public.sites.code", "code", "sites.code"], ["sites"], ["public.sites", "sites"], [""]]
    d = spark.createDataFrame([(3,), (0,), (-2,)], "d long")
    assert [r.t for r in d.select(signed_text(F.col("d")).alias("t")).collect()] == ["+3", "+0", "-2"]


def digests(frames):
    return [fingerprint(f).collect()[0].checksum for f in frames]


def test_floating_point_text_is_exact(spark):
    up = math.nextafter
    values = [1e-7, 4e-7, 1e33, up(1e33, 2e33), math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, up(8, 9), 8.0, 1 / 3, up(1 / 3, 1)]
    texts = [r.t for r in spark.createDataFrame([(v,) for v in values], "x double").select(
        row_text(spark.createDataFrame([], "x double")).alias("t")).collect()]
    assert len(set(texts)) == len(values)
    assert [float.fromhex(t[1:-1].replace("Infinity", "inf")) for t in texts if "NaN" not in t] == [v for v in values if v == v]
    one, two = (spark.createDataFrame([(1, v)], "id int, x float") for v in (0.1, up(0.1, 1)))
    assert digests([one])[0] == digests([two])[0]  # the same single precision number
    a, b = (spark.createDataFrame([([1.0, v],)], "x array<double>") for v in (1e-7, 4e-7))
    assert len(set(digests([a, b]))) == 2


def test_null_elements_and_the_string_null_differ(spark):
    frames = [spark.createDataFrame([(x,)], "x array<string>") for x in (["NULL"], [None], ["null"], [], None, [""], ['"NULL"'])]
    assert len(set(digests(frames))) == 7


def test_instants_do_not_depend_on_the_session_zone(spark):
    # 2023-10-29 00:30 and 01:30 UTC are both 02:30 on a clock in Berlin
    hours = [spark.sql(f"SELECT timestamp_seconds({s}) AS t") for s in (1698539400, 1698543000)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    seen = []
    try:
        for z in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", z)
            seen.append(digests(hours))
            local = spark.sql("SELECT TIMESTAMP_NTZ '2023-03-26 02:30:00' AS t")  # skipped by that clock
            assert local.select(row_text(local)).first()[0] == '("2023-03-26 02:30:00")'
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seen[0] == seen[1] and len(set(seen[0])) == 2
