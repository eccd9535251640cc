"""Mixing sources to target weights by a low-discrepancy schedule, DataFrame functions only.

Sources weigh 1, 2, 3, 1, ... in code point order (null last) and share all words by weight; a target stops
at ``MAX_EPOCHS`` times its source's words and the excess goes to the others by weight until none is above
(``targets``). Within a source the documents are shuffled by a hash and laid end to end; this stream is cut into blocks
of equal words. The schedule is a row of slots, one block each: slot i has the point frac((i + 1) * golden ratio), the
source is the one whose interval of cumulative shares holds the point, and the slot's rank among
its source's slots is the block that it takes (past the last block the next epoch begins). Any stretch of the
schedule holds the sources in nearly their shares; what the points leave a source short of at the end is
appended, what is over is dropped, and the last block is cut at the target, so a source's taken words are its
target, rounded down.

Slots are joined to blocks, blocks to the documents in them. The block length follows from the total so that there are
about ``SLOTS`` slots at any size. Running sums over a source go through hash buckets of about
``BUCKET_ROWS`` documents, so a source with a third of all rows is never one task's; only a few sums come to the driver.
Ordering the sources takes one task one row per source.

Defined results: null and empty texts have size 0 and are taken 0 times; with no words at all every target
is 0. A null source is a source. Repeated rows are documents of their own; rows without id too. The shuffle depends on the
id, the text and ``seed`` alone, ties go by size; rows of one id and text stand together, in as many buckets as the input had
partitions. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from branchwise.llm.common import WORD, table, written

MAX_EPOCHS = 3
SLOTS = 1 << 16
BUCKET_ROWS = 4096
CHUNK = 4096
GOLDEN = 0.6180339887498949


def shuffle_key(doc_id: str, text: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"),
                          F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).cast("binary"))


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division of what isn't negative."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sid (place in order), source, source_size, weight, target (double), goal (target rounded down)."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sums.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", F.col("sid") % 3 + 1)
    sources = written(sources, "mixing-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    whole = lambda x: F.lit(x).cast("decimal(20,0)")
    rest, weights, capped = total, 1, -1
    over = F.lit(False)
    while True:  # shares only grow, so a capped source stays capped
        now = sources.agg(F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))),
                          F.sum(over.cast("long"))).first()
        rest, weights = total - max_epochs * (now[0] or 0), now[1] or 1
        if (now[2] or 0) == capped:
            break
        capped = now[2] or 0
        over = F.col("weight") * whole(rest) > F.col("source_size").cast("decimal(20,0)") * whole(max_epochs * weights)
    share = F.col("weight") * F.lit(rest).cast("long")
    most = max_epochs * F.col("source_size")
    return sources.select(
        "sid", "source", "source_size", "weight",
        F.when(over, most.cast("double")).otherwise(share.cast("double") / F.lit(float(weights))).alias("target"),
        F.when(over, most).otherwise(div(share, weights)).alias("goal"))


def schedule(plan: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """slot, sid, k: each slot's source and its rank there; all of ``need`` ranks of each source, no more."""
    counts = plan.agg(F.sum("need"), F.count("*")).first()
    n, cells = int(counts[0] or 0), max(1024, 2 * int(counts[1]))
    upto = F.sum("need").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    ends = plan.where("need > 0").select("sid", "need", upto.alias("hi")).select(
        "sid", "need", ((F.col("hi") - F.col("need")) / max(n, 1)).alias("lo"), (F.col("hi") / max(n, 1)).alias("hi"))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    ends = ends.select("*", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    spark = plan.sparkSession
    point = (F.col("id") + 1) * GOLDEN
    points = spark.range(n).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    drawn = points.withColumn("cell", cell(F.col("u"))).join(ends, "cell").where("u >= lo and u < hi")
    drawn = written(drawn.select("slot", "sid", F.floor(F.col("slot") / chunk).alias("chunk")), "mixing-slots")
    per_chunk = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    run = Window.partitionBy("sid").orderBy("chunk")
    first = per_chunk.select("sid", "chunk", (F.sum("n").over(run) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = drawn.select("slot", "sid", "chunk", inside.alias("inside")).join(first, ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("first") + F.col("inside")).alias("k"))
    ranked = ranked.join(plan.select("sid", "need"), "sid").where("k < need").select("slot", "sid", "k")
    have = per_chunk.groupBy("sid").agg(F.sum("n").alias("have"))
    short = plan.select("sid", "need").join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    tail = short.where("have < need").select(F.lit(n).alias("slot"), "sid", F.explode(F.sequence("have", F.col("need") - 1)).alias("k"))
    return ranked.unionByName(tail)


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17,
        max_epochs: int = MAX_EPOCHS, slots: int = SLOTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The columns of ``df`` except ``text`` with size, source_size, target and taken."""
    new = ["size", "source_size", "target", "taken"]
    keep = [c for c in df.columns if c != text and c not in new]
    base = df.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in keep),
                     F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                     shuffle_key(f"`{doc_id}`", f"`{text}`", seed).alias("turn"))
    base = base.withColumn("row", F.monotonically_increasing_id()).withColumn("source", F.col(f"`__{source}`"))
    base = written(base, "mixing-sizes")
    plan = targets(base.select("source", "size"), max_epochs)
    sums = base.agg(F.sum("size"), F.count("*")).first()
    total, rows = int(sums[0] or 0), int(sums[1])
    block = max(1, -(-total // slots))
    size = F.greatest(F.col("source_size"), F.lit(1))
    plan = plan.withColumn("blocks", div(F.col("source_size") + (block - 1), block))
    plan = plan.withColumn("need", div(F.col("goal"), size) * F.col("blocks") + div(F.col("goal") % size + (block - 1), block))
    plan = written(plan, "mixing-plan")

    # what the slots take of each block: n whole takes, and the words of the one take that is cut
    turn = schedule(plan.select("sid", "need")).join(plan.select("sid", "source_size", "goal", "blocks"), "sid")
    turn = turn.withColumn("block", F.col("k") % F.col("blocks"))
    turn = turn.withColumn("words", F.least(F.lit(block), F.col("source_size") - F.col("block") * block))
    start = div(F.col("k"), F.col("blocks")) * F.col("source_size") + F.col("block") * block
    turn = turn.withColumn("got", F.least("words", F.col("goal") - start))
    takes = turn.groupBy("sid", "block").agg(F.sum((F.col("got") == F.col("words")).cast("long")).alias("whole"),
                                             F.max(F.when(F.col("got") < F.col("words"), F.col("got")).otherwise(0)).alias("cut"))

    # where each document lies in its source's stream
    digits = 0
    while rows > bucket_rows * 16**digits:
        digits += 1
    docs = base.where("size > 0").join(plan.select("sid", "source"), base["source"].eqNullSafe(plan["source"]))
    docs = docs.select("row", "sid", "size", "turn", f"__{doc_id}", F.substring("turn", 1, digits).alias("bucket"))
    # where one id and text has more rows than a bucket should, its bucket is cut on in the order of the rows: turn, size, input partition
    hot = docs.groupBy("sid", "bucket", "turn").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("sid", "bucket").distinct()
    docs = docs.join(hot.withColumn("cut", F.lit(True)), ["sid", "bucket"], "left")
    padded = lambda c: F.lpad(c.cast("string"), 20, "0")
    docs = docs.withColumn("bucket", F.when(F.col("cut"), F.concat("turn", padded(F.col("size")), padded(F.shiftright("row", 33))))
                           .otherwise(F.col("bucket"))).drop("cut")
    per_bucket = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    at = per_bucket.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("first"))
    order = Window.partitionBy("sid", "bucket").orderBy("turn", f"__{doc_id}", "size", "row")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = docs.select("row", "sid", "size", "bucket", inside.alias("inside")).join(at, ["sid", "bucket"])
    placed = placed.select("row", "sid", "size", (F.col("first") + F.col("inside")).alias("at"))
    parts = placed.select("row", "sid", "size", "at", F.explode(F.sequence(
        div(F.col("at"), block), div(F.col("at") + F.col("size") - 1, block))).alias("block"))
    begin = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))
    parts = parts.select("row", "sid", "block", begin.alias("a"), end.alias("z")).join(takes, ["sid", "block"])
    got = F.col("whole") * (F.col("z") - F.col("a")) + F.greatest(F.least("z", "cut") - F.col("a"), F.lit(0))
    taken = parts.groupBy("row").agg(F.sum(got).alias("taken"))

    out = base.join(plan.select(F.col("source").alias("__of"), "source_size", "target"), base["source"].eqNullSafe(F.col("__of")))
    out = out.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select(*(F.col(f"`__{c}`").alias(c) for c in keep), *new)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || sha256(coalesce(text, ''))) AS turn
           FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
           FROM d GROUP BY source),
     r AS (SELECT *, CAST(sum(source_size) OVER () - 3 * (sum(source_size) OVER o - source_size) AS BIGINT) AS rest,
                  CAST(sum(w) OVER () - (sum(w) OVER o - w) AS BIGINT) AS weights
           FROM s WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST)),
     c AS (SELECT *, CAST(w AS HUGEINT) * rest > CAST(3 AS HUGEINT) * source_size * weights AS capped FROM r),
     f AS (SELECT arg_max(rest, weights) AS rest, max(weights) AS weights FROM c WHERE NOT capped),
     t AS (SELECT c.source, c.source_size,
                  CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * f.rest AS DOUBLE) / CAST(f.weights AS DOUBLE) END AS target,
                  CASE WHEN capped THEN 3 * source_size ELSE (w * f.rest) // f.weights END AS goal
           FROM c, f),
     p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.goal // greatest(t.source_size, 1) AS epochs,
                  t.goal % greatest(t.source_size, 1) AS part,
                  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size
                                    ROWS UNBOUNDED PRECEDING) - d.size AS pos
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(least(pos + size, part) - pos, 0) AS BIGINT) AS taken FROM p
"""
