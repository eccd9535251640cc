"""Secret scan with multipart credential linking, DataFrame functions only.

Base findings stand by themselves: assignments (a keyword, ``:`` or ``=``, a value of 6 or more
characters), access identifiers and long hex strings. Weak parts are only reported together: an access
identifier by name (``user = ...``), a bare 40-character key, a value behind a weak keyword, an endpoint. Each part
has a role (identifier, secret, endpoint); base findings have roles too. A scope is an interval of the text that its form
bounds, however long: a group of lines up to a blank line, one record of a list of records (``},{``), or, in prose, a sentence. Parts
link if they begin in one scope: a weak secret needs an identifier, a weak identifier a secret, an endpoint both. The interval
join of parts and scopes is a running count of the scopes' bounds over the places of both; what roles a scope has is one
aggregated row, so no pairs of parts are made.

Places come from the lengths of the matches and of what lies between them, summed along a text by a
window. Texts with a match are known by a hash of the text: the parts of equal texts are worked out
once however often they occur, and texts without a match take no part in a join or shuffle. The patterns run once over each text,
for the scan as for masking.

Patterns see whole texts; none of them goes back over what it has repeated, so matching takes neither deep stacks nor more
than linear time. Spans count code points, end exclusive. Weak parts that overlap a base finding are dropped.

Defined results: null and empty texts have no findings. Repeated rows and null ids each get their
row. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from branchwise.llm.common import table, written

#: Code points of the cells by which overlapping spans meet.
CELL = 400
#: Matches of an assignment take in too short values, as a longest run does; those are dropped afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 6
#: Between scopes: a blank line, the end of a record before the next, the end of a sentence.
BREAK = r"\n[ \t\r]*+\n|\}[ \t\r\n]*+,[ \t\r\n]*+\{|[.!?][\"')\]]*+[ \t\r\n]++(?=[A-Z\u00C0-\u00DE])"
#: kind: (pattern, role). The first three are the base, in the order in which kinds of one start are listed.
#: The access and hex patterns are maximal runs, so a least length in the pattern drops what is too short.
KINDS = {
    "assign": (ASSIGN, "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", "identifier"),
    "hex": (r"[0-9a-f]{24,}", "secret"),
    "key40": (r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=]))(?=[^A-Z]{0,39}[A-Z])(?=[^a-z]{0,39}[a-z])(?=[^0-9]{0,39}[0-9])"
              r"[A-Za-z0-9+/]{40}",
              "secret"),
    "value": (r"""(?i)\b(?:pwd|passphrase|credentials?|auth|private_?key)["']?\x20*[:=]\x20*["']?[^\s"'<>]{6,}""", "secret"),
    "ident": (r"""(?i)\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""",
              "identifier"),
    "endpoint": (r"""(?i)\b(?:(?:https?|ftps?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb)://[^\s"'<>]{3,}|"""
                 r"""(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++)""", "endpoint"),
}
BASE = ("assign", "access", "hex")
RANK = {k: n for n, k in enumerate(KINDS)}
NEEDS = {"secret": ("identifier",), "identifier": ("secret",), "endpoint": ("identifier", "secret")}


def hit(text: Column, kind: str) -> Column:
    """Does the kind's pattern match? What every match of it holds is looked for first, which is much cheaper."""
    pattern = KINDS[kind][0]
    if kind == "access":
        return text.contains("AKIA") & text.rlike(pattern)
    if kind in ("hex", "key40"):
        return text.rlike(pattern)
    return (text.contains("=") | text.contains(":")) & text.rlike(pattern)


def suspect(text: Column) -> Column:
    """Does any pattern match?"""
    return F.coalesce(reduce(Column.__or__, (hit(text, k) for k in KINDS)), F.lit(False))


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, gap, size, good): what lies before each match, its length, is it long enough."""
    pattern = BREAK if kind == "break" else KINDS[kind][0]
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE) \
        if kind == "assign" else F.transform(hits, lambda h: F.lit(True))
    found = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h"), good.alias("k")), lambda z: F.struct(
        F.lit(kind).alias("kind"), F.length(z["g"]).alias("gap"), F.length(z["h"]).alias("size"), z["k"].alias("good")))
    return F.when(text.rlike(pattern) if kind == "break" else hit(text, kind), F.slice(found, 1, F.size(hits)))


def matches(text: Column) -> Column:
    """What ``_matches`` gives for each kind and for blank lines; null for a text without a finding or part."""
    found = F.array_compact(F.array(*(_matches(text, k) for k in (*KINDS, "break"))))
    return F.when(suspect(text), found)


def spans(seen: DataFrame) -> DataFrame:
    """key and found, the sorted (start, rank, kind, end) of each text that has a finding; seen: key, m (``matches``)."""
    seen = seen.select("key", "m").dropDuplicates(["key"])
    rows = seen.select("key", F.explode("m").alias("m")).select("key", F.posexplode("m").alias("n", "m")).select("key", "n", "m.*")
    along = Window.partitionBy("key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("long")).over(along))
    rows = rows.withColumn("start", F.col("end") - F.col("size")).where("good")
    in_text = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.sum((F.col("kind") == "break").cast("long")).over(in_text)).where("kind <> 'break'")
    role = F.create_map(*(F.lit(x) for k, (_, r) in KINDS.items() for x in (k, r)))
    rank = F.create_map(*(F.lit(x) for k, r in RANK.items() for x in (k, r)))
    parts = written(rows.select("key", "kind", "start", "end", "scope", role[F.col("kind")].alias("role"),
                                rank[F.col("kind")].alias("rank")), "secret-parts")
    base = parts.where(F.col("kind").isin(*BASE))
    # weak parts that overlap a base finding go: both cover a common cell
    cells = F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL)))
    weak = parts.where(~F.col("kind").isin(*BASE))
    covers = base.select(F.col("key").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"), cells.alias("c2"))
    hidden = weak.select("key", "rank", "start", "end", cells.alias("c1")).join(
        covers, (F.col("key") == F.col("k2")) & (F.col("c1") == F.col("c2")) & (F.col("s2") < F.col("end")) & (F.col("start") < F.col("e2")),
        "left_semi").select("key", "rank", "start").distinct()
    weak = weak.join(hidden, ["key", "rank", "start"], "left_anti")
    every = base.unionByName(weak)
    roles = every.groupBy("key", "scope").agg(*(F.max(F.col("role") == r).alias(f"has_{r}") for r in ("identifier", "secret")))
    linked = reduce(Column.__or__, ((F.col("role") == r) & reduce(Column.__and__, (F.col(f"has_{need}") for need in needs))
                                    for r, needs in NEEDS.items()))
    weak = weak.join(roles, ["key", "scope"]).where(linked).select(*base.columns)
    found = base.unionByName(weak)
    return found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("found"))


def _found(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df``, named ``kept_``, with found (null where the text has nothing)."""
    t = F.col(f"`{text}`").cast("string")
    rows = df.select(*(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep), matches(t).alias("m"), t.alias("t"))
    rows = rows.withColumn("__key", F.when(F.col("m").isNotNull(), text_key(F.col("t")))).drop("t")
    rows = written(rows, "secret-rows")
    found = spans(rows.where("__key is not null").select(F.col("__key").alias("key"), "m"))
    kept = [F.col(f"`kept_{c}`") for c in keep]
    hits = rows.where("__key is not null").join(found, F.col("__key") == F.col("key"), "left").select(*kept, "found")
    none = F.lit(None).cast(found.schema["found"].dataType).alias("found")
    return hits.unionByName(rows.where("__key is null").select(*kept, none))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``df`` with found: the sorted (start, rank, kind, end) of each row's text."""
    keep = [c for c in df.columns if c not in (text, "found")]
    out = _found(df, text, keep)
    return out.select(*(F.col(f"`kept_{c}`").alias(c) for c in keep), F.coalesce("found", F.array().cast(out.schema["found"].dataType)).alias("found"))


def mask(df: DataFrame, text: str = "text", mark: str = "[redacted]") -> DataFrame:
    """``df`` with every finding in ``text`` replaced by ``mark``; overlapping findings become one."""
    out = _found(df, text, df.columns)
    # runs of overlapping findings: a finding begins one if none before it reaches it
    merged = F.aggregate(
        "found", F.array().cast("array<struct<s:bigint,e:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] > x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["end"]).alias("e"))))).otherwise(
            F.concat(acc, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e"))))))
    out = out.withColumn("cuts", F.when(F.col("found").isNotNull(), merged))
    t, n = F.col(f"`kept_{text}`").cast("string"), F.size("cuts")
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substr(
        t, F.when(i == 0, 1).otherwise(F.get("cuts", i - 1)["e"] + 1).cast("int"),
        (F.when(i == n, F.length(t)).otherwise(F.get("cuts", i)["s"]) - F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["e"])).cast("int")))
    new = F.when(F.col("cuts").isNull(), t).otherwise(F.array_join(pieces, mark))
    return out.select(*(new.alias(c) if c == text else F.col(f"`kept_{c}`").alias(c) for c in df.columns))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"),
                      listed(F.col("found")).alias("spans"))
