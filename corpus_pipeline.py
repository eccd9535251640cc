"""The corpus pipeline: documents that may be trained on, and how often each is taken.

Five stages, each one of the operators of ``branchwise.llm``: documents in no known language go, one of each group of
near-duplicates stays, documents that hold benchmark passages go, secrets are masked, and the rest is mixed
to its sources' target weights. A stage gets its predecessor's documents, written as Parquet and read again.
All stages but the last return the columns of their input; the last adds size, source_size, target and taken.

Every stage keeps rows that differ in nothing but their other columns, passes null texts as its operator defines
(the first drops them: they have no language), and gives an empty result for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm import decontaminate, langid, mixing, secret_scan, simhash
from branchwise.llm.common import cleared, remove, table, written
from branchwise.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined: no letters, or like no language that was learned (``langid.floors``)."""
    model = langid.train(docs.where(~langid.held_out()).select("text", "lang"))
    judged = written(langid.identify(docs, model, pred="__pred", score="__score"), "pipeline-judged")
    floors = langid.floors(judged.where(~langid.held_out()), "lang", "__pred", "__score")
    known = judged.where("__pred <> 'und' and __score > 0").join(F.broadcast(floors), F.col("__pred") == F.col("__lang"), "left")
    known = known.where(F.col("__score") >= F.coalesce("__floor", F.lit(langid.NOISE)))
    return known.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the one with the smallest id (null last), of those the smallest row."""
    key = F.sha2(F.col("text"), 256)
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), key.alias("key"))
    found = written(simhash.near_duplicates(docs.select(name.alias("__name"), "text"), doc_id="__name"), "pipeline-groups")
    kept = found.where(F.col("doc_id.id").eqNullSafe(F.col("component_id.id"))).select(
        F.col("doc_id.id").alias("__id"), F.col("doc_id.key").alias("__key"), F.col("root").alias("__root")).distinct()
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & key.eqNullSafe(F.col("__key")))
    rest = [c for c in docs.columns if c != "doc_id"]
    row = F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("__row")
    rows = rows.groupBy("__root").agg(F.min("doc_id").alias("__id"), row)  # a root's rows share their id by now
    return rows.select(*(F.col("__id").alias(c) if c == "doc_id" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    key = F.sha2(F.col("text"), 256)  # ids may be null or repeat; equal texts hold the same
    leaks = decontaminate.find_leaks(docs.select(key.alias("__key"), "text"), table(spark, sf_dir, "benchmark"), doc_id="__key")
    return docs.join(leaks.select(F.col("doc_id").alias("__leak")).distinct(), key == F.col("__leak"), "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every finding in the texts; ``n_chars`` follows the text."""
    out = secret_scan.mask(docs)
    if "n_chars" in out.columns:
        changed = F.col("text").contains("[redacted]")
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, 0 if none."""
    return mixing.mix(docs.withColumn("__words", F.col("text")), text="__words")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
]

#: Hashed profiles, XXH64 fingerprints and a latent space have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; what the stages wrote on the way is deleted when the next stage's documents are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with cleared(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
