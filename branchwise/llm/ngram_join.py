"""N-gram Jaccard join by prefixes of single tokens and of token combinations.

A text's set holds its shingles of words, each as one 61-bit hash (a token). Two sets link when their intersection is
``SHARE`` percent of their union at least; linked sets form components. Equal sets are one row from the start, whatever their
number.

All tokens have one global order: rare ones first, frequent ones last, by hash within. Of similar sets x and y, let a
and b be the tokens that only one of them has; a + b is at most D = |x| * (100 - SHARE) // SHARE, for either set. So

* their first common token is among the first D + 1 of both (the prefix for single tokens), and
* of their first a + b + 2 common tokens two neighbours stand side by side in both sets, since each token that is not
  common parts at most one pair of neighbours; these lie in the first 2 * (D + 1) (the extended prefix).

Hence a set is indexed by the single tokens of its prefix that aren't frequent, and where fewer than D + 1 tokens are not frequent, so that the
first common token may be a frequent one, also by the combinations of two neighbouring frequent tokens in its extended prefix.
A posting list of a frequent token falls into many short ones that way, and the number of keys stays linear in the set's size.
Which tokens are frequent only decides the cost: any choice that is the same for all sets loses no pair. All tokens are counted, in
blocks of ``HELD`` tokens, of which only what occurs twice or more in its block is sent on; so a token in more than ``FREQUENT`` texts
and one a block besides is known as frequent. At most ``MAX_FREQUENT`` of them are broadcast.

Candidates come in two rounds, so that a large group of near copies isn't expanded into its pairs. First each posting list links
its sets to one of them (of its size class). Lists whose sets are one component by then are done. In the others every two sets of
different components are candidates: the rows outside a list's largest component meet the rows inside, and one another across
components. Sizes and bit sketches rule out candidates in the join itself: a set's sketch is the parity of its tokens by
bucket (``SKETCH`` bits), and sketches that differ in more bits than the sets may in tokens can't be similar's. What is left is held
against finer sketches, of as many bits as the sets have tokens, and then the whole sets decide. Posting lists and hubs are joined, never collected; a hot key is split by the adaptive skew join.

Defined results: null and empty texts, and texts without words, have an empty set, which links with nothing. Texts of fewer words than
a shingle are one shingle. A component's id is the smallest id in it that is not null, null if there is none. Repeated
rows and ids are rows of their own, equal sets link. Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from branchwise.llm.common import table, written
from branchwise.llm.simhash import components

SHINGLE, SHARE = 3, 90
#: Texts that a token is in before it counts as frequent; frequent tokens that are broadcast.
FREQUENT, MAX_FREQUENT = 32, 1 << 20
#: Tokens that are counted together before their counts are sent on.
HELD = 1 << 22
#: Bits of a set's sketch, a multiple of 64.
SKETCH = 256
#: Sets whose numbers are broadcast to fetch their texts; more are joined.
FETCHED = 1 << 20
#: Bits of a token's hash; the class goes above them.
HASH = 61

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Words(dict):
    """Word -> 64-bit hash; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(text: str | None, known: Words, shingle: int = SHINGLE) -> np.ndarray:
    """The text's set as hashes in order."""
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for at in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[at:len(w) - k + 1 + at])
    return np.unique(h >> np.uint64(64 - HASH))


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col(f"`{text}`").cast("string").alias("text"))


def frequent_tokens(texts: DataFrame, shingle: int = SHINGLE, frequent: int = FREQUENT, most: int = MAX_FREQUENT) -> np.ndarray:
    """In order: the tokens in more than ``frequent`` texts, or than a power of two times that if there are over ``most``."""
    def count(batches):
        known, held, size = Words(), [], 0

        def send():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"token": found[n > 1].view(np.int64), "n": n[n > 1].astype(np.int32)})

        for batch in batches:
            for t in batch.column(0):
                held.append(tokens(t.as_py(), known, shingle))
                size += len(held[-1])
                if size >= HELD:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    sums = texts.mapInArrow(count, "token long, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > frequent)
    sums = written(sums, "ngram-frequent")
    power = F.floor(F.log2(F.col("n") / F.lit(frequent))).cast("int")
    sizes = {r[0]: r[1] for r in sums.groupBy(power.alias("p")).count().collect()}
    least = 0
    while sum(k for p, k in sizes.items() if p >= least) > most:
        least += 1
    kept = sums.where(power >= least).select("token").toArrow().column("token").to_numpy()
    return np.sort(kept).view(np.uint64)


def ordered(own: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The tokens of a set in the global order, frequent ones marked above the hash. Also how many aren't frequent."""
    often = np.zeros(len(own), bool)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
    return np.concatenate((own[~often], own[often] | np.uint64(1 << HASH))), len(own) - int(often.sum())


def sketch(own: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Parity of the tokens in each of ``bits`` buckets (a power of two), as 64-bit numbers."""
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_bits(n: int) -> int:
    return max(SKETCH, 1 << (n - 1).bit_length())


def keys_of(order: np.ndarray, rare: int, share: int = SHARE) -> tuple[np.ndarray, int]:
    """The keys of the (extended) prefix, and how many of them, the first ones, are single tokens; sets that only equal ones
    are similar to have none.
    """
    most = len(order) * (100 - share) // share
    if not most:
        return order[:0], 0
    singles = order[:min(most + 1, rare)]
    if rare > most:
        return singles, len(singles)
    run = order[rare:2 * (most + 1)]
    pairs = mixed(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + run[1:])
    return np.concatenate((singles, pairs)), len(singles)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def indexed(df: DataFrame, doc_id: str, text: str, frequent: np.ndarray, shingle: int, share: int) -> DataFrame:
    """Each row's id, text, n (size of its set), a 128-bit digest of the set, its sketches and its keys."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(frequent)
    kind = "n int, high long, low long, sketch array<bigint>, fine array<bigint>, keys array<bigint>"

    def judge(texts: pa.Array) -> pa.Array:
        known, numbers, sketches, fine, keys = Words(), [], [], [], []
        for t in texts:
            own = tokens(t.as_py(), known, shingle)
            digest = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
            key, _ = keys_of(*ordered(own, shared.value), share)
            numbers.append((len(own), int(digest[0]), int(digest[1])))
            sketches.append(sketch(own) if len(key) else np.zeros(0, np.int64))
            fine.append(sketch(own, fine_bits(len(own))) if len(key) else np.zeros(0, np.int64))
            keys.append(key.view(np.int64))
        columns = list(zip(*numbers, strict=True)) or [()] * 3
        types = [pa.int32(), pa.int64(), pa.int64()]
        return pa.StructArray.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), _lists(sketches), _lists(fine),
                                           _lists(keys)], names=["n", "high", "low", "sketch", "fine", "keys"])

    out = docs.withColumn("set", F.arrow_udf(judge, kind)(F.col("text")))
    return out.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "set.*")


def postings(sets: DataFrame) -> DataFrame:
    """key, sid, n: the sets of each key; keys of one set alone are left out."""
    rows = sets.select("sid", "n", F.explode("keys").alias("key"))
    beside = Window.partitionBy("key").orderBy("sid")
    rows = rows.withColumn("alone", F.lag("sid").over(beside).isNull() & F.lead("sid").over(beside).isNull())
    return rows.where(~F.col("alone")).select("key", "sid", "n")


def similar_sizes(share: int) -> Column:
    return 100 * F.least("a.n", "b.n").cast("long") >= share * F.greatest("a.n", "b.n")


def similar_sketches(share: int) -> Column:
    """Sets that differ in both - 2 * common tokens have sketches that differ in no more bits; similar ones have
    (100 + share) * common >= share * both.
    """
    both = (F.col("a.n") + F.col("b.n")).cast("long")
    differ = reduce(Column.__add__, (F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in range(SKETCH // 64)))
    return (100 + share) * differ.cast("long") <= (100 - share) * both


def named(rows: DataFrame) -> DataFrame:
    """Pairs of rows a and b as pairs of sets, the smaller number first."""
    return rows.select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")).distinct()


def stars(posted: DataFrame, sketches: DataFrame, share: int) -> DataFrame:
    """Each posting list's sets with the first of them that is of their size class."""
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / share))).cast("int")
    rows = posted.withColumn("class", size)
    lead = rows.groupBy("key", "class").agg(F.min("sid").alias("lead"), F.count("*").alias("c")).where("c > 1").select("key", "class", "lead")
    pairs = rows.join(lead, ["key", "class"]).where("sid <> lead").select("lead", "sid").distinct()
    a, b = sketches.alias("a"), sketches.alias("b")
    found = pairs.join(a, F.col("lead") == F.col("a.sid")).join(b, pairs["sid"] == F.col("b.sid"))
    return named(found.where(similar_sizes(share) & similar_sketches(share)))


def across(posted: DataFrame, sketches: DataFrame, root: DataFrame, share: int) -> DataFrame:
    """Pairs of sets of one posting list and different components."""
    rows = posted.join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    rows = written(rows.join(main.select("key", F.col("m.root").alias("main")), "key"), "ngram-mixed")
    rows = rows.join(sketches.drop("n"), "sid")
    inside, outside = rows.where("root = main"), rows.where("root <> main")

    def join(right: DataFrame, apart: Column) -> DataFrame:
        return named(outside.alias("a").join(right.alias("b"), (F.col("a.key") == F.col("b.key")) & apart & similar_sizes(share)
                                             & similar_sketches(share)))

    return join(inside, F.lit(True)).unionByName(join(outside, F.col("a.root") < F.col("b.root"))).distinct()


def alike(pairs: DataFrame, docs: DataFrame, shingle: int, share: int) -> DataFrame:
    """The pairs (a, b) that link, by their finer sketches and then their whole sets."""
    fine = docs.select(F.col("row").alias("sid"), "n", "fine")
    both = pairs.join(fine.toDF("a", "n_a", "f_a"), "a").join(fine.toDF("b", "n_b", "f_b"), "b")

    def folded(x: Column, to: Column) -> Column:
        """A sketch of twice the bits, folded: bucket k and the one half the bits further are one."""
        half = F.size(to)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda v, w: v.bitwiseXOR(w))).otherwise(x)

    x, y = F.col("f_a"), F.col("f_b")
    bits = F.zip_with(folded(x, y), folded(y, x), lambda v, w: F.bit_count(v.bitwiseXOR(w)).cast("long"))
    differ = F.aggregate(bits, F.lit(0).cast("long"), lambda total, v: total + v)
    pairs = written(both.where((100 + share) * differ <= (100 - share) * (F.col("n_a") + F.col("n_b")).cast("long")).select("a", "b"), "ngram-likely")
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "ngram-needed")
    needed = F.broadcast(needed) if needed.count() <= FETCHED else needed
    texts = docs.select(F.col("row").alias("sid"), "text").join(needed, "sid")

    def judge(texts_: pa.Array) -> pa.Array:
        known = Words()
        return _lists([tokens(t.as_py(), known, shingle).view(np.int64) for t in texts_])

    whole = written(texts.select("sid", F.arrow_udf(judge, "array<bigint>")("text").alias("own")), "ngram-sets")
    both = pairs.join(whole.toDF("a", "t_a"), "a").join(whole.toDF("b", "t_b"), "b")
    common = F.size(F.array_intersect("t_a", "t_b")).cast("long")
    return both.where((100 + share) * common >= share * (F.size("t_a") + F.size("t_b"))).select("a", "b")


def ngram_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, share: int = SHARE,
               frequent: int = FREQUENT, most: int = MAX_FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; ``share`` is a percentage from 75 to 99 (neighbours need a + b + 2 common tokens)."""
    if not 75 <= share < 100:
        raise ValueError("share must be from 75 to 99")
    often = frequent_tokens(_texts(df, text), shingle, frequent, most)
    docs = written(indexed(df, doc_id, text, often, shingle, share), "ngram-docs")
    groups = docs.where("n > 0").groupBy("high", "low").agg(F.min("row").alias("sid"), F.min("doc_id").alias("least"))
    groups = written(groups, "ngram-groups")
    sets = docs.withColumnRenamed("row", "sid").join(groups.select("sid"), "sid")
    posted = written(postings(sets), "ngram-postings")
    sketches = sets.select("sid", "n", "sketch")

    first = written(stars(posted, sketches, share), "ngram-pairs")
    links = written(alike(first, docs, shingle, share), "ngram-links")
    root = components(links).toDF("sid", "root")
    second = written(across(posted, sketches, root, share).join(first, ["a", "b"], "left_anti"), "ngram-pairs")
    links = links.unionByName(written(alike(second, docs, shingle, share), "ngram-links"))

    root = components(links).toDF("sid", "root")
    rooted = groups.join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(ids, "root").select("high", "low", "component_id")
    out = docs.select("doc_id", "n", "high", "low").join(rooted, ["high", "low"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
