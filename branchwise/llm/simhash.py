"""SimHash near-duplicates: fingerprints, then a binary trie self-join over them.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes (seed
42) of the text's shingles of words. Texts whose fingerprints differ in at most ``bits`` places are
linked, and linked texts form a component.

The join works on distinct fingerprints, so exact copies meet as one row whatever their number. A
binary trie over the fingerprints is traversed as pairs of nodes: a pair carries the differing
bits of its prefixes, its four child pairs add one bit each, and a pair over the error budget ends
there with everything below it (``join_tries``). To spread this over tasks the 64 bits are cut into
``bits + r`` bands: two fingerprints within the budget agree in ``r`` bands at least. For each choice of
``r`` bands the bits are permuted so that these come first; down to their end only equal nodes need a
visit, and each node there is a trie of its own that one task traverses. ``r`` grows with the number of
fingerprints, so that a node's expected rows stay far below ``NODE_ROWS`` (``choose_bands``). No link is lost.

A node that has more than ``NODE_ROWS`` fingerprints all the same (a huge group of near copies that
differ a little) isn't given to one task: its rows are dealt into blocks by a hash, and each pair of
blocks is a pair of tries to traverse, a unit of bounded size (``_hot_units``).

A task links what it finds in a union-find and sends one row per fingerprint that has a partner
in its node, not one per pair. Components follow from these links by rounds of large and small stars
over written tables (``components``).

Defined results: null and empty texts, and texts without a word, have fingerprint zero and are
linked like any other; texts of fewer words than a shingle are one shingle. Rows without an id
get a component like any other row, but can't name it: a component's id is the smallest id that
is not null, null if there is none. Repeated ids are rows of their own. Empty tables give empty
results.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import table, written

SHINGLE = 4
BITS = 4
#: Fingerprints of a trie node that one task traverses; more are cut into blocks of this many.
NODE_ROWS = 8192
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 15

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_UPPER)) if text else []
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    last = ends[-n:].tolist()
    first = starts[:n].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42)
                              for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK], strict=True)), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """The other columns of ``df`` with the fingerprint of ``text`` as a signed long."""
    def judge(texts):
        import pandas as pd

        return pd.Series([signed(fingerprint(t, shingle)) for t in texts], dtype="int64")

    keep = [F.col(f"`{c}`") for c in df.columns if c not in (text, name)]
    return df.select(*keep, F.pandas_udf(judge, "long")(F.col(text).cast("string")).alias(name))


def choose_bands(n: int, bits: int, node_rows: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For each choice of bands the order in which all bands (place, width) are put; the chosen come first.
    Also their number. Takes the fewest chosen bands with which ``n`` random fingerprints leave ``node_rows / 8`` in a node.
    """
    for r in range(1, 9):
        cuts = [round(64 * k / (bits + r)) for k in range(bits + r + 1)]
        bands = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        if n <= node_rows / 8 * 2 ** sum(w for _, w in bands[:r]):
            break
    return [[*chosen, *(x for x in bands if x not in chosen)] for chosen in combinations(bands, r)], r


def join_tries(left: np.ndarray, right: np.ndarray | None, depth: int, bits: int):
    """Pairs of places (i, j) whose keys differ in at most ``bits`` places.

    Both arrays are sorted uint64 keys; ``right`` None joins ``left`` with itself (i < j). The keys
    of one array agree in their first ``depth`` bits. A node is a range of its sorted array; live
    pairs of nodes go down one level at a time, all pairs of a level at once, and in parts so that
    a level's pairs stay bounded. Yields arrays i, j.
    """
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    start = np.array([[0, len(left), 0, len(right), 0]], np.int64)
    stack = [(depth, start)]
    one = np.uint64(1)
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > 1 << 16:
            half = len(pairs) // 2
            stack += [(level, pairs[:half]), (level, pairs[half:])]
            continue
        a, b, c, d, spent = pairs.T
        pairs = pairs[spent <= bits]  # the error budget
        a, b, c, d, spent = pairs.T
        small = (b - a) * (d - c) <= 32
        for n in np.unique(((b - a) * (d - c))[small]):  # few keys: compare them whole
            at = small & ((b - a) * (d - c) == n)
            w = np.arange(n)
            i, j = a[at][:, None] + w // (d - c)[at][:, None], c[at][:, None] + w % (d - c)[at][:, None]
            near = np.bitwise_count(left[i] ^ right[j]) <= bits
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        a, b, c, d, spent = pairs[~small].T
        if not len(a):
            continue
        # the first key with this level's bit set ends the node's left child
        shift = np.uint64(63 - level)
        prefix = ~((one << (shift + one)) - one) if level else np.uint64(0)
        m = np.searchsorted(left, (left[a] & prefix) | (one << shift))
        k = np.searchsorted(right, (right[c] & prefix) | (one << shift))
        m, k = np.clip(m, a, b), np.clip(k, c, d)
        kids = [np.stack(x, 1) for x in ((a, m, c, k, spent), (m, b, k, d, spent), (a, m, k, d, spent + 1),
                                         (m, b, c, k, spent + 1))]
        if own:  # of two different children of one node one order is enough
            same = (a == c) & (b == d)
            kids[3] = kids[3][~same]
        kids = np.concatenate(kids)
        kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= bits)]
        if len(kids):
            stack.append((level + 1, kids))


class Links:
    """Union-find over places 0 to n-1; roots are the smallest places."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return nxt
            self.up = nxt

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            up = self.roots()
            a, b = up[i], up[j]
            live = a != b
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def permuted(keys: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(keys)
    for start, width in order:
        out = out << np.uint64(width) | keys >> np.uint64(64 - start - width) & np.uint64((1 << width) - 1)
    return out


def _links_of(left: np.ndarray, right: np.ndarray | None, order: list[tuple[int, int]], depth: int, bits: int):
    """(fingerprint, smallest-placed linked fingerprint) for the fingerprints that have a link here."""
    sides = []
    for side in (left, right):
        if side is not None:
            key = permuted(side, order)
            by = np.argsort(key)
            sides.append((key[by], side[by]))
    links = Links(sum(len(k) for k, _ in sides))
    shift = 0 if right is None else len(left)
    for i, j in join_tries(sides[0][0], None if right is None else sides[1][0], depth, bits):
        links.add(i, j + shift)
    up = links.roots()
    linked = np.flatnonzero(up != np.arange(len(up)))
    every = np.concatenate([x for _, x in sides])
    return every[linked], every[up[linked]]


def trie_links(distinct: DataFrame, bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``; enough of them to keep every component."""
    orders, r = choose_bands(distinct.count(), bits, node_rows)
    depth = [sum(w for _, w in order[:r]) for order in orders]

    def node(order):
        out = F.lit(0).cast("long")
        for s, w in order[:r]:
            out = F.shiftleft(out, w).bitwiseOR(F.shiftrightunsigned("fp", 64 - s - w).bitwiseAND(F.lit((1 << w) - 1)))
        return out

    nodes = distinct.select("fp", F.explode(F.array(*(
        F.struct(F.lit(k).alias("way"), node(order).alias("node")) for k, order in enumerate(orders)))).alias("n"))
    nodes = nodes.select("fp", "n.way", "n.node")
    sizes = nodes.groupBy("way", "node").count()
    hot = written(sizes.where(F.col("count") > node_rows), "simhash-hot")
    cool = nodes.join(hot, ["way", "node"], "left_anti")

    def in_nodes(batches):
        """Whole nodes of a sorted partition; the rows of one node at a time."""
        key, parts = None, []

        def send():
            if sum(map(len, parts)) > 1:
                a, b = _links_of(np.concatenate(parts), None, orders[key[0]], depth[key[0]], bits)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            fp, way, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "way", "node"))
            cuts = np.flatnonzero((np.diff(way) != 0) | (np.diff(at) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(fp)]):
                if s == e:
                    continue
                if (k := (int(way[s]), int(at[s]))) != key:
                    yield from send()
                    key, parts = k, []
                parts.append(fp[s:e].astype(np.int64).view(np.uint64))
        yield from send()

    cool = cool.repartition("way", "node").sortWithinPartitions("way", "node")
    out = cool.mapInArrow(in_nodes, "a long, b long")
    return out.unionByName(_hot_units(nodes, hot, orders, depth, bits, node_rows))


def _hot_units(nodes: DataFrame, hot: DataFrame, orders: list, depth: list[int], bits: int, node_rows: int) -> DataFrame:
    """Links inside the large nodes: their rows dealt into n blocks, each pair of blocks a unit."""
    n = F.ceil(F.col("count") * 2 / F.lit(node_rows)).cast("long")
    rows = nodes.join(hot, ["way", "node"]).select("way", "node", "fp", n.alias("n"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
    unit = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
                       lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    units = rows.select("way", "node", "fp", "own", F.explode(unit).alias("u"))
    units = units.select("way", "node", "u.i", "u.j", "fp", (F.col("own") == F.col("u.i")).alias("first"))

    def in_unit(key, t):
        fp = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        first = t.column("first").to_numpy()
        way, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        a, b = _links_of(fp[first], None if i == j else fp[~first], orders[way], depth[way], bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return units.groupBy("way", "node", "i", "j").applyInArrow(in_unit, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint that each linked fingerprint reaches.

    Alternates large-star and small-star rounds: each hangs a node's larger (or its smaller)
    neighbours on its smallest one, until nothing changes. Rounds are written tables; a hub's rows are
    reduced by partial minima before they meet, and no neighbour list is collected.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "simhash-edges")
    mark = None
    while True:
        # large star: all larger neighbours of u (and u itself) to the smallest around u
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: smaller neighbours of u to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "simhash-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        mark = now


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fp, root (smallest fingerprint of the component) and component_id of every row."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fps = written(fingerprints(docs, "text", shingle), "simhash-fp")
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = written(groups, "simhash-distinct")
    found = components(trie_links(groups.select("fp"), bits, node_rows))
    rooted = groups.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
