"""URL filter: a broadcast trie over reversed host labels, then path segments.

Each allow or block entry is one path through the trie: the host's labels from the right
(``org``, ``example``), then the path's segments, then what follows the path's last slash (a prefix
of the segment that it meets). A url walks down while its labels and segments match; the deepest
entry on its way wins. More host labels beat fewer, then the longer path wins, and of an allow and
a block entry that are equal the block entry wins.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no entry
and gets ``default``. No entries: everything gets ``default``. Repeated rows are judged alike;
other columns pass through, and result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchwise.llm.common import table

#: The trie is broadcast; it must stay under these bounds. A node takes about 700 bytes.
MAX_NODES = 300_000
MAX_ENTRY_BYTES = 50_000_000

#: The rules of the query: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nodes of host labels; ``path`` leads to the nodes of the path segments of a host's entries."""
    root: dict = {"next": {}, "path": None}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        node = root
        for label in reversed(host.translate(_LOWER).split(".")) if host else ():
            node = node["next"].setdefault(label, {"next": {}, "path": None})
        at = node["path"] = node["path"] or {"next": {}, "tails": {}, "sizes": []}
        *segments, tail = path.split("/")
        for segment in segments:
            at = at["next"].setdefault(segment, {"next": {}, "tails": {}, "sizes": []})
        rule = host.translate(_LOWER) + path
        if at["tails"].get(tail, (rule, ""))[1] != "block":
            at["tails"][tail] = (rule, verdict)
        if len(tail) not in at["sizes"]:
            insort(at["sizes"], len(tail))
    return root


def count_nodes(trie: dict) -> int:
    stack, n = [trie], 0
    while stack:
        node = stack.pop()
        n += 1
        stack += [*node["next"].values(), *([node["path"]] if node.get("path") else [])]
    return n


def _best_path(node: dict, path: str) -> tuple[str, str] | None:
    """Longest entry of a host's path trie that ``path`` starts with."""
    best, segments = None, path.split("/")
    for k, segment in enumerate(segments):
        for n in reversed(node["sizes"]):  # an entry's tail holds no slash: a prefix of this segment
            if n <= len(segment) and segment[:n] in node["tails"]:
                best = node["tails"][segment[:n]]
                break
        if k + 1 == len(segments) or segment not in node["next"]:  # a deeper entry needs a slash here
            break
        node = node["next"][segment]
    return best


def lookup(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the entry that wins, or None."""
    node, best = trie, None
    if trie["path"]:
        best = _best_path(trie["path"], path)
    for label in reversed(host.split(".")) if host else ():
        node = node["next"].get(label)
        if node is None:
            break
        if node["path"] and (found := _best_path(node["path"], path)):
            best = found
    return best


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url",
                default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to each row of ``df``."""
    rules = list(rules)
    size = sum(len(host) + len(path) for _, host, path in rules)
    trie = build_trie(rules) if size <= MAX_ENTRY_BYTES else None
    if trie is None or (nodes := count_nodes(trie)) > MAX_NODES:
        raise ValueError(f"{len(rules)} entries, {size} characters" + (f", {nodes} nodes" if trie else "") + ": over the bound of the "
                         "broadcast; split the list by top-level label and filter in several passes")
    trie = df.sparkSession.sparkContext.broadcast(trie)

    def judge(urls):
        import pandas as pd

        rows = []
        for u in urls:
            host, path = split_url(u)
            found = lookup(trie.value, host, path)
            rows.append((host, path, *(found or (None, default))))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    kind = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])
    judged = F.pandas_udf(judge, kind)(F.col(url).cast("string"))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    return df.select(*keep, judged.alias("__judged")).select(*keep, "__judged.*")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
     s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     r AS (SELECT page_id, host, path,
                  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')
                       THEN 'example.net/en/'
                       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')
                       THEN 'example.com/de/'
                       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
                       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                  END AS rule FROM s)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
