"""The order in which tables can be staged: parents before the tables that refer to them.

Tables are nodes and foreign keys edges. Tables that refer to each other in a circle are one component; components are put into
levels, a component one level above the highest one it refers to. Within a level nothing refers to anything else there, so its
tables can be written and checked at the same time, and a level's checks see their parents checked already. References to the table itself,
or to tables that aren't there, make no order. The graph has one node per table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from ..functions.names import qualify
from ..sources.spec import TableSpec


def reachable(edges: Mapping[str, set[str]], start: str) -> set[str]:
    seen, stack = set(), [start]
    while stack:
        for n in edges[stack.pop()] - seen:
            seen.add(n)
            stack.append(n)
    return seen


def apply_levels(specs: Mapping[str, TableSpec], tables: Iterable[str] | None = None) -> list[list[list[str]]]:
    """Levels of components of table names, parents first; names in order within."""
    names = sorted({qualify(t) for t in (specs if tables is None else tables)})
    by_name = {qualify(t): s for t, s in specs.items()}
    edges = {t: {qualify(fk.ref_table) for fk in by_name.get(t, TableSpec()).foreign_keys.values()} & set(names) - {t} for t in names}
    below = {t: reachable(edges, t) for t in names}
    component = {t: tuple(sorted({t} | {u for u in below[t] if t in below[u]})) for t in names}
    level: dict[tuple, int] = {}
    # a component's parents reach strictly fewer tables than it does
    for c in sorted(set(component.values()), key=lambda c: (len(below[c[0]] | {c[0]}), c)):
        parents = {component[u] for t in c for u in edges[t]} - {c}
        level[c] = 1 + max((level[p] for p in parents), default=-1)
    out: list[list[list[str]]] = [[] for _ in range(1 + max(level.values(), default=-1))]
    for c, k in sorted(level.items()):
        out[k].append(list(c))
    return out
