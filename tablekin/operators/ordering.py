"""Load order of tables: cycles condensed, then layers. The graph is as small as the schema, so this runs on the driver."""

from __future__ import annotations

from collections.abc import Iterable


def cycles_and_layers(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> tuple[list[list[str]], list[list[str]]]:
    """(layers, cycles). A layer holds all whose targets lie in earlier ones; a cycle counts as one unit.

    Components are found by Kosaraju's two sweeps, the second of which meets them in an order in which a unit's
    targets come after it; depths then follow in one pass backwards.
    """
    nodes = list(dict.fromkeys(nodes))
    ahead: dict[str, set[str]] = {n: set() for n in nodes}
    back: dict[str, set[str]] = {n: set() for n in nodes}
    for a, b in edges:
        if a != b and a in ahead and b in ahead:
            ahead[a].add(b)
            back[b].add(a)

    done: list[str] = []
    seen: set[str] = set()
    for root in nodes:
        work = [(root, False)]
        while work:
            node, leave = work.pop()
            if leave:
                done.append(node)
            elif node not in seen:
                seen.add(node)
                work.append((node, True))
                work += [(m, False) for m in ahead[node] if m not in seen]

    unit: dict[str, int] = {}
    units: list[list[str]] = []
    for root in reversed(done):
        if root in unit:
            continue
        members, work = [], [root]
        unit[root] = len(units)
        while work:
            node = work.pop()
            members.append(node)
            for m in back[node]:
                if m not in unit:
                    unit[m] = len(units)
                    work.append(m)
        units.append(sorted(members))

    depth = [0] * len(units)
    for k in reversed(range(len(units))):  # targets of a unit have larger numbers
        depth[k] = max((depth[unit[m]] + 1 for n in units[k] for m in ahead[n] if unit[m] != k), default=0)
    layers = [sorted(n for k, u in enumerate(units) if depth[k] == d for n in u) for d in range(max(depth, default=-1) + 1)]
    return layers, sorted(u for u in units if len(u) > 1)
