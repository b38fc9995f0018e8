"""Positions for diagrams: layered components, grids for large ones, shelves for all.

A layout belongs to one workspace's diagram; ``lay_out_models`` makes those of
all workspaces in parallel.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import model_views, scan

NODE_GAP, RANK_GAP, BLOCK_GAP = 28, 90, 70
ASPECT = 1.6
#: Components beyond these are laid out as a grid, and so are those after the budget is spent.
MOST_NODES, MOST_EDGES, BUDGET = 60, 250, 800
#: Candidate wrappings of long ranks.
WRAPS = 8

Box = tuple[float, float]
Place = tuple[float, float]


def components(ids: list[str], edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Connected groups in the order of ``ids``, the largest first, ties by first id."""
    beside = _beside(ids, edges)
    seen: set[str] = set()
    out = []
    rank = {v: i for i, v in enumerate(ids)}
    for start in ids:
        if start in seen:
            continue
        seen.add(start)
        group = [start]
        for v in group:
            new = beside[v] - seen
            seen |= new
            group += sorted(new)
        out.append(sorted(group, key=rank.__getitem__))
    return sorted(out, key=lambda g: (-len(g), g[0]))


def _beside(ids: Iterable[str], edges: Iterable[tuple[str, str]]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {v: set() for v in ids}
    for a, b in edges:
        if a != b and a in out and b in out:
            out[a].add(b)
            out[b].add(a)
    return out


def neighbour_order(ids: list[str], beside: dict[str, set[str]]) -> list[str]:
    """Breadth first from the most connected, so neighbours stay close."""
    weight = lambda v: (-len(beside[v]), v)
    seen: set[str] = set()
    out: list[str] = []
    for start in sorted(ids, key=weight):
        if start in seen:
            continue
        seen.add(start)
        queue = [start]
        for v in queue:
            new = sorted(beside[v] - seen, key=weight)
            seen.update(new)
            queue += new
        out += queue
    return out


def ranks(ids: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Layers by longest path; edges that would close a cycle count backwards, and layers are ordered by their neighbours' middle."""
    out_of: dict[str, list[str]] = defaultdict(list)
    for a, b in edges:
        out_of[a].append(b)
    state: dict[str, int] = {}
    kept: dict[str, set[str]] = defaultdict(set)
    finished: list[str] = []
    for start in ids:
        if start in state:
            continue
        state[start] = 1
        stack = [(start, iter(out_of[start]))]
        while stack:
            v, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                state[v] = 2
                finished.append(v)
                stack.pop()
            elif state.get(w) == 1:
                kept[w].add(v)
            else:
                kept[v].add(w)
                if w not in state:
                    state[w] = 1
                    stack.append((w, iter(out_of[w])))
    order = _topological(ids, kept)
    level = {v: 0 for v in ids}
    for v in order:
        for w in kept[v]:
            level[w] = max(level[w], level[v] + 1)
    layers: list[list[str]] = [[] for _ in range(max(level.values(), default=-1) + 1)]
    for v in order:
        layers[level[v]].append(v)
    beside = _beside(ids, edges)
    for sweep in range(4):
        sequence = range(1, len(layers)) if sweep % 2 == 0 else range(len(layers) - 2, -1, -1)
        for i in sequence:
            near = layers[i - 1] if sweep % 2 == 0 else layers[i + 1]
            at = {v: k for k, v in enumerate(near)}
            own = {v: k for k, v in enumerate(layers[i])}

            def middle(v: str) -> float:
                places = [at[w] for w in beside[v] if w in at]  # noqa: B023
                return sum(places) / len(places) if places else own[v]  # noqa: B023

            layers[i].sort(key=lambda v: (middle(v), own[v]))  # noqa: B023
    return layers


def _topological(ids: list[str], out_of: dict[str, set[str]]) -> list[str]:
    waiting = {v: 0 for v in ids}
    for v in ids:
        for w in out_of[v]:
            waiting[w] += 1
    ready = [v for v in ids if not waiting[v]]
    for v in ready:
        for w in sorted(out_of[v]):
            waiting[w] -= 1
            if not waiting[w]:
                ready.append(w)
    return ready + [v for v in ids if waiting[v] > 0]


def _strips(layer: list[str], length: dict[str, float], most: float) -> list[list[str]]:
    """A layer in as many strips of about equal length as keep each near ``most``: a node goes where its middle lies."""
    ends = list(accumulate(length[v] + NODE_GAP for v in layer))
    n = max(1, math.ceil((ends[-1] - NODE_GAP) / most)) if most > 0 else len(layer)
    share = ends[-1] / min(n, len(layer))
    strips: dict[int, list[str]] = defaultdict(list)
    for v, end in zip(layer, ends):
        strips[int((end - (length[v] + NODE_GAP) / 2) / share)].append(v)
    return [strips[i] for i in sorted(strips)]


def _drawn(layers: list[list[str]], sizes: dict[str, Box], across: bool, most: float) -> dict[str, Place]:
    """Places of all nodes, layer after layer along one axis, the strips of a layer closer together; each strip is a column in the middle of its width."""
    thick, long = ({v: s[i] for v, s in sizes.items()} for i in ((0, 1) if across else (1, 0)))
    spread, edge = {}, 0.0
    for layer in layers:
        for strip in _strips(layer, long, most):
            middle = edge + max(thick[v] for v in strip) / 2
            tops = [0.0, *accumulate(long[v] + NODE_GAP for v in strip)]
            half = (tops[-1] - NODE_GAP) / 2
            spread.update({v: (middle - thick[v] / 2, top - half) for v, top in zip(strip, tops)})
            edge = 2 * middle - edge + NODE_GAP
        edge += RANK_GAP - NODE_GAP
    least = min(y for _, y in spread.values())
    return {v: (x, y - least) if across else (y - least, x) for v, (x, y) in spread.items()}


def extent(places: dict[str, Place], sizes: dict[str, Box]) -> Box:
    return max((x + sizes[v][0] for v, (x, _) in places.items()), default=0.0), max((y + sizes[v][1] for v, (_, y) in places.items()), default=0.0)


def layered(ids: list[str], edges: list[tuple[str, str]], sizes: dict[str, Box], direction: str) -> dict[str, Place]:
    """Layers of a component, wrapped where it would be far from the wanted shape.

    The shorter the strips, the more of them lie side by side, so the length
    at which the shape turns from too narrow to too wide is found by halving.
    """
    across = direction == "LR"
    layers = ranks(ids, edges)
    i = 1 if across else 0
    low = max(sizes[v][i] for v in ids)
    high = max(sum(sizes[v][i] + NODE_GAP for v in layer) for layer in layers)
    tried = [_drawn(layers, sizes, across, high)]
    for _ in range(WRAPS if high > low else 0):
        w, h = extent(tried[-1], sizes)
        most = (low + high) / 2
        if (w / max(h, 1) < ASPECT) == across:
            high = most
        else:
            low = most
        tried.append(_drawn(layers, sizes, across, (low + high) / 2))

    def off(places: dict[str, Place]) -> float:
        w, h = extent(places, sizes)
        return abs(math.log(max(w, 1) / max(h, 1)) - math.log(ASPECT))

    return min(tried, key=off)


def grid(ids: list[str], sizes: dict[str, Box]) -> dict[str, Place]:
    """Rows and columns in the given order."""
    width = max(sizes[v][0] for v in ids) + NODE_GAP
    columns = max(1, round(math.sqrt(len(ids) * ASPECT * 0.6)))
    out, y = {}, 0.0
    for i in range(0, len(ids), columns):
        row = ids[i : i + columns]
        out.update({v: (k * width, y) for k, v in enumerate(row)})
        y += max(sizes[v][1] for v in row) + NODE_GAP
    return out


def lay_out(sizes: dict[str, Box], edges: Iterable[tuple[str, str]], direction: str = "LR") -> dict[str, Place]:
    """Places of all nodes without overlaps: components as blocks on shelves, the largest first, single nodes last."""
    edges = [(a, b) for a, b in edges if a != b and a in sizes and b in sizes]
    beside = _beside(sizes, edges)
    blocks, alone, left = [], [], BUDGET
    of: dict[str, int] = {}
    parts = components(list(sizes), edges)
    for i, group in enumerate(parts):
        of.update(dict.fromkeys(group, i))
    inside: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for a, b in edges:
        inside[of[a]].append((a, b))
    for i, group in enumerate(parts):
        if len(group) == 1:
            alone += group
            continue
        cost = len(group) + len(inside[i])
        if len(group) > MOST_NODES or len(inside[i]) > MOST_EDGES or cost > left:
            blocks.append(grid(neighbour_order(group, beside), sizes))
        else:
            left -= cost
            blocks.append(layered(group, inside[i], sizes, direction))
    blocks.sort(key=lambda p: -math.prod(extent(p, sizes)))
    blocks += [grid(alone, sizes)] if alone else []
    area = sum(math.prod(extent(b, sizes)) for b in blocks)
    width = max([math.sqrt(area) * ASPECT, *(extent(b, sizes)[0] for b in blocks)])
    out, x, y, shelf = {}, 0.0, 0.0, 0.0
    for block in blocks:
        w, h = extent(block, sizes)
        if x and x + w > width:
            x, y, shelf = 0.0, y + shelf + BLOCK_GAP, 0.0
        out.update({v: (x + a, y + b) for v, (a, b) in block.items()})
        x, shelf = x + w + BLOCK_GAP, max(shelf, h)
    return out


def place_new(known: dict[str, Place], sizes: dict[str, Box], edges: Iterable[tuple[str, str]], direction: str = "LR") -> dict[str, Place]:
    """Known places are kept; new nodes are laid out among themselves, right of the others."""
    kept = {v: p for v, p in known.items() if v in sizes}
    new = {v: s for v, s in sizes.items() if v not in kept}
    shift = extent(kept, sizes)[0] + BLOCK_GAP if kept else 0.0
    return kept | {v: (x + shift, y) for v, (x, y) in (lay_out(new, edges, direction) if new else {}).items()}


def overlaps(a: tuple[float, float, float, float], b: tuple[float, float, float, float], pad: float = 0) -> bool:
    """Whether two rectangles (x, y, width, height) meet."""
    return a[0] - pad < b[0] + b[2] and a[0] + a[2] + pad > b[0] and a[1] - pad < b[1] + b[3] and a[1] + a[3] + pad > b[1]


def lay_out_models(models: DataFrame, direction: str = "LR") -> DataFrame:
    """Places of the tables of every workspace: ``workspace``, ``id``, ``x``, ``y``; card sizes are estimated from their rows."""
    cards = model_views.cards(models)
    longest = F.array_max(F.transform("rows", lambda r: F.length(r["name"]) + F.length(r["type"])))
    width = F.greatest(F.lit(150.0), F.least(F.lit(340.0), F.greatest(F.coalesce(longest, F.lit(0)), F.length("id")) * 7.0 + 48))
    nodes = cards.select("workspace", F.lit(0).alias("edge"), F.col("id").alias("a"), F.lit("").alias("b"), width.alias("w"), (36.0 + 22.0 * F.size("rows") + F.when(F.col("hidden") > 0, 20.0).otherwise(0.0)).alias("h"))
    links = scan.relations(models).where(f"cardinality <> '{model_views.MANY}'").select("workspace", F.lit(1).alias("edge"), F.col("from").alias("a"), F.col("to").alias("b"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["edge", "a", "b"], kind="stable")
        nodes = group[group.edge == 0]
        sizes = {r.a: (r.w, r.h) for r in nodes.itertuples()}
        placed = lay_out(sizes, [(r.a, r.b) for r in group[group.edge == 1].itertuples()], direction) if sizes else {}
        return pd.DataFrame([(group.workspace.iloc[0], v, x, y) for v, (x, y) in placed.items()], columns=["workspace", "id", "x", "y"])

    return nodes.unionByName(links).groupBy("workspace").applyInPandas(run, "workspace string, id string, x double, y double")
