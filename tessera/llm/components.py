"""Connected components of a large graph, by hooking and pointer doubling.

Every round hooks each vertex to its smallest neighbour, doubles the pointers
until they end at roots, and replaces the edges by those between different
roots, so the graph shrinks until no edge is left.  Minima are aggregated
before they are shuffled, edges are joined with one row for each vertex, and
every table is cut by a checkpoint in the shared folder: neither a hub nor a
chain gathers in one task, and nothing is collected.  Once LOCAL_EDGES edges or
fewer are left, one task finds their roots at once instead of further rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Edges that one task may hold, 16 bytes each.
LOCAL_EDGES = 500_000


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's component; edges are arrays of ends."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while np.any((far := root[root]) != root):
            root = far
    return root


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vertices that are not their component's smallest, and that."""
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(names), ends[: len(a)], ends[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_pydict({"v": names[moved], "to": names[root[moved]]})


def _roots(links: DataFrame) -> DataFrame:
    """``links`` (v, to) with ``to < v``, made to point at the end of every chain."""
    while True:
        far = links.select(F.col("v").alias("to"), F.col("to").alias("next"))
        doubled = common.written(links.join(far, "to", "left").select("v", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "links")
        links = doubled.select("v", "to")
        if doubled.where("moved").isEmpty():
            return links


def components(edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``edges`` (a, b): rows (v, root).

    Loops and repeated edges are harmless; a graph without edges between
    different vertices gives no rows.
    """
    edges = common.written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while left := edges.count():
        if left <= LOCAL_EDGES:
            links = common.written(edges.coalesce(1).mapInArrow(_at_once, "v long, to long"), "links")
        else:
            links = _roots(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("to")))
        if labels is None:
            labels = links.select("v", F.col("to").alias("root"))
        else:
            hop = links.select(F.col("v").alias("root"), F.col("to").alias("next"))
            moved = labels.join(hop, "root", "left").select("v", F.coalesce("next", "root").alias("root"))
            labels = moved.unionByName(links.select("v", F.col("to").alias("root")))
        labels = common.written(labels, "labels")
        if left <= LOCAL_EDGES:
            break
        ends = []
        for end in ("a", "b"):
            ends.append(links.select(F.col("v").alias(end), F.col("to").alias(f"root_{end}")))
        joined = edges.join(ends[0], "a", "left").join(ends[1], "b", "left")
        joined = joined.select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")).where("x <> y")
        edges = common.written(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels.dropDuplicates(["v"])
