"""Graph operators over edge tables: hops, components, degrees, visibility."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: Edges that one task may hold.
TASK_EDGES = 1_000_000


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both directions of every edge that is not a loop."""
    one = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each vertex: ``v``, ``degree``."""
    return undirected(edges).distinct().groupBy(F.col("a").alias("v")).agg(F.count("*").alias("degree"))


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Vertices that ``start`` (v) reaches in ``hops`` edges or fewer, itself included: ``v``, ``hop``.

    Each hop joins the newest vertices alone; few hops are unrolled into one plan.
    """
    both = cut(undirected(edges).distinct(), "both-ways")
    seen = start.select("v").distinct().withColumn("hop", F.lit(0))
    newest = seen
    for hop in range(1, hops + 1):
        reached = newest.join(both, newest.v == both.a).select(F.col("b").alias("v")).distinct()
        newest = reached.join(seen.select("v"), "v", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(newest)
        if hop % 3 == 0:
            seen, newest = cut(seen, "hops"), cut(newest, "hops")
    return seen


def _roots_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vertices of all edges of one task that are not their component's smallest, and that."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks])
    names = pc.array_sort_indices(distinct := pc.unique(ends))
    distinct = distinct.take(names)
    root = np.arange(len(distinct))
    a, b = (pc.index_in(table.column(c), distinct).to_numpy() for c in ("a", "b"))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while np.any((far := root[root]) != root):
            root = far
    moved = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([distinct.take(pa.array(moved)), distinct.take(pa.array(root[moved]))], names=["v", "to"])


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest vertex reachable from each vertex: ``v``, ``component``.

    Vertices hook to their smallest neighbour, pointers are doubled to the
    root, and the graph is contracted, so long chains take few rounds.  Once so
    few edges are left that a task can hold them, it finds their roots at once.
    """
    kind = vertices.schema["v"].dataType.simpleString()
    rest = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = vertices.select("v", F.col("v").alias("component")).distinct()
    while left := rest.count():
        if left <= TASK_EDGES:
            links = rest.coalesce(1).mapInArrow(_roots_at_once, f"v {kind}, to {kind}")
        else:
            links = rest.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("to"))
            while True:
                far = links.select(F.col("v").alias("to"), F.col("to").alias("next"))
                links = cut(links.join(far, "to", "left").select("v", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "links")
                if links.where("moved").isEmpty():
                    break
                links = links.drop("moved")
            links = links.drop("moved")
        hop = links.select(F.col("v").alias("component"), F.col("to").alias("next"))
        labels = cut(labels.join(hop, "component", "left").select("v", F.coalesce("next", "component").alias("component")), "labels")
        if left <= TASK_EDGES:
            break
        for end in ("a", "b"):
            moved = links.select(F.col("v").alias(end), F.col("to").alias("__to"))
            rest = rest.join(moved, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
        rest = cut(rest.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``visible`` (v)."""
    at_a = edges.join(visible.select(F.col("v").alias("a")), "a", "left_semi")
    return at_a.join(visible.select(F.col("v").alias("b")), "b", "left_semi")
