"""Connected components by random contraction, all of it distributed.

Each round first shrinks the edges where they lie: a partition replaces its own edges, a bounded number at a time, by a star
for each group that they link. Then every node moves to that one of itself and its neighbours that comes first in the order
of the round, and edges follow. Every other round that is the order of ids, which takes all stars at once; in between it is
an order drawn anew, under which a constant part of the nodes of any graph goes, chains in order of their ids included. So
rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.llm.shared import cut, lean

#: Edges that a task holds at a time.
HELD = 1 << 20
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of the nodes 0 to n - 1 reaches over the edges a, b."""
    label = np.arange(n)
    while len(a):
        a, b = label[a], label[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        live = a != b
        a, b = a[live], b[live]
        np.minimum.at(label, b, a)
        while (after := label[label]).tobytes() != label.tobytes():
            label = after
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to an edge from each node to the least node that the edges held together with it link it to."""

    def shrunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        least = roots(at[: len(u)], at[len(u) :], len(nodes))
        far = least != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[least[far]]), pa.array(nodes[far])], schema=_EDGE)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield shrunk(held)
            held, n = [], 0
    if held:
        yield shrunk(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component_id long) for every node of `edges`; component_id is the smallest node reachable.

    The moves of a round are pre-aggregated by node before they are shuffled, so a node with very many edges is no more
    than a long side of joins that Spark splits. The maps of the rounds shrink geometrically and are put together from the
    last to the first, as joins of which each is as long as its own map. Nulls in either column are dropped, loops keep
    their node; repeated edges count once; other columns are not read; no edges give an empty frame.
    """
    given = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    given = cut(given.distinct())

    def shrunk(edges: DataFrame, most: int) -> DataFrame:
        """`edges`, `most` at most, with HELD or more to a task: the last rounds of any graph are one of these."""
        return cut(edges.coalesce(most // HELD + 1).mapInArrow(lean(_stars), "u long, v long").distinct(), free=False)

    left = shrunk(given.where("u <> v"), given.count())
    maps: list[DataFrame] = []
    while n := left.count():
        rank = F.lit(0).cast("long") if len(maps) % 2 == 0 else None
        ranked = lambda c: F.struct((F.xxhash64(F.lit(len(maps)), F.col(c)) if rank is None else rank).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        both = left.unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = cut(both.groupBy("u").agg(F.min(ranked("v")).alias("next")).select(F.col("u").alias("node"), F.least("next", ranked("u"))["node"].alias("to")), free=False)
        maps.append(step)
        u = step.select(F.col("node").alias("u"), F.col("to").alias("u2"))
        v = step.select(F.col("node").alias("v"), F.col("to").alias("v2"))
        moved = left.join(u, "u").join(v, "v").where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct()
        left = shrunk(moved, n)
    loops = given.where("u = v").select(F.col("u").alias("node"))
    if not maps:
        return loops.select("node", F.col("node").alias("component_id"))
    found = maps.pop()
    for step in reversed(maps):
        found = step.join(found.select(F.col("node").alias("to"), F.col("to").alias("top")), "to", "left").select("node", F.coalesce("top", "to").alias("to"))
    least = found.groupBy("to").agg(F.min("node").alias("component_id"))
    linked = found.join(least, "to").select("node", "component_id")
    return linked.unionAll(loops.join(linked, "node", "left_anti").select("node", F.col("node").alias("component_id")))
