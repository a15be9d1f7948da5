"""Connected components of an edge table, by alternating stars.

Each round first contracts the edges of every partition on their own (a forest has no more
edges than nodes), then lets every node point to its least neighbour: the large-star and the
small-star step.  Neighbour lists are never gathered; a node's least neighbour is an
aggregate, combined before the shuffle, and is joined back to its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.llm.memory import lean
from notarium.session import materialise

_EDGE = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as a forest: each node with the least node that it reaches here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at:at + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"a": pa.array(part, pa.int64()), "b": pa.array([find(x) for x in part], pa.int64())})


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): every node of an edge (a, b) with the least node that it can reach.

    Self-edges, repeated edges and both directions are fine; edges with a null end are left
    out.  No edges give no rows.
    """
    now = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = materialise(now.mapInArrow(lean(_forest), _EDGE), label)
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return found.union(now.select("b", "b")).distinct()
        before = mark
        now = materialise(_small_star(_large_star(now)), label)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).distinct()
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
