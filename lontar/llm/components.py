"""Connected components by rounds of Borůvka's minimum-edge contraction.

Each round every component picks its least edge, the picked edges join components (kept as a spanning forest), and the
remaining edges are rewritten to the new components. At least half of the components that still have edges go in each
round. Once at most `finish_at` edges are left, one task of that bounded size ends the work with union-find; with
finish_at=0 the rounds go on to the end. Tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .shared import forget, stored

#: Edges that one task may hold: few enough to cost less than a round.
FINISH_AT = 2_000


def components(edges: DataFrame, finish_at: int = FINISH_AT, forest: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(labels, tree) of the graph whose edges have the columns a, b.

    labels: node, root - each node of an edge with the least node of its component. tree: a, b - with forest, the edges
    of a spanning forest. Loops, nulls and repeated edges are allowed; isolated nodes have no edge and so no row.
    """
    ship(edges.sparkSession)
    kind = edges.schema["a"].dataType.simpleString()
    e = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("ca"), F.greatest("a", "b").alias("cb"))
        .distinct()
        .select("ca", "cb", F.col("ca").alias("a"), F.col("cb").alias("b")),
        "edges",
    )
    maps: list[DataFrame] = []
    trees: list[DataFrame] = []
    while (left := e.count()) > finish_at:
        parent, picked = _pick(e)
        flat = _flatten(parent)
        trees.append(picked)
        maps.append(flat)
        e2 = stored(_rewrite(e, flat), "edges")
        forget(e)
        e = e2
    if left:
        ends = stored(e.repartition(1).mapInArrow(_union_find(kind), f"k int, x {kind}, y {kind}, a {kind}, b {kind}"), "finish")
        maps.append(ends.where("k = 0").select(F.col("x").alias("c"), F.col("y").alias("p")))
        trees.append(ends.where("k = 1").select("a", "b"))
    if not maps:
        empty = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return empty, empty.toDF("a", "b") if forest else None
    full = maps[-1]
    for m in reversed(maps[:-1]):
        full = m.join(full.toDF("p", "p2"), "p", "left").select("c", F.coalesce("p2", "p").alias("p"))
    full = stored(full, "labels")
    labels = full.join(full.groupBy("p").agg(F.min("c").alias("root")), "p").select(F.col("c").alias("node"), "root")
    tree = None
    if forest:
        tree = trees[0]
        for t in trees[1:]:
            tree = tree.unionByName(t)
    return labels, tree


def _pick(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parent (c, p) of each component that has an edge, roots being their own parent; and the picked edges."""
    half = e.select(F.col("ca").alias("c"), F.struct("ca", "cb", "a", "b").alias("e")).unionByName(e.select(F.col("cb").alias("c"), F.struct("ca", "cb", "a", "b").alias("e")))
    best = stored(half.groupBy("c").agg(F.min("e").alias("e")).select("c", F.when(F.col("e.ca") == F.col("c"), F.col("e.cb")).otherwise(F.col("e.ca")).alias("p"), "e.a", "e.b"), "picked")
    up = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    parent = best.join(up, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
    return stored(parent, "parent"), best.select("a", "b").distinct()


def _flatten(parent: DataFrame) -> DataFrame:
    """Pointer jumping until every component points to a root."""
    while True:
        up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        nxt = stored(parent.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "parent")
        moved = nxt.where("moved").limit(1).count()
        forget(parent)
        parent = nxt
        if not moved:
            return nxt.select("c", "p")


def _rewrite(e: DataFrame, flat: DataFrame) -> DataFrame:
    ra, rb = flat.toDF("ca", "ra"), flat.toDF("cb", "rb")
    new = e.join(ra, "ca", "left").join(rb, "cb", "left").select(F.coalesce("ra", "ca").alias("x"), F.coalesce("rb", "cb").alias("y"), "a", "b")
    return (
        new.where("x <> y")
        .groupBy(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"))
        .agg(F.min(F.struct("a", "b")).alias("e"))
        .select("ca", "cb", "e.a", "e.b")
    )


def _union_find(kind: str):
    def run(batches):
        import pyarrow as pa

        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        joined, seen = [], []
        for batch in batches:
            for ca, cb, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                seen.append((ca, cb, a, b))
        for ca, cb, a, b in sorted(seen):
            x, y = find(ca), find(cb)
            if x != y:
                root[max(x, y)] = min(x, y)
                joined.append((a, b))
        rows = [(0, x, find(x), None, None) for x in list(root)] + [(1, None, None, a, b) for a, b in joined]
        if rows:
            at = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
            k, x, y, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *[pa.array(v, at) for v in (x, y, a, b)]], names=["k", "x", "y", "a", "b"])

    return run
