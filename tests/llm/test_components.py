import random

import pytest

from lontar.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


CASES = {
    "path": [(k, k + 1) for k in range(60)],
    "star": [(0, k) for k in range(1, 40)] + [(0, 5), (5, 0)],
    "random": [(random.Random(7).randrange(300), random.Random(k).randrange(300)) for k in range(200)],
    "loops, nulls, repeats": [(1, 1), (2, None), (None, 3), (4, 5), (5, 4), (4, 5)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("finish_at", [0, 10, 100_000])
def test_labels_and_forest(spark, name, finish_at):
    edges = CASES[name]
    labels, tree = components(spark.createDataFrame(edges, "a bigint, b bigint"), finish_at, forest=True)
    expected = brute(edges)
    assert {r["node"]: r["root"] for r in labels.collect()} == expected
    forest = [(r["a"], r["b"]) for r in tree.collect()]
    assert len(forest) == len(expected) - len(set(expected.values()))
    assert brute(forest) == expected


def test_text_nodes(spark):
    labels, _ = components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string"), 0)
    assert {r["node"]: r["root"] for r in labels.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_many_edges_by_rounds_alone(spark):
    """300,000 edges of rings and stars, contracted to the end without the final task."""
    from pyspark.sql import functions as F

    e = spark.range(300_000).select(F.floor(F.col("id") / 300).alias("g"), (F.col("id") % 300).alias("k"))
    ring = F.struct((F.col("g") * 300 + F.col("k")).alias("a"), (F.col("g") * 300 + (F.col("k") + 1) % 300).alias("b"))
    star = F.struct((F.col("g") * 300).alias("a"), (F.col("g") * 300 + F.col("k")).alias("b"))
    edges = e.select(F.when(F.col("g") % 2 == 0, ring).otherwise(star).alias("e")).select("e.a", "e.b")
    labels, _ = components(edges, 0)
    assert labels.where("root <> node - node % 300").count() == 0 and labels.count() == 300_000
