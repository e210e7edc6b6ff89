"""Pairs of similar sets by pigeonhole blocks, without comparing all pairs.

A record's fingerprint is its set of 64-bit shingle hashes. Two sets of Jaccard similarity t or more differ in few
elements, so their `prefix_length` rarest elements can't all differ: split into one-element blocks, close pairs share a
block. How many records have an element is counted exactly, in one aggregation over all sets, and joined back; elements
that no partner has are never sent further. A block that would bring together more than HOT pairs is split: whoever
meets in frequent elements only shares two of them among one element more, so records meet in pairs of such elements.
Any block size gives all pairs. Joined pairs are verified by Hamming distance twice: on a 256-bit parity sketch, whose
distance never exceeds that of the sets, and then on the sets themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import ship
from .shared import forget, stored

#: Words of 64 bits of the parity sketch: enough for sets of some hundred elements to differ visibly.
SKETCH = 4
#: Pairs that one block may bring together before it is split.
HOT = 500_000


def least_common(n: Column, permille: int) -> Column:
    """Elements that a set of n has in common with any set of Jaccard similarity permille / 1000 or more, at least."""
    return F.floor((n * permille + 999) / 1000).cast("int")


def prefix_length(n: Column, permille: int) -> Column:
    """Elements of which a set of n must share one with any set of Jaccard similarity permille / 1000 or more."""
    return n - least_common(n, permille) + 1


def parity(items):
    """Words of the sketches of the sets of a list array: bit k tells whether an odd number of elements falls on k."""
    import numpy as np

    v = items.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    length = items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(length)))
    bit = np.left_shift(np.uint64(1), v & np.uint64(63))
    word = (v >> np.uint64(6)) % np.uint64(SKETCH)
    out = []
    for k in range(SKETCH):
        run = np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(np.where(word == k, bit, np.uint64(0))))) if len(v) else np.zeros(1, np.uint64)
        out.append((run[start[1:]] ^ run[start[:-1]]).view(np.int64))
    return out


def _sketches(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(w) for w in parity(batch.column(1))]], names=["id", *[f"f{k}" for k in range(SKETCH)]])


def block_pairs(sets: DataFrame, permille: int, two_sided: bool = False, hot: int = HOT) -> DataFrame:
    """Candidate pairs a < b of ids, each once, stored.

    sets: id, items array<bigint> (distinct); with two_sided also left, right boolean, and then only pairs with a left
    and a right member. No pair of Jaccard similarity permille / 1000 or more is lost.
    """
    ship(sets.sparkSession)
    sides = ["left", "right"] if two_sided else []
    each = sets.select("id", F.size("items").alias("n"), *sides, F.explode("items").alias("h"))
    if two_sided:
        counted = each.groupBy("h").agg((F.count_if("left") * F.count_if("right")).alias("pairs"))
    else:
        n = F.count(F.lit(1))
        counted = each.groupBy("h").agg(F.floor(n * (n - 1) / 2).cast("bigint").alias("pairs"))
    met = each.join(counted.where("pairs > 0"), "h")
    # a window holds the elements of one text, from the rarest
    ranked = met.withColumns({"rank": F.row_number().over(W.partitionBy("id").orderBy("pairs", "h")), "met": F.count(F.lit(1)).over(W.partitionBy("id").orderBy("pairs", "h").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    reach = prefix_length(F.col("n"), permille) - (F.col("n") - F.col("met"))
    near = ranked.withColumn("reach", reach).where((F.col("reach") > 0) & (F.col("rank") <= F.col("reach") + 1))
    tiny = least_common(F.col("n"), permille) < 2
    near = stored(near.select("id", "n", *sides, "h", (F.col("rank") <= F.col("reach")).alias("inside"), (F.col("pairs") > hot).alias("hot"), tiny.alias("tiny")), "prefixes")
    single = near.where("inside AND (tiny OR NOT hot)").select("id", "n", *sides, "h")
    # the frequent elements of one text's prefix, in a fixed order
    frequent = near.where("hot").groupBy("id", "n", *sides).agg(F.array_sort(F.collect_list("h")).alias("e")).where(F.size("e") > 1)
    both = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.xxhash64(x, y))))
    keyed = single.unionByName(frequent.select("id", "n", *sides, F.explode(both).alias("h")))
    words = sets.select("id", "items").mapInArrow(_sketches, f"id {sets.schema['id'].dataType.simpleString()}, {', '.join(f'f{k} long' for k in range(SKETCH))}")
    rows = stored(keyed.join(words, "id"), "blocks")
    forget(near)
    a, b = (rows.where("left"), rows.where("right")) if two_sided else (rows, rows)
    a, b = a.alias("a"), b.alias("b")
    differ = sum((F.bit_count(F.col(f"a.f{k}").bitwiseXOR(F.col(f"b.f{k}"))) for k in range(SKETCH)), F.lit(0))
    joined = a.join(b, F.col("a.h") == F.col("b.h")).where(F.col("a.id") != F.col("b.id") if two_sided else F.col("a.id") < F.col("b.id"))
    pairs = stored(
        joined.where(F.least("a.n", "b.n") * 1000 >= F.greatest("a.n", "b.n") * permille)
        .where(differ * (1000 + permille) <= (F.col("a.n") + F.col("b.n")) * (1000 - permille))
        .select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
        .distinct(),
        "pairs",
    )
    forget(rows)
    return pairs


def verified(pairs: DataFrame, sets: DataFrame, permille: int) -> DataFrame:
    """a, b, common, total of the pairs whose items have a Jaccard similarity of permille / 1000 or more."""
    s = sets.select("id", "items")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    sized = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sum"))
    return sized.where(F.col("common") * 1000 >= (F.col("sum") - F.col("common")) * permille).select("a", "b", "common", (F.col("sum") - F.col("common")).alias("total"))
