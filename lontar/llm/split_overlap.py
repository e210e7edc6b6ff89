"""Problem 2: records of evaluation splits that the training split has too, exactly or almost.

Method: winnowing fingerprints. Rolling hashes of two words are taken over each record and minima selected, the rarest
hashes first; selected minima are joined across the splits. The usual selection, one minimum for each window, finds
only runs as long as a window, which a bigram similarity of 0.6 doesn't promise; so the window is the whole record and
the number of minima is the one that such a similarity can't escape, whatever words repeat. The exact
share of word pairs decides. The collinear chains of common seeds, extended by alignment, are no step of the search:
they measure the coverage of accepted links, per split and source, in report() alone.

Cases: a missing split, or one that is neither training nor evaluation, takes no part; rows with a null id are left
out; of rows with the same id the least counts; short and null texts have no partners.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .near_duplicates import COPIES, thinned, wordings
from .pigeonhole import HOT, block_pairs, verified
from .shared import forget, norm_split, shingles, stored


@dataclass(frozen=True)
class SplitOverlap:
    """links: a, b, common, total between representatives, an equal pair a = b for wordings of both sides;
    members: id, rep, split, source; texts: id, text of the representatives."""

    links: DataFrame
    members: DataFrame
    texts: DataFrame


def split_overlap(
    df: DataFrame, id_col: str = "text_id", text_col: str = "processed_text", split_col: str = "split", source_col: str = "source_type",
    train: tuple[str, ...] = ("train",), held_out: tuple[str, ...] = ("calibration", "test"), min_words: int = 8, permille: int = 600, hot: int = HOT,
) -> SplitOverlap:
    known = df.where(norm_split(df[split_col]).isin(*train, *held_out))
    own = wordings(known, id_col, text_col, min_words, {"split": split_col, "source": source_col})
    source = F.regexp_replace(F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")), r"[-\s]+", "_")
    own = stored(own.select("id", "text", norm_split(F.col("split")).alias("split"), source.alias("source"), F.md5("text").alias("key")), "wordings")
    in_train = F.col("split").isin(*train)
    classes = own.groupBy("key").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.max(in_train).alias("left"), F.max(~in_train).alias("right"))
    classes = stored(classes, "classes")
    words = F.split("text", " ")
    sets = stored(classes.select("id", "left", "right", shingles(words, 2).alias("items")), "sets")
    pairs = block_pairs(sets, permille, two_sided=True, hot=hot)
    links = verified(pairs, sets, permille)
    same = sets.where("left AND right").select(F.col("id").alias("a"), F.col("id").alias("b"), F.size("items").alias("common"), F.size("items").alias("total"))
    members = own.select("id", "key", "split", "source").join(classes.select("key", F.col("id").alias("rep")), "key").drop("key")
    out = SplitOverlap(stored(links.unionByName(same), "links"), stored(members, "members"), classes.select("id", "text"))
    for done in (pairs, sets, own):
        forget(done)
    return out


def record_pairs(result: SplitOverlap, train: tuple[str, ...] = ("train",), copies: int = COPIES) -> DataFrame:
    """Pairs of a training and a held-out record: train_id, held_id, a, b. As in near_duplicates.expanded(), wordings of
    more than `copies` records on a side stand in all pairs by their first record there, and each other record of theirs
    is paired with the first of the partner's."""
    side = result.members.select("id", "rep", F.col("split").isin(*train).alias("is_train"))
    m = stored(thinned(side, ["rep", "is_train"], copies), "members")
    both = result.links.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
        result.links.where("a <> b").select("a", "b", F.col("b").alias("x"), F.col("a").alias("y"))
    )
    t = m.where("is_train").select(F.col("rep").alias("x"), F.col("id").alias("train_id"), F.col("few").alias("few_t"))
    h = m.where("NOT is_train").select(F.col("rep").alias("y"), F.col("id").alias("held_id"), F.col("few").alias("few_h"))
    first_t, first_h = t.groupBy("x").agg(F.min("train_id").alias("train_id")), h.groupBy("y").agg(F.min("held_id").alias("held_id"))
    columns = ["train_id", "held_id", "a", "b"]
    most = both.join(t.where("few_t"), "x").join(h.where("few_h"), "y").select(*columns)
    more_t = both.join(t.where("NOT few_t"), "x").join(first_h, "y").select(*columns)
    more_h = both.join(h.where("NOT few_h"), "y").join(first_t, "x").select(*columns)
    return most.unionByName(more_t).unionByName(more_h)


def aligned(result: SplitOverlap) -> DataFrame:
    """links with covered_a, covered_b (share of each text's words on the chain) and longest (words of its longest run)."""
    ship(result.links.sparkSession)
    t = result.texts
    both = result.links.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b").select("a", "b", "common", "total", "ta", "tb")
    kind = result.links.schema["a"].dataType.simpleString()
    return both.mapInArrow(_align_batches, f"a {kind}, b {kind}, common int, total int, covered_a double, covered_b double, longest int")


def report(result: SplitOverlap, train: tuple[str, ...] = ("train",)) -> DataFrame:
    """Per held-out split and source: records, records with an overlap, pairs, and the mean best coverage of the former."""
    cover = aligned(result).select(
        F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("other"), F.col("covered_a").alias("c")), F.struct(F.col("b").alias("rep"), F.col("a").alias("other"), F.col("covered_b").alias("c")))).alias("s")
    ).select("s.*").distinct()
    m = result.members.withColumn("is_train", F.col("split").isin(*train))
    n_train = m.where("is_train").groupBy(F.col("rep").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    best = cover.join(n_train, "other").groupBy("rep").agg(F.sum("n").alias("pairs"), F.max("c").alias("covered"))
    held = m.where("NOT is_train").join(best, "rep", "left")
    return held.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.avg("covered"), 6).alias("mean_coverage")
    )


def align(a: list[str], b: list[str], k: int = 3) -> tuple[int, int, int]:
    """Words of a and of b on the best collinear chain of common k-word seeds, extended while words agree; and its
    longest run. Seeds that occur more than once are paired in their order."""
    if a == b:
        return len(a), len(b), len(a)
    at: dict[tuple, list[int]] = {}
    for j in range(len(b) - k + 1):
        at.setdefault(tuple(b[j : j + k]), []).append(j)
    used: dict[tuple, int] = {}
    seeds = []
    for i in range(len(a) - k + 1):
        s = tuple(a[i : i + k])
        js = at.get(s)
        if js and used.get(s, 0) < len(js):
            seeds.append((i, js[used.get(s, 0)]))
            used[s] = used.get(s, 0) + 1
    chain = _increasing(seeds)
    in_a, in_b = set(), set()
    longest, ends = 0, (-1, -1)
    for i, j in chain:
        x, y = i, j
        while x > 0 and y > 0 and a[x - 1] == b[y - 1] and x - 1 > ends[0] and y - 1 > ends[1]:
            x, y = x - 1, y - 1
        p, q = i + k, j + k
        while p < len(a) and q < len(b) and a[p] == b[q]:
            p, q = p + 1, q + 1
        in_a.update(range(x, p))
        in_b.update(range(y, q))
        longest, ends = max(longest, p - x), (p - 1, q - 1)
    return len(in_a), len(in_b), longest


def _increasing(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of seeds that rises in both positions."""
    from bisect import bisect_left

    tails: list[int] = []
    tail_at: list[int] = []
    before = [-1] * len(seeds)
    for n, (_, j) in enumerate(seeds):
        k = bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
            tail_at.append(n)
        else:
            tails[k], tail_at[k] = j, n
        before[n] = tail_at[k - 1] if k else -1
    out, n = [], tail_at[-1] if tail_at else -1
    while n >= 0:
        out.append(seeds[n])
        n = before[n]
    return out[::-1]


def _align_batches(batches):
    import pyarrow as pa

    for batch in batches:
        ca, cb, long = [], [], []
        for ta, tb in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            wa, wb = ta.split(), tb.split()
            x, y, n = align(wa, wb)
            ca.append(x / len(wa))
            cb.append(y / len(wb))
            long.append(n)
        arrays = [*batch.columns[:4], pa.array(ca), pa.array(cb), pa.array(long, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "common", "total", "covered_a", "covered_b", "longest"])
