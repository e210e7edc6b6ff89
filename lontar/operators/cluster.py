"""Vectors in groups: leader clustering, centroids, similarity to them, majority labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CLUSTER_SIMILARITY, MIN_CLUSTER
from ..functions.numeric import cosine
from ..runtime import ship


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector of each cluster, noise apart: element sums combine on the map side."""
    parts = df.where(F.col(cluster) >= 0).select(F.col(cluster), F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def similarity_to_centroid(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """df with semantic_similarity to its cluster's centroid, to four digits, 0 for noise."""
    c = centroids(df, cluster, vector)
    return df.join(c, cluster, "left").withColumn("semantic_similarity", F.when(F.col("centroid").isNull(), 0.0).otherwise(F.round(cosine(F.col(vector), F.col("centroid")), 4))).drop("centroid")


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """The k nearest vectors of `base` for each query by cosine, without itself: queries, a stated set, are sent to all
    tasks in blocks of which the driver holds one at a time; the base is read once, each task keeps the best k of each
    query among the rows of a batch, and only those are shuffled."""
    import numpy as np

    spark = ship(base.sparkSession)
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("q"), F.col(vector).alias("v"))
    blocks, block = [], []
    kind = base.schema[id_col].dataType.simpleString()

    def shared(rows: list):
        m = np.array([r["v"] for r in rows], dtype=np.float64)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return spark.sparkContext.broadcast(([r["q"] for r in rows], np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)))

    for r in q.toLocalIterator():
        block.append(r)
        if len(block) == 2000:
            blocks.append(shared(block))
            block = []
    if block:
        blocks.append(shared(block))
    if not blocks:
        return spark.createDataFrame([], f"q {kind}, b {kind}, similarity double, rank int")
    out = base.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("b"), F.col(vector).alias("v")).mapInPandas(_best(blocks, k), f"q {kind}, b {kind}, similarity double")
    from .relational import top_n

    return top_n(out, [F.desc("similarity"), F.col("b")], k, ["q"])


def _best(blocks: list, k: int):
    def run(frames: Iterator) -> Iterator:
        import numpy as np

        for f in frames:
            if not len(f):
                continue
            v = np.array(f["v"].tolist(), dtype=np.float64)
            norms = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)
            b = f["b"].to_numpy()
            for shared in blocks:
                ids, m = shared.value
                s = np.round(v @ m.T, 6)
                rows = []
                for j, q in enumerate(ids):
                    col = np.where(b == q, -np.inf, s[:, j])
                    order = np.lexsort((b, -col))[:k]
                    rows += [(q, b[i], float(col[i])) for i in order if col[i] > -np.inf]
                yield pd.DataFrame(rows, columns=["q", "b", "similarity"])

    return run


def leader_assignments(vectors, threshold: float = CLUSTER_SIMILARITY) -> list[int]:
    """Each vector joins the first most similar running centroid at or above the threshold, or founds a cluster."""
    import numpy as np

    sums, counts, out = [], [], []
    unit = None
    for v in vectors:
        v = np.asarray(v if v is not None else [], dtype=np.float64)
        n = np.linalg.norm(v)
        best, at = -2.0, -1
        if unit is not None and n > 0 and unit.shape[1] == len(v):
            sims = unit[: len(sums)] @ (v / n)
            at = int(np.argmax(sims))
            best = float(sims[at])
        if at >= 0 and best >= threshold:
            sums[at] += v
            counts[at] += 1
        else:
            at = len(sums)
            sums.append(v.copy())
            counts.append(1)
        if len(v):
            if unit is None:
                unit = np.zeros((16, len(v)))
            while unit.shape[0] < len(sums):
                unit = np.vstack([unit, np.zeros_like(unit)])
            if unit.shape[1] == len(v):
                c = sums[at] / counts[at]
                m = np.linalg.norm(c)
                unit[at] = c / m if m else 0.0
        out.append(at)
    return out


def leader_clusters(df: DataFrame, id_col: str, vector: str, label: str, group: str, threshold: float = CLUSTER_SIMILARITY, smallest: int = MIN_CLUSTER) -> DataFrame:
    """id, cluster_id (-1 for clusters below `smallest`), cluster_size, semantic_similarity, semantic_label.

    The result depends on the order of all vectors of a group, so one group is one task, ordered by id: `group` names a
    column whose groups a task can hold (a topic, a source, a shard). Cluster ids are numbered within each group.
    """
    ship(df.sparkSession)

    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"))

    def assign(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        return pd.DataFrame({"g": f["g"], "id": f["id"], "cluster_id": leader_assignments(f["v"], threshold)})

    ids = own.groupBy("g").applyInPandas(assign, f"g string, id {kind}, cluster_id int")
    sizes = ids.groupBy("g", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    rows = own.join(ids, ["g", "id"]).join(sizes, ["g", "cluster_id"]).withColumn("cluster_id", F.when(F.col("n") >= smallest, F.col("cluster_id")).otherwise(-1)).drop("n")
    size = rows.groupBy("g", "cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    votes = rows.where("cluster_id >= 0").groupBy("g", "cluster_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    ranked = votes.groupBy("g", "cluster_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "label"))["label"].alias("semantic_label"))
    keyed = rows.withColumn("k", F.when(F.col("cluster_id") >= 0, F.xxhash64("g", "cluster_id")))
    parts = keyed.where("k IS NOT NULL").select("k", F.posexplode("v").alias("i", "x")).groupBy("k", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    out = keyed.join(mean, "k", "left").join(size, ["g", "cluster_id"]).join(ranked, ["g", "cluster_id"], "left")
    sim = F.when(F.col("c").isNull(), 0.0).otherwise(F.round(cosine(F.col("v"), F.col("c")), 4))
    return out.select(F.col("id").alias(id_col), F.col("g").alias(group), "cluster_id", "cluster_size", sim.alias("semantic_similarity"), F.coalesce("semantic_label", F.lit("netral")).alias("semantic_label"))
