"""The older flow: hashed vectors, leader clusters, ambiguity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_embedding
from ..operators.cluster import leader_clusters
from ..operators.fusion import with_ambiguity
from ..operators.lexicon import Rules, score_texts
from ..runtime import ship


def legacy_decisions(df: DataFrame, id_col: str, text: str, group: str, rules: Rules | None = None) -> DataFrame:
    """df with rule, cluster and decision columns; see leader_clusters() for `group`."""
    ship(df.sparkSession)
    df = df.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("")))
    scored = score_texts(df, text, rules).withColumn("embedding_backend", F.lit("hashing")).withColumn("_vector", hash_embedding()(F.col(text)))
    clusters = leader_clusters(scored, id_col, "_vector", "rule_label", group)
    out = scored.join(clusters, [id_col, group])
    return with_ambiguity(out).drop("_vector")
