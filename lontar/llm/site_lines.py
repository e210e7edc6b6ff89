"""Problem 1: lines that many documents of one site repeat.

Method: weighted graphs of consecutive lines. Nodes are the lines of a site, compared in lower case by a-z and 0-9
only; a node's weight is the number of different pages (canonical URLs) that have the line, an edge's weight the number
of pages where one line follows the other, blank ones apart. Nodes and edges of `support` pages or more stay; connected
components of the edges are boilerplate blocks, a node without an edge being a block of its own. Found lines are those of
the blocks; a text loses every occurrence of a block, that is each run of lines of one block with the blank lines in it.

Texts are read once, into 64-bit line keys. Pages are counted over distinct (line, page) pairs, so that a line or a
page that holds a third of all rows is combined on the map side and spread by both keys.

Cases: rows without a site (null domain and no host in the URL) or without text have no case; a null URL counts for no
page; lines with nothing left are never boilerplate and stay in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

#: Lines or blocks that may be sent to all executors: 16 bytes each.
BROADCAST = 500_000


def site_of(domain: Column, url: Column) -> Column:
    """The domain in lower case without blanks around it and a leading www.; the host of url where it is missing."""
    clean = F.lower(F.regexp_replace(domain, r"^\s+|\s+$", ""))
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = F.when(clean == "", None).otherwise(clean)
    return F.nullif(F.regexp_replace(F.coalesce(own, host), r"^www\.", ""), F.lit(""))


def line_keys(df: DataFrame, id_col: str, text_col: str, url_col: str, domain_col: str, keep: bool = False) -> DataFrame:
    """id, page (hash of the URL), keys: one 64-bit key for each line of the text, null for a line with nothing left;
    with keep also site and squashed, the lines as they are compared."""
    own = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[text_col].alias("text"), site_of(df[domain_col], df[url_col]).alias("site"))
    squashed = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9\n]+", ""), "\n")
    keys = F.transform(squashed, lambda x: F.when(x != "", F.xxhash64("site", x)))
    shown = ["site", squashed.alias("squashed")] if keep else []
    return own.where("site IS NOT NULL AND text IS NOT NULL").select("id", F.when(F.col("url").isNotNull(), F.xxhash64("url")).alias("page"), keys.alias("keys"), *shown)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def line_graph(lines: DataFrame, support: int) -> DataFrame:
    """k, pages, block: the line keys that `support` pages or more have, with their block - the least key of all lines
    that hang together by steps of `support` pages or more - stored."""
    seen = lines.where("page IS NOT NULL").select("page", F.explode(F.array_distinct("keys")).alias("k")).where("k IS NOT NULL")
    nodes = stored(seen.distinct().groupBy("k").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= support), "nodes")
    hot = _small(nodes.select("k"))
    solid = F.filter("keys", lambda x: x.isNotNull())
    n = F.size("solid")
    steps = lines.where("page IS NOT NULL").select("page", solid.alias("solid")).where(n > 1)
    steps = steps.select("page", F.explode(F.arrays_zip(F.slice("solid", 1, n - 1).alias("a"), F.slice("solid", F.lit(2), n - 1).alias("b"))).alias("e")).select("page", "e.a", "e.b")
    steps = steps.where("a <> b").join(hot.withColumnRenamed("k", "a"), "a", "left_semi").join(hot.withColumnRenamed("k", "b"), "b", "left_semi")
    edges = steps.distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= support)
    labels, _ = components(edges.select("a", "b"))
    return stored(nodes.join(labels.toDF("k", "root"), "k", "left").select("k", "pages", F.coalesce("root", "k").alias("block")), "line-blocks")


def boilerplate_lines(
    df: DataFrame, id_col: str = "record_id", text_col: str = "content_text", url_col: str = "canonical_url", domain_col: str = "domain", support: int = 6,
) -> DataFrame:
    """id_col, line_no (from 1), block (key of the block's least line) of each occurrence of a boilerplate line."""
    lines = stored(line_keys(df, id_col, text_col, url_col, domain_col), "lines")
    graph = line_graph(lines, support)
    places = lines.select("id", F.posexplode("keys").alias("pos", "k")).where("k IS NOT NULL")
    return places.join(_small(graph.select("k", "block")), "k").select(F.col("id").alias(id_col), (F.col("pos") + 1).alias("line_no"), "block")


def boilerplate_blocks(
    df: DataFrame, id_col: str = "record_id", text_col: str = "content_text", url_col: str = "canonical_url", domain_col: str = "domain", support: int = 6,
) -> DataFrame:
    """site, first_line (the least of the block's lines, as compared), n_lines, pages (of its most frequent line),
    n_places (occurrences of its lines in all records): a row for each block."""
    lines = stored(line_keys(df, id_col, text_col, url_col, domain_col, keep=True), "lines")
    graph = line_graph(lines, support)
    places = lines.select("site", F.explode(F.arrays_zip(F.col("keys").alias("k"), F.col("squashed").alias("x"))).alias("p")).select("site", "p.k", "p.x").where("k IS NOT NULL")
    per_line = places.join(_small(graph), "k").groupBy("site", "block", "k", "pages").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"))
    per_block = per_line.groupBy("site", "block").agg(F.min("x").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.max("pages").alias("pages"), F.sum("n").alias("n_places"))
    return per_block.select("site", "first_line", "n_lines", "pages", "n_places")


def without_boilerplate(df: DataFrame, id_col: str = "record_id", text_col: str = "content_text", **columns) -> DataFrame:
    """df with text_col freed of the occurrences of its boilerplate blocks; a text may become empty, a null text stays
    null. An occurrence is a run of lines of one block, and the lines with nothing left inside the run go with it."""
    found = boilerplate_lines(df, id_col, text_col, **columns)
    # the lines of one record, so bounded by its text
    per = found.groupBy(F.col(id_col).alias("__record")).agg(F.array_sort(F.collect_set(F.struct("line_no", "block"))).alias("__at"))
    n = F.size("__at")
    runs = F.arrays_zip(F.slice("__at", F.lit(1), n - 1).alias("p"), F.slice("__at", F.lit(2), n - 1).alias("q"))
    empty = F.array().cast("array<int>")

    def inner(z: Column) -> Column:
        p, q = z["p"], z["q"]
        between = F.slice("__lines", p["line_no"] + 1, F.greatest(q["line_no"] - p["line_no"] - 1, F.lit(0)))
        same = (p["block"] == q["block"]) & (q["line_no"] - p["line_no"] > 1) & ~F.exists(between, lambda x: x.rlike("[A-Za-z0-9]"))
        return F.when(same, F.sequence(p["line_no"] + 1, q["line_no"] - 1)).otherwise(empty)

    drop = F.concat(F.transform("__at", lambda x: x["line_no"]), F.when(n > 1, F.flatten(F.transform(runs, inner))).otherwise(empty))
    joined = df.join(per, df[id_col] == per["__record"], "left").withColumn("__lines", F.when(F.col("__at").isNotNull(), F.split(text_col, "\n")))
    left = F.array_except(F.sequence(F.lit(1), F.size("__lines")), drop)
    kept = F.array_join(F.transform(left, lambda k: F.element_at("__lines", k)), "\n")
    text = F.when(F.col("__at").isNull(), F.col(text_col)).otherwise(kept)
    return joined.withColumn(text_col, text).drop("__record", "__at", "__lines")
