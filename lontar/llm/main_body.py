"""Problem 6: the main body of each page, without the lines of its frame.

Method: two-pass block rules of blocks.py over the lines of each page, row-local and so without a shuffle. The same
scan tells what problem 4 needs, so that both problems read each text once.

Cases: a null text has a null body; a blank text an empty one; lines that are blank belong to neither side; rows
without an id and repeated rows come out as they go in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from ..runtime import ship
from . import residue as R
from .site_lines import site_of

PAGE = "frame_lines array<int>, trusted boolean, seed boolean, cores array<string>, brief array<long>, head long"


def scan_pages(
    df: DataFrame, id_col: str, text_col: str, title_cols: tuple[str, ...] = (), body: bool = False, site_cols: tuple[str, str] | None = None, messages: bool = True,
) -> DataFrame:
    """For each row: id, frame_lines (numbers of the non-blank lines outside the main body, from 1), trusted (the record
    is residue by its own lines), seed, cores, brief and head (for problem 4's likeness and repetition) and, with body,
    main_text."""
    ship(df.sparkSession)
    site = F.lower(F.regexp_extract(site_of(df[site_cols[0]], df[site_cols[1]]), "^([^.]*)", 1)) if site_cols else F.lit("")
    url = df[site_cols[1]] if site_cols else F.lit(None).cast("string")
    titles = [df[c].alias(f"title{k}") for k, c in enumerate(title_cols)]
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.coalesce(site, F.lit("")).alias("site"), url.alias("url"), *titles)
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_scanner(body, messages), f"id {id_type}, {PAGE}" + ", main_text string" * body)


def _scanner(body: bool, messages: bool):
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.list_(pa.int32()), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.string()]
        names = ["frame_lines", "trusted", "seed", "cores", "brief", "head", "main_text"]
        cache: dict[str, B.Line] = {}
        for batch in batches:
            _, texts, sites, urls, *titles = [c.to_pylist() if k else None for k, c in enumerate(batch.columns)]
            heads = list(zip(*titles, strict=True)) if titles else [()] * len(texts)
            pages = [read_page(t, h, s, u, cache, body, messages) for t, h, s, u in zip(texts, heads, sites, urls, strict=True)]
            columns = list(zip(*pages, strict=True)) if pages else [()] * len(kinds)
            n = len(kinds) - (not body)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(columns[:n], kinds[:n], strict=True)]], names=["id", *names[:n]])

    return scan


class Page(NamedTuple):
    """frame: numbers of the frame's lines; trusted and seed: residue by its own lines, with placeholders and sentences or
    without; cores and brief: the body for likeness and repetition; head: hash of the headline, or of the URL."""

    frame: list[int]
    trusted: bool
    seed: bool
    cores: list[str]
    brief: list[int] | None
    head: int | None
    main: str | None


def read_page(text: str | None, titles: tuple[str | None, ...] = (), site: str = "", url: str | None = None, cache: dict[str, B.Line] | None = None, body: bool = True, messages: bool = True) -> Page:
    if text is None:
        return Page([], False, False, [], None, None, None)
    lines = text.split("\n")
    heads = tuple(h for h in {B.squash(x) for t in titles if t for x in (t, t.rpartition(" - ")[0])} if len(h) > 3)
    known, labels, links = B.page_lines(lines, heads, cache)
    frame = [k + 1 for k, x in enumerate(labels) if x == B.FRAME]
    sentences = placeholders = residue = filled = n_words = 0
    core, whole = [], []
    for k, x in enumerate(known):
        if x.mark not in (B.MAIN, B.OPEN) or k in links:
            continue
        line = lines[k]
        if heads and B.is_title(line, heads) and not R.has_placeholder(line, x.text):
            continue
        words = R.line_words(x.text)
        kind = R.kind_of(line, x.text, x.mark, words[0], messages)
        sentences += kind == "sentence"
        placeholders += kind == "placeholder"
        residue += kind == "residue"
        filled += kind == "placeholder" and x.mark == B.MAIN
        n_words += x.n_words
        whole.append((x.text, *words))
        if x.mark == B.MAIN or kind == "residue":
            core.append(whole[-1])
    trusted = bool(placeholders or residue and not sentences)
    cores = sorted({R.core_of(x) for x in (core, whole)} - {""}) if len(core) < len(whole) else sorted({R.core_of(whole)} - {""})
    brief = R.brief_body(whole, site) if n_words <= 2 * R.BRIEF else None
    headline = next((h for t in titles if t for h in [B.squash(t.rpartition(" - ")[0] or t)] if h), None) or url
    head = xxhash64(headline) if brief and headline else None
    main = "\n".join(line for line, x in zip(lines, labels, strict=True) if x == B.MAIN) if body else None
    return Page(frame, trusted, trusted and not sentences and not filled, cores, brief, head, main)


def xxhash64(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - 2**63


def main_bodies(df: DataFrame, id_col: str = "record_id", text_col: str = "content_text", title_cols: tuple[str, ...] = ()) -> DataFrame:
    """id_col and main_text: the text of each record without its frame; null for a null text."""
    return scan_pages(df, id_col, text_col, title_cols, body=True).select(F.col("id").alias(id_col), "main_text")


def frame_lines(
    df: DataFrame, id_col: str = "record_id", text_col: str = "content_text", title_cols: tuple[str, ...] = (), site_cols: tuple[str, str] | None = None,
) -> DataFrame:
    """id_col, line_no of each non-blank line outside the main body, in records that are no residue (problem 4)."""
    from .shared import stored

    pages = stored(scan_pages(df, id_col, text_col, title_cols, site_cols=site_cols), "pages")
    bad = stored(R.propagate(pages).distinct(), "residue")
    kept = pages.join(R._small(bad), "id", "left_anti")
    return kept.select(F.col("id").alias(id_col), F.explode("frame_lines").alias("line_no"))
