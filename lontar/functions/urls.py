"""Addresses: normal form, domain, title from the path, and blanking of login walls."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TRACKING
from .text import collapse, strip


def netloc(url: Column) -> Column:
    """What stands between scheme and path, in lower case; empty without a scheme."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)), F.lit(""))


def domain(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^\s*(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)", 1), F.lit(""))


def _unquote(c: Column) -> Column:
    """Percent-decoded; a plus stays, and what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def normal_url(url: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """Scheme (https without one) and host in lower case without www., decoded path without closing slashes, sorted
    parameters without tracking ones, `hl` and `page=all`; no fragment. Parameters keep the coding that they have, which
    is where normalize_url() is exact instead. Empty for null and empty."""
    u = strip(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    drop = "|".join(t.replace(".", r"\.") for t in tracking)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^(?:(?:{drop}|hl)(?:=|$)|page=all$)")))
    out = F.concat(
        F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), domain(u), F.regexp_replace(_unquote(path(u)), r"/+$", ""),
        F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""),
    )
    return F.when(F.coalesce(u, F.lit("")) == "", "").otherwise(out)


def normalize_one(url: str | None, tracking: frozenset[str]) -> str:
    """normal_url() with exact decoding and encoding of the parameters."""
    from urllib.parse import parse_qsl, unquote, urlencode, urlsplit, urlunsplit

    if not url or not url.strip():
        return ""
    try:
        u = urlsplit(url.strip())
    except ValueError:
        return url.strip()
    kept = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.casefold() not in tracking and k.casefold() != "hl" and not (k.casefold() == "page" and v.casefold() == "all"))
    return urlunsplit(((u.scheme or "https").lower(), u.netloc.lower().removeprefix("www."), unquote(u.path).rstrip("/"), urlencode(kept), ""))


def normalize_url(tracking: Sequence[str] = TRACKING):
    """The exact normal form as an Arrow UDF on a column."""

    own = frozenset(t.casefold() for t in tracking)

    @F.pandas_udf("string")
    def normal(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: normalize_one(u, own))

    return normal


def title_from_url(url: Column) -> Column:
    """Words of the last two path parts; of the first two for instagram, of all but `video` and `photo` for tiktok."""
    parts = F.filter(F.transform(F.split(path(url), "/"), lambda p: strip(_unquote(p))), lambda p: p != "")
    host = netloc(url)
    media = F.filter(parts, lambda p: ~p.isin("video", "photo"))
    n = F.size(parts)
    last = F.when(n > 2, F.slice(parts, n - 1, F.lit(2))).otherwise(parts)
    chosen = (
        F.when(host.contains("instagram.com") & (n >= 2), F.slice(parts, 1, 2))
        .when(host.contains("tiktok.com"), F.when(F.size(media) > 0, media).otherwise(parts))
        .otherwise(last)
    )
    return collapse(F.regexp_replace(F.array_join(chosen, " "), "[_-]+", " "))


# Texts of login walls, per site the longest text that may be one, markers with and without blanks.
WALLS = (
    ("instagram.com", 1200, ("loginsignupnevermissapostfrom", "signupforinstagramtostayintheloop", "masukdaftarjanganpernahlewatkanpostingan"),
     ("post isn't available", "the link may be broken, or the profile may have been removed", "see everyday moments from your close friends", "log into instagram")),
    ("tiktok.com", 800, (), ("drag the slider to fit the puzzle", "access to www.tiktok.com was denied", "you don't have authorization to view this page")),
)


def blank_walls(text: Column, url: Column, walls: Sequence = WALLS) -> Column:
    """The text with white space collapsed, empty where it is a site's login wall."""
    t = collapse(F.coalesce(text, F.lit("")))
    low, host = F.lower(t), netloc(url)
    compact = F.regexp_replace(low, r"\s+", "")
    wall = F.lit(False)
    for site, longest, tight, loose in walls:
        marks = F.lit(False)
        for m in tight:
            marks = marks | compact.contains(m)
        for m in loose:
            marks = marks | low.contains(m)
        wall = wall | (host.contains(site) & (F.length(t) <= longest) & marks)
    return F.when(wall, "").otherwise(t)


def title_url_text(title: Column, url: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), _unquote(path(F.coalesce(url, F.lit("")))), domain(F.coalesce(url, F.lit(""))))
