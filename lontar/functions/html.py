"""HTML to lines of text."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

# Elements that begin and end a line, and elements whose text isn't shown.
LINE_ELEMENTS = frozenset(
    """address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav
    ol p pre section table tbody td tfoot th thead tr ul""".split()
)
HIDDEN_ELEMENTS = frozenset("script style noscript svg canvas".split())


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list[str]] = [[]]
        self.hidden = 0

    def _edge(self, tag: str, by: int) -> None:
        if tag in HIDDEN_ELEMENTS:
            self.hidden = max(0, self.hidden + by)
        elif tag in LINE_ELEMENTS and self.lines[-1]:
            self.lines.append([])

    def handle_starttag(self, tag, attrs):
        self._edge(tag, 1)

    def handle_endtag(self, tag):
        self._edge(tag, -1)

    def handle_data(self, data):
        if not self.hidden:
            self.lines[-1].extend(data.split())


def html_lines(html: str | None) -> str:
    """The shown text, a line for each block element, without empty and repeated neighbouring lines."""
    if not html:
        return ""
    p = _Lines()
    p.feed(html)
    p.close()
    out: list[str] = []
    for words in p.lines:
        line = " ".join(words)
        if line and (not out or out[-1] != line):
            out.append(line)
    return "\n".join(out)


def html_to_text():
    """html_lines() as an Arrow UDF on a column."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(html_lines)

    return text
