"""Title, visible text and links of HTML, parsed once per page in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is not shown, and elements that begin and end on a line of their own (fixed values).
HIDDEN = {"script", "style", "noscript", "template", "head"}
BLOCKS = {"p", "div", "section", "article", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.shown: list[str] = []
        self.names: dict[str, list[str]] = {"title": [], "h1": []}
        self.links: list[str] = []
        self.depth = {"title": 0, "h1": 0}
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.depth:
            self.depth[tag] += 1
        self.hidden += tag in HIDDEN
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v][:1]
        if tag in BLOCKS:
            self.shown.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.depth:
            self.depth[tag] = max(0, self.depth[tag] - 1)
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self.shown.append("\n")

    def handle_data(self, data):
        if self.depth["title"]:
            self.names["title"].append(data)
        if not self.hidden:
            self.shown.append(data)
            if self.depth["h1"]:
                self.names["h1"].append(data)


def read(html: str | None) -> tuple[str, str, list[str]] | None:
    """(title, text, links); None for null.

    The title is all text within title elements, else that of the shown h1. The text has one line per block, stripped,
    without blank lines. Links are all nonempty href of a elements in order, hidden ones too.
    """
    if html is None:
        return None
    r = _Reader()
    r.feed(html)
    title = "".join(r.names["title"]).strip() or "".join(r.names["h1"]).strip()
    return title, "\n".join(x for line in "".join(r.shown).splitlines() if (x := line.strip())), r.links


_PARSED = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))])


@F.pandas_udf(_PARSED)
def extracted(html: pd.Series) -> pd.DataFrame:
    rows = [read(h) or (None, None, None) for h in html]
    return pd.DataFrame(rows, columns=["title", "text", "links"])
