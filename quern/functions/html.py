"""HTML as scripts read it: without scripts, styles and what only looks good. Arrow batches, as nesting needs a parser."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DROPPED = ("script", "style", "noscript")


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.inside = ""
        self.doctype = False

    def handle_starttag(self, tag, attrs):
        if self.inside:
            return
        if tag in DROPPED:
            self.inside = tag
        elif not (tag == "link" and "stylesheet" in (dict(attrs).get("rel") or "").lower()):
            kept = "".join(f" {k}" if v is None else f' {k}="{escape(v)}"' for k, v in attrs if k != "style")
            self.out.append(f"<{tag}{kept}>")

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.inside:
            self.inside = "" if tag == self.inside else self.inside
        elif tag not in DROPPED:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.inside:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def handle_decl(self, decl):
        self.doctype = self.doctype or decl.lower().startswith("doctype")
        self.handle_data(f"<!{decl}>")


def clean(html: str) -> str:
    parser = _Cleaner()
    parser.feed(html)
    parser.close()
    return ("" if parser.doctype else "<!DOCTYPE html>") + "".join(parser.out)


@F.pandas_udf(T.StringType())
def clean_html(pages: pd.Series) -> pd.Series:
    """The page without scripts, styles, noscript, stylesheet links and style attributes; a doctype is added if missing."""
    return pages.map(clean, na_action="ignore")
