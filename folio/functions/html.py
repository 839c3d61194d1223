"""Rows of stored HTML pages, by the standard library's parser in vectorised functions."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import contains_any, strip
from folio.sources.shipping import ship_package


class _Page(HTMLParser):
    """Table rows as (row attributes, cells); a cell has its text and its anchors (attributes, text)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list = []
        self.links: list[str] = []
        self._anchor = None
        self._cell = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "tr":
            self.rows.append((attrs, []))
            self._cell = None
        elif tag == "td" and self.rows:
            self._cell = {"text": "", "anchors": []}
            self.rows[-1][1].append(self._cell)
        elif tag == "a":
            if attrs.get("href") is not None:
                self.links.append(attrs["href"])
            self._anchor = {"attrs": attrs, "text": ""}
            if self._cell is not None:
                self._cell["anchors"].append(self._anchor)

    def handle_endtag(self, tag):
        if tag == "a":
            self._anchor = None
        elif tag in ("td", "tr"):
            self._cell = None

    def handle_data(self, data):
        if self._cell is not None:
            self._cell["text"] += data
        if self._anchor is not None:
            self._anchor["text"] += data


def listing_rows(html: Column, row_color: str = "#ffffff") -> Column:
    """array<struct<name, company>> of rows with the colour and three cells or more; a null page has none."""
    ship_package()

    @F.pandas_udf("array<struct<name: string, company: string>>")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for html in pages:
            rows = _Page(html or "").rows
            out.append([{"name": c[1]["text"].strip(), "company": c[2]["text"].strip()} for attrs, c in rows if attrs.get("bgcolor") == row_color and len(c) >= 3])
        return pd.Series(out)

    return run(html)


def candidate_rows(html: Column) -> Column:
    """array<struct<name, link, size, date>> of rows with five cells or more.

    The name is the title (else the text) of the second cell's last anchor to a view page, else the
    cell's text; the link is the third cell's first magnet anchor, else empty.
    """
    ship_package()

    @F.pandas_udf("array<struct<name: string, link: string, size: string, date: string>>")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for html in pages:
            found = []
            for _, c in _Page(html or "").rows:
                if len(c) < 5:
                    continue
                views = [a for a in c[1]["anchors"] if "view" in (a["attrs"].get("href") or "")]
                name = (views[-1]["attrs"].get("title") or views[-1]["text"].strip()) if views else c[1]["text"].strip()
                links = [a["attrs"]["href"] for a in c[2]["anchors"] if "magnet:?xt=urn:btih:" in (a["attrs"].get("href") or "")]
                found.append({"name": name, "link": links[0] if links else "", "size": c[3]["text"].strip(), "date": c[4]["text"].strip()})
            out.append(found)
        return pd.Series(out)

    return run(html)


def anchors(html: Column) -> Column:
    """Targets of all anchors, in order."""
    ship_package()

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([_Page(html or "").links for html in pages])

    return run(html)


def listings(pages: DataFrame, skip: list[str], *, date_col: str = "date", html_col: str = "html") -> DataFrame:
    """date, name, company, ordinal of stored listing pages: both fields filled, and no skipped literal in the name.

    ``ordinal`` is (page, row); ``page`` is 0 where ``pages`` has no such column.
    """
    page = F.col("page") if "page" in pages.columns else F.lit(0)
    rows = pages.select(date_col, page.alias("_p"), F.posexplode(listing_rows(F.col(html_col))).alias("_r", "row"))
    return rows.select(date_col, "row.name", "row.company", F.struct("_p", "_r").alias("ordinal")).where((F.col("name") != "") & (F.col("company") != "") & ~contains_any(F.col("name"), skip))


def candidates(pages: DataFrame, *, key_cols: list[str], html_col: str = "html") -> DataFrame:
    """Key columns, name, link, size, date (timestamp or null), ordinal of stored search pages."""
    rows = pages.select(*key_cols, F.posexplode(candidate_rows(F.col(html_col))).alias("ordinal", "row"))
    return rows.select(*key_cols, "row.name", "row.link", "row.size", F.try_to_timestamp(strip(F.col("row.date")), F.lit("yyyy-M-d H:m")).alias("date"), "ordinal")
