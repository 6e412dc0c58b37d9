"""HTML tables: cells, Markdown, row sentences."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import HTML_TABLE


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.head: list[list[str]] = []
        self.body: list[list[str]] = []
        self.in_head, self.row, self.cell = False, None, None

    def handle_starttag(self, tag, attrs):
        if tag == "thead":
            self.in_head = True
        elif tag == "tr":
            self.close_row()
            self.row = []
        elif tag in ("td", "th"):
            self.close_cell()
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.close_cell()
        elif tag == "tr":
            self.close_row()
        elif tag == "thead":
            self.close_row()
            self.in_head = False

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def close_cell(self):
        if self.cell is not None:
            self.row = self.row if self.row is not None else []
            self.row.append(" ".join("".join(self.cell).split()).strip("|").strip())
        self.cell = None

    def close_row(self):
        self.close_cell()
        if self.row:
            (self.head if self.in_head else self.body).append(self.row)
        self.row = None


def parse(html: str | None) -> tuple[list[str], list[list[str]]]:
    """(header, rows): the header is the first thead row, else the first row; blank rows go; all are padded to one width."""
    p = _Cells()
    p.feed(html or "")
    p.close_row()
    rows = [r for r in p.body if any(r)]
    head = next((r for r in p.head if any(r)), None)
    if head is None:
        head, rows = (rows[0], rows[1:]) if rows else ([], [])
    width = max([len(head), *map(len, rows)])
    pad = lambda r: r + [""] * (width - len(r))
    return pad(head), [pad(r) for r in rows]


@F.pandas_udf(HTML_TABLE)
def parse_table_html(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(h) for h in html], columns=["header", "rows"])


def markdown(header: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.regexp_replace(c, r"\|", r"\\|")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(header)))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")


def row_sentence(header: Column, row: Column) -> Column:
    """``subject — column: value; …``; a column without a name gives its value alone."""
    named = F.zip_with(header, row, lambda h, v: F.when(v == "", None).when(h == "", v).otherwise(F.concat(h, F.lit(": "), v)))
    rest = F.array_join(F.filter(F.slice(named, 2, F.greatest(F.size(named), F.lit(1))), lambda x: x.isNotNull()), "; ")
    return F.when(F.size(row) == 1, F.get(row, F.lit(0))).otherwise(F.concat(F.get(row, F.lit(0)), F.lit(" — "), rest))
