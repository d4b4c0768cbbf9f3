"""Listings in pages: cards, tables, streamed fragments and what people write as a date (S-05, S-06, S-09, S-13, S-15, D-06)."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import clean
from lodestone.sources.html import VOID, flat

CARD = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "text", "href")]))
ROWS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


class Cards(HTMLParser):
    """The title (first heading), text and first link with words of every element of a tag and class."""

    def __init__(self, html: str, tag: str, cls: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.cls = tag, cls
        self.found: list[dict] = []
        self.path: list[str] = []
        self.depth = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if self.depth is None and tag == self.tag and (self.cls is None or self.cls in (found.get("class") or "").split()):
            self.depth = len(self.path)
            self.found.append({"title": [], "text": [], "links": []})
        if self.depth is not None and tag == "a" and found.get("href"):
            self.found[-1]["links"].append([found["href"].strip(), ""])
        if tag not in VOID:
            self.path.append(tag)

    def handle_endtag(self, tag):
        if tag in self.path:
            while self.path.pop() != tag:
                pass
            if self.depth is not None and len(self.path) <= self.depth:
                self.depth = None

    def handle_data(self, data):
        if self.depth is None:
            return
        card = self.found[-1]
        if any(t in ("h1", "h2", "h3", "h4") for t in self.path[self.depth :]):
            card["title"].append(data)
        else:
            card["text"].append(data)
        if "a" in self.path[self.depth :] and card["links"]:
            card["links"][-1][1] += data


def cards(html: Column, tag: str, cls: str | None = None) -> Column:
    """array<struct<title, text, href>> of a page's cards; stray links without words don't count."""
    @F.udf(CARD, useArrow=False)
    def read(page: str | None) -> list[tuple]:
        return [(flat(c["title"]), flat(c["text"]), next((u for u, words in c["links"] if words.strip()), None)) for c in Cards(page or "", tag, cls).found]

    return read(html)


class Tables(HTMLParser):
    """The rows of every table, by the names in its first row."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict[str, str]] = []
        self.names: list[str] | None = None
        self.row: list[list[str]] | None = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.names = None
        elif tag == "tr":
            self.end_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append([])

    def handle_endtag(self, tag):
        if tag in ("tr", "table"):
            self.end_row()

    def handle_data(self, data):
        if self.row:
            self.row[-1].append(data)

    def end_row(self):
        if self.row:
            cells = [flat(c) for c in self.row]
            if self.names is None:
                self.names = [c.lower() for c in cells]
            else:
                self.rows.append(dict(zip(self.names, cells, strict=False)))
        self.row = None


def table_rows(html: Column) -> Column:
    """array<map<header, cell>> of a page's tables; headers in lower case."""
    @F.udf(ROWS, useArrow=False)
    def read(page: str | None) -> list[dict[str, str]]:
        return Tables(page or "").rows

    return read(html)


def fragments(script: Column, pattern: str, schema: str) -> Column:
    """The records in a streamed script: every match's first group parsed as an array of records, malformed ones left out (S-05)."""
    parts = F.transform(F.regexp_extract_all(script, F.lit(pattern), 1), lambda x: F.from_json(x, f"array<{schema}>"))
    return F.flatten(F.filter(parts, lambda x: x.isNotNull()))


def filled(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first value of each column that isn't empty, in an order (N-06, N-07)."""
    out = [F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*out)


def fullest(rows: DataFrame, key: str, line: str, order: str) -> DataFrame:
    """(key, line): of several lines of founders the one with the most separators, the first of equals (N-07)."""
    marks = F.length(line) - F.length(F.translate(line, ",/&", ""))
    return rows.where(F.col(line).isNotNull()).groupBy(key).agg(F.min_by(line, F.struct((-marks).alias("n"), F.col(order).alias("order"))).alias(line))


def written_date(text: Column, this_year: int) -> Column:
    """struct<date, label, year> of an incubation date: a day, a period, a year, a financial year, or words (D-06).

    The date has no more precision than the text; the year is given only if the text names one year, or a day in it.
    """
    line = clean(text)

    def day(x: Column) -> Column:
        iso = F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), x)
        dmy = F.when(x.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$"), F.regexp_replace(x, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", "$3-$2-$1"))
        return F.coalesce(iso, dmy).try_cast("date").cast("string")

    def year(x: Column) -> Column:
        y = F.substring(x, 1, 4).try_cast("int")
        return F.when(y.between(1900, this_year), y)

    def out(date: Column, label: Column, y: Column) -> Column:
        return F.struct(date.cast("string").alias("date"), label.alias("label"), y.cast("int").alias("year"))

    null = F.lit(None)
    a, b = F.regexp_extract(line, r"^(\S+)\s+-\s+(\S+)$", 1), F.regexp_extract(line, r"^(\S+)\s+-\s+(\S+)$", 2)
    fy = F.regexp_replace(line, r"\s*-\s*", "-")
    first, second = F.substring(fy, 1, 4).try_cast("int"), F.substring_index(fy, "-", -1)
    follows = ((F.length(second) == 2) & (second.try_cast("int") == (first + 1) % 100)) | ((F.length(second) == 4) & (second.try_cast("int") == first + 1))
    return (
        F.when(line.isNull(), out(null, null, null))
        .when(line.rlike(r"^\d{4}-\d{2}-\d{2}$") & day(line).isNotNull(), out(line, line, year(line)))
        .when(year(day(a)).isNotNull(), out(day(a), F.concat(day(a), F.lit(" to "), F.coalesce(day(b), b)), year(day(a))))
        .when(line.rlike(r"^\d{4}$") & year(line).isNotNull(), out(line, line, year(line)))
        .when(fy.rlike(r"^\d{4}-(?:\d{2}|\d{4})$") & follows, out(null, fy, null))
        .otherwise(out(null, line, null))
    )


def deep_records(text: Column, keys: tuple[str, ...]) -> Column:
    """array<string>: every object in a JSON text that has all the keys, at any depth, as JSON (S-12, N-05); none for malformed text."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def walk(texts: pd.Series) -> pd.Series:
        def of(x):
            try:
                todo = [json.loads(x or "null")]
            except ValueError:
                return []
            found = []
            while todo:
                node = todo.pop()
                if isinstance(node, dict):
                    if set(keys) <= node.keys():
                        found.append(json.dumps(node))
                    todo += reversed(list(node.values()))
                elif isinstance(node, list):
                    todo += reversed(node)
            return found

        return texts.map(of)

    return walk(text)
