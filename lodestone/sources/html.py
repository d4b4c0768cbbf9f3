"""Web pages read with the standard parser, row by row (E-10 to E-12, S-06, S-09, X-07).

Parsing takes far longer than passing a page on, and an Arrow batch of 10,000 pages would be held whole, so these aren't
pandas functions: a worker holds a hundred pages at a time.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import without_contacts

VOID = {"br", "hr", "img", "input", "link", "meta", "source", "wbr"}
#: Text that a page is read by, at most, and the least that tells something (fixed values).
MOST, THIN = 6000, 400
ROLE_FIRST = ("info", "contact", "hello", "hi", "office", "admin", "support", "sales", "team", "mail", "enquiry", "enquiries")


class Page(HTMLParser):
    """Title, description, headings, paragraphs, list items, links and visible text of a page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.links, self.text = "", "", [], []
        self.blocks: dict[str, list[str]] = {"h": [], "p": [], "li": []}
        self.open: list[tuple[str, list[str]]] = []
        self.hidden = 0
        self.feed(html)
        self.close()
        for tag, held in self.open:
            self.keep(tag, held)

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        elif tag == "meta" and (found.get("name") or "").lower() == "description":
            self.meta = (found.get("content") or "").strip()
        elif tag == "a" and found.get("href"):
            self.links.append([found["href"].strip(), []])
        if tag not in VOID and tag in ("title", "h1", "h2", "h3", "p", "li"):
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for t, held in self.open[i:]:
                    self.keep(t, held)
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.hidden:
            return
        for _, held in self.open:
            held.append(data)
        if self.links:
            self.links[-1][1].append(data)
        if not any(t == "title" for t, _ in self.open):
            self.text.append(data)

    def keep(self, tag, held):
        text = " ".join("".join(held).split())
        if tag == "title":
            self.title = self.title or text
        elif text:
            self.blocks["h" if tag[0] == "h" else tag].append(text)


def flat(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


LIST = T.ArrayType(T.StringType())
PAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "meta")]
    + [T.StructField(n, LIST) for n in ("headings", "paragraphs", "items", "links")]
    + [T.StructField("visible", T.StringType()), T.StructField("thin", T.BooleanType())]
)


@F.udf(PAGE, useArrow=False)
def read_page(html: str | None) -> tuple:
    """Title, description, up to 12 headings, 15 paragraphs and 15 items, links, visible text, and whether it is too thin to read."""
    p = Page(html or "")
    visible = flat(p.text)
    parts = {k: list(dict.fromkeys(p.blocks[k]))[:n] for k, n in (("h", 12), ("p", 15), ("li", 15))}
    return p.title, p.meta, parts["h"], parts["p"], parts["li"], list(dict.fromkeys(u for u, _ in p.links)), visible[:MOST], len(visible) < THIN


def written_title(html: Column) -> Column:
    """The first title on one line of markup as it is written, on one line, with `&amp;` alone read as a character.

    Other references, and those cut off before their semicolon, stay as they are; `read_page` reads them all.
    """
    found = F.regexp_extract(html, r"<title>([^\n]*?)</title>", 1)
    return F.btrim(F.regexp_replace(F.replace(found, F.lit("&amp;"), F.lit("&")), r"[\t\n\f\r ]+", " "))


@F.udf(T.StringType(), useArrow=False)
def plain_text(html: str | None) -> str | None:
    """The visible text of fragments, with what was escaped before it was put into HTML unescaped as well."""
    return None if html is None else flat([unescape(" ".join(Page(html).text))])


def text_of(rows: DataFrame, html: str, name: str) -> DataFrame:
    """rows with a column of HTML fragments as one line of plain text each, without contacts (X-07)."""
    return rows.withColumn(name, plain_text(html)).withColumn(name, without_contacts(F.col(name)))


CONTACT = T.StructType([T.StructField("email", T.StringType()), T.StructField("page", T.StringType()), T.StructField("kinds", LIST)])


@F.udf(CONTACT, useArrow=False)
def read_contact(html: str | None) -> tuple:
    """A mailbox, the role's one first, the link to a contact page, and the kinds of pages linked to (E-11, E-12, O-17, O-18)."""
    kinds = {"careers": r"career|jobs|join-us", "team": r"team|about", "repo": r"github\.com|gitlab\.com", "contact": r"contact|reach-us"}
    p = Page(html or "")
    mails = re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", (html or "").lower())
    mails = sorted(dict.fromkeys(mails), key=lambda m: ROLE_FIRST.index(m.split("@")[0]) if m.split("@")[0] in ROLE_FIRST else len(ROLE_FIRST))
    pages = sorted((u for u, _ in p.links if re.search(kinds["contact"], u.lower())), key=len)
    return mails[0] if mails else None, pages[0] if pages else None, [k for k, v in kinds.items() if any(re.search(v, u.lower()) for u, _ in p.links)]
