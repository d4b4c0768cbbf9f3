"""Texts that are read off a record: what it builds, who noticed it, what isn't known, and a Markdown brief (K-05, K-06, P-12, X-17, SURVEY 2.13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.said import label_kind
from lodestone.functions.text import host, safe_url


def builds(row: DataFrame) -> Column:
    """struct<text, source>: the own sentence on a verified site, else a source's description, else nothing."""
    c = F.col
    own = (F.coalesce("product", F.lit("")) != "") & F.coalesce(c("website_identity") == "verified", F.lit(False))
    told = (F.coalesce("description", F.lit("")) != "") & label_kind(c("description")).isNull()
    return F.struct(F.when(own, c("product")).when(told, c("description")).alias("text"), F.when(own, "own words").when(told, "a source").otherwise("none").alias("source"))


def event_phrase(signals: Column) -> Column:
    """The oldest dated signal as `type date`."""
    dated = F.filter(signals, lambda s: s["date"].isNotNull())
    first = F.get(F.array_sort(F.transform(dated, lambda s: F.struct(s["date"].alias("d"), s["type"].alias("t")))), F.lit(0))
    return F.when(first.isNotNull(), F.concat_ws(" ", first["t"], first["d"]))


def trail(signals: Column) -> Column:
    """Who noticed the record: distinct names in the order of the signals."""
    names = F.array_distinct(F.transform(signals, lambda s: F.trim(F.regexp_replace(s["label"], r"\s*\d+$", ""))))
    return F.array_join(F.filter(names, lambda n: n != ""), " + ")


def badges(now_year: int, years: int = 5) -> Column:
    """What a narrower list would have left out: not a company, name only, old, struck off."""
    c = F.col
    said = c("said_state").isin("own", "source")
    return F.array_compact(F.array(
        F.when(~c("is_company"), "not a company"),
        F.when(~said, "name only"),
        F.when(c("started") < now_year - years, F.concat(F.lit("started "), c("started"))),
        F.when(c("struck"), "struck off"),
    ))


def unknowns() -> Column:
    """What no source says, as short names in a fixed order."""
    c = F.col
    site = safe_url(c("website"))
    return F.array_compact(F.array(
        F.when(~c("is_company"), "entity"),
        F.when(c("said_state").isin("label", "none"), "what it builds").when(c("said_state") == "source", "what it says about itself"),
        F.when(c("started").isNull(), "when it was founded"),
        F.when(c("city").isNull() & c("state").isNull(), "where it is based"),
        F.when(site.isNotNull() & ~F.coalesce(c("website_identity") == "verified", F.lit(False)), "whether the site is its own").when(site.isNull() & ~c("website_checked"), "whether it has a site"),
        F.when(c("founders").isNull(), "founders"),
    ))


def compact(rows: DataFrame, most: int = 10) -> DataFrame:
    """The first rows of a view with short texts (P-12)."""
    words = builds(rows)["text"]
    return rows.select("id", "name", F.substring(F.coalesce(words, F.lit("no description")), 1, 100).alias("builds"), F.coalesce("state", F.lit("unknown")).alias("state"), F.coalesce(F.col("started").cast("string"), F.lit("unknown")).alias("started")).limit(most)


def documents(rows: DataFrame) -> DataFrame:
    """(id, json): each row as a JSON document with its nulls (K-05)."""
    return rows.select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def markdown(rows: DataFrame) -> DataFrame:
    """(id, brief): a Markdown brief of each row with its `signals` (K-06)."""
    c = F.col
    told = builds(rows)
    located = F.concat_ws(", ", "city", "state")
    evidence = F.transform("signals", lambda s: F.concat(F.lit("- "), s["label"], F.lit(" ("), F.coalesce(s["source"], s["type"]), F.lit(", "), F.coalesce(s["date"], F.lit("undated")), F.lit(")")))
    lines = F.concat(
        F.array(
            F.concat(F.lit("# "), c("name")),
            F.concat(F.lit("**What it builds:** "), F.coalesce(told["text"], F.lit("unknown")), F.lit(" _("), told["source"], F.lit(")_")),
            F.concat(F.lit("**Started:** "), F.coalesce(c("started").cast("string"), F.lit("unknown")), F.lit(" · **Based:** "), F.when(located != "", located).otherwise("unknown"), F.lit(" · **References:** "), c("trace_count")),
            F.lit("## Open questions"),
        ),
        F.transform(unknowns(), lambda u: F.concat(F.lit("- "), u)),
        F.array(F.lit("## Evidence")),
        evidence,
        F.array(F.concat(F.lit("Tier "), c("tier"))),
    )
    return rows.select("id", F.array_join(lines, "\n").alias("brief"))


def site_of(url: Column) -> Column:
    """The host that a brief names."""
    return host(safe_url(url))
