"""The read model: a view's filters, order, pages and facets (F-01 to F-25, O-01 to O-08, A-01 to A-06, A.3 to A.5)."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.dates import started_year
from lodestone.functions.said import completeness
from lodestone.functions.text import like_pattern

SORTS = ("obscurity", "newest", "quietest", "described", "programmes", "name")
SAID = ("own", "source")


@dataclass(frozen=True)
class View:
    """What a reader asked for; None leaves a filter out. Filters are conjunctive."""

    sector: str | None = None
    subsector: str | None = None
    tiers: tuple[str, ...] | None = None
    search: str | None = None
    source: str | None = None
    state: str | None = None  # "" for unknown
    traces: str | None = None  # 1 (one at most), 2 or 3+
    described: str | None = None  # a said state, said or unsaid
    kind: str | None = None  # company or other
    dpiit: str | None = None
    programmes_at_least: int | None = None
    alone: bool = False
    noticed_once: bool = False
    ids: tuple[str, ...] | None = None
    build: str | None = None
    domain: str | None = None
    website: str | None = None  # has or none
    dated: bool | None = None
    min_started: int | None = None
    min_registered: int | None = None
    active: bool = False

    def without(self, *names: str) -> View:
        """The view with some filters left out."""
        return replace(self, **{f.name: f.default for f in fields(self) if f.name in names})


def parse_view(args: dict, strict: bool) -> View:
    """A view from text arguments: a wrong value is an error (strict) or left out (F-21); a sub-sector outside the chosen sector wins over it (F-22)."""
    allowed = {"traces": ("1", "2", "3+"), "described": ("own", "source", "label", "none", "said", "unsaid"), "kind": ("company", "other"), "website": ("has", "none")}
    found = {}
    for name, value in args.items():
        if value in (None, ""):
            continue
        if name in allowed and value not in allowed[name] or name not in {f.name for f in fields(View)}:
            if strict:
                raise ValueError(f"{name}={value}")
            continue
        found[name] = value
    if "subsector" in found and "sector" in found and not found["subsector"].startswith(f"{found['sector']}."):
        found["sector"] = found["subsector"].split(".")[0]
    return View(**found)


def with_started(companies: DataFrame, enrichment: DataFrame) -> DataFrame:
    """companies with registry_year, struck and started, from at most one enrichment row each (J-03, J-04)."""
    facts = enrichment.select("id", F.col("incorporated_year").alias("registry_year"), F.col("reg_status").isin(*STRUCK).alias("struck"))
    joined = companies.join(facts, "id", "left").withColumn("struck", F.coalesce("struck", F.lit(False)))
    return joined.withColumn("started", started_year(F.col("registry_year"), F.col("origin_year"), F.col("founded_year")))


# Register statuses of companies that are gone.
STRUCK = ("Strike Off", "Under Process of Striking Off", "Dissolved", "Amalgamated")


def conditions(view: View) -> list[Column]:
    """The view's filters on rows that have said_state, started and struck; the source filter is a semi-join."""
    c, v, out = F.col, view, []
    if v.sector:
        out.append(c("sector_id") == v.sector)
    if v.subsector:
        out.append(c("subsector_id") == v.subsector)
    if v.tiers:
        out.append(c("tier").isin(*v.tiers))
    if v.search:
        found = [F.coalesce(F.ilike(c(x), F.lit(like_pattern(v.search)), F.lit("!")), F.lit(False)) for x in ("name", "description", "product")]
        out.append(found[0] | found[1] | found[2])
    if v.state is not None:
        out.append(F.coalesce("state", F.lit("")) == v.state)
    if v.traces:
        out.append({"1": c("trace_count") <= 1, "2": c("trace_count") == 2, "3+": c("trace_count") >= 3}[v.traces])
    if v.described:
        out.append(c("said_state").isin(*SAID) if v.described == "said" else ~c("said_state").isin(*SAID) if v.described == "unsaid" else c("said_state") == v.described)
    if v.kind:
        out.append(c("is_company") if v.kind == "company" else ~c("is_company"))
    if v.dpiit:
        out.append(c("dpiit_status") == v.dpiit)
    if v.programmes_at_least:
        out.append(c("programme_count") >= v.programmes_at_least)
    if v.alone:
        out.append(c("other_count") == 0)
    if v.noticed_once:
        out.append(c("outside_count") == 1)
    if v.ids:
        out.append(c("id").isin(*v.ids))
    if v.build:
        out.append(F.coalesce(F.array_contains("build_tags", v.build), F.lit(False)))
    if v.domain:
        out.append(F.coalesce(F.array_contains("domain_tags", v.domain), F.lit(False)))
    if v.website == "has":
        out.append(F.coalesce("website", F.lit("")) != "")
    if v.website == "none":
        out.append((F.coalesce("website", F.lit("")) == "") & c("website_checked"))
    if v.dated is not None:
        out.append(c("first_seen").isNotNull() if v.dated else c("first_seen").isNull())
    if v.min_started:
        out.append(c("started").isNull() | (c("started") >= v.min_started))
    if v.min_registered:
        out.append(c("registry_year").isNull() | (c("registry_year") >= v.min_registered))
    if v.active:
        out.append(~c("struck"))
    return out


def filtered(base: DataFrame, signals: DataFrame, view: View) -> DataFrame:
    """The rows of a view; a record with several signals of the source comes once (J-01)."""
    rows = base.where(reduce(and_, conditions(view), F.lit(True)))
    if view.source:
        rows = rows.join(signals.where(F.col("source") == view.source).select(F.col("company_id").alias("id")), "id", "left_semi")
    return rows


def sort_keys(sort: str) -> list[Column]:
    """The order of a sort; the id breaks ties (O-01 to O-06)."""
    c = F.col
    newest = F.desc_nulls_last("first_seen")
    keys = {
        "obscurity": [F.when(c("tier") == "A", 0).when(c("tier") == "B", 1).otherwise(2), newest],
        "newest": [newest],
        "quietest": [F.asc("trace_count"), newest],
        "described": [F.desc(score()), F.asc("trace_count"), F.asc("name")],
        "programmes": [F.desc("programme_count"), F.asc("trace_count"), F.asc("name")],
        "name": [F.asc("name")],
    }
    return [*keys[sort], F.asc("id")]


def score() -> Column:
    names = ("product", "website_identity", "description", "founders", "contact_email", "contact_page", "first_seen")
    return completeness({n: F.col(n) for n in names})


def merged_order(base: DataFrame, signals: DataFrame, view: View, sort: str = "quietest", most: int = 5000) -> DataFrame:
    """(id, pos) of the dated and the undated list in one order, up to `most` places (O-07, O-08, W-02, W-03, A.5).

    The undated list leaves tiers out and takes the register's year for the year gate. The sort's own keys stand for
    the place in each list, so no list is ranked on its own; the first places are a top-k, and only they are numbered.
    """
    dated = filtered(base, signals, replace(view, dated=True)).withColumn("is_dated", F.lit(True))
    undated = filtered(base, signals, replace(view.without("tiers", "min_started"), dated=False, min_registered=view.min_started)).withColumn("is_dated", F.lit(False))
    both = dated.unionByName(undated)
    first = [F.desc(F.col("said_state").isin(*SAID)), F.asc("trace_count"), F.desc("is_dated")] if sort == "quietest" else [F.desc("is_dated")]
    top = both.orderBy(*first, *sort_keys(sort)).limit(most)
    return top.select("id", F.row_number().over(Window.orderBy(*first, *sort_keys(sort))).alias("pos"))


def page(base: DataFrame, order: DataFrame, number: int, size: int = 100) -> DataFrame:
    """The wide rows of one page, in its order: only their ids meet the wide table (P-04, O-08)."""
    keys = order.where(F.col("pos").between((number - 1) * size + 1, number * size))
    return base.join(F.broadcast(keys), "id").orderBy("pos")


def first_rows(base: DataFrame, sort: str, n: int) -> DataFrame:
    """The first n rows of a sort (a top-k, not a sorted table)."""
    return base.orderBy(*sort_keys(sort)).limit(n)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def buckets(base: DataFrame, signals: DataFrame, view: View, gate: int | None) -> DataFrame:
    """total = ranked + undated + older + tier_hidden, and what lies across them, in one pass (A-01, A.3)."""
    rows = filtered(base, signals, view.without("tiers", "dated", "min_started", "min_registered", "active"))
    c, off = F.col, F.lit(False)
    struck = c("struck") & F.lit(view.active)
    dated = c("first_seen").isNotNull()
    aged = F.coalesce(c("started") < gate, off) if gate else off
    registered = F.coalesce(c("registry_year") < gate, off) if gate else off
    chosen = c("tier").isin(*view.tiers) if view.tiers else F.lit(True)
    older = (dated & aged) | (~dated & registered)
    ranked = ~struck & dated & ~aged & chosen
    return rows.agg(
        count_if(~struck).alias("total"),
        count_if(~struck & ~dated & ~registered).alias("undated"),
        count_if(~struck & older).alias("older"),
        count_if(~struck & older & registered).alias("older_registry"),
        count_if(~struck & dated & ~aged & ~chosen).alias("tier_hidden"),
        count_if(ranked).alias("ranked"),
        count_if(ranked & c("started").isNull()).alias("unknown_age"),
        count_if(struck).alias("struck"),
    )


#: The filters that each facet leaves out besides tiers, dates and year gates.
FACETS = {
    "state": ("state",),
    "subsector": ("sector", "subsector"),
    "traces": ("traces",),
    "said": ("described",),
    "source": ("source",),
    "tag": ("build", "domain"),
    "programmes": ("programmes_at_least", "alone"),
}


def facets(base: DataFrame, signals: DataFrame, view: View) -> DataFrame:
    """(facet, value, n): each facet counts under all filters but its own (A-02 to A-06, T-01).

    One scan: a row gives the values of the facets whose other filters it passes, and one aggregation counts them.
    """
    plain = view.without("tiers", "dated", "min_started", "min_registered")
    sources = signals.groupBy(F.col("company_id").alias("id")).agg(F.collect_set("source").alias("sources"))
    traces = F.when(F.col("trace_count") <= 1, "1").when(F.col("trace_count") == 2, "2").otherwise("3+")
    none = F.array().cast("array<string>")
    values = {
        "state": F.array(F.coalesce("state", F.lit(""))),
        "subsector": F.array_compact(F.array("subsector_id")),
        "traces": F.array(traces),
        "said": F.array("said_state"),
        "source": F.coalesce("sources", none),
        "tag": tag_rows(),
        "programmes": F.array(F.least("programme_count", F.lit(3)).cast("string")),
    }

    def passes(v: View) -> Column:
        of_source = [F.coalesce(F.array_contains("sources", v.source), F.lit(False))] if v.source else []
        return reduce(and_, [*conditions(v), *of_source], F.lit(True))

    def counted(facet: str, own: tuple[str, ...]) -> Column:
        shown = F.transform(values[facet], lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("value")))
        return F.when(passes(plain.without(*own)), shown).otherwise(F.array().cast("array<struct<facet:string,value:string>>"))

    rows = base.join(sources, "id", "left").select(F.inline(F.concat(*[counted(k, own) for k, own in FACETS.items()])))
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def tag_rows() -> Column:
    none = F.array().cast("array<string>")
    return F.concat(prefixed("build", none), prefixed("domain", none))


def prefixed(kind: str, none: Column) -> Column:
    return F.transform(F.coalesce(F.col(f"{kind}_tags"), none), lambda t: F.concat(F.lit(f"{kind}:"), t))


def places(base: DataFrame) -> DataFrame:
    """(state, n, dated, districts): counts per state with its cities, the largest first (A-03, O-09)."""
    by_city = base.where("state is not null").groupBy("state", "city").agg(F.count("*").alias("n"), count_if(F.col("first_seen").isNotNull()).alias("dated"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("city").isNotNull(), F.struct((-F.col("n")).alias("k"), "city")))), lambda x: F.concat_ws(":", x["city"], -x["k"]))
    return by_city.groupBy("state").agg(F.sum("n").alias("n"), F.sum("dated").alias("dated"), F.array_join(listed, ",").alias("districts"))


def shares(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Each value's share of its facet in percent, one decimal (W-12, D-09)."""
    return counts.withColumn("pct", F.round(F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy(by)), 1))


def discovered_since(rows: DataFrame, day: str) -> DataFrame:
    """(id, discovered) of records first seen on a known day, on or after one (F-25); a bare year is no day."""
    seen = F.when(F.length("first_seen") == 10, F.col("first_seen")).try_cast("date")
    return rows.select("id", seen.alias("discovered")).where(F.col("discovered") >= F.lit(day).cast("date"))


def suggestions(rows: DataFrame, slug: str, words: int = 3, least: int = 2, n: int = 5) -> DataFrame:
    """The n shortest ids that hold one of the first words of an address that doesn't exist (F-24)."""
    asked = [w for w in slug.lower().split("-") if len(w) >= least][:words]
    if not asked:
        return rows.limit(0).select("id")
    held = [F.contains("id", F.lit(w)) for w in asked]
    return rows.select("id").where(F.greatest(*held) if len(held) > 1 else held[0]).orderBy(F.length("id"), "id").limit(n)
