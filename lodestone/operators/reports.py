"""Whole-table reports: coverage, gaps, findings, sources, places, outcomes (A-07 to A-36, J-05 to J-11, J-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.said import label_kind
from lodestone.operators.views import SAID, count_if

NO_GAP, OUTSIDE = "no gap named", "outside this taxonomy"
REGISTER = "dpiit-startup-india"


def with_signals(companies: DataFrame, signals: DataFrame) -> DataFrame:
    """Each row with its signals as an array, empty for none (P-01, J-05, N-01)."""
    lists = signals.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("type", "label", "date", "source"))).alias("signals"))
    kind = lists.schema["signals"].dataType.simpleString()
    return companies.join(lists.withColumnRenamed("company_id", "id"), "id", "left").withColumn("signals", F.coalesce("signals", F.array().cast(kind)))


def overlaid(rows: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Hand-made values over a row's own (P-10)."""
    own = overrides.select("id", *[F.col(c).alias(f"o_{c}") for c in columns])
    return rows.join(own, "id", "left").withColumns({c: F.coalesce(f"o_{c}", c) for c in columns}).drop(*[f"o_{c}" for c in columns])


def coverage(dim: DataFrame, companies: DataFrame) -> DataFrame:
    """(subsector_id, n) for every sub-sector of the dimension, zeros included (A-07, J-25)."""
    counts = companies.where("subsector_id is not null").groupBy("subsector_id").agg(F.count("*").alias("n"))
    return dim.join(counts, "subsector_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def coverage_totals(dim: DataFrame, companies: DataFrame) -> DataFrame:
    """cells, covered, off_map, unclassified and total (A-07)."""
    cells = coverage(dim, companies).agg(F.count("*").alias("cells"), count_if(F.col("n") > 0).alias("covered"), F.sum("n").alias("on_map"))
    rows = companies.agg(F.count("*").alias("total"), count_if(F.col("subsector_id").isNull()).alias("unclassified"))
    return cells.crossJoin(rows).select("cells", "covered", (F.col("total") - F.col("on_map") - F.col("unclassified")).alias("off_map"), "unclassified", "total")


def gaps_grouped(gaps: DataFrame, examples: int = 3) -> DataFrame:
    """(missing, n, examples): the names kept are the first in order (A-08, O-10). The example list is cut before it is gathered."""
    ranked = gaps.withColumn("k", F.row_number().over(Window.partitionBy("missing").orderBy("name", "company_id"))).where(F.col("k") <= examples)
    names = ranked.groupBy("missing").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("examples"))
    return gaps.groupBy("missing").agg(F.count("*").alias("n")).join(names, "missing", "left").select("missing", "n", "examples")


def gap_split(gaps: DataFrame) -> DataFrame:
    """(part, n): gaps in the taxonomy and those that name none (A.8)."""
    return gaps.groupBy(F.when(F.col("missing") == NO_GAP, "undescribed").otherwise("taxonomy").alias("part")).agg(F.count("*").alias("n"))


def holes(gaps: DataFrame, n: int = 3) -> DataFrame:
    """The commonest missing topics (O-11)."""
    named = gaps.where(~F.col("missing").isin(NO_GAP, OUTSIDE))
    return named.groupBy("missing").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "missing").limit(n)


def product_outcomes(companies: DataFrame) -> DataFrame:
    """Outcomes of reading websites, in one pass (A-09)."""
    c = F.col
    site = F.coalesce("website", F.lit("")) != ""
    own = F.coalesce("product", F.lit("")) != ""
    return companies.agg(
        count_if(site).alias("with_site"),
        count_if(~site & c("website_checked")).alias("looked_none"),
        count_if(~site & ~c("website_checked")).alias("not_looked"),
        count_if(own).alias("read"),
        count_if(site & ~own).alias("unread"),
        *[count_if(c("website_identity") == s).alias(s) for s in ("verified", "associated", "discovered")],
    )


def register_outcomes(companies: DataFrame, signals: DataFrame, gaps: DataFrame) -> DataFrame:
    """Records of the register: placed, not placed, and placed by a label (A-10)."""
    placed = signals.where(F.col("source") == REGISTER).agg(F.count_distinct("company_id").alias("placed"))
    rest = gaps.agg(count_if(F.col("source") == REGISTER).alias("unplaced"))
    label = companies.agg(count_if(F.col("classify_basis") == "register-label").alias("by_label"))
    return placed.crossJoin(rest).crossJoin(label)


def source_health(runs: DataFrame) -> DataFrame:
    """Per source the latest run and the latest good one (A-11, J-11, W-01)."""
    key = F.struct("started_at", "id")
    ok = F.col("status") == "ok"
    return runs.groupBy("source").agg(
        F.max_by("status", key).alias("last_status"),
        F.max_by("records", key).alias("last_records"),
        F.max("started_at").alias("last_at"),
        F.max_by("records", F.when(ok, key)).alias("good_records"),
        F.max(F.when(ok, F.col("started_at"))).alias("good_at"),
    )


def verdicts(runs: DataFrame, keep: float = 0.5) -> DataFrame:
    """Each run's verdict against the good run before it (W-11, A.10, U-19)."""
    good = F.when(F.col("status") == "ok", F.col("records"))
    before = F.last(good, ignorenulls=True).over(Window.partitionBy("source").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.withColumn("previous", before)
    poor = (F.col("records") == 0) | F.coalesce((F.col("previous") > 0) & (F.col("records") < keep * F.col("previous")), F.lit(False))
    return rows.withColumn("verdict", F.when(F.col("status") == "failed", "failed").when(poor, "quarantined").otherwise("ok"))


def places_summary(companies: DataFrame, signals: DataFrame) -> DataFrame:
    """Located records, those located by the register, and those ranked (A-13)."""
    register = signals.where(F.col("source") == REGISTER).select(F.col("company_id").alias("id"), F.lit(True).alias("reg")).distinct()
    located = F.col("state").isNotNull()
    return companies.join(register, "id", "left").agg(count_if(located).alias("located"), count_if(located & F.col("reg")).alias("from_register"), count_if(located & F.col("first_seen").isNotNull()).alias("ranked_located"), F.count("*").alias("total"))


def records_per_source(signals: DataFrame) -> DataFrame:
    """(source, n) distinct records (A-04, A-14, J-07)."""
    return signals.groupBy("source").agg(F.count_distinct("company_id").alias("n"))


def substance(companies: DataFrame) -> DataFrame:
    """Companies and others, said and unsaid, quiet ones (A-15)."""
    said = F.col("said_state").isin(*SAID)
    return companies.agg(count_if(F.col("is_company")).alias("company"), count_if(~F.col("is_company")).alias("other"), count_if(~said).alias("unsaid"), count_if(said & (F.col("trace_count") <= 1)).alias("quiet"), F.count("*").alias("total"))


def findings(companies: DataFrame, gaps: DataFrame, signals: DataFrame) -> DataFrame:
    """The findings in one row (A-16, A.9, J-09, R-03)."""
    facts = signals.groupBy("company_id").agg(F.max(F.col("source") == REGISTER).alias("on_register"), count_if(F.col("type") != "website").alias("outside"), count_if(F.col("type").isin("website", "press")).alias("others"))
    c = F.col
    rows = companies.join(facts.withColumnRenamed("company_id", "id"), "id", "left")
    said = c("said_state").isin(*SAID)
    lead = c("is_company") & said
    gap_said = (F.coalesce("description", F.lit("")) != "") & label_kind(c("description")).isNull()
    reg = c("source") == REGISTER
    a = rows.agg(
        count_if(c("on_register")).alias("r1"), count_if(c("on_register") & said).alias("r2"), count_if(said).alias("d1"),
        count_if(c("dpiit_status").isNotNull()).alias("recognition_known"), count_if(c("dpiit_status") == "profile").alias("recognition_profile"),
        count_if(lead & (c("outside") == 1)).alias("noticed_once"),
        count_if(lead & (c("programme_count") >= 2)).alias("two_plus"), count_if(lead & (c("programme_count") >= 3)).alias("three_plus"),
        count_if(lead & (c("programme_count") >= 2) & (F.coalesce("others", F.lit(0)) == 0)).alias("alone"),
    )
    b = gaps.agg(count_if(reg).alias("g1"), count_if(reg & gap_said).alias("g2"), count_if(gap_said).alias("g3"), count_if(gap_said & (c("missing") != NO_GAP)).alias("unmapped"))
    return a.crossJoin(b).select((c("r1") + c("g1")).alias("register_total"), (c("r2") + c("g2")).alias("register_described"), (c("d1") + c("g3")).alias("described_total"), "unmapped", "recognition_known", "recognition_profile", "noticed_once", "two_plus", "three_plus", "alone")


def view_summary(rows: DataFrame) -> DataFrame:
    """total, from_label, described (A-17)."""
    return rows.agg(F.count("*").alias("total"), count_if(F.col("classify_basis") == "register-label").alias("from_label"), count_if(F.col("said_state").isin(*SAID)).alias("described"))


def enrichment_summary(companies: DataFrame, enrichment: DataFrame) -> DataFrame:
    """What the register says about known records (A-19, J-10)."""
    c = F.col
    return enrichment.join(companies.select("id", "founded_year"), "id").agg(
        F.count("*").alias("checked"), F.count("incorporated_year").alias("with_year"), F.count("reg_status").alias("with_status"),
        count_if(c("reg_status") == "Strike Off").alias("struck"), count_if(c("incorporated_year") < c("founded_year")).alias("older_than_said"), F.min("incorporated_year").alias("oldest"),
    )


def trace_shape(signals: DataFrame, order: list[str]) -> DataFrame:
    """(company_id, shape): counts per type in a fixed order as an English list (A-25)."""
    counts = signals.groupBy("company_id", "type").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("type"))
    listed = counts.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.concat_ws(" ", "n", "type").alias("t")))), lambda x: x["t"]).alias("a"))
    return listed.select("company_id", english_list(F.col("a")).alias("shape"))


def english_list(items: Column) -> Column:
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def papers_newest(works: DataFrame, n: int = 3) -> DataFrame:
    """(company_id, count, works): one work per title, posters only where nothing else has the title; the newest titles (A-26, W-08)."""
    title = Window.partitionBy("company_id", "title_key")
    newest = works.withColumn("newest", F.max("published").over(title)).withColumn("k", F.row_number().over(title.orderBy("poster", F.desc("published"), "work_id"))).where("k = 1")
    placed = newest.withColumn("r", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("newest"), "work_id")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= n, F.struct("r", "work_id")))), lambda x: x["work_id"].cast("string")), ",")
    return placed.groupBy("company_id").agg(F.count("*").alias("n"), top.alias("works"))


def largest_per(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """(group, value, n): the n commonest values of each group (O-13)."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("k") <= n).select(group, value, "n")


def preview(rows: DataFrame) -> DataFrame:
    """What each source's rows lack (A-34)."""
    def missing(c: str) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    return rows.groupBy("source").agg(F.count("*").alias("n"), count_if(missing("website")).alias("no_site"), count_if(missing("description")).alias("no_text"), count_if(F.col("founded_year").isNull() & F.col("origin_year").isNull()).alias("no_year"))


def costs(log: DataFrame, by: str, prices: dict[str, float]) -> DataFrame:
    """(by, cost, calls): usage columns times their prices (A-35, D-10)."""
    cost = sum((F.col(c) * p for c, p in prices.items()), F.lit(0.0))
    return log.groupBy(by).agg(F.round(F.sum(cost), 6).alias("cost"), F.count("*").alias("calls"))


def metered(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """df and an observation of its rows, read after an action (A-33)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def counts(rows: DataFrame, since: str, few: int = 10) -> DataFrame:
    """One row: records with one trace at most, those that are no company, those discovered since a day, and whether the
    upper tier has enough to be shown ranked (A-18)."""
    seen = F.when(F.length("first_seen") == 10, F.col("first_seen")).try_cast("date")
    return rows.agg(
        F.count_if(F.col("trace_count") <= 1).alias("one_trace"),
        F.count_if(~F.col("is_company")).alias("not_companies"),
        F.count_if(F.coalesce(seen >= F.lit(since).cast("date"), F.lit(False))).alias("discovered"),
        (F.count_if(F.col("tier") == "A") >= few).alias("has_ranked"),
    )


def spend_by_day(log: DataFrame, at: str, cost: str) -> DataFrame:
    """(day, questions, spent): the questions of each day, in UTC, and what they cost (A-23, D-10)."""
    return log.groupBy(F.to_date(at).cast("string").alias("day")).agg(F.count("*").alias("questions"), F.round(F.sum(cost), 2).alias("spent"))
