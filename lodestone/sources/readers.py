"""Readers of listings: CSV, JSON pages, binary files and tables (S-01 to S-24)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import slug
from lodestone.operators.merge import first_per

GRANTS = "company_name string, scheme string, award_date string, project_summary string, url string, website string, city string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder (S-24)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def grants(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(companies, signals) of a grants file with a header: the first row of an id owns it, one signal per scheme (S-07).

    A row that doesn't fit the schema is an error.
    """
    rows = spark.read.csv(path, header=True, schema=GRANTS, mode="FAILFAST", enforceSchema=False).withColumn("pos", F.monotonically_increasing_id()).withColumn("id", slug(F.col("company_name")))
    companies = first_per(rows, ["id"], ["pos"]).select("id", F.col("company_name").alias("name"), F.col("project_summary").alias("description"), "website", "city")
    signals = first_per(rows, ["id", "scheme"], ["pos"]).select(F.col("id").alias("company_id"), F.lit("grant").alias("type"), F.col("scheme").alias("label"), F.col("award_date").alias("date"), "url", F.lit("grants-csv").alias("source"))
    return companies, signals


def data_as_of(dates: Column) -> Column:
    """The latest full date (S-07, A-27)."""
    return F.max(F.when(F.length(dates) == 10, dates))


def paged_json(spark: SparkSession, path: str, schema: str, id_col: str) -> DataFrame:
    """Records of JSON pages, the first of each id by file and place (S-08, S-10, S-11)."""
    rows = spark.read.schema(schema).json(path).withColumn("file", F.input_file_name()).withColumn("pos", F.monotonically_increasing_id())
    return first_per(rows, [id_col], ["file", "pos"]).drop("file", "pos")


def last_pages(pages: DataFrame, n: int) -> DataFrame:
    """The last n pages of each industry (S-08): a register's newest entries. pages: industry, page (from 0), total."""
    return pages.where((F.col("page") >= F.greatest(F.col("total") - n, F.lit(0))) & (F.col("page") < F.col("total")))


def until_short(pages: DataFrame, size: int) -> DataFrame:
    """The records of a listing's pages up to the first short one, or the one that reaches the total it gives (S-11).

    pages: listing, page (from 1), total (or null), records (an array). Out come listing, page, place and record.
    """
    over = Window.partitionBy("listing").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    short = (F.size("records") < size) | F.coalesce(F.sum(F.size("records")).over(over.rowsBetween(Window.unboundedPreceding, 0)) >= F.col("all"), F.lit(False))
    known = pages.withColumn("all", F.first("total", ignorenulls=True).over(Window.partitionBy("listing").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ended = known.withColumn("ends", short).withColumn("ended", F.coalesce(F.max("ends").over(over), F.lit(False)))
    return ended.where("not ended").select("listing", "page", F.posexplode("records").alias("place", "record"))


def blanks_filled(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row of each key, the first, whose blanks among some columns are filled from later rows that have a value (S-11)."""
    first, rest = F.struct(*order), [c for c in rows.columns if c not in (key, *columns)]
    filled = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", first)).alias(c) for c in columns]
    return rows.groupBy(key).agg(*filled, *[F.min_by(c, first).alias(c) for c in rest]).select(*rows.columns)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their paths and times (S-04)."""
    return spark.read.format("binaryFile").load(path)


def embedded_json(html: Column, schema: str) -> Column:
    """The record that a page carries in its __NEXT_DATA__ script, null if it is malformed (S-12)."""
    return F.from_json(F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), schema)


def fetch_outcome(code: Column) -> Column:
    """ok, refused or unreachable (S-02)."""
    return F.when(code.between(200, 299), "ok").when(code.isin(401, 403, 405, 406, 429), "refused").otherwise("unreachable")


def fresh(fetched_at: Column, now: Column, days: int = 30) -> Column:
    """Whether a cached page still counts (S-01)."""
    return fetched_at >= now - F.make_interval(days=F.lit(days))


def registered_on(events: Column) -> Column:
    """The registration date in a domain register's answer (S-17)."""
    dates = F.filter(events, lambda e: e["eventAction"] == "registration")
    return F.substring(F.get(dates, F.lit(0))["eventDate"], 1, 10).try_cast("date")


def first_capture(rows: Column) -> Column:
    """The first date in an archive's answer, an array of rows under a header (S-18)."""
    stamps = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.get(r, F.lit(0)))
    first = F.array_min(F.filter(stamps, lambda s: s.rlike(r"^\d{14}$")))
    return F.when(first.isNotNull(), F.concat_ws("-", F.substring(first, 1, 4), F.substring(first, 5, 2), F.substring(first, 7, 2)).try_cast("date"))


def isolated(sources: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables of the sources that work, and why the others don't (S-23)."""
    found, failed = {}, {}
    for name, read in sources.items():
        try:
            found[name] = read()
        except Exception as e:  # a failing source must not stop the others; the reason is reported
            failed[name] = f"{type(e).__name__}: {e}"
    return found, failed
