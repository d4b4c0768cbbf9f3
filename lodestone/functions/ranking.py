"""Trace counts and tiers (U-10, U-11, A-20, A-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.dates import day_of, days_since, earliest_event

# The signal types that count as public traces.
TRACE_TYPES = ("website", "press", "grant", "incubator", "dpiit", "award")


def tier(first_seen: Column, basis: Column, classify_basis: Column, traces: Column, event: Column, now: Column) -> Column:
    """A, B or C by recency and number of traces (A.1)."""
    age = days_since(day_of(first_seen, False), now)
    fresh_event = event.isNull() | (days_since(event, now) < 90)
    found = F.coalesce(basis == "discovered", F.lit(False)) & (age < 90) & (traces <= 2) & fresh_event
    return F.when(first_seen.isNull() | (F.coalesce(classify_basis, F.lit("")) == "register-label"), "C").when(found, "A").when((age < 180) & (traces <= 5), "B").otherwise("C")


def signal_facts(signals: DataFrame) -> DataFrame:
    """Per company: trace_count, outside_count, other_count, dates and the sources, in one keyed aggregation."""
    return signals.groupBy("company_id").agg(
        F.count_if(F.col("type").isin(*TRACE_TYPES)).alias("trace_count"),
        F.count_if(F.col("type") != "website").alias("outside_count"),
        F.count_if(F.col("type").isin("website", "press")).alias("other_count"),
        F.array_sort(F.collect_set("date")).alias("dates"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def ranked(companies: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """companies with trace_count, outside_count, other_count and tier recomputed from their signals."""
    names = ("trace_count", "outside_count", "other_count")
    base = companies.drop(*names, "tier").join(signal_facts(signals).withColumnRenamed("company_id", "id"), "id", "left")
    base = base.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in names})
    event = earliest_event(F.col("dates"), F.col("origin_year"))
    return base.withColumn("tier", tier(F.col("first_seen"), F.col("first_seen_basis"), F.col("classify_basis"), F.col("trace_count"), event, now)).drop("dates", "sources")
