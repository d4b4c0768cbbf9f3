"""The flagship query: one page of the default list, with its filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.views import View, merged_order, page
from lodestone.plans.proxies import Tables


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose text says "00" or "labs", listed by a source, in the default order; the first 100."""
    t = Tables(spark, folder)
    order = merged_order(t.base, t.signals, View(search="labs", source="sine-iitb"))
    return page(t.base, order, 1).select("pos", "id", "name", "trace_count", "tier", "first_seen", "said_state", "started")
