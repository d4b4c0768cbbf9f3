"""A cache of pages that asks conditionally, as one merge a run (S-01), and the versions that an archive has of a page (S-18).

A page is an address and the digest of the request's body: two queries to one address are two pages. An entry is fresh for
some days. A stale one is asked for with the ETag and date of its last answer; the answer 304 keeps the page and moves
the date it was checked, any 2xx replaces it, and any other leaves the entry as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.readers import fresh

KEY = ["url", "body_hash"]
HELD = ["fetched_at", "response", "etag", "last_modified", "version"]


def keyed(requests: DataFrame) -> DataFrame:
    """requests (url, body) with body_hash; no body and an empty one are the same."""
    return requests.withColumn("body_hash", F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256))


def to_ask(requests: DataFrame, cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(url, body_hash, if_none_match, if_modified_since): requests (url, body_hash) without a fresh entry, with what to ask them by."""
    held = cache.select(*KEY, "fetched_at", "response", "etag", "last_modified")
    stale = requests.select(*KEY).distinct().join(held, KEY, "left").where(~F.coalesce(fresh(F.col("fetched_at"), now, days), F.lit(False)))
    known = F.col("response").isNotNull()
    return stale.select(*KEY, F.when(known, F.col("etag")).alias("if_none_match"), F.when(known, F.col("last_modified")).alias("if_modified_since"))


def merged(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache after some answers (url, body_hash, code, response, etag, last_modified, at).

    Of several answers for a page the latest counts, of equally late ones the one with the greater code. version counts
    the bodies that a page has had, so a fresh fetch of the same bytes is no new one. A 304 without an entry is no page.
    """
    last = answers.groupBy(*KEY).agg(F.max(F.struct("at", "code", "response", "etag", "last_modified")).alias("a"))
    both = cache.withColumn("held", F.struct(*HELD)).select(*KEY, "held").join(last, KEY, "full")
    ok, same = F.coalesce(F.col("a.code").between(200, 299), F.lit(False)), F.coalesce(F.col("a.code") == 304, F.lit(False)) & F.col("held").isNotNull()
    new = F.when(F.col("held.response").eqNullSafe(F.col("a.response")), F.col("held.version")).otherwise(F.coalesce("held.version", F.lit(0)) + 1)
    out = {
        "fetched_at": F.when(ok | same, F.col("a.at")).otherwise(F.col("held.fetched_at")),
        "version": F.when(ok, new).otherwise(F.col("held.version")).cast("bigint"),
        **{c: F.when(ok, F.col(f"a.{c}")).otherwise(F.col(f"held.{c}")) for c in ("response", "etag", "last_modified")},
    }
    return both.where(ok | F.col("held").isNotNull()).select(*KEY, *[out[c].alias(c) for c in HELD])


def served(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(url, body_hash, response, fetched_at): what the cache gives for requests; its least fetched_at says how old a source is (A-27)."""
    return requests.select(*KEY).distinct().join(cache.select(*KEY, "response", "fetched_at"), KEY)


def versions(captures: DataFrame, now: Column, years: int = 2) -> DataFrame:
    """(url, first_capture, captures, versions): of an archive's captures (url, at, digest, status), by address.

    first_capture is the first of all good ones; captures and versions (distinct digests) are of the last `years` years,
    both ends included.
    """
    good = captures.where(F.col("status").between(200, 299) & F.col("at").isNotNull())
    recent = (F.col("at") <= now) & (F.col("at") >= F.add_months(F.to_date(now), -12 * years))
    return good.groupBy("url").agg(F.min("at").alias("first_capture"), F.count_if(recent).alias("captures"), F.count_distinct(F.when(recent, F.col("digest"))).alias("versions"))
