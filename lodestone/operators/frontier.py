"""Searching for many phrases in few requests: batches whose answer overflows are halved, round by round (S-19).

A search service answers a batch of phrases with the works that match any of them, a page at a time. A batch that doesn't
fit into one page can't be told apart by phrase, so it is asked again in halves, down to single phrases; a single phrase
is paged through, unless it matches too much to be a name. The frontier, the phrases that are still open with the batch
each is in, is a table that each round reads and writes; a batch of n phrases takes log2(n) + 1 rounds at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rounds import stored


@dataclass
class Resolved:
    needles: DataFrame  #: no, needle, lo, hi, total, outcome (ok or broad)
    requests: DataFrame  #: round, lo, hi, total, pages
    rounds: int


def numbered(needles: DataFrame) -> DataFrame:
    """(no, needle): distinct needles numbered from 0 in order, range by range, so that no task holds all."""
    dealt = stored(needles.select("needle").where("needle is not null").distinct().repartitionByRange("needle").sortWithinPartitions("needle").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part")).groupBy(F.col("a.part").alias("part")).agg(F.sum("b.n").alias("before"))
    out = dealt.withColumn("part", part).join(F.broadcast(before), "part", "left")
    return out.select((F.coalesce("before", F.lit(0)) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("no"), "needle")


def resolve(needles: DataFrame, matches: DataFrame, batch: int = 40, page: int = 100, most: int = 1000) -> Resolved:
    """The batch in which each needle (no, needle) is answered, and the requests that it takes.

    matches (no, work_id): what the service finds for each needle. A needle's answer is the works of its last batch (they
    are verified afterwards); one with over `most` works of its own is broad and has none. Needles without a match are
    asked for like any other.
    """
    def sized(frontier: DataFrame, number: int) -> DataFrame:
        totals = found.join(frontier, "no").groupBy("lo", "hi").agg(F.count_distinct("work_id").alias("n"))
        return stored(frontier.join(totals, ["lo", "hi"], "left").select("no", "needle", "lo", "hi", F.coalesce("n", F.lit(0)).alias("total"), F.lit(number).alias("round")))

    found = stored(matches.select("no", "work_id").distinct())
    n = needles.count()
    lo = F.col("no") - F.col("no") % batch
    frontier = needles.select("no", "needle", lo.cast("bigint").alias("lo"), F.least(lo + batch, F.lit(n)).cast("bigint").alias("hi"))
    rounds, over = [], (F.col("total") > page) & (F.col("hi") - F.col("lo") > 1)
    while True:
        now = sized(frontier, len(rounds) + 1)
        rounds.append(now)
        halved = now.where(over)
        if halved.isEmpty():
            break
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("bigint")
        left = F.col("no") < middle
        frontier = halved.select("no", "needle", F.when(left, F.col("lo")).otherwise(middle).alias("lo"), F.when(left, middle).otherwise(F.col("hi")).alias("hi"))
    asked = rounds[0]
    for more in rounds[1:]:
        asked = asked.union(more)
    outcome = F.when(F.col("total") > F.greatest(F.lit(page), F.lit(most)), "broad").otherwise("ok")
    pages = F.when((F.col("hi") - F.col("lo") == 1) & (F.col("total") <= most), F.greatest(F.ceil(F.col("total") / page), F.lit(1))).otherwise(1).cast("bigint")
    requests = asked.select("round", "lo", "hi", "total", pages.alias("pages")).distinct()
    return Resolved(asked.where(~over).select("no", "needle", "lo", "hi", "total", outcome.alias("outcome")), requests, len(rounds))


def nominations(resolved: Resolved, matches: DataFrame) -> DataFrame:
    """(no, needle, work_id): the works of the batch that answers each needle, to be verified one by one; none for broad needles."""
    ok = resolved.needles.where("outcome = 'ok'")
    works = ok.select("no", "lo", "hi").join(matches, "no").select("lo", "hi", "work_id").distinct()
    return ok.join(works, ["lo", "hi"]).select("no", "needle", "work_id")
