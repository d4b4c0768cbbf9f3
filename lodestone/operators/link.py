"""Record linkage: duplicates, awards, affiliations, shared hosts, near names, caches and budgets (J-13 to J-32, W-09, U-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.dates import days_since
from lodestone.operators.rounds import stored


def duplicates(rows: DataFrame) -> DataFrame:
    """(from, into): every id of a name key but the smallest, to the smallest (J-13). rows: id, key."""
    named = rows.where("key <> ''")
    first = named.groupBy("key").agg(F.min("id").alias("into"))
    return named.join(first, "key").where("id <> into").select(F.col("id").alias("from"), "into")


def closure(aliases: DataFrame) -> DataFrame:
    """(from, into): every alias followed to its end, however far (J-13). A cycle is an error.

    Each round doubles the steps, so n aliases need log2(n) rounds; what still moves after that goes round in a cycle.
    """
    now = stored(aliases.where("from <> into").select("from", "into").distinct())
    rounds = now.count().bit_length() + 1
    for _ in range(rounds):
        nxt = now.select(F.col("from").alias("into"), F.col("into").alias("far"))
        step = stored(now.join(nxt, "into", "left").select("from", F.coalesce("far", "into").alias("into"), F.col("far").isNotNull().alias("moved")))
        now = step.select("from", "into")
        if not step.where("moved").limit(1).count():
            return now
    raise ValueError("aliases form a cycle")


def follow(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """rows with a column's ids replaced by what they resolve to (J-14)."""
    a = aliases.select(F.col("from").alias(column), F.col("into").alias("__into"))
    return rows.join(a, column, "left").withColumn(column, F.coalesce("__into", column)).drop("__into")


def match_awards(awards: DataFrame, held: DataFrame) -> DataFrame:
    """(award_id, id, by): a match by number, else by name key, only to a single candidate (J-16, A.15).

    A number that is held never falls through to names; a name doesn't match a record that holds another number.
    awards: award_id, number, key; held: id, number, key.
    """
    numbers = held.where("number is not null").groupBy("number").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    numbered = awards.join(numbers, "number", "left")
    by_number = numbered.where("n = 1").select("award_id", "id", F.lit("number").alias("by"))
    rest = numbered.where("n is null").select("award_id", "number", "key")
    # per key and number, at most two ids tell one candidate from several
    per = held.groupBy("key", "number").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).withColumnRenamed("number", "own")
    names = rest.join(per, "key").where("number is null or own is null or own = number")
    by_name = names.groupBy("award_id").agg(F.sum("n").alias("n"), F.min("id").alias("id")).where("n = 1").select("award_id", "id", F.lit("name").alias("by"))
    return by_number.union(by_name)


def shared_hosts(rows: DataFrame) -> DataFrame:
    """(host, n): hosts that several records claim (J-20, A-29). rows: id, host."""
    return rows.where("host is not null").groupBy("host").agg(F.count_distinct("id").alias("n")).where("n > 1")


def contained_lists(members: DataFrame, least: int = 10) -> DataFrame:
    """(a, b): lists whose members all stand in another list, the larger or the earlier one (J-19). members: list, member.

    A list meets only those that hold its globally rarest member, so a member of very many lists makes no pairs.
    """
    own = members.distinct()
    size = own.groupBy("list").agg(F.count("*").alias("n"))
    spread = own.groupBy("member").agg(F.count("*").alias("lists"))
    rarest = own.join(spread, "member").groupBy("list").agg(F.min(F.struct("lists", "member")).alias("rare"), F.count("*").alias("na")).where(F.col("na") >= least)
    asked = rarest.select(F.col("list").alias("a"), "na", F.col("rare.member").alias("member"))
    other = own.join(size, "list").select(F.col("list").alias("b"), F.col("n").alias("nb"), "member")
    pairs = asked.join(other, "member").where((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))).select("a", "b", "na")
    # a list of b's size or less, each of whose members is b's as well
    held = pairs.join(own.select(F.col("list").alias("a"), "member"), "a").join(own.select(F.col("list").alias("b"), "member"), ["b", "member"])
    return held.groupBy("a", "b", "na").agg(F.count("*").alias("k")).where("k = na").select("a", "b")


def near_names(rows: DataFrame, query: str, n: int = 3) -> DataFrame:
    """The n names nearest to a search text (J-26, F-23, A.7). rows: id, name."""
    q = " ".join("".join(c if c.isalnum() else " " for c in query.lower()).split())
    if len(q) < 3:
        return rows.limit(0).select("id", "name", F.lit(0).alias("distance"))
    words = F.filter(F.split(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    held = rows.withColumn("words", words).where(F.exists("words", lambda w: F.startswith(w, F.lit(q[:2]))))
    opening = F.array_join(F.slice("words", 1, len(q.split())), " ")
    distance = F.least(F.levenshtein(F.lit(q), opening), F.array_min(F.transform("words", lambda w: F.levenshtein(F.lit(q), w))))
    return held.select("id", "name", distance.alias("distance")).where(F.col("distance") <= max(2, len(q) // 4)).orderBy("distance", F.length("name"), "id").limit(n)


def affiliations(needles: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, part_id): needles that stand in an affiliation as whole words (J-18, A.16, E-09).

    Needles and parts meet on the needle's word that the fewest parts have, so the join is on a key and a word such as
    "the" joins nothing; the containment is checked after it. needles: id, needle; parts: part_id, text; both of words
    joined by one space.
    """
    own = needles.select("id", "needle", F.explode(F.array_distinct(F.split("needle", " "))).alias("word"))
    # (part, word) of words that a needle has: no text is joined until the parts of a needle are known
    words = parts.select("part_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).join(own.select("word").distinct(), "word", "left_semi")
    words = stored(words.distinct())
    spread = words.groupBy("word").agg(F.count("*").alias("n"))
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)), "word"))
    keyed = own.join(spread, "word", "left").groupBy("id", "needle").agg(rare.alias("rare")).select("id", "needle", F.col("rare.word").alias("word"))
    near = words.join(keyed, "word").groupBy("part_id").agg(F.collect_set(F.struct("id", "needle")).alias("asked"))
    text = F.concat(F.lit(" "), "text", F.lit(" "))
    held = F.filter("asked", lambda a: F.contains(text, F.concat(F.lit(" "), a["needle"], F.lit(" "))))
    found = parts.join(near.hint("shuffle_merge"), "part_id").select("part_id", F.explode(held).alias("a")).select("a.id", "part_id")
    return found.select("id", "part_id").distinct()


def cache_probe(rows: DataFrame, cache: DataFrame, overrides: DataFrame) -> DataFrame:
    """(id, answer, origin): an override, else the cached answer of id and hash, else of the hash, else todo (J-15, J-30, R-17)."""
    exact = cache.select("id", "hash", F.col("answer").alias("exact"))
    anywhere = cache.groupBy("hash").agg(F.min(F.struct("id", "answer")).alias("f")).select("hash", F.col("f.answer").alias("same"))
    j = rows.join(overrides.select("id", F.col("answer").alias("hand")), "id", "left").join(exact, ["id", "hash"], "left").join(anywhere, "hash", "left")
    origin = F.when(F.col("hand").isNotNull(), "override").when(F.col("exact").isNotNull(), "cache").when(F.col("same").isNotNull(), "hash").otherwise("todo")
    return j.select("id", F.coalesce("hand", "exact", "same").alias("answer"), origin.alias("origin"))


def fan_out(rows: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """A cached answer for all records that share its key (J-17)."""
    return rows.join(answers, key, "left")


def running(rows: DataFrame, value, order: list, group: list[str], name: str) -> DataFrame:
    """rows with the sum of a value over the rows of their group up to them, in an order that tells rows apart.

    Rows are dealt by ranges of group and order, summed range by range, and each range starts from what the ranges before
    it have: no task holds a whole group, however few groups there are.
    """
    dealt = stored(rows.withColumn("__value", value).repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    per_part = dealt.groupBy("__part", *group).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # null is a group as well
    before = per_part.withColumn("__before", F.sum("__sum").over(earlier)).select("__part", "__before", F.struct(F.lit(0), *group).alias("__group"))
    here = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("__here", F.sum("__value").over(here)).withColumn("__group", F.struct(F.lit(0), *group))
    both = summed.alias("s").join(before.alias("b"), (F.col("s.__part") == F.col("b.__part")) & F.col("s.__group").eqNullSafe(F.col("b.__group")))
    kind = rows.select(F.sum(value)).schema[0].dataType
    return both.select(*[F.col(f"s.{c}") for c in rows.columns], (F.col("__here") + F.coalesce("__before", F.lit(0))).cast(kind).alias(name))


def admit(rows: DataFrame, cost: str, order: list, ceiling: float, group: str | None = None) -> DataFrame:
    """rows with `spent`, the cost of the rows up to each, and `admitted`: it stays within the ceiling (W-09, E-14).

    With a group, each has a budget of its own.
    """
    return running(rows, F.col(cost), order, [group] if group else [], "spent").withColumn("admitted", F.col("spent") <= ceiling)


def needs_asking(entry_at: Column, outcome: Column, now: Column, days: int = 30) -> Column:
    """Whether a cached answer is asked for again: never after a hit, after some days if empty, always after a failure (U-16, A.19)."""
    return F.when(outcome.isNull() | (outcome == "failed"), True).when(outcome == "hit", False).otherwise(days_since(entry_at, now) > days)


def rate_limited(log: DataFrame, now: Column, most: int) -> DataFrame:
    """(who, n, limited) over the last hour (F-26)."""
    recent = log.where((F.col("at") > now - F.expr("interval 1 hour")) & (F.col("at") <= now))
    return recent.groupBy("who").agg(F.count("*").alias("n")).withColumn("limited", F.col("n") >= most)
