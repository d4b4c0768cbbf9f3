"""Steps of a nightly run around the merge: eligibility, guards, sweeps, queues, placements and sinks.

K-01, K-03, K-09, P-14, F-27, F-28, J-22, J-28 to J-32, W-05, O-14, O-15, T-02 to T-07, X-17, X-20, U-15, U-17, E-13, E-16, E-19 to E-23.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.entity import RECOGNISED, label_supports, register_labels
from lodestone.functions.text import name_key
from lodestone.operators.link import running
from lodestone.operators.merge import first_per
from lodestone.operators.reports import NO_GAP
from lodestone.operators.rounds import stored


def eligible(rows: DataFrame, chosen: DataFrame, held_sources: list[str]) -> DataFrame:
    """Described records with a site, unless their source is held back; hand-chosen ids come in anyway (F-27)."""
    picked = rows.join(chosen.select("id", F.lit(True).alias("picked")).distinct(), "id", "left")
    fit = (F.coalesce("description", F.lit("")) != "") & (F.coalesce("website", F.lit("")) != "") & ~F.col("source").isin(*held_sources)
    return picked.where(F.coalesce("picked", F.lit(False)) | fit).drop("picked")


def complete(rows: DataFrame, most: int) -> DataFrame:
    """rows, or an error if there are as many as the read was capped at: a capped read isn't trusted (F-28)."""
    if rows.limit(most).count() >= most:
        raise ValueError(f"the read hit its cap of {most} rows")
    return rows


def union_by_id(*reads: DataFrame) -> DataFrame:
    """Several reads of one table, each id once (T-07, T-02)."""
    return reduce(DataFrame.unionByName, reads).dropDuplicates(["id"])


def ordered_union(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the first list, then of the second whose key is new (T-05)."""
    both = first.withColumn("__list", F.lit(0)).unionByName(second.withColumn("__list", F.lit(1)))
    return first_per(both, [key], ["__list", order]).drop("__list")


def stale_labels(rows: DataFrame, sent: DataFrame) -> DataFrame:
    """Gaps for stored label-only placements that the run didn't send and their labels don't support (J-22, U-18)."""
    left = rows.join(sent.select("id"), "id", "left_anti").where("classify_basis = 'register-label'")
    labelled = left.where(F.size(register_labels(F.col("description"))) > 0)
    wrong = labelled.where(~F.coalesce(label_supports(F.col("description"), F.col("subsector_id")), F.lit(False)))
    return wrong.select(F.col("id").alias("company_id"), "name", "description", "sector_id", F.lit(NO_GAP).alias("missing"))


def held_numbers(signals: DataFrame) -> DataFrame:
    """(company_id, number): the register number in a signal's label, the last one of each company (J-32)."""
    number = F.regexp_extract("label", r"\((DIPP\d+)\)", 1)
    return signals.where(number != "").groupBy("company_id").agg(F.max_by(number, F.struct("found_at", "label")).alias("number"))


def with_city(finalists: DataFrame, winners: DataFrame) -> DataFrame:
    """Finalists' cities from a list with cities, by name key, the first listed (J-29). Both: key; winners: city, pos."""
    cities = winners.where("city is not null").groupBy("key").agg(F.min_by("city", "pos").alias("found"))
    return finalists.join(cities, "key", "left").withColumn("city", F.coalesce("city", "found")).drop("found")


def missing_awardees(lists: DataFrame, typed: DataFrame) -> DataFrame:
    """(round, missing, with_suffix): awardees of lists that a hand-typed file lacks in its rounds (J-31). Both: round, slug; lists: name."""
    keyed = lists.withColumn("key", name_key(F.col("slug")))
    known = typed.select("round", name_key(F.col("slug")).alias("key")).distinct()
    lacking = keyed.join(typed.select("round").distinct(), "round", "left_semi").join(known, ["round", "key"], "left_anti")
    suffixed = F.col("name").rlike(r"(?i)\b(?:pvt|private|ltd|limited|llp)\b")
    return lacking.groupBy("round").agg(F.count_distinct("key").alias("missing"), F.count_distinct(F.when(suffixed, F.col("key"))).alias("with_suffix"))


def one_signal_per_hub(events: DataFrame) -> DataFrame:
    """The dated record where there is one, then the earliest, then the first listed, per company and hub (W-05)."""
    return first_per(events, ["company_id", "hub"], [F.col("date").isNull(), "date", "pos"])


def lookup_queue(domains: DataFrame, cache: DataFrame) -> DataFrame:
    """Domains to ask for: never asked first, then failed ones, then stale ones (O-14)."""
    asked = domains.join(cache.select("domain", "outcome", "asked_at"), "domain", "left")
    return asked.withColumn("turn", F.when(F.col("outcome").isNull(), 0).when(F.col("outcome") == "failed", 1).otherwise(2)).orderBy("turn", F.asc_nulls_first("asked_at"), "domain")


def by_priority(rows: DataFrame, sources: list[str]) -> DataFrame:
    """Rows by their source's place in a list, then by arrival (O-15)."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    return rows.orderBy(F.when(place == 0, len(sources) + 1).otherwise(place), "seq")


def slices(companies: DataFrame, size: int = 50) -> DataFrame:
    """companies with their upload slice per source, in the order of ids; signals join it by company (K-01, T-06)."""
    numbered = running(companies, F.lit(1).cast("bigint"), ["id"], ["source"], "__n")
    return numbered.withColumn("slice", F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")


def append_runs(runs: DataFrame, path: str) -> None:
    """Add run rows to the log (K-03)."""
    runs.write.mode("append").parquet(path)


def replace_known(old: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """old with rows replaced by new ones of the same id, of known ids only (K-09, J-28)."""
    fresh = new.join(known.select("id"), "id", "left_semi")
    return old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def setting(table: DataFrame, key: str, default: str) -> DataFrame:
    """One row with a key's value or a default (P-14)."""
    return table.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("value"))


def trace_name(kind: Column, label: Column, source_name: Column, status: Column) -> Column:
    """What a signal is called in a trail (X-17)."""
    text = F.trim(F.coalesce(label, F.lit("")))
    scheme = F.regexp_replace(F.regexp_replace(text, "(?i)^SINE IIT Bombay\\s+", ""), "(?i)^seed investment,\\s*", "")
    scheme = F.trim(F.regexp_replace(F.regexp_replace(scheme, "(?i),\\s*Cohort.*$", ""), r"\s+\d+(?:\.\d+)?$", ""))
    scheme = F.regexp_replace(scheme, r"\bNIDHI-PRAYAS\b", "NIDHI PRAYAS")
    head = F.substring_index(text, ",", 1)
    portfolio = F.coalesce(source_name, F.regexp_replace(head, r"(?i)\s+(?:incubatee|startup|portfolio company)s?$", ""))
    return (
        F.when(kind == "incubator", F.concat(portfolio, F.lit(" portfolio")))
        .when(kind == "grant", F.when(scheme == "", "a grant").otherwise(scheme))
        .when(kind == "dpiit", F.when(status.isin(*RECOGNISED), "DPIIT recognition").otherwise("Startup India profile"))
        .when(kind == "award", F.when(head == "", "an award").otherwise(head))
        .when(kind == "press", "press mention")
        .when(kind == "website", "own website")
    )


def short_date(text: Column, day: bool = True) -> Column:
    """25 Aug 2023, Aug 2023 or 2023, as precise as the date is (D-07)."""
    date = F.substring(text, 1, 10).try_cast("date")
    return F.when(F.length(text) >= 10, F.date_format(date, "d MMM yyyy" if day else "MMM yyyy")).otherwise(F.substring(text, 1, 4))


def canonical_query(args: dict[str, str], known: tuple[str, ...], most: int = 200) -> str:
    """Known arguments, trimmed, cut and sorted, as a query string: equal views have equal keys (X-20, R-14)."""
    kept = {k: v.strip()[:most] for k, v in args.items() if k in known and v and v.strip()}
    return urlencode(sorted(kept.items()))


def canonical(args: Column, known: tuple[str, ...], most: int = 200) -> Column:
    """canonical_query of a map column."""
    kept = F.filter(F.map_entries(args), lambda e: e["key"].isin(*known) & (F.trim(F.coalesce(e["value"], F.lit(""))) != ""))
    pairs = F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), F.url_encode(F.substring(F.trim(e["value"]), 1, most)))))
    return F.array_join(pairs, "&")


def reserved(log: DataFrame, cost: float, cap: float) -> DataFrame:
    """Questions with `allowed`: what the day has spent before each, with the reserve of those still pending, stays under the cap (U-15)."""
    own = F.coalesce("cost_usd", F.lit(cost))
    spent = running(log, own, ["asked_at", "id"], ["day"], "__spent")
    return spent.withColumn("allowed", F.col("__spent") - own + cost <= cap).drop("__spent")


def migrated(rows: DataFrame, changes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One-off rewrites: per column a condition and the value it takes there (U-17)."""
    return rows.withColumns({c: F.when(F.coalesce(when, F.lit(False)), value).otherwise(F.col(c)) for c, (when, value) in changes.items()})


def product_status(identity: Column, text: Column, outcome: Column, product: Column) -> Column:
    """What reading a homepage came to: the fetch's outcome, unverified, nothing found, or read (E-16, E-23)."""
    return F.when(text.isNull(), outcome).when(F.coalesce(identity != "verified", F.lit(True)), "unverified").when(product.isNull(), "nothing-stated").otherwise("read")


def basis_kind(basis: Column) -> Column:
    """How firm a fact is, by words in its basis (E-21)."""
    b, out = F.lower(basis), None
    words = (("self-reported", "unverified"), ("not verified", "unverified"), ("government", "record"), ("checked by hand", "checked"), ("absence", "absent"), ("third-party", "third"), ("founder", "founder"))
    for word, kind in words:
        here = F.contains(b, F.lit(word))
        out = F.when(here, kind) if out is None else out.when(here, kind)
    return out.otherwise("own")


def near_duplicate_pairs(rows: DataFrame, most: int = 2) -> DataFrame:
    """(a, b): pairs of ids with names at a small edit distance, for measuring, never for merging (E-19).

    Names within `most` edits have a string in common that is left after at most `most` deletions in each: they meet there.
    Equal names are one name until the end, and names meet by hashes of what is left; only pairs that are near meet their
    ids. Ids of equal names are paired with the first of them, so n copies give n - 1 pairs, and the pairs of two near
    names are those of their first ids.
    """
    def shorter(names):
        cut = F.flatten(F.transform(names, lambda x: F.transform(F.sequence(F.lit(0), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i), F.substring(x, i + 2, F.length(x))))))
        return F.array_distinct(F.concat(names, cut))

    ids = rows.where("name is not null").select("id", F.lower("name").alias("name"))
    names = stored(ids.groupBy("name").agg(F.min("id").alias("first")))
    keyed = names.select("first", F.array("name").alias("left"))
    for _ in range(most):
        keyed = keyed.withColumn("left", shorter(F.col("left")))
    keyed = stored(keyed.select("first", F.explode(F.transform("left", lambda x: F.xxhash64(x))).alias("left")).distinct())
    shared = keyed.groupBy("left").agg(F.count("*").alias("n")).where("n > 1").select("left")
    held = keyed.join(shared, "left")
    met = held.select("left", F.col("first").alias("a")).join(held.select("left", F.col("first").alias("b")), "left").where("a < b").select("a", "b").distinct()
    for x in "ab":
        met = met.join(names.select(F.col("first").alias(x), F.col("name").alias(f"n{x}")), x)
    near = met.where(F.levenshtein("na", "nb", most) >= 0).select("a", "b")
    equal = ids.join(names, "name").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return near.union(equal)


def distinct_roles(titles: Column, n: int = 6) -> Column:
    """struct<count, first>: distinct role titles of a page, the first as they are written (A-30, N-08)."""
    keys = F.transform(titles, lambda t: F.struct(F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " ")).alias("k"), t.alias("t")))
    empty = F.array().cast("array<struct<k:string,t:string>>")
    kept = F.aggregate(keys, empty, lambda seen, x: F.when(F.exists(seen, lambda y: y["k"] == x["k"]), seen).otherwise(F.concat(seen, F.array(x))))
    return F.struct(F.size(kept).alias("count"), F.slice(F.transform(kept, lambda x: x["t"]), 1, n).alias("first"))


def config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of hand-kept rows: taxonomy, aliases, overrides (S-21)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def valid_placements(answers: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """A classifier's answers made consistent: a sub-sector of its sector, a project of its sub-sector, else null (E-13, A.20).

    answers: id, sector_id, subsector_id, project_type; taxonomy: sector_id, subsector_id, projects. on_map says whether
    the record has a place. The classifier itself is the caller's; cache_probe and admit say whom to ask.
    """
    known = taxonomy.select(F.col("sector_id").alias("s"), F.col("subsector_id").alias("u"), "projects")
    joined = answers.join(known, (answers.sector_id == known.s) & (answers.subsector_id == known.u), "left")
    project = F.when(F.array_contains("projects", F.col("project_type")), F.col("project_type"))
    return joined.select("id", "sector_id", F.col("u").alias("subsector_id"), project.alias("project_type"), (F.col("sector_id").isNotNull() & F.col("u").isNotNull()).alias("on_map"))


def regrouped(labels: DataFrame, answers: DataFrame) -> DataFrame:
    """(label, topic): numbered labels under the first topic that names their number; those that none names keep their own (E-22).

    labels: number, label; answers: place, topic, numbers. Numbers out of range match nothing.
    """
    named = answers.select("place", "topic", F.explode("numbers").alias("number")).groupBy("number").agg(F.min_by("topic", "place").alias("topic"))
    return labels.join(named, "number", "left").select("label", F.coalesce("topic", "label").alias("topic"))
