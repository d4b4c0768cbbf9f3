"""A batch merged into a snapshot: (old tables, batch) -> new tables, by a rule per column (U-01 to U-14, J-21 to J-24, T-03)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.dates import refine
from lodestone.functions.ranking import ranked
from lodestone.functions.said import label_kind

#: Rules of the snapshot's columns (fixed values); a column without one takes the new value where there is one.
REPLACE = ("name", "classify_basis", "updated_at")
VERIFIED_ONLY = ("contact_email", "contact_page", "domain_registered", "web_first_capture", "site_signals", "product")
INSERT_ONLY = ("first_seen", "first_seen_basis", "discovered")
LARGER, SMALLER = ("website_checked",), ("origin_year",)


@dataclass
class Snapshot:
    companies: DataFrame
    signals: DataFrame
    gaps: DataFrame


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in an order (W-04)."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def rule(c: str) -> Column:
    """The merged value of a column of o (old) and n (new) for an id that both have."""
    o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
    identity = F.col("n.website_identity")
    if c in REPLACE:
        return n
    if c in INSERT_ONLY:
        return o
    if c in VERIFIED_ONLY:
        return F.when(identity != "verified", F.lit(None)).otherwise(F.coalesce(n, o))
    if c == "product_status":
        return F.when(identity != "verified", F.coalesce(n, F.lit("unverified"))).otherwise(F.coalesce(n, o))
    if c == "website":
        return F.when(identity.isNotNull(), n).otherwise(F.coalesce(n, o))
    if c in LARGER:
        return F.coalesce(n, F.lit(False)) | F.coalesce(o, F.lit(False))
    if c in SMALLER:
        return F.least(n, o)
    if c == "project_type":
        return F.when(F.col("n.classify_basis") == "register-label", F.lit(None)).otherwise(F.coalesce(n, o))
    if c == "founders_source":
        return F.when(F.col("n.founders").isNotNull(), n).otherwise(o)
    if c in ("description", "description_source"):
        take_new = F.col("n.description").isNotNull() & (label_kind(F.col("n.description")).isNull() | F.col("o.description").isNull() | label_kind(F.col("o.description")).isNotNull())
        return F.when(take_new, n).otherwise(o)
    return F.coalesce(n, o)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows by id, each column by its rule: one full join on the key (U-01). Ids are unique on either side."""
    joined = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full")
    out = [F.coalesce("o.id", "n.id").alias("id")]
    for c in old.columns:
        if c == "id":
            continue
        o = F.col(f"o.{c}")
        if c not in new.columns:
            out.append(o.alias(c))
            continue
        n = F.col(f"n.{c}")
        out.append(F.when(F.col("n.id").isNull(), o).when(F.col("o.id").isNull(), n).otherwise(rule(c)).alias(c))
    return joined.select(*out)


def insert_signals(old: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """old plus the new signals of known companies; an old row wins over an equal key (U-02, T-03, J-21)."""
    keys = ["company_id", "type", "label"]
    fresh = first_per(new, keys, ["date", "source"]).join(known.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    same = reduce(lambda a, b: a & b, [fresh[k].eqNullSafe(old[k]) for k in keys])
    return old.unionByName(fresh.join(old.select(*keys), same, "left_anti").select(*old.columns))


def upsert_gaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Name, missing, note and source replaced; description and sector filled (U-03)."""
    joined = old.alias("o").join(new.alias("n"), F.col("o.company_id") == F.col("n.company_id"), "full")
    replaced = ("name", "missing", "note", "source")
    cols = [F.when(F.col("n.company_id").isNull(), F.col(f"o.{c}")).when(F.lit(c in replaced), F.col(f"n.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in old.columns if c != "company_id"]
    return joined.select(F.coalesce("o.company_id", "n.company_id").alias("company_id"), *cols)


def exclusive(snapshot: Snapshot, placed: DataFrame, unplaced: DataFrame) -> Snapshot:
    """No id is a row and a gap: what the payload places wins, else what it doesn't place goes (U-04, J-23)."""
    gone = unplaced.select(F.col("company_id").alias("id")).join(placed.select("id"), "id", "left_anti").distinct()
    return Snapshot(
        snapshot.companies.join(gone, "id", "left_anti"),
        snapshot.signals.join(gone.withColumnRenamed("id", "company_id"), "company_id", "left_anti").select(*snapshot.signals.columns),
        snapshot.gaps.join(placed.select(F.col("id").alias("company_id")), "company_id", "left_anti").select(*snapshot.gaps.columns),
    )


def withdraw_sites(signals: DataFrame, new: DataFrame) -> DataFrame:
    """Website traces go where the site is out of reach or not theirs (U-05)."""
    wrong = new.where((F.col("website_identity") != "verified") | (F.col("product_status") == "unreachable")).select(F.col("id").alias("company_id"), F.lit("website").alias("type")).distinct()
    return signals.join(wrong, ["company_id", "type"], "left_anti").select(*signals.columns)


def one_register_line(signals: DataFrame, kind: str = "dpiit") -> DataFrame:
    """The latest register line of each company, and everything else (U-06)."""
    lines = signals.where(F.col("type") == kind)
    latest = first_per(lines, ["company_id"], [F.desc("found_at"), "label"])
    return signals.where(F.coalesce(F.col("type") != kind, F.lit(True))).unionByName(latest)


def dated(companies: DataFrame, signals: DataFrame) -> DataFrame:
    """Undated rows take their earliest dated event as cohort; a bare year takes its year's first full date (U-07, A.17)."""
    events = signals.where("date is not null").groupBy("company_id").agg(F.min("date").alias("event"), F.collect_set(F.when(F.length("date") == 10, F.col("date"))).alias("days"))
    rows = companies.join(events.withColumnRenamed("company_id", "id"), "id", "left")
    first = F.coalesce("first_seen", F.col("event"))
    in_year = F.array_min(F.filter("days", lambda d: F.startswith(d, first)))
    basis = F.when(F.col("first_seen").isNull() & F.col("event").isNotNull(), F.lit("cohort")).otherwise(F.col("first_seen_basis"))
    seen = F.when(F.coalesce(basis == "cohort", F.lit(False)), refine(first, F.coalesce(in_year, F.col("event")))).otherwise(first)
    return rows.withColumns({"first_seen": seen, "first_seen_basis": basis}).select(*companies.columns)


def with_first_seen(new: DataFrame, backfill: Column, today: Column) -> DataFrame:
    """first_seen and basis of rows that are new: a cohort year or nothing in a backfill, else today (U-09)."""
    year = F.coalesce("source_year", "origin_year").cast("string")
    return new.withColumns({
        "first_seen": F.when(backfill, year).otherwise(today.cast("string")),
        "first_seen_basis": F.when(~backfill, F.lit("discovered")).when(year.isNotNull(), F.lit("cohort")),
    })


def is_backfill(runs: DataFrame, today: Column) -> DataFrame:
    """(source, backfill): whether the source has no good run on an earlier day (U-08)."""
    earlier = (F.col("status") == "ok") & (F.to_date("started_at") < today)
    return runs.groupBy("source").agg((F.count_if(earlier) == 0).alias("backfill"))


def merge_duplicates(snapshot: Snapshot, merges: DataFrame) -> Snapshot:
    """Duplicates (from, into) folded into rows that exist: the earlier first_seen stays, the rest of the duplicate goes (U-12, J-24, A.18)."""
    valid = merges.join(snapshot.companies.select(F.col("id").alias("into")), "into", "left_semi").where(F.col("from") != F.col("into"))
    seen = snapshot.companies.join(valid.select(F.col("from").alias("id"), "into"), "id").where("first_seen is not null")
    earliest = seen.groupBy("into").agg(F.min(F.struct("first_seen", "first_seen_basis")).alias("f"))
    rows = snapshot.companies.join(valid.select(F.col("from").alias("id")).distinct(), "id", "left_anti").join(earliest.withColumnRenamed("into", "id"), "id", "left")
    better = F.col("f").isNotNull() & (F.col("first_seen").isNull() | (F.col("f.first_seen") < F.col("first_seen")))
    rows = rows.withColumns({c: F.when(better, F.col(f"f.{c}")).otherwise(F.col(c)) for c in ("first_seen", "first_seen_basis")}).select(*snapshot.companies.columns)
    gone = valid.select(F.col("from").alias("company_id")).distinct()
    return Snapshot(rows, snapshot.signals.join(gone, "company_id", "left_anti").select(*snapshot.signals.columns), snapshot.gaps.join(gone, "company_id", "left_anti").select(*snapshot.gaps.columns))


def apply_batch(old: Snapshot, batch: Snapshot, now: Column) -> Snapshot:
    """All effects of a batch on the tables in their order (U-13); applying it twice changes nothing more."""
    companies = upsert(old.companies, batch.companies)
    signals = insert_signals(old.signals, batch.signals, companies)
    out = exclusive(Snapshot(companies, signals, upsert_gaps(old.gaps, batch.gaps)), batch.companies, batch.gaps)
    signals = one_register_line(withdraw_sites(out.signals, batch.companies))
    companies = ranked(dated(out.companies, signals), signals, now).select(*old.companies.columns)
    return Snapshot(companies, signals, out.gaps)


@dataclass
class Ingested:
    """The tables after a run, its row for the log, and the version that readers' caches go by."""

    snapshot: Snapshot
    run: DataFrame
    version: DataFrame


def ingest(old: Snapshot, runs: DataFrame, source: str, batch: Snapshot, merges: DataFrame, now: Column, backfill: bool | None = None) -> Ingested:
    """A whole run of a source: what is new gets its date, the batch is applied, duplicates are folded, the run is logged (U-08 to U-13).

    New rows are dated by the cohort year in a backfill and by today else; it is a backfill if the source has no good run
    on an earlier day, unless the caller says which it is. `merges` (from, into) are applied after the batch, and the rows
    that stay are ranked again. batch.companies may have source_year and origin_year; columns that the tables lack go.
    run: source, started_at, status, records; version: one row, for the caches.
    """
    if backfill is None:
        known = is_backfill(runs.where(F.col("source") == source), F.to_date(now)).first()
        backfill = known is None or known.backfill
    fresh = batch.companies.withColumns({c: F.lit(None).cast("int") for c in ("source_year", "origin_year") if c not in batch.companies.columns})
    fresh = with_first_seen(fresh, F.lit(backfill), F.to_date(now)).select(*[c for c in old.companies.columns if c in {*fresh.columns, "first_seen", "first_seen_basis"}])
    out = apply_batch(old, Snapshot(fresh, batch.signals, batch.gaps), now)
    merged = merge_duplicates(out, merges)
    companies = ranked(merged.companies, merged.signals, now).select(*old.companies.columns)
    run = batch.companies.agg(F.count("*").alias("records")).select(F.lit(source).alias("source"), now.alias("started_at"), F.lit("ok").alias("status"), "records")
    return Ingested(Snapshot(companies, merged.signals, merged.gaps), run, run.select(now.cast("string").alias("version")))


def owner_merge(rows: DataFrame, groups: dict[str, tuple[str, ...]], order: str = "source_rank") -> DataFrame:
    """One row per id: the first source owns it, and each group of columns comes whole from the first source that has it (A-12, J-27).

    Descriptions prefer a real text over a label.
    """
    out = [F.min_by("source", order).alias("owner")]
    for lead, cols in groups.items():
        given = F.col(lead).isNotNull()
        key = F.struct(label_kind(F.col(lead)).isNotNull(), order) if lead == "description" else F.col(order)
        picked = F.min_by(F.struct(*cols), F.when(given, key))
        out += [picked[c].alias(c) for c in cols]
    return rows.groupBy("id").agg(*out)


def upsert_notes(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Notes by company; an empty body deletes, created_at survives (U-14)."""
    j = old.alias("o").join(new.alias("n"), F.col("o.company_id") == F.col("n.company_id"), "full")
    kept = j.select(F.coalesce("o.company_id", "n.company_id").alias("company_id"), F.coalesce("n.body", "o.body").alias("body"), F.coalesce("o.created_at", now).alias("created_at"), F.when(F.col("n.body").isNotNull(), now).otherwise(F.col("o.updated_at")).alias("updated_at"))
    return kept.where(F.trim("body") != "")


def problems(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with `problems`, the names of the checks that fail; empty is valid (K-02, S-22)."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.withColumn("problems", found)


