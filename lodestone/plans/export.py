"""A view as a file for spreadsheets: a line per record, every field quoted (K-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.said import register_text
from lodestone.functions.text import csv_field
from lodestone.operators.link import running

# The columns of the file, in their order.
COLUMNS = (
    "name", "builds", "builds_from", "source_description", "website", "website_identity", "website_looked_for", "entity_type", "founders",
    "founders_source", "dpiit_status", "dpiit_stage", "contact_email", "contact_page", "domain_registered", "web_first_capture", "build_tags",
    "domain_tags", "public_programmes", "programme_count", "publishing_organisations", "hiring_roles", "team_page", "site_versions_2y",
    "parked_homepage", "papers_found", "city", "state", "rdi_sector", "rdi_subsector", "rdi_project", "placed_from", "classifier_reasoning",
    "tier", "public_traces", "on_record", "on_record_basis", "started", "in_database", "signals", "page",
)
OWN_HOMEPAGE = "the company's own homepage"
#: Columns of the file that stand under another name in a record.
RENAMED = {
    "builds": "product",
    "public_programmes": "programmes",
    "publishing_organisations": "organisation_count",
    "hiring_roles": "roles",
    "team_page": "team",
    "site_versions_2y": "versions",
    "papers_found": "papers",
    "rdi_sector": "sector_id",
    "rdi_subsector": "subsector",
    "rdi_project": "project_type",
    "placed_from": "classify_basis",
    "classifier_reasoning": "classify_note",
    "public_traces": "trace_count",
    "on_record": "first_seen",
    "on_record_basis": "first_seen_basis",
    "in_database": "discovered",
}
#: What is told only if the site is known to be the record's own.
VERIFIED_ONLY = ("contact_email", "contact_page", "domain_registered", "web_first_capture")


def fields(rows: DataFrame, site: str) -> dict[str, Column]:
    """The file's columns of records; what a record has no column for is empty, and so is null."""
    def own(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    def joined(name: str) -> Column:
        return F.array_join(name, "; ") if dict(rows.dtypes).get(name, "").startswith("array") else own(name)

    out = {c: joined(RENAMED.get(c, c)) for c in COLUMNS}
    verified = F.coalesce(own("website_identity") == "verified", F.lit(False))
    out |= {c: F.when(verified, own(c)) for c in VERIFIED_ONLY}
    out["builds_from"] = F.when(F.coalesce("product", F.lit("")) != "", OWN_HOMEPAGE)
    out["source_description"] = register_text(own("description"), own("dpiit_status"))
    out["website_looked_for"] = F.when(own("website_checked").cast("boolean"), "yes").otherwise("no")
    out["founders_source"] = F.when(F.coalesce(own("founders"), F.lit("")) != "", own("founders_source"))
    out["parked_homepage"] = F.when(own("parked").cast("boolean"), "yes")
    if "subsector" not in rows.columns:
        out["rdi_subsector"] = own("subsector_id")
    out["started"] = F.coalesce(own("origin_year"), own("founded_year"))
    out["page"] = F.concat(F.lit(f"{site}/c/"), F.col("id"))
    return out


def lines(rows: DataFrame, site: str) -> DataFrame:
    """(id, line): each record as a line of the file, without its end."""
    cells = [csv_field(x.cast("string")) for x in fields(rows, site).values()]
    return rows.select("id", F.concat_ws(",", *cells).alias("line"))


def header() -> str:
    """The first line, with the mark by which spreadsheets know UTF-8."""
    return "\ufeff" + ",".join(f'"{c}"' for c in COLUMNS)


def file(rows: DataFrame, order: list, site: str) -> DataFrame:
    """(pos, line): the lines of the file in an order that tells rows apart, from 1 on, and its header at 0."""
    numbered = running(rows, F.lit(1).cast("bigint"), order, [], "pos")
    first = rows.sparkSession.createDataFrame([(0, header())], "pos bigint, line string")
    return lines(numbered, site).join(numbered.select("id", "pos"), "id").select("pos", "line").unionByName(first)


def write(rows: DataFrame, order: list, site: str, path: str) -> None:
    """Write records in an order; the parts of the folder, one after another, are the file."""
    file(rows, order, site).orderBy("pos").select("line").write.option("lineSep", "\r\n").text(path)
