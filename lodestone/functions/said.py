"""Whose words describe a record, and what follows from that (P-05, P-08, P-09, O-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The openings of texts that are list labels, not descriptions.
REGISTER_LABEL = "DPIIT-recognised startup. Industry:"
GRANT_LABEL = "BIRAC Biotechnology Ignition Grant awardee, category:"
# The phrase that a register status is shown by.
STATUS_PHRASES = {
    "recognised": "DPIIT recognised",
    "expired": "DPIIT recognition expired",
    "cancelled": "DPIIT recognition cancelled",
    "pending": "Startup India profile, DPIIT recognition pending",
    "profile": "Startup India profile, not DPIIT recognised",
}


def label_kind(text: Column) -> Column:
    """register, grant, or null for a real description (P-08)."""
    return F.when(F.startswith(text, F.lit(REGISTER_LABEL)), "register").when(F.startswith(text, F.lit(GRANT_LABEL)), "grant")


def said_state(product: Column, identity: Column, description: Column) -> Column:
    """own, source, label or none (P-05)."""
    given = F.coalesce(description, F.lit("")) != ""
    own = (F.coalesce(product, F.lit("")) != "") & F.coalesce(identity == "verified", F.lit(False))
    return F.when(own, "own").when(given & label_kind(description).isNull(), "source").when(given, "label").otherwise("none")


def register_text(description: Column, status: Column) -> Column:
    """A register label with its first sentence replaced by what the status says (P-09)."""
    phrases = F.create_map(*[F.lit(x) for kv in STATUS_PHRASES.items() for x in kv])
    opening = F.concat(F.coalesce(F.try_element_at(phrases, status), F.lit("On the DPIIT Startup India register")), F.lit("."))
    rest = F.substring(description, len("DPIIT-recognised startup.") + 1, 1 << 30)
    return F.when(label_kind(description) == "register", F.concat(opening, rest)).otherwise(description)


def completeness(c: dict[str, Column]) -> Column:
    """0 to 7: own sentence on a verified site 2; real description, verified site, founders, contact, dated 1 each (A.6)."""
    verified = F.coalesce(c["website_identity"] == "verified", F.lit(False))

    def has(x: Column) -> Column:
        return F.coalesce(x, F.lit("")) != ""

    points = [
        F.when(has(c["product"]) & verified, 2),
        F.when(has(c["description"]) & label_kind(c["description"]).isNull(), 1),
        F.when(verified, 1),
        F.when(has(c["founders"]), 1),
        F.when(has(c["contact_email"]) | has(c["contact_page"]), 1),
        F.when(c["first_seen"].isNotNull(), 1),
    ]
    total = F.lit(0)
    for p in points:
        total = total + F.coalesce(p, F.lit(0))
    return total
