"""The engine's tables made from the driver's: one SQL text that Spark and DuckDB both run.

companies come from customer, signals from orders, gaps from part, enrichment from supplier, runs from events, and the
sub-sectors from nation. "Now" is fixed, so results don't depend on the day.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.ranking import ranked
from lodestone.functions.said import said_state
from lodestone.operators.views import with_started
from lodestone.sources.readers import table

NOW = "2001-08-01"

COMPANIES = """
SELECT 'c' || CAST(c_custkey AS STRING) AS id,
  split_part('Aster,Boreal,Cobalt,Delta,Ember,Fjord,Garnet', ',', CAST(c_custkey % 7 + 1 AS INT)) || ' ' || CAST(c_custkey % 499 AS STRING) || ' '
    || split_part('Robotics Pvt Ltd,Labs,Energy Systems Private Limited,Bio Inc,Analytics LLP', ',', CAST(c_custkey % 5 + 1 AS INT)) AS name,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'DPIIT-recognised startup. Industry: Robotics. Sector: AI, Robotics Technology. Stage: Scaling.'
    WHEN 2 THEN 'BIRAC Biotechnology Ignition Grant awardee, category: Diagnostics.' WHEN 3 THEN ''
    WHEN 4 THEN 'We build drones and sensors for farms' ELSE 'A software platform for hospitals; write to us at team@example.com' END AS description,
  CASE c_custkey % 7 WHEN 0 THEN 'Makes battery packs for electric vehicles' WHEN 1 THEN '' ELSE NULL END AS product,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://www.site' || CAST(c_custkey % 977 AS STRING) || '.example.co.in/about?x=1' END AS website,
  c_custkey % 3 <> 0 AS website_checked,
  CASE c_custkey % 4 WHEN 2 THEN 'verified' WHEN 3 THEN 'discovered' ELSE NULL END AS website_identity,
  CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE 'State ' || CAST(c_nationkey AS STRING) END AS state,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE split_part('Bangalore,Pune,mumbai suburban,Hosur,jharkhand', ',', CAST(c_custkey % 5 + 1 AS INT)) END AS city,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(1990 + c_custkey % 12 AS INT) END AS founded_year,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(1991 + c_custkey % 11 AS INT) END AS origin_year,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey % 5 + 1 AS STRING) END AS sector_id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey % 5 + 1 AS STRING) || '.' || CAST(c_custkey % 6 + 1 AS STRING) END AS subsector_id,
  c_custkey % 3 <> 1 AS is_company,
  CASE WHEN c_custkey % 6 = 1 THEN 'register-label' ELSE 'description' END AS classify_basis,
  CASE c_custkey % 5 WHEN 0 THEN 'recognised' WHEN 1 THEN 'expired' WHEN 2 THEN 'profile' ELSE NULL END AS dpiit_status,
  CASE WHEN c_custkey % 4 = 1 THEN 'Dr. Asha Rao/Ben Low' ELSE NULL END AS founders,
  CASE WHEN c_custkey % 8 = 2 THEN 'info@site.example' ELSE NULL END AS contact_email,
  CASE WHEN c_custkey % 8 = 3 THEN '/contact' ELSE NULL END AS contact_page,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN split('hardware', ',') WHEN 2 THEN split('hardware,software', ',') ELSE split('software', ',') END AS build_tags,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN split('health', ',') ELSE split('energy,health', ',') END AS domain_tags,
  CAST(c_custkey % 4 AS BIGINT) AS programme_count,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(1996 + c_custkey % 6 AS STRING) ELSE CAST(DATE '2001-08-01' - CAST(c_custkey % 400 AS INT) AS STRING) END AS first_seen,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'cohort' ELSE 'discovered' END AS first_seen_basis
FROM customer"""

SIGNALS = """
SELECT 'c' || CAST(o_custkey AS STRING) AS company_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'grant' WHEN '2' THEN 'incubator' WHEN '3' THEN 'press' WHEN '4' THEN 'website' ELSE 'patent' END AS type,
  split_part('BIRAC BIG,NIDHI PRAYAS,TDB loan,Other scheme', ',', CAST(o_orderkey % 4 + 1 AS INT)) || ' ' || CAST(o_orderkey % 50 AS STRING) AS label,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date,
  split_part('sine-iitb,rtbi-iitm,grants-csv,dpiit-startup-india,venture-center,nmicps-tih,fsid-iisc,tides-iitr', ',', CAST(o_orderkey % 8 + 1 AS INT)) AS source,
  o_orderdate AS found_at
FROM orders"""

GAPS = """
SELECT CASE WHEN p_partkey % 10 = 0 THEN 'c' ELSE 'g' END || CAST(p_partkey AS STRING) AS company_id, p_name AS name,
  CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'DPIIT-recognised startup. Industry: AI.' ELSE p_type END AS description,
  CASE p_size % 5 WHEN 0 THEN 'no gap named' WHEN 1 THEN 'outside this taxonomy' ELSE p_brand END AS missing,
  'note ' || CAST(p_size AS STRING) AS note, CAST(p_size % 5 + 1 AS STRING) AS sector_id,
  CASE WHEN p_partkey % 2 = 0 THEN 'dpiit-startup-india' ELSE 'grants-csv' END AS source
FROM part"""

ENRICHMENT = """
SELECT 'c' || CAST(s_suppkey AS STRING) AS id, CAST(1989 + s_nationkey % 13 AS INT) AS incorporated_year,
  CASE s_nationkey % 4 WHEN 0 THEN 'Strike Off' WHEN 1 THEN NULL ELSE 'Active' END AS reg_status
FROM supplier"""

RUNS = """
SELECT event_id AS id, event_type AS source, ts AS started_at,
  CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'quarantined' ELSE 'ok' END AS status, CAST(floor(value) AS INT) AS records, user_id AS who
FROM events"""

SUBSECTORS = """
SELECT DISTINCT CAST(n_nationkey % 5 + 1 AS STRING) || '.' || CAST(floor(n_nationkey / 5) + 1 AS INT) AS subsector_id FROM nation"""

VIEWS = {"companies": COMPANIES, "signals": SIGNALS, "gaps": GAPS, "enrichment": ENRICHMENT, "runs": RUNS, "subsectors": SUBSECTORS}
ORIGIN = {"companies": "customer", "signals": "orders", "gaps": "part", "enrichment": "supplier", "runs": "events", "subsectors": "nation"}


class Tables:
    """The tables of one folder, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        origin = ORIGIN[name]
        return self.spark.sql(VIEWS[name].replace(f"FROM {origin}", "FROM {t}"), t=self.raw(origin))

    @property
    def now(self):
        return F.lit(NOW).cast("timestamp")

    @cached_property
    def base(self) -> DataFrame:
        """companies with trace counts, tier, said_state, registry_year, struck and started."""
        rows = ranked(self.companies, self.signals, self.now)
        rows = rows.withColumn("said_state", said_state(F.col("product"), F.col("website_identity"), F.col("description")))
        return with_started(rows, self.enrichment)
