"""Registered queries of the nightly steps and of text rules, on inputs that vary from row to row.

Each input is one SQL text that Spark and DuckDB both run. Where a rule takes something out of a text, the input puts the
text together from parts, and the SQL beside the query says which parts must stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import awards, dates, entity, said, tags, text
from lodestone.operators import merge, steps, views
from lodestone.plans import export
from lodestone.plans.catalog import query
from lodestone.plans.proxies import Tables

TODAY = "2001-08-01"


def made(t: Tables, sql: str, origin: str) -> DataFrame:
    """The rows of an input's SQL over one of the driver's tables."""
    return t.spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {origin}", "FROM {t}"), t=t.raw(origin))


# --- texts --------------------------------------------------------------------------------------------------------

CONTACTS = """SELECT c_custkey AS id, c_name || ' builds pumps for ' || c_mktsegment AS want,
  CASE c_custkey % 6 WHEN 0 THEN c_name || ' builds pumps for ' || c_mktsegment WHEN 1 THEN c_name || ' builds pumps for ' || c_mktsegment || ', e-mail: a' || CAST(c_custkey AS STRING) || '@site.example.com'
    WHEN 2 THEN c_name || ' builds pumps for ' || c_mktsegment || '; phone +91 98' || lpad(CAST(c_custkey AS STRING), 8, '7') WHEN 3 THEN c_name || '  builds x' || CAST(c_custkey AS STRING) || '@a.example.org pumps for ' || c_mktsegment
    WHEN 4 THEN c_name || ' builds pumps for ' || c_mktsegment || ' / Mobile: ' || lpad(CAST(c_custkey AS STRING), 10, '9') || ' , email ids: q@w.example, ' ELSE c_name || ' builds pumps for ' || c_mktsegment || ' Contact details: ' END AS line
FROM customer"""


@query(f", i AS ({CONTACTS}) SELECT id, want AS line FROM i")
def strip_contacts(t):
    """X-06. A small file is one partition, however many rows it unfolds to: they are dealt out before the rules run."""
    return made(t, CONTACTS, "customer").repartition("id").select("id", text.without_contacts(F.col("line")).alias("line"))


NAMES = """SELECT c_custkey AS id, upper(CASE c_custkey % 3 WHEN 0 THEN 'House of ' WHEN 1 THEN 'AI for ' ELSE '' END || c_mktsegment || ' '
  || split_part('Robotics Pvt Ltd,R&D and Labs,Power-Grid Systems,Ncf 2d Works,IoT Motors LLP', ',', CAST(c_custkey % 5 + 1 AS INT))) AS name FROM customer"""
_KEPT = f"list_contains({list(text.KEEP_UPPER)}, p)"
_TITLE = f"array_to_string(list_transform(string_split(w, '-'), lambda p: CASE WHEN {_KEPT} THEN p ELSE p[1] || lower(p[2:]) END), '-')"


@query(f""", i AS ({NAMES}), w AS (SELECT id, string_split(name, ' ') AS ws FROM i), u AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM w)
SELECT id, string_agg(CASE WHEN w IN ('PVT', 'LTD') THEN w[1] || lower(w[2:]) WHEN {_KEPT.replace('p)', 'w)')} OR length(w) = 1 OR (length(w) <= 3 AND regexp_matches(w, '[0-9]')) OR regexp_full_match(w, '[B-DF-HJ-NP-TV-Z]+') THEN w
  WHEN k > 1 AND lower(w) IN {text.KEEP_LOWER} THEN lower(w) ELSE {_TITLE} END, ' ' ORDER BY k) AS shown FROM u GROUP BY id""")
def recase_name(t):
    """X-09."""
    return made(t, NAMES, "customer").select("id", text.display_name(F.col("name")).alias("shown"))


_HOSTS = """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'https://www.site' || CAST(c_custkey AS STRING) || '.example.co.in/a?b' WHEN 1 THEN 'http://shop.acme' || CAST(c_custkey % 9 AS STRING) || '.com'
  WHEN 2 THEN 'HTTPS://WWW2.B' || CAST(c_custkey AS STRING) || '.ORG:8080/x' WHEN 3 THEN 'https://in.linkedin.com/in/p' || CAST(c_custkey AS STRING) WHEN 4 THEN 'https://localhost/' WHEN 5 THEN 'https://co.uk' ELSE NULL END AS url FROM customer"""
_HOST = "nullif(regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:@]+)', 1), '^www[0-9]?\\.', ''), '')"


@query(f""", h AS (SELECT id, {_HOST} AS host FROM ({_HOSTS})), l AS (SELECT id, host, string_split(host, '.') AS ls FROM h)
SELECT id, host, CASE WHEN list_contains({list(text.SECOND_LEVEL)}, array_to_string(ls[-2:], '.')) THEN CASE WHEN len(ls) > 2 THEN array_to_string(ls[-3:], '.') END WHEN len(ls) > 1 THEN array_to_string(ls[-2:], '.') END AS registrable,
  coalesce(host IN ('linkedin.com') OR host LIKE '%.linkedin.com', false) AS profile FROM l""")
def host_registrable(t):
    """X-11, X-12."""
    rows = made(t, _HOSTS, "customer").withColumn("host", text.host(F.col("url")))
    return rows.select("id", "host", text.registrable(F.col("host")).alias("registrable"), text.is_profile(F.col("url")).alias("profile"))


SITES = """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'www.firm' || CAST(c_custkey AS STRING) || '.in Phone' WHEN 1 THEN 'N/A' WHEN 2 THEN 'https://x' || CAST(c_custkey AS STRING) || '.example.com/a.PDF?z=1'
  WHEN 3 THEN 'https://lab' || CAST(c_custkey AS STRING) || '.ac.in' WHEN 4 THEN 'https://twitter.com/t' || CAST(c_custkey AS STRING) WHEN 5 THEN 'coming soon' WHEN 6 THEN 'https:--firm.com' WHEN 7 THEN 'https://www.justdial.com/x' ELSE 'https://a' || CAST(c_custkey AS STRING) || '.example.org/?p=b.png' END AS value FROM customer"""


@query(f", i AS ({SITES}) SELECT id, CASE id % 9 WHEN 0 THEN 'https://www.firm' || id || '.in' WHEN 8 THEN value END AS url FROM i")
def own_websites(t):
    """X-05: addresses of companies' own stay; files, institutions, profiles, directories and placeholders go."""
    return made(t, SITES, "customer").select("id", text.own_website(F.col("value")).alias("url"))


FOUNDERS = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Dr. ' || c_name || '/Ben ' || c_mktsegment WHEN 1 THEN 'Prof. Asha ' || c_mktsegment || ' Dr. ' || c_name WHEN 2 THEN 'Prof. Dr. ' || c_name || ' and Mrs. Low'
  WHEN 3 THEN ' ' || c_name || ', Carla  May /carla-may/ ' ELSE NULL END AS founders,
  CASE c_custkey % 5 WHEN 0 THEN 'Dr. ' || c_name || ', Ben ' || c_mktsegment WHEN 1 THEN 'Prof. Asha ' || c_mktsegment || ', Dr. ' || c_name WHEN 2 THEN 'Prof. Dr. ' || c_name || ' and Mrs. Low' WHEN 3 THEN c_name || ', Carla May' END AS want FROM customer"""


@query(f", i AS ({FOUNDERS}) SELECT id, want AS line FROM i")
def founder_lines(t):
    """X-08."""
    return made(t, FOUNDERS, "customer").select("id", text.founder_line(F.col("founders")).alias("line"))


LABELS = """SELECT p_partkey AS id, p_brand AS brand, split_part('Robotics,Biotechnology,Space Technology,Agri-Tech,Nanotechnology', ',', CAST(p_size % 5 + 1 AS INT)) AS industry, split_part('2.3,4.1,2.5,5.2,2.6', ',', CAST(p_partkey % 5 + 1 AS INT)) AS subsector_id,
  CASE p_partkey % 4 WHEN 0 THEN 'DPIIT-recognised startup. Industry: ' || split_part('Robotics,Biotechnology,Space Technology,Agri-Tech,Nanotechnology', ',', CAST(p_size % 5 + 1 AS INT)) || '. Sector: ' || p_brand || ', Robotics Technology. Stage: Scaling.'
    WHEN 1 THEN 'DPIIT-recognised startup. Industry: ' || split_part('Robotics,Biotechnology,Space Technology,Agri-Tech,Nanotechnology', ',', CAST(p_size % 5 + 1 AS INT)) || '. Stage: Validation.' WHEN 2 THEN 'BIRAC Biotechnology Ignition Grant awardee, category: Diagnostics.' ELSE p_name END AS description FROM part"""
_OWN = "CASE id % 4 WHEN 0 THEN [lower(industry), lower(brand), 'robotics technology'] WHEN 1 THEN [lower(industry)] WHEN 2 THEN ['diagnostics'] ELSE [] END"
_TABLE = ", ".join(f"('{label}', '{s}')" for label, subs in entity.SUPPORTS.items() for s in subs)


@query(f", i AS ({LABELS}) SELECT id, array_to_string({_OWN}, ',') AS labels FROM i")
def register_labels_parse(t):
    """X-14."""
    return made(t, LABELS, "part").select("id", F.array_join(entity.register_labels(F.col("description")), ",").alias("labels"))


@query(f", i AS ({LABELS}), s(label, sub) AS (VALUES {_TABLE}), o AS (SELECT id, subsector_id, unnest({_OWN}) AS label FROM i)\nSELECT id, id IN (SELECT id FROM o JOIN s ON o.label = s.label AND o.subsector_id = s.sub) AS supported FROM i")
def label_support(t):
    """E-06, A.14, U-18."""
    return made(t, LABELS, "part").select("id", F.coalesce(entity.label_supports(F.col("description"), F.col("subsector_id")), F.lit(False)).alias("supported"))


def _tags(vocabulary: dict[str, str]) -> str:
    """The tags of a text in SQL; what the pattern language there lacks, looking ahead, is said apart."""
    parts = []
    for tag, p in vocabulary.items():
        plain = p.replace(r"\bmachines?\b(?! learning)|", "")
        more = " OR regexp_matches(regexp_replace(words, 'machines? learning', '', 'gi'), '(?i)\\bmachines?\\b')" if plain != p else ""
        parts.append(f"CASE WHEN regexp_matches(words, '(?i)(?:{plain})'){more} THEN '{tag}' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


_DESCRIBED = "CASE WHEN website_identity = 'verified' AND product <> '' THEN product || ' ' || more END, CASE WHEN description <> '' AND description NOT LIKE 'DPIIT-%' AND description NOT LIKE 'BIRAC %' THEN description END"
#: Half-sentences that are added to the own sentences, so that tags vary.
MORE = ("machine learning for farms", "machines and solar panels", "a mobile app for students", "enzymes against disease", "nothing more")
_MORE = f"split_part('{','.join(MORE)}', ',', CAST(CAST(substr(id, 2) AS INT) % 5 + 1 AS INT))"


@query(f", i AS (SELECT id, concat_ws(' ', {_DESCRIBED}) AS words FROM (SELECT *, {_MORE} AS more FROM companies)) SELECT id, {_tags(tags.BUILD)} AS build, {_tags(tags.DOMAIN)} AS domain FROM i")
def keyword_tags(t):
    """E-04, E-05."""
    own = F.concat_ws(" ", "product", F.expr(_MORE))
    words = tags.described_text(F.when(F.col("product") != "", own), F.col("website_identity"), F.col("description"))
    return t.companies.select("id", F.array_join(tags.tags(words, tags.BUILD), ",").alias("build"), F.array_join(tags.tags(words, tags.DOMAIN), ",").alias("domain"))


PLACES = """SELECT s_suppkey AS id, s_name AS firm, CASE s_suppkey % 4 WHEN 0 THEN 'M/s ' || s_name || ' Pvt. Ltd., Pune, Maharashtra' WHEN 1 THEN s_name || ', Kochi (Kerala)' WHEN 2 THEN s_name || ' Limited for a pump' ELSE s_name END AS cell FROM supplier"""


@query(f", i AS ({PLACES}) SELECT id, CASE id % 4 WHEN 0 THEN firm || ' Pvt. Ltd.' WHEN 2 THEN firm || ' Limited' ELSE firm END AS name, CASE id % 4 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Kochi' END AS city FROM i")
def award_cells(t):
    """X-15: the company and the city of a list's cell."""
    return made(t, PLACES, "supplier").select("id", awards.split_company(F.col("cell")).alias("c")).select("id", "c.name", "c.city")


TITLES = """SELECT s_suppkey AS id, s_name AS project, CASE s_suppkey % 3 WHEN 0 THEN s_name || '.' WHEN 1 THEN 'TDB signs an agreement with M/s X for ' || s_name ELSE 'Technology Development Board funds "' || s_name || '" of M/s Y' END AS title FROM supplier"""


@query(f", i AS ({TITLES}) SELECT id, project AS title FROM i")
def project_titles(t):
    """X-15: the project that a title names."""
    return made(t, TITLES, "supplier").select("id", awards.project_title(F.col("title")).alias("title"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN c_name || ' ' || c_mktsegment ELSE c_mktsegment || ' x' END AS line FROM customer")
def undoubled_names(t):
    """X-16."""
    twice = F.concat_ws(" ", "c_mktsegment", F.lit("x"), "c_mktsegment", F.lit("x"))
    once = F.concat_ws(" ", "c_mktsegment", F.lit("x"))
    k = F.col("c_custkey") % 3
    line = F.when(k == 0, twice).when(k == 1, once).otherwise(F.concat_ws(" ", "c_name", "c_mktsegment"))
    return t.raw("customer").select(F.col("c_custkey").alias("id"), text.undoubled(line).alias("line"))


@query("SELECT doc_id, substr(trim(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), ' '), 1, 300) AS question FROM documents")
def clean_questions(t):
    """X-18."""
    return t.raw("documents").select("doc_id", text.clean_question(F.col("text")).alias("question"))


FIRMS = """SELECT c_custkey AS id, c_mktsegment || CAST(c_custkey % 400 AS STRING) AS own, c_mktsegment || CAST(c_custkey % 400 AS STRING) || CASE c_custkey % 4 WHEN 0 THEN ' & Co. Energy Pvt. Ltd.' WHEN 1 THEN ' Robotics (India) Private Limited' WHEN 2 THEN ' and Sons LLP' ELSE ', Pune' END AS name FROM customer"""


@query(f", i AS ({FIRMS}) SELECT id, lower(own) || CASE id % 4 WHEN 0 THEN ' co energy pvt ltd' WHEN 1 THEN ' robotics india private limited' WHEN 2 THEN ' sons llp' ELSE ' pune' END AS words, own || CASE id % 4 WHEN 0 THEN ' Co Energy' WHEN 1 THEN ' Robotics' WHEN 2 THEN ' and Sons' ELSE '' END AS needle FROM i")
def needles(t):
    """X-24: a name's plain words, and the phrase that affiliations are searched for."""
    return made(t, FIRMS, "customer").select("id", awards.normal_words(F.col("name")).alias("words"), awards.needle(F.col("name"), ("energy", "robotics")).alias("needle"))


@query("SELECT p_partkey AS id, regexp_replace(replace(p_type, ' ', '') || 'EarlyTraction', '([a-z])([A-Z])', '\\1 \\2', 'g') AS stage FROM part")
def camel_words(t):
    """X-25."""
    return t.raw("part").select(F.col("p_partkey").alias("id"), text.spread_camel(F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.lit("EarlyTraction"))).alias("stage"))


@query("""SELECT id, substr(sha256('{"v0":"' || id || '","v1":' || coalesce('"' || state || '"', 'null') || '}'), 1, 16) AS digest FROM companies""")
def fingerprints(t):
    """X-26."""
    return t.companies.select("id", text.digest16(F.col("id"), F.col("state")).alias("digest"))


# --- dates --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day FROM orders")
def prose_dates(t):
    """D-05: written day first, month first, with an ordinal, or not at all."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    line = F.when(k == 0, F.concat(F.lit("since "), F.date_format(d, "d MMMM yyyy"), F.lit(" or so"))).when(k == 1, F.concat(F.date_format(d, "MMM d"), F.lit(", "), F.date_format(d, "yyyy"))).when(k == 2, F.concat(F.lit("on "), F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMM, yyyy"))).otherwise(F.date_format(d, "'in' yyyy"))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), dates.prose_date(line).alias("day"))


NUMBERS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'AAA-' ELSE 'U72900KA' END || CAST(1990 + c_custkey % 30 AS STRING) || 'PTC' || lpad(CAST(c_custkey AS STRING), 6, '0') AS number FROM customer"


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN CAST(1990 + c_custkey % 30 AS INT) END AS year FROM customer")
def number_years(t):
    """D-08."""
    return made(t, NUMBERS, "customer").select("id", dates.number_year(F.col("number")).alias("year"))


# --- steps of a run -----------------------------------------------------------------------------------------------


@query("SELECT id FROM companies WHERE id IN ('c1', 'c2', 'c3') OR (coalesce(description, '') <> '' AND coalesce(website, '') <> '' AND sector_id NOT IN ('2', '3'))")
def eligible_rows(t):
    """F-27."""
    chosen = t.companies.where("id in ('c1', 'c2', 'c3')").select("id")
    return steps.eligible(t.companies.withColumn("source", F.col("sector_id")), chosen, ["2", "3"]).select("id")


@query("SELECT company_id, type, count(*) AS n FROM signals GROUP BY 1, 2")
def complete_reads(t):
    """F-28: a read below its cap is taken whole."""
    return steps.complete(t.signals, 1 << 31 - 1).groupBy("company_id", "type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, w.city) AS city FROM part LEFT JOIN (SELECT s_nationkey AS k, arg_min(s_name, s_suppkey) AS city FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY 1) w ON p_size = w.k")
def finalists_city(t):
    """J-29."""
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("key"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("city"))
    winners = t.raw("supplier").select(F.col("s_nationkey").alias("key"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("city"), F.col("s_suppkey").alias("pos"))
    return steps.with_city(rows, winners).select("id", "city")


LISTED = "SELECT o_orderkey % 5 AS round, 'firm-' || CAST(o_custkey % 300 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '-inc' ELSE '' END AS slug, 'Firm ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Pvt Ltd' ELSE 'Labs' END AS name FROM orders"
TYPED = "SELECT o_orderkey % 4 AS round, 'firm-' || CAST(o_custkey % 500 AS STRING) AS slug FROM orders"


@query(f""", l AS (SELECT *, replace(regexp_replace(slug, '-inc$', ''), '-', '') AS key FROM ({LISTED})), t AS (SELECT DISTINCT round, replace(slug, '-', '') AS key FROM ({TYPED} WHERE o_custkey % 3 = 0))
SELECT round, count(DISTINCT key) AS missing, count(DISTINCT key) FILTER (name LIKE '%Pvt%') AS with_suffix FROM l WHERE round IN (SELECT round FROM t) AND (round, key) NOT IN (SELECT (round, key) FROM t) GROUP BY round""")
def missing_awardees(t):
    """J-31."""
    return steps.missing_awardees(made(t, LISTED, "orders"), made(t, TYPED + " WHERE o_custkey % 3 = 0", "orders"))


@query("SELECT o_custkey AS company_id, arg_max('DIPP' || o_orderkey, {'a': o_orderdate, 'b': 'Recognised (DIPP' || o_orderkey || ')'}) AS number FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1")
def held_numbers(t):
    """J-32."""
    k = F.col("o_orderkey")
    label = F.when(k % 3 == 0, F.concat(F.lit("Recognised (DIPP"), k, F.lit(")"))).otherwise(F.concat(F.lit("Listed "), k))
    return steps.held_numbers(t.raw("orders").select(F.col("o_custkey").alias("company_id"), label.alias("label"), F.col("o_orderdate").alias("found_at")))


@query("SELECT c_custkey AS domain, CASE WHEN s_suppkey IS NULL THEN 0 WHEN s_nationkey % 3 = 0 THEN 1 ELSE 2 END AS turn FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey ORDER BY turn, s_nationkey NULLS FIRST, c_custkey LIMIT 200")
def lookup_queue(t):
    """O-14: the head of the queue."""
    cache = t.raw("supplier").select(F.col("s_suppkey").alias("domain"), F.when(F.col("s_nationkey") % 3 == 0, "failed").otherwise("hit").alias("outcome"), F.col("s_nationkey").alias("asked_at"))
    return steps.lookup_queue(t.raw("customer").select(F.col("c_custkey").alias("domain")), cache).limit(200).select("domain", "turn")


@query("SELECT id FROM companies ORDER BY CASE sector_id WHEN '3' THEN 1 WHEN '1' THEN 2 ELSE 3 END, CAST(substr(id, 2) AS BIGINT) LIMIT 200")
def by_priority(t):
    """O-15: the head of the queue."""
    return steps.by_priority(t.companies.withColumns({"source": F.coalesce("sector_id", F.lit("")), "seq": F.substring("id", 2, 20).cast("bigint")}), ["3", "1"]).limit(200).select("id")


_WINNERS, _GRID = "SELECT s_nationkey AS key, s_suppkey AS pos, s_name AS name FROM supplier", "SELECT n_nationkey AS key, n_regionkey AS pos, n_name AS name FROM nation"


@query(f", w AS (SELECT key, arg_min(name, pos) AS name FROM ({_WINNERS} WHERE s_nationkey % 2 = 0) GROUP BY key) SELECT key, name FROM w UNION ALL SELECT key, name FROM ({_GRID}) WHERE key NOT IN (SELECT key FROM w)")
def winners_then_grid(t):
    """T-05, S-16."""
    return steps.ordered_union(made(t, _WINNERS + " WHERE s_nationkey % 2 = 0", "supplier"), made(t, _GRID, "nation"), "key", "pos").select("key", "name")


@query("SELECT id, name FROM companies WHERE sector_id IN ('1', '2', '3') OR first_seen IS NULL")
def union_reads(t):
    """T-07, T-02: several reads of one table, each id once."""
    reads = [t.companies.where(F.col("sector_id") == s) for s in "123"] + [t.companies.where("first_seen is null")]
    return steps.union_by_id(*[r.select("id", "name") for r in reads])


@query("""SELECT coalesce(o.k, n.k) AS company_id, coalesce(n.body, o.body) AS body, coalesce(o.at, '2001-08-01') AS created_at, CASE WHEN n.k IS NULL THEN o.at ELSE '2001-08-01' END AS updated_at
FROM (SELECT s_suppkey AS k, s_name AS body, '2000-01-01' AS at FROM supplier) o FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END AS body FROM customer WHERE c_custkey % 3 = 0) n ON o.k = n.k WHERE trim(coalesce(n.body, o.body)) <> ''""")
def upsert_notes(t):
    """U-14."""
    old = t.raw("supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("body"), F.lit("2000-01-01").alias("created_at"), F.lit("2000-01-01").alias("updated_at"))
    new = t.raw("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("company_id"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name")).alias("body"))
    return merge.upsert_notes(old, new, F.lit(TODAY))


@query("SELECT id, CASE WHEN product IS NULL THEN 'unreachable' WHEN coalesce(website_identity <> 'verified', true) THEN 'unverified' WHEN description IS NULL THEN 'nothing-stated' ELSE 'read' END AS status FROM companies")
def product_statuses(t):
    """E-16, E-23."""
    return t.companies.select("id", steps.product_status(F.col("website_identity"), F.col("product"), F.lit("unreachable"), F.col("description")).alias("status"))


BASES = "SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'Self-reported by the founder' WHEN 1 THEN 'Checked by hand against a government list' WHEN 2 THEN 'absence from a third-party list' WHEN 3 THEN 'the founder says' WHEN 4 THEN 'third-party page, not verified' WHEN 5 THEN 'checked by hand' WHEN 6 THEN 'a third-party page' ELSE p_name END AS basis FROM part"


@query(f""", i AS ({BASES}), w AS (SELECT * FROM (VALUES (1, 'self-reported', 'unverified'), (2, 'not verified', 'unverified'), (3, 'government', 'record'), (4, 'checked by hand', 'checked'), (5, 'absence', 'absent'), (6, 'third-party', 'third'), (7, 'founder', 'founder')) w(k, word, kind))
SELECT id, coalesce(arg_min(kind, k), 'own') AS kind FROM i LEFT JOIN w ON contains(lower(basis), word) GROUP BY id""")
def basis_kinds(t):
    """E-21."""
    return made(t, BASES, "part").select("id", steps.basis_kind(F.col("basis")).alias("kind"))


@query("SELECT p_partkey AS label, coalesce(n.topic, CAST(p_partkey AS STRING)) AS topic FROM part LEFT JOIN (SELECT number, arg_min(n_name, n_nationkey) AS topic FROM (SELECT n_nationkey, n_name, unnest([n_nationkey * 3, n_nationkey * 5, 7]) AS number FROM nation) GROUP BY 1) n ON p_partkey = n.number")
def regrouped_labels(t):
    """E-22."""
    labels = t.raw("part").select(F.col("p_partkey").alias("number"), F.col("p_partkey").cast("string").alias("label"))
    n = F.col("n_nationkey")
    answers = t.raw("nation").select(n.alias("place"), F.col("n_name").alias("topic"), F.array(n * 3, n * 5, F.lit(7).cast("bigint")).alias("numbers"))
    return steps.regrouped(labels, answers).select(F.col("label").cast("bigint").alias("label"), "topic")


@query("SELECT id, name FROM base WHERE subsector_id = '2.3' AND sector_id = '2' AND is_company")
def lenient_view(t):
    """F-21, F-22: wrong values are left out, and the sub-sector wins over another sector."""
    view = views.parse_view({"sector": "4", "subsector": "2.3", "kind": "company", "traces": "17", "nonsense": "x", "described": ""}, strict=False)
    return views.filtered(t.base, t.signals, view).select("id", "name")


@query("SELECT 'INDIA' AS name, coalesce(max(CAST(n_regionkey AS STRING)), 'none') AS value FROM nation WHERE n_name = 'INDIA' UNION ALL SELECT 'NOWHERE', 'none'")
def settings(t):
    """P-14: a key's value, or a default."""
    rows = t.raw("nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return steps.setting(rows, "INDIA", "none").select(F.lit("INDIA").alias("name"), "value").union(steps.setting(rows, "NOWHERE", "none").select(F.lit("NOWHERE"), "value"))


_ROLES = "string_split(p_type || ' ' || p_brand || ' ' || p_type, ' ')"


@query(f""", r AS (SELECT p_partkey AS id, unnest({_ROLES}) AS role, generate_subscripts({_ROLES}, 1) AS k FROM part), d AS (SELECT id, lower(role) AS key, min(k) AS k, arg_min(role, k) AS role FROM r GROUP BY 1, 2)
SELECT id, count(*)::INT AS n, array_to_string(list(role ORDER BY k)[1:3], ',') AS first FROM d GROUP BY id""")
def page_roles(t):
    """A-30, N-08."""
    titles = F.split(F.concat_ws(" ", "p_type", "p_brand", "p_type"), " ")
    found = t.raw("part").select(F.col("p_partkey").alias("id"), steps.distinct_roles(titles, 3).alias("r"))
    return found.select("id", F.col("r.count").alias("n"), F.array_join("r.first", ",").alias("first"))


@query("""SELECT p_partkey AS id, p_size % 6 AS sector_id, n_nationkey AS subsector_id, CASE WHEN p_size % 4 IN (0, 1) AND n_nationkey IS NOT NULL THEN p_size % 4 END AS project_type, n_nationkey IS NOT NULL AS on_map
FROM part LEFT JOIN nation ON p_size % 6 = n_regionkey AND p_partkey % 25 = n_nationkey""")
def valid_placements(t):
    """E-13, A.20: answers of a classifier made consistent."""
    answers = t.raw("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 6).alias("sector_id"), (F.col("p_partkey") % 25).alias("subsector_id"), (F.col("p_size") % 4).alias("project_type"))
    taxonomy = t.raw("nation").select(F.col("n_regionkey").alias("sector_id"), F.col("n_nationkey").alias("subsector_id"), F.expr("array(0, 1)").alias("projects"))
    return steps.valid_placements(answers, taxonomy)


_NAMES = "SELECT p_partkey AS id, substr(p_name, 1, 5) || ' ' || substr(p_brand, 7) || CASE WHEN p_partkey % 3 = 0 THEN ' Co' ELSE '' END AS name FROM part"


@query(f""", n AS ({_NAMES}), f AS (SELECT lower(name) AS name, min(id) AS id FROM n GROUP BY 1)
SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.id < b.id AND levenshtein(a.name, b.name) <= 2 UNION ALL SELECT f.id, n.id FROM n JOIN f ON lower(n.name) = f.name WHERE n.id <> f.id""")
def near_name_pairs(t):
    """E-19."""
    return steps.near_duplicate_pairs(made(t, _NAMES, "part"))


@query("SELECT id, CASE WHEN sector_id = '2' THEN 'State X' ELSE state END AS state, CASE WHEN city = 'jharkhand' THEN NULL ELSE city END AS city FROM companies")
def migrated_rows(t):
    """U-17."""
    return steps.migrated(t.companies.select("id", "state", "city", "sector_id"), {"state": (F.col("sector_id") == "2", F.lit("State X")), "city": (F.col("city") == "jharkhand", F.lit(None).cast("string"))}).drop("sector_id")


@query("""SELECT id, CASE WHEN sector_id = '2' THEN CAST(coalesce(founded_year, origin_year) AS STRING) ELSE '2001-08-01' END AS first_seen,
CASE WHEN coalesce(sector_id, '') <> '2' THEN 'discovered' WHEN coalesce(founded_year, origin_year) IS NOT NULL THEN 'cohort' END AS first_seen_basis FROM companies""")
def first_seen_of_new(t):
    """U-09: a cohort year or nothing in a backfill, else the day of the run."""
    rows = t.companies.select("id", F.col("founded_year").alias("source_year"), "origin_year", "sector_id")
    return merge.with_first_seen(rows, F.coalesce(F.col("sector_id") == "2", F.lit(False)), F.lit(TODAY)).select("id", "first_seen", "first_seen_basis")


@query("SELECT id, name, trace_count FROM (SELECT * REPLACE (CASE WHEN id LIKE '%7' THEN name || ' 1%_' WHEN id LIKE '%8' THEN name || ' 1xy' ELSE name END AS name) FROM base) WHERE contains(lower(name), '1%_') OR contains(description, '1%_') OR contains(product, '1%_')")
def filter_search_literal_percent(t):
    """F-04: the signs of patterns stand for themselves."""
    mark = F.when(F.col("id").endswith("7"), F.concat("name", F.lit(" 1%_"))).when(F.col("id").endswith("8"), F.concat("name", F.lit(" 1xy"))).otherwise(F.col("name"))
    return views.filtered(t.base.withColumn("name", mark), t.signals, views.View(search="1%_")).select("id", "name", "trace_count")



_RUN = """
, keyed AS (SELECT *, CAST(substr(id, 2) AS INT) AS k FROM companies),
held AS (
  SELECT id, k, k % 3 <> 0 AS had, CASE WHEN k % 3 <> 0 THEN first_seen ELSE CAST(coalesce(founded_year, origin_year) AS STRING) END AS seen,
    CASE WHEN k % 3 <> 0 THEN first_seen_basis WHEN coalesce(founded_year, origin_year) IS NOT NULL THEN 'cohort' END AS basis FROM keyed WHERE k % 3 <> 0 OR k % 2 = 0),
events AS (SELECT company_id AS id, min(date) AS event, list(date) FILTER (length(date) = 10) AS days FROM signals WHERE date IS NOT NULL GROUP BY 1),
first AS (SELECT held.*, event, coalesce(seen, event) AS f, CASE WHEN seen IS NULL AND event IS NOT NULL THEN 'cohort' ELSE basis END AS b, days FROM held LEFT JOIN events USING (id)),
seen_at AS (
  SELECT id, k, b, CASE WHEN b = 'cohort' AND length(f) = 4 THEN CASE WHEN len(list_filter(days, lambda d: starts_with(d, f))) > 0 THEN list_min(list_filter(days, lambda d: starts_with(d, f))) ELSE f END ELSE f END AS f FROM first),
m AS (SELECT id AS src, 'c' || CAST(k - 4 AS STRING) AS dst FROM seen_at WHERE k % 30 = 5 AND 'c' || CAST(k - 4 AS STRING) IN (SELECT id FROM seen_at)),
best AS (SELECT dst, arg_min(f, {'a': f, 'b': b}) AS f, arg_min(b, {'a': f, 'b': b}) AS b FROM m JOIN seen_at ON src = id WHERE f IS NOT NULL GROUP BY dst)
"""


@query(_RUN + """SELECT id, CASE WHEN best.f IS NOT NULL AND (seen_at.f IS NULL OR best.f < seen_at.f) THEN best.f ELSE seen_at.f END AS first_seen,
CASE WHEN best.f IS NOT NULL AND (seen_at.f IS NULL OR best.f < seen_at.f) THEN best.b ELSE seen_at.b END AS first_seen_basis
FROM seen_at LEFT JOIN best ON id = dst WHERE id NOT IN (SELECT src FROM m)""")
def ingest_run(t):
    """U-08 to U-13: a source's first run, with what it makes of the dates of new, dated and merged rows."""
    k = F.substring("id", 2, 9).cast("int")
    whole = t.companies.withColumns({"product_status": F.lit(None).cast("string"), "website_identity": F.lit(None).cast("string"), "trace_count": F.lit(0), "outside_count": F.lit(0), "other_count": F.lit(0), "tier": F.lit("C")})
    nothing = t.gaps.limit(0)
    old = merge.Snapshot(whole.where(k % 3 != 0), t.signals, nothing)
    batch = merge.Snapshot(whole.where(k % 2 == 0).withColumn("source_year", F.col("founded_year")), t.signals.limit(0), nothing)
    merges = t.companies.where(k % 30 == 5).select(F.col("id").alias("from"), F.concat(F.lit("c"), k - 4).alias("into"))
    return merge.ingest(old, t.runs, "sine-iitb", batch, merges, t.now).snapshot.companies.select("id", "first_seen", "first_seen_basis")


def _cell(x: str) -> str:
    return f"""'"' || replace(coalesce(CASE WHEN regexp_matches({x}, '^[=+@\\t\\r-]') THEN '''' || {x} ELSE {x} END, ''), '"', '""') || '"'"""


_CELLS = {c: "NULL::VARCHAR" for c in export.COLUMNS} | {c: c for c in ("name", "website", "website_identity", "founders", "dpiit_status", "city", "state", "tier")} | {
    "builds": "product",
    "builds_from": f"CASE WHEN product <> '' THEN '{export.OWN_HOMEPAGE.replace(chr(39), chr(39) * 2)}' END",
    "source_description": f"CASE WHEN description LIKE 'DPIIT-recognised startup.%' THEN CASE dpiit_status {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in said.STATUS_PHRASES.items())} ELSE 'On the DPIIT Startup India register' END || '.' || substr(description, 26) ELSE description END",
    "website_looked_for": "CASE WHEN website_checked THEN 'yes' ELSE 'no' END",
    "contact_email": "CASE WHEN website_identity = 'verified' THEN contact_email END",
    "contact_page": "CASE WHEN website_identity = 'verified' THEN contact_page END",
    "build_tags": "array_to_string(build_tags, '; ')",
    "domain_tags": "array_to_string(domain_tags, '; ')",
    "programme_count": "CAST(programme_count AS VARCHAR)",
    "rdi_sector": "sector_id",
    "rdi_subsector": "subsector_id",
    "placed_from": "classify_basis",
    "public_traces": "CAST(trace_count AS VARCHAR)",
    "on_record": "first_seen",
    "on_record_basis": "first_seen_basis",
    "started": "CAST(coalesce(origin_year, founded_year) AS VARCHAR)",
    "page": "'https://x.example/c/' || id",
}


@query(f"SELECT id, {' || chr(44) || '.join(_cell(f'({_CELLS[c]})') for c in export.COLUMNS)} AS line FROM (SELECT * REPLACE (CASE WHEN id LIKE '%3' THEN '=\"' || name || '\"' ELSE name END AS name) FROM base)")
def csv_export(t):
    """K-04: all 41 columns, with quotes and formulas in some names."""
    name = F.when(F.col("id").endswith("3"), F.concat(F.lit('="'), "name", F.lit('"'))).otherwise(F.col("name"))
    return export.lines(t.base.withColumn("name", name), "https://x.example")


# --- a run with signals and gaps ----------------------------------------------------------------------------------

# old tables without one source, a batch of that source with its signals and gaps, and some merges
_WHOLE = """
, k AS (SELECT *, CAST(substr(id, 2) AS INT) AS k FROM companies),
placed AS (SELECT id, website_identity FROM k WHERE k % 4 = 0), known AS (SELECT id FROM k WHERE k % 3 <> 0 OR k % 4 = 0),
holes AS (SELECT company_id FROM gaps WHERE company_id LIKE 'c%'), gone AS (SELECT company_id FROM holes WHERE company_id NOT IN (SELECT id FROM placed)),
rows AS (SELECT id, CAST(substr(id, 2) AS INT) AS k FROM known WHERE id NOT IN (SELECT company_id FROM gone)),
m AS (SELECT id AS src FROM rows WHERE k % 30 = 5 AND 'c' || CAST(k - 1 AS STRING) IN (SELECT id FROM rows)),
old AS (SELECT * FROM signals WHERE source <> 'sine-iitb'),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, type, label ORDER BY date NULLS FIRST, source) AS n FROM signals WHERE source = 'sine-iitb') WHERE n = 1 AND company_id IN (SELECT id FROM known)),
after AS (SELECT company_id, type, label, date, source FROM old UNION ALL SELECT company_id, type, label, date, source FROM fresh ANTI JOIN old USING (company_id, type, label))
"""


def _run_with_all(t):
    k = F.substring("id", 2, 9).cast("int")
    whole = t.companies.withColumns({"product_status": F.lit(None).cast("string"), "trace_count": F.lit(0), "outside_count": F.lit(0), "other_count": F.lit(0), "tier": F.lit("C")})
    mine = F.col("source") == "sine-iitb"
    gap = F.col("company_id").startswith("c")
    old = merge.Snapshot(whole.where(k % 3 != 0), t.signals.where(~mine), t.gaps)
    batch = merge.Snapshot(whole.where(k % 4 == 0).withColumn("source_year", F.col("founded_year")), t.signals.where(mine), t.gaps.where(gap).withColumns({"missing": F.lit("new hole"), "description": F.lit(None).cast("string")}))
    merges = t.companies.where(k % 30 == 5).select(F.col("id").alias("from"), F.concat(F.lit("c"), k - 1).alias("into"))
    return merge.ingest(old, t.runs, "sine-iitb", batch, merges, t.now)


@query(_WHOLE + """SELECT company_id, type, label, date, source FROM after WHERE company_id NOT IN (SELECT company_id FROM gone) AND company_id NOT IN (SELECT src FROM m)
AND NOT (type = 'website' AND company_id IN (SELECT id FROM placed WHERE website_identity <> 'verified'))""")
def ingest_run_signals(t):
    """U-02, U-04, U-05, U-12, U-13, J-21, T-03: a run's signals: new ones of known companies, without withdrawn and merged ones."""
    return _run_with_all(t).snapshot.signals.select("company_id", "type", "label", "date", "source")


@query(_WHOLE + """SELECT company_id, name, CASE WHEN company_id LIKE 'c%' THEN 'new hole' ELSE missing END AS missing, description, source FROM gaps
WHERE company_id NOT IN (SELECT id FROM placed) AND company_id NOT IN (SELECT src FROM m)""")
def ingest_run_gaps(t):
    """U-03, U-04, J-23: a run's gaps: renewed, and none for what the run placed."""
    return _run_with_all(t).snapshot.gaps.select("company_id", "name", "missing", "description", "source")


@query(_WHOLE + """SELECT id FROM rows WHERE id NOT IN (SELECT src FROM m)""")
def ingest_run_rows(t):
    """U-01, U-04, U-12, J-24: the rows that a run leaves."""
    return _run_with_all(t).snapshot.companies.select("id")


_LINES = f"""SELECT id, trace_count, first_seen, {' || chr(44) || '.join(_cell(f'({_CELLS[c]})') for c in export.COLUMNS)} AS line FROM base WHERE trace_count >= 3"""


@query(f""", l AS ({_LINES}) SELECT row_number() OVER (ORDER BY trace_count, first_seen DESC NULLS LAST, id) AS pos, line FROM l UNION ALL SELECT 0, chr(65279) || '{','.join(f'"{c}"' for c in export.COLUMNS)}'""")
def csv_file(t):
    """K-04: the file of a view, whole and in the view's order, under its header."""
    return export.file(views.filtered(t.base, t.signals, views.View(traces="3+")), ["trace_count", F.desc_nulls_last("first_seen"), "id"], "https://x.example")
