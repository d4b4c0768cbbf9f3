"""Registered queries of the keyword classifier, batched searches, the page cache and record lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import classify, frontier
from lodestone.plans.catalog import query
from lodestone.sources import pagecache, records, site

# --- placing texts in a taxonomy ----------------------------------------------------------------------------------

# the taxonomy's terms: the benchmark's words of five letters or more, and its pairs of a two- and a three-letter word
_TERMS = """
words AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)),
named AS (
  SELECT DISTINCT word AS term FROM words WHERE regexp_full_match(word, '[a-z]{5,}')
  UNION SELECT a.word || ' ' || b.word FROM words a JOIN words b ON a.item_id = b.item_id AND b.i = a.i + 1 WHERE regexp_full_match(a.word, '[a-z]{2}') AND regexp_full_match(b.word, '[a-z]{3}')),
terms AS (
  SELECT term, CAST(ascii(substr(term, 2)) % 4 + 1 AS VARCHAR) AS sector, (ascii(substr(term, 2)) % 4 + 1) || '.' || (length(term) % 3 + 1) AS sub,
    CASE WHEN length(term) % 2 = 0 THEN 'p' || (ascii(substr(term, 4)) % 2) END AS project, length(term) AS weight FROM named)"""


def taxonomy_terms(t):
    words = t.raw("benchmark").select("item_id", F.posexplode(classify.words_of(F.col("text"))).alias("i", "word"))
    pairs = words.alias("a").join(words.alias("b"), (F.col("a.item_id") == F.col("b.item_id")) & (F.col("b.i") == F.col("a.i") + 1))
    pairs = pairs.where(F.col("a.word").rlike("^[a-z]{2}$") & F.col("b.word").rlike("^[a-z]{3}$")).select(F.concat_ws(" ", "a.word", "b.word").alias("term"))
    terms = words.where(F.col("word").rlike("^[a-z]{5,}$")).select(F.col("word").alias("term")).union(pairs).distinct()
    sector = (F.ascii(F.substring("term", 2, 1)) % 4 + 1).cast("string")
    project = F.when(F.length("term") % 2 == 0, F.concat(F.lit("p"), F.ascii(F.substring("term", 4, 1)) % 2))
    return terms.select(sector.alias("sector_id"), F.concat(sector, F.lit("."), F.length("term") % 3 + 1).alias("subsector_id"), project.alias("project_type"), "term", F.length("term").alias("weight"))


_PLACED = f"""{_TERMS},
own AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
single AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM own),
double AS (SELECT DISTINCT doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) AS term FROM own WHERE len(w) > 1),
hits AS (SELECT doc_id, terms.* FROM (SELECT * FROM single UNION SELECT * FROM double) JOIN terms USING (term)),
s AS (SELECT doc_id, sector, sum(weight) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY sum(weight) DESC, sector) AS k FROM hits GROUP BY 1, 2),
s1 AS (SELECT a.doc_id, a.sector FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND b.k = 2 WHERE a.k = 1 AND a.n >= 20 AND a.n - coalesce(b.n, -9) >= 3),
u AS (SELECT doc_id, sub, sum(weight) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY sum(weight) DESC, sub) AS k FROM hits SEMI JOIN s1 USING (doc_id, sector) GROUP BY 1, 2),
u1 AS (SELECT a.doc_id, a.sub FROM u a LEFT JOIN u b ON a.doc_id = b.doc_id AND b.k = 2 WHERE a.k = 1 AND a.n >= 20 AND a.n - coalesce(b.n, -9) >= 3),
p AS (SELECT doc_id, arg_min(project, {{'n': -n, 'p': project}}) AS project FROM (SELECT doc_id, project, sum(weight) AS n FROM hits SEMI JOIN u1 USING (doc_id, sub) WHERE project IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
note AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT term))[:5], ', ') AS note FROM hits SEMI JOIN u1 USING (doc_id, sub) GROUP BY 1)
"""


@query(", " + _PLACED.strip() + " SELECT d.doc_id AS id, sector AS sector_id, sub AS subsector_id, project AS project_type, note FROM documents d LEFT JOIN s1 USING (doc_id) LEFT JOIN u1 USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN note USING (doc_id)")
def keyword_placement(t):
    """E-13: the keyword classifier over all documents."""
    rows = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    return classify.KeywordClassifier(taxonomy_terms(t), least=20, margin=3).place(rows)


@query(", " + _PLACED.strip() + """,
cache AS (SELECT doc_id AS id, length(text) AS hash, lang AS sector FROM documents WHERE doc_id % 3 = 0),
anywhere AS (SELECT hash, arg_min(sector, id) AS sector FROM cache GROUP BY 1)
SELECT d.doc_id AS id, CASE WHEN quality = 1 AND toxic = 1 THEN 'by hand' WHEN c.id IS NOT NULL THEN c.sector WHEN w.hash IS NOT NULL THEN w.sector ELSE s1.sector END AS sector_id,
  CASE WHEN quality = 1 AND toxic = 1 THEN 'override' WHEN c.id IS NOT NULL THEN 'cache' WHEN w.hash IS NOT NULL THEN 'hash' WHEN s1.sector IS NULL THEN 'none' ELSE 'asked' END AS origin
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN cache c ON d.doc_id = c.id LEFT JOIN anywhere w ON length(d.text) = w.hash LEFT JOIN s1 USING (doc_id)""")
def classify_cascade(t):
    """E-13, J-15, J-30: a hand-made answer, else the cache, else the classifier."""
    none = F.lit(None).cast("string")
    rest = [none.alias(c) for c in classify.ANSWER[1:]]
    rows = t.raw("documents").select(F.col("doc_id").alias("id"), F.length("text").alias("hash"), "text", "lang")
    cache = rows.where("id % 3 = 0").select("id", "hash", F.col("lang").alias("sector_id"), *rest)
    hand = t.raw("labels").where("quality = 1 and toxic = 1").select(F.col("doc_id").alias("id"), F.lit("by hand").alias("sector_id"), *rest)
    keywords = classify.KeywordClassifier(taxonomy_terms(t), least=20, margin=3)
    return classify.classify(rows.drop("lang"), cache, hand, keywords).select("id", "sector_id", "origin")


# --- searches in batches ------------------------------------------------------------------------------------------

_NEEDLES = """
ws AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS needle FROM benchmark),
needles AS (SELECT row_number() OVER (ORDER BY needle) - 1 AS no, needle FROM ws),
pairs AS (SELECT no, doc_id FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS needle FROM documents) JOIN needles USING (needle))"""
_FRONTIER = f""",{_NEEDLES},
asks AS (
  SELECT 1 AS round, b.lo, b.hi, count(DISTINCT doc_id) AS total FROM (SELECT DISTINCT no - no % 16 AS lo, least(no - no % 16 + 16, (SELECT count(*) FROM needles)) AS hi FROM needles) b
  LEFT JOIN pairs ON no >= lo AND no < hi GROUP BY ALL
  UNION ALL
  SELECT round, lo, hi, count(DISTINCT doc_id) AS total FROM (
    SELECT round + 1 AS round, unnest([lo, (lo + hi) // 2]) AS lo, unnest([(lo + hi) // 2, hi]) AS hi FROM asks WHERE total > 30 AND hi - lo > 1) b
  LEFT JOIN pairs ON no >= lo AND no < hi GROUP BY ALL)
"""


def _needles(t):
    def words(name, key):
        return t.raw(name).select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1))).alias("needle"))

    needles = frontier.numbered(words("benchmark", "item_id"))
    return needles, words("documents", "doc_id").join(needles, "needle").select("no", F.col("doc_id").alias("work_id"))


@query(_FRONTIER.replace(", ", ", ", 1) + "SELECT no, needle, lo::BIGINT AS lo, hi::BIGINT AS hi, total, CASE WHEN total > 120 THEN 'broad' ELSE 'ok' END AS outcome FROM asks JOIN needles ON no >= lo AND no < hi WHERE total <= 30 OR hi - lo = 1")
def needle_batches(t):
    """S-19: the benchmark's words searched for in all documents, in batches that are halved on overflow."""
    needles, matches = _needles(t)
    return frontier.resolve(needles, matches, batch=16, page=30, most=120).needles


@query(_FRONTIER + "SELECT round, count(*) AS requests, sum(CASE WHEN hi - lo = 1 AND total <= 120 THEN greatest(ceil(total / 30), 1) ELSE 1 END)::BIGINT AS pages FROM asks GROUP BY round")
def needle_requests(t):
    """S-19: what each round asks for."""
    needles, matches = _needles(t)
    found = frontier.resolve(needles, matches, batch=16, page=30, most=120).requests
    return found.groupBy("round").agg(F.count("*").alias("requests"), F.sum("pages").alias("pages"))


# --- pages --------------------------------------------------------------------------------------------------------

_PAGES = """
p AS (SELECT page_id, url || '&n=' || page_id AS url, html, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'q' || (page_id % 2) END AS body, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (page_id % 60) AS held_at FROM pages),
held AS (SELECT * FROM p WHERE page_id % 5 <> 0),
asked AS (SELECT p.* FROM p WHERE page_id % 5 = 0 OR held_at < TIMESTAMP '2024-03-01' - INTERVAL 30 DAY),
ans AS (SELECT *, CASE page_id % 7 WHEN 0 THEN 503 WHEN 1 THEN 304 WHEN 2 THEN 200 WHEN 3 THEN 404 ELSE 200 END AS code, CASE WHEN page_id % 7 = 4 THEN html || '<!-- new -->' ELSE html END AS new FROM asked)
"""
_NOW = "2024-03-01"


def _pages(t):
    p = t.raw("pages")
    n = F.col("page_id")
    body = F.when(n % 4 != 0, F.concat(F.lit("q"), n % 2))
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(n % 60).cast("int"))
    rows = pagecache.keyed(p.select("page_id", F.concat("url", F.lit("&n="), n).alias("url"), "html", body.alias("body"), at.alias("held_at")))
    held = rows.where("page_id % 5 <> 0")
    etag = F.when(n % 3 == 0, F.concat(F.lit("e"), n))
    cache = held.select(*pagecache.KEY, F.col("held_at").alias("fetched_at"), F.col("html").alias("response"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(1).cast("bigint").alias("version"))
    return rows, cache


@query("," + _PAGES + """SELECT url, CASE WHEN page_id % 5 <> 0 AND page_id % 3 = 0 THEN 'e' || page_id END AS if_none_match FROM asked""")
def pages_to_ask(t):
    """S-01: stale and unknown pages, with what to ask them by."""
    rows, cache = _pages(t)
    return pagecache.to_ask(rows, cache, F.lit(_NOW).cast("timestamp")).select("url", "if_none_match")


@query("," + _PAGES + """SELECT p.url, CAST(CASE WHEN code = 200 OR (code = 304 AND p.page_id % 5 <> 0) THEN TIMESTAMP '2024-03-01' ELSE p.held_at END AS VARCHAR) AS fetched_at,
  md5(CASE WHEN code = 200 THEN new ELSE p.html END) AS digest, CASE WHEN code = 200 THEN 'n' || p.page_id WHEN p.page_id % 3 = 0 THEN 'e' || p.page_id END AS etag,
  CASE WHEN code = 200 AND p.page_id % 5 <> 0 AND new <> p.html THEN 2 ELSE 1 END::BIGINT AS version
FROM p LEFT JOIN ans ON p.page_id = ans.page_id WHERE p.page_id % 5 <> 0 OR code = 200""")
def page_cache_merge(t):
    """S-01, A-27: answers 304, 2xx and others merged into the cache."""
    rows, cache = _pages(t)
    n = F.col("page_id")
    asked = rows.join(pagecache.to_ask(rows, cache, F.lit(_NOW).cast("timestamp")).select(*pagecache.KEY), pagecache.KEY)
    code = F.when(n % 7 == 0, 503).when(n % 7 == 1, 304).when(n % 7 == 3, 404).otherwise(200)
    body = F.when(code == 200, F.when(n % 7 == 4, F.concat("html", F.lit("<!-- new -->"))).otherwise(F.col("html")))
    answers = asked.select(*pagecache.KEY, code.alias("code"), body.alias("response"), F.concat(F.lit("n"), n).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(_NOW).cast("timestamp").alias("at"))
    return pagecache.merged(cache, answers).select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), F.md5("response").alias("digest"), "etag", "version")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_capture, count(*) FILTER (ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 MONTH) AS captures,
  count(DISTINCT CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN event_type || floor(value) END) AS versions FROM events WHERE event_id % 10 <> 0 GROUP BY 1""")
def archive_versions(t):
    """S-18: first captures and distinct versions of addresses."""
    e = t.raw("events")
    captures = e.select(F.col("user_id").alias("url"), F.col("ts").alias("at"), F.concat("event_type", F.floor("value")).alias("digest"), F.when(F.col("event_id") % 10 == 0, 404).otherwise(200).alias("status"))
    found = pagecache.versions(captures, F.lit("2024-01-20").cast("timestamp"))
    return found.select(F.col("url").alias("user_id"), F.date_format("first_capture", "yyyy-MM-dd HH:mm:ss").alias("first_capture"), "captures", "versions")


# --- records at any depth -----------------------------------------------------------------------------------------

# an order's lines as a list of records, in documents of five shapes: at the top, one and three levels down, beside a list
# that is none, and cut off
_RECORD = """'{"title":"' || l_linenumber || '","desci":' || l_suppkey || ',"category":' || CASE WHEN l_linenumber % 2 = 0 THEN 'null' ELSE '"' || l_returnflag || '"' END || '}'"""
_WRAP = """CASE k % 5 WHEN 0 THEN list WHEN 1 THEN '{"props":{"rows":' || list || '},"x":[1,{"title":2}]}' WHEN 2 THEN '{"a":[{"b":{"c":' || list || ',"n":[]}},' || list || ']}'
  WHEN 3 THEN '{"odd":[' || substr(list, 2, length(list) - 2) || ',{"title":1}],"t":"[]"}' ELSE substr(list, 1, length(list) - 1) END"""
_DOCS = f"SELECT k, {_WRAP} AS json FROM (SELECT l_orderkey AS k, '[' || string_agg({_RECORD}, ',' ORDER BY l_linenumber, {_RECORD}) || ']' AS list FROM lineitem GROUP BY 1)"


@query(f""", docs AS ({_DOCS}),
tree AS (SELECT k, t.id, t.parent, t.fullkey, t.type, t.value, t.key FROM docs, json_tree(docs.json) AS t WHERE json_valid(docs.json)),
full_lists AS (SELECT k, parent FROM tree WHERE parent IS NOT NULL GROUP BY k, parent
  HAVING bool_and(type = 'OBJECT' AND coalesce(json_exists(value, '$.title') AND json_exists(value, '$.desci') AND json_exists(value, '$.category'), false)))
SELECT r.k AS doc, replace(replace(replace(l.fullkey, '[', '.'), ']', ''), '"', '') AS path, CAST(r.key AS INT) AS place, CAST(r.value->'$.desci' AS BIGINT) AS desci
FROM tree r JOIN full_lists f ON r.k = f.k AND r.parent = f.parent JOIN tree l ON l.k = r.k AND l.id = r.parent WHERE l.type = 'ARRAY'""")
def json_record_lists(t):
    """S-12, N-05, N-03: the lists of records in documents of several shapes."""
    items = t.raw("lineitem")
    category = F.when(F.col("l_linenumber") % 2 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), "l_returnflag", F.lit('"')))
    record = F.concat(F.lit('{"title":"'), "l_linenumber", F.lit('","desci":'), "l_suppkey", F.lit(',"category":'), category, F.lit("}"))
    grouped = items.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", record.alias("r")))).alias("rs"))
    listed = grouped.select("k", F.concat(F.lit("["), F.array_join("rs.r", ","), F.lit("]")).alias("list"))
    docs = listed.select(F.col("k").alias("doc"), F.expr(_WRAP).alias("json"))
    found = records.record_lists(docs, ("title", "desci", "category"))
    return found.select("doc", "path", "place", F.get_json_object("record", "$.desci").cast("bigint").alias("desci"))


# --- what home pages say ------------------------------------------------------------------------------------------

# pages with links, addresses and headings planted behind them, which vary from page to page
_BLOCK = """'<p>Write to ' || CASE page_id % 5 WHEN 0 THEN 'Ceo@' || own || ', or info@' || own || '.' WHEN 1 THEN 'a@gmail.com' WHEN 2 THEN 'noreply@' || own || ' career@' || own WHEN 3 THEN 'x@mail.' || own || '; y@' || own ELSE 'hr@' || own END
  || '</p><script>hello@' || own || '</script>' || CASE WHEN page_id % 7 = 0 THEN '<a href="https://jobs.lever.co/x">Apply</a>' ELSE '' END
  || CASE page_id % 3 WHEN 0 THEN '<a href="/careers/senior">Senior</a><a href="/careers">Work</a>' WHEN 1 THEN '<a href="/x">Join our team</a>' ELSE '<a href="/teams">None</a>' END
  || CASE page_id % 4 WHEN 0 THEN '<a href="/about/team">Who</a><a href="/the/About_us/2">We</a>' WHEN 1 THEN '<a href="/who">Who we are</a><a href="/people.html">P</a>' WHEN 2 THEN '<a href="/about.pdf">About</a>' ELSE '<a href="/?about">Company</a>' END
  || CASE page_id % 6 WHEN 0 THEN '<a href="/p/contact-us#form">Write</a>' WHEN 1 THEN '<a href="/hello#us">Contact Us!</a><a href="/contactless">C</a>' WHEN 2 THEN '<a href="/jobs/contact">Contact</a>' ELSE '<a href="#contact">Contact</a>' END
  || CASE page_id % 4 WHEN 1 THEN '<a href="https://www.github.com/login/x">in</a><a href="https://github.com/Site-' || page_id || '/repo">Code</a>' WHEN 2 THEN '<a href="https://github.com/other/repo">Theme</a>' ELSE '' END
  || CASE WHEN page_id % 9 = 0 THEN '<p>This domain is <b>for sale</b></p>' ELSE '' END || CASE WHEN page_id % 10 = 0 THEN '<h2>No current openings</h2>' ELSE '' END
  || CASE WHEN page_id % 8 < 3 THEN '<h3>Senior Engineer</h3><h4>Job: Data Analyst</h4><li>senior engineer</li><li>Reporting to a manager</li><li>Our engineers</li>' ELSE '' END"""
_SITES = f"SELECT page_id, own, 'https://www.' || own AS website, html || {_BLOCK} AS html, {_BLOCK} AS block FROM (SELECT page_id, 'site' || page_id || '.co.in' AS own, html FROM pages)"
_ORDER = ("careers", "team", "about")
_SITE_WORDS = {"careers": ("career|careers|jobs?|join-us|openings", "('join our team', 'careers', 'jobs')"), "team": ("team|people", "('team', 'our team')"), "about": ("about|about-us", "('who we are', 'company', 'about')")}


def _kinds() -> str:
    out, before = "", []
    for kind in _ORDER:
        words, said = _SITE_WORDS[kind]
        used = "".join(f" AND NOT EXISTS (SELECT 1 FROM k_{b} WHERE k_{b}.page_id = a.page_id AND k_{b}.url = a.url)" for b in before)
        named = f"(mine AND path NOT IN ('', '/') AND regexp_matches(marked, '-({words})-'))"
        hiring = "(contains(url, 'lever.co'))" if kind == "careers" else "false"
        out += f""",
f_{kind} AS (SELECT *, {named} AS named, {hiring} AS hiring FROM a WHERE NOT regexp_matches(path, '[.]pdf$'){used}),
k_{kind} AS (SELECT page_id, coalesce(arg_min(url, {{'n': length(url), 'i': i}}) FILTER (named OR (hiring AND i = first)), arg_min(url, i) FILTER (mine AND NOT named AND path NOT IN ('', '/') AND said IN {said})) AS url
  FROM (SELECT *, min(i) FILTER (named OR hiring) OVER (PARTITION BY page_id) AS first FROM f_{kind}) GROUP BY page_id)"""
        before.append(kind)
    return out


@query(f""", sites AS ({_SITES}),
l AS (SELECT page_id, own, website, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS words,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS i FROM sites),
a AS (SELECT *, url LIKE website || '%' AS mine, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?].*$', '') AS path, '-' || regexp_replace(lower(regexp_replace(url, '^https?://[^/]+', '')), '[/_.-]+', '-', 'g') || '-' AS marked,
  lower(regexp_replace(words, '!', '')) AS said FROM (SELECT *, regexp_replace(CASE WHEN href LIKE 'http%' THEN href ELSE website || href END, '#.*$', '') AS url FROM l WHERE href NOT LIKE '#%')){_kinds()},
m AS (SELECT page_id, own, lower(unnest(regexp_extract_all(regexp_replace(block, '<script>.*?</script>', ' '), '[A-Za-z]+@[a-z0-9.]+[a-z]'))) AS m, generate_subscripts(regexp_extract_all(regexp_replace(block, '<script>.*?</script>', ' '), '[A-Za-z]+@[a-z0-9.]+[a-z]'), 1) AS i FROM sites),
mail AS (SELECT page_id, arg_min(m, {{'r': m NOT LIKE 'info@%', 'i': i}}) AS contact_email FROM m WHERE (m LIKE '%@' || own OR m LIKE '%.' || own) AND split_part(m, '@', 1) NOT IN ('noreply', 'career', 'hr') GROUP BY 1),
page AS (SELECT page_id, coalesce(arg_min(url, i) FILTER (regexp_matches(marked, '-contact(-us)?-')), arg_min(website || href, i) FILTER (said = 'contact us' OR said = 'contact')) AS contact_page
  FROM a WHERE mine AND path NOT IN ('', '/') AND NOT regexp_matches(path, 'job|career|hiring|recruit') GROUP BY 1)
SELECT s.page_id, contact_email, contact_page, k_careers.url AS careers, k_team.url AS team, k_about.url AS about, CASE WHEN s.page_id % 4 = 1 THEN 'https://github.com/Site-' || s.page_id END AS repo,
  s.page_id % 9 = 0 AS parked, s.page_id % 10 = 0 AS says_none, CASE WHEN s.page_id % 8 < 3 THEN 2 ELSE 0 END AS roles, CASE WHEN s.page_id % 8 < 3 THEN 'Senior Engineer, Data Analyst' ELSE '' END AS titles
FROM sites s LEFT JOIN mail USING (page_id) LEFT JOIN page USING (page_id) LEFT JOIN k_careers USING (page_id) LEFT JOIN k_team USING (page_id) LEFT JOIN k_about USING (page_id)""")
def home_pages(t):
    """E-11, E-12, A-30, O-17, O-18: contact, pages by kind, repository, roles and parked of every page."""
    rows = t.spark.sql(_SITES.replace("FROM pages", "FROM {t}"), t=t.raw("pages"))
    found = site.sites(rows.select(F.col("page_id").alias("id"), "website", "html"))
    return found.select(F.col("id").alias("page_id"), "contact_email", "contact_page", *_ORDER, "repo", "parked", "says_none", "roles", F.array_join("titles", ", ").alias("titles"))


@query("""SELECT event_id, CASE WHEN robot AND NOT (user_id % 4 = 1 AND event_id % 2 = 0) THEN 'robots' WHEN code = 200 THEN CASE WHEN value < 5 THEN 'thin' ELSE 'ok' END WHEN code IN (404, 410) THEN 'missing' WHEN code IN (401, 403, 429) THEN 'refused' ELSE 'unreachable' END AS outcome
FROM (SELECT *, user_id % 4 < 2 AND event_id % 4 < 3 AS robot, [200, 200, 404, 401, 500, 429][event_id % 6 + 1] AS code FROM events)""")
def page_outcomes(t):
    """E-23: the robots gate by the longest rule, and the outcome of each request."""
    e = t.raw("events")
    hosts = e.select((F.col("user_id") % 4).alias("host")).distinct()
    # two hosts forbid /x; one of them allows /x/0 and /x/2 again
    robots = hosts.where("host < 2").select("host", F.lit(False).alias("allow"), F.lit("/x/").alias("prefix")).union(hosts.where("host = 1").select("host", F.lit(True), F.explode(F.array(F.lit("/x/0"), F.lit("/x/2")))))
    k = F.col("event_id") % 4
    requests = e.select("event_id", (F.col("user_id") % 4).alias("host"), F.concat(F.when(k < 3, "/x/").otherwise("/y/"), k).alias("path"), "value")
    code = F.get(F.array(*map(F.lit, (200, 200, 404, 401, 500, 429))), (F.col("event_id") % 6).cast("int"))
    return site.allowed(robots, requests).select("event_id", site.outcome(code, F.col("allowed"), F.col("value") < 5).alias("outcome"))
