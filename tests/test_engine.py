"""Single operators on small rows: edge cases, invariants and idempotence."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.functions import dates, entity, ranking, said, tags, text
from lodestone.operators import link, merge, reports, views
from lodestone.plans.proxies import Tables
from lodestone.sources import html, readers
from lodestone.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def values(spark, expression, *inputs):
    """The expression's results for single strings."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_slug_and_key(spark):
    names = ["Acmé Tech (P) Ltd.", "Private Limited", "Zürich AG", "Limited Edition Labs", None, "Foo Inc"]
    assert values(spark, text.slug, *names) == ["acme-tech", "private-limited", "zurich-ag", "limited-edition-labs", None, "foo-inc"]
    assert values(spark, lambda x: text.name_key(text.slug(x)), "Foo Inc", "F-oo") == ["foo", "foo"]


def test_text(spark):
    assert values(spark, text.clean, " a  b\n", "", None, "  ") == ["a b", None, None, None]
    assert values(spark, text.website, "acme.com", "http://x", "not a site", None, "a.co/x") == ["https://acme.com", "http://x", None, None, "https://a.co/x"]
    assert values(spark, text.own_website, "www.own.com Phone", "N/A", "https://linkedin.com/in/x", "https:--x", "x.ac.in", "a.com/file.pdf", None, "tofler.in") == ["https://www.own.com", None, None, None, None, None, None, None]
    assert values(spark, text.host, "https://www.A.com:80/x", "b.org/p", None, "") == ["a.com", "b.org", None, None]
    assert values(spark, text.registrable, "a.b.co.in", "x.y.com", "localhost", None, "co.in") == ["b.co.in", "y.com", None, None, None]
    assert values(spark, text.without_contacts, "Pumps. Email: a@b.co", "call +91 98765 43210, x", "2019-2020", None) == ["Pumps.", "call , x", "2019-2020", None]
    assert values(spark, text.display_name, "NCF OF THE AI PVT LTD", "Mixed Case", "ABC-DEF (ROBOTICS)", "2D") == ["NCF of the AI Pvt Ltd", "Mixed Case", "Abc-Def (Robotics)", "2D"]
    assert values(spark, text.founder_line, "Rohan D/Ayush G", "Prof. Udayan Ganguly Prof. Swaroop Ganguly", "A and Prof. B", None) == ["Rohan D, Ayush G", "Prof. Udayan Ganguly, Prof. Swaroop Ganguly", "A and Prof. B", None]
    assert values(spark, text.place_name, "Bangalore ", "jharkhand", "", None, "Khordha") == ["Bengaluru", None, None, None, "Khordha"]
    assert values(spark, text.csv_field, "=1+1", 'a"b', None, "-x") == ['"\'=1+1"', '"a""b"', '""', '"\'-x"']
    assert values(spark, text.undoubled, "A B A B", "A B A", "A A", "x") == ["A B", "A B A", "A", "x"]
    assert values(spark, text.safe_url, "HTTP://x", "javascript:x", None) == ["HTTP://x", None, None]


def test_said_and_labels(spark):
    label = "DPIIT-recognised startup. Industry: Robotics. Sector: AI, NLP. Stage: Scaling."
    grant = "BIRAC Biotechnology Ignition Grant awardee, category: Industrial Biotechnology, Clean Energy & Environment."
    assert values(spark, said.label_kind, label, grant, "We build", "", None) == ["register", "grant", None, None, None]
    assert values(spark, entity.register_labels, label, grant, None) == [["robotics", "ai", "nlp"], ["industrial biotechnology, clean energy & environment"], []]
    assert values(spark, lambda x: entity.label_supports(x, F.lit("2.7")), label, grant) == [True, False]
    assert values(spark, lambda x: said.register_text(F.lit(label), x), "expired", None)[0].startswith("DPIIT recognition expired. Industry")
    assert values(spark, lambda x: tags.tags(x, tags.BUILD), "A machine learning app", "a machine", "", None)[:3] == [["software"], ["hardware"], []]


def test_dates(spark):
    assert values(spark, lambda x: dates.day_of(x, True).cast("string"), "2021", "2021-05-03", "May", None) == ["2021-12-31", "2021-05-03", None, None]
    assert values(spark, dates.prose_date, "on 5th March 2021", "March 5, 2021", "31 Feb 2020", "never", None) == ["2021-03-05", "2021-03-05", None, None, None]
    assert values(spark, lambda x: dates.refine(F.lit("2021"), x), "2021-05-03", "2020-05-03", "2021", None) == ["2021-05-03", "2021", "2021", "2021"]
    assert values(spark, dates.number_year, "U72200KA2015PTC081234", "x", None) == [2015, None, None]


def test_tier_rules(spark):
    now = F.lit("2021-06-01").cast("timestamp")
    rows = [
        ("2021-05-01", "discovered", None, 2, None, "A"),
        ("2021-05-01", "discovered", None, 3, None, "B"),
        ("2021-05-01", "discovered", "register-label", 1, None, "C"),
        ("2021-05-01", "discovered", None, 1, "2019-01-01", "B"),
        ("2021", "cohort", None, 1, None, "B"),
        (None, None, None, 1, None, "C"),
        ("2021-01-02", "cohort", None, 6, None, "C"),
    ]
    df = spark.createDataFrame(rows, "f string, b string, k string, n int, e string, t string")
    found = df.select("t", ranking.tier(F.col("f"), F.col("b"), F.col("k"), F.col("n"), F.col("e").cast("date"), now).alias("got")).collect()
    assert all(r.t == r.got for r in found), found


def test_entities(spark):
    rows = [
        ("Acme Pvt Ltd", ["sine-iitb"], None, None, "company"),
        ("Open Water", ["dpiit-startup-india"], "recognised", None, "company"),
        ("Open Water", ["dpiit-startup-india"], "profile", None, "unverified"),
        ("Department of Physics", ["sine-iitb"], None, None, "lab"),
        ("Asha Rao", ["sine-iitb"], None, None, "researcher-project"),
        ("Asha Rao", ["nmicps-tih"], None, "Dr. Asha R; Ben", "researcher-project"),
        ("Asha Rao", ["nmicps-tih"], None, None, "unverified"),
        ("Tavisha Robotics", ["sine-iitb"], None, None, "unverified"),
        ("X", None, None, None, "unverified"),
    ]
    df = spark.createDataFrame(rows, "n string, s array<string>, d string, f string, t string")
    found = df.select("n", "t", entity.entity_type(F.col("n"), F.col("s"), F.col("d"), F.col("f")).alias("got")).collect()
    assert all(r.t == r.got for r in found), [r for r in found if r.t != r.got]
    page = " ".join(f"word{chr(97 + i)}unique" for i in range(26))
    ids = [("Zerodha Labs", "https://zerodha.com", "", None, False, "verified"), ("Foo Bar", "https://linkedin.com/x", "", None, False, "discovered"), ("Foo", None, "", None, False, None), ("Quux Works", "https://abc.io", "all about Quux Works here", None, False, "verified"), ("Quux Works", "https://abc.io", "nothing", None, False, "associated"), ("Quux Works", "https://abc.io", "Quux Works", None, True, "discovered")]
    df = spark.createDataFrame(ids, "n string, u string, p string, d string, s boolean, t string")
    found = df.select("n", "t", entity.website_identity(F.col("n"), F.col("u"), F.col("p"), F.col("d"), F.col("s")).alias("got")).collect()
    assert all(r.t == r.got for r in found), found
    assert values(spark, lambda x: entity.contradicts(F.lit("turbines generators hydropower rivers reservoirs barrages"), x), page, "short") == [True, False]


def test_view_parsing():
    assert views.parse_view({"traces": "9", "described": "said"}, strict=False) == views.View(described="said")
    with pytest.raises(ValueError):
        views.parse_view({"traces": "9"}, strict=True)
    assert views.parse_view({"sector": "1", "subsector": "2.3"}, strict=False).sector == "2"


def test_buckets_add_up(spark):
    t = Tables(spark, SMALL)
    for view, gate in ((views.View(), None), (views.View(tiers=("A",), active=True), 1996), (views.View(search="labs", tiers=("B", "C")), 1999)):
        r = views.buckets(t.base, t.signals, view, gate).first()
        assert r.total == r.ranked + r.undated + r.older + r.tier_hidden
    empty = views.buckets(t.base.limit(0), t.signals, views.View(), None).first()
    assert set(empty.asDict().values()) == {0}


def test_order_survives_repartition(spark):
    t = Tables(spark, SMALL)
    one = views.merged_order(t.base, t.signals, views.View()).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        t = Tables(spark, SMALL)
        assert views.merged_order(t.base.repartition(5), t.signals, views.View()).collect() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def snapshot_of(t):
    companies = ranking.ranked(t.companies, t.signals, t.now).withColumns({"updated_at": F.lit(1), "product_status": F.lit(None).cast("string"), "description_source": F.lit("s"), "founders_source": F.lit("s")})
    return merge.Snapshot(companies, merge.first_per(t.signals, ["company_id", "type", "label"], ["date", "source"]), merge.first_per(t.gaps, ["company_id"], ["name"]))


def test_batch_twice_is_once(spark, tmp_path):
    t = Tables(spark, SMALL)
    whole = snapshot_of(t)
    key = F.substring("id", 2, 9).cast("int")
    old = merge.Snapshot(whole.companies.where(key % 3 != 0), whole.signals.where("found_at < timestamp'1999-01-01'"), whole.gaps.where("sector_id > '2'"))
    batch = merge.Snapshot(whole.companies.where(key % 2 == 0).withColumn("name", F.concat("name", F.lit("!"))), whole.signals.where("found_at >= timestamp'1998-01-01'"), whole.gaps.where("sector_id < '4'"))
    once = merge.apply_batch(old, batch, t.now)
    kept = []
    for name in ("companies", "signals", "gaps"):
        getattr(once, name).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    once = merge.Snapshot(*kept)
    twice = merge.apply_batch(once, batch, t.now)
    for name in ("companies", "signals", "gaps"):
        a, b = getattr(once, name), getattr(twice, name)
        assert a.exceptAll(b.select(*a.columns)).count() == 0 and b.count() == a.count()
    placed, gaps = once.companies, once.gaps
    assert placed.join(gaps, placed.id == gaps.company_id).count() == 0


def test_whole_run(spark):
    t = Tables(spark, SMALL)
    whole = snapshot_of(t)
    batch = merge.Snapshot(whole.companies.where("id in ('c1', 'c2', 'c3')"), whole.signals.limit(0), whole.gaps.limit(0))
    old = merge.Snapshot(whole.companies.where("id = 'c1'"), whole.signals.limit(0), whole.gaps.limit(0))
    runs = spark.sql("select 'a' as source, timestamp'2001-07-01' as started_at, 'ok' as status union all select 'b', timestamp'2001-08-01', 'ok' union all select 'c', timestamp'2001-07-01', 'failed'")
    merges = spark.createDataFrame([("c3", "c1"), ("c2", "nowhere")], "from string, into string")
    before = {r.id: r for r in whole.companies.where("id in ('c1', 'c2', 'c3')").collect()}
    for source, backfill in (("a", False), ("b", True), ("c", True), ("new", True)):
        done = merge.ingest(old, runs, source, batch, merges, t.now)
        rows = {r.id: r for r in done.snapshot.companies.collect()}
        assert set(rows) == {"c1", "c2"}
        year = before["c2"].origin_year
        assert (rows["c2"].first_seen, rows["c2"].first_seen_basis) == ((str(year) if year else None, "cohort" if year else None) if backfill else ("2001-08-01", "discovered"))
        run = done.run.first()
        assert (run.source, run.status, run.records) == (source, "ok", 3) and done.version.first().version.startswith("2001-08-01")
    assert merge.ingest(old, runs, "a", batch, merges, t.now, backfill=True).snapshot.companies.where("first_seen = '2001-08-01' and id = 'c2'").count() == 0


def test_upsert_rules(spark):
    schema = "id string, name string, description string, website string, website_identity string, product string, origin_year int, first_seen string, classify_basis string"
    old = spark.createDataFrame([("a", "A", "Real text", "https://a", "verified", "P", 2001, "2020", "description"), ("b", "B", None, None, None, None, None, None, None)], schema)
    new = spark.createDataFrame([("a", "A2", "DPIIT-recognised startup. Industry: AI.", None, "discovered", None, 1999, "2021-01-01", "x"), ("c", "C", None, None, None, None, None, "2021", None)], schema)
    r = {x.id: x for x in merge.upsert(old, new).collect()}
    assert (r["a"].name, r["a"].description, r["a"].website, r["a"].product, r["a"].origin_year, r["a"].first_seen) == ("A2", "Real text", None, None, 1999, "2020")
    assert r["b"].name == "B" and r["c"].first_seen == "2021"


def test_signals_and_lines(spark):
    schema = "company_id string, type string, label string, date string, source string, found_at int"
    old = spark.createDataFrame([("a", "dpiit", "x", None, "s", 1)], schema)
    new = spark.createDataFrame([("a", "dpiit", "x", "2020", "t", 2), ("a", "dpiit", "y", None, "t", 3), ("a", "grant", None, None, "t", 3), ("a", "grant", None, "2020", "t", 3), ("zz", "press", "p", None, "t", 3)], schema)
    known = spark.createDataFrame([("a",)], "id string")
    out = merge.insert_signals(old, new, known)
    assert sorted((r.type, r.label, r.source) for r in out.collect() if r.label) == [("dpiit", "x", "s"), ("dpiit", "y", "t")] and out.count() == 3
    assert [r.label for r in merge.one_register_line(out).where("type = 'dpiit'").collect()] == ["y"]


def test_alias_chains(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    assert {r["into"] for r in link.closure(spark.createDataFrame(chain, "from string, into string")).collect()} == {"n040"}
    long = [(i, i + 1) for i in range(1000)]
    assert {r["into"] for r in link.closure(spark.createDataFrame(long, "from int, into int")).collect()} == {1000}
    for cycle in ([("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "c"), ("c", "b")]):
        with pytest.raises(ValueError):
            link.closure(spark.createDataFrame(cycle, "from string, into string"))


def test_affiliations_meet_on_the_rarest_word(spark):
    needles = spark.createDataFrame([("a", "the bright labs"), ("b", "the"), ("c", "not there"), ("d", "labs the bright")], "id string, needle string")
    parts = spark.createDataFrame([(1, "at the bright labs in pune"), (2, "the brightest labs"), (3, "of the labs")], "part_id int, text string")
    assert sorted(map(tuple, link.affiliations(needles, parts).collect())) == [("a", 1), ("b", 1), ("b", 2), ("b", 3)]


def test_budgets_over_ranges(spark):
    rows = [(i, i % 3, float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, g int, cost double").repartition(5)
    found = {r.k: r for r in link.admit(df, "cost", ["k"], 300.0).collect()}
    spent = 0
    for k, _, cost in rows:
        spent += cost
        assert (found[k].spent, found[k].admitted) == (spent, spent <= 300)
    spent = [0, 0, 0]
    found = {r.k: r for r in link.admit(df, "cost", [F.desc("k")], 300.0, "g").collect()}
    for k, g, cost in reversed(rows):
        spent[g] += cost
        assert (found[k].spent, found[k].admitted) == (spent[g], spent[g] <= 300)


def test_award_matching(spark):
    held = spark.createDataFrame([("h1", 1, "k1"), ("h2", None, "k2"), ("h3", 3, "k3"), ("h4", None, "k3"), ("h5", 5, "k5"), ("h6", 5, "k6")], "id string, number int, key string")
    awards = spark.createDataFrame([(1, 1, "zz"), (2, None, "k2"), (3, None, "k3"), (4, 9, "k3"), (5, 5, "k5"), (6, 9, "k1"), (7, None, "no")], "award_id int, number int, key string")
    found = {r.award_id: (r.id, r.by) for r in link.match_awards(awards, held).collect()}
    assert found == {1: ("h1", "number"), 2: ("h2", "name"), 4: ("h4", "name")}


def test_owner_merge_keeps_pairs(spark):
    rows = spark.createDataFrame([("a", 1, "s1", "DPIIT-recognised startup. Industry: AI.", None, "Goa"), ("a", 2, "s2", "Real", "Pune", None), ("a", 3, "s3", "Other", "Kochi", "Kerala")], "id string, source_rank int, source string, description string, city string, state string")
    r = merge.owner_merge(rows, {"description": ("description",), "city": ("city", "state")}).first()
    assert (r.owner, r.description, r.city, r.state) == ("s1", "Real", "Pune", None)


def test_notes_and_verdicts(spark):
    old = spark.createDataFrame([("a", "x", 1, 1), ("b", "y", 1, 1)], "company_id string, body string, created_at int, updated_at int")
    new = spark.createDataFrame([("a", "z"), ("b", ""), ("c", "n")], "company_id string, body string")
    assert sorted(map(tuple, merge.upsert_notes(old, new, F.lit(5)).collect())) == [("a", "z", 1, 5), ("c", "n", 5, 5)]
    runs = spark.createDataFrame([(1, "s", 1, "ok", 100), (2, "s", 2, "ok", 49), (3, "s", 3, "failed", 10), (4, "s", 4, "ok", 0), (5, "t", 1, "ok", 3)], "id int, source string, started_at int, status string, records int")
    assert [r.verdict for r in reports.verdicts(runs).orderBy("id").collect()] == ["ok", "quarantined", "failed", "quarantined", "ok"]


def test_budget(spark):
    rows = spark.createDataFrame([(i, 2.0) for i in range(10)], "i int, cost double")
    assert [r.i for r in link.admit(rows, "cost", ["i"], 7.0).where("admitted").orderBy("i").collect()] == [0, 1, 2]


def test_html(spark):
    page = "<html><title>A &amp; B</title><meta name=description content='what we do'><script>var x='<p>no</p>'</script><h1>Head</h1><p>One<p>Two <a href='/contact-us'>c</a><li>Item</li><a href='https://github.com/x'>g</a> mail: sales@x.com, info@x.com</html>"
    df = spark.createDataFrame([(page,), (None,), ("<p",)], "html string")
    r = df.select(html.read_page("html").alias("p"), html.read_contact("html").alias("c")).collect()
    assert (r[0].p.title, r[0].p.meta, r[0].p.headings, r[0].p.thin) == ("A & B", "what we do", ["Head"], True)
    assert "var x" not in r[0].p.visible and r[0].p.items == ["Item"]
    assert (r[0].c.email, r[0].c.page, r[0].c.kinds) == ("info@x.com", "/contact-us", ["repo", "contact"])
    assert r[1].p.title == "" and r[1].c.email is None


def test_readers(spark, tmp_path):
    path = tmp_path / "grants.csv"
    path.write_text("company_name,scheme,award_date,project_summary,url,website,city\nAcme Ltd,BIG,2020-01-02,Pumps,u,,Pune\nACME,BIG,2019,Other,u,,\nAcme,NIDHI,,x,u,,\n")
    companies, signals = readers.grants(spark, str(path))
    assert [(r.id, r.description) for r in companies.collect()] == [("acme", "Pumps")]
    assert sorted((r.label, r.date) for r in signals.collect()) == [("BIG", "2020-01-02"), ("NIDHI", None)]
    assert signals.agg(readers.data_as_of(F.col("date"))).first()[0] == "2020-01-02"
    (tmp_path / "p").mkdir()
    (tmp_path / "p/1.json").write_text('{"id": 1, "n": "a"}\n{"id": 1, "n": "b"}\n{"id": 2, "n": "c"}\n')
    assert sorted((r.id, r.n) for r in readers.paged_json(spark, str(tmp_path / "p"), "id int, n string", "id").collect()) == [(1, "a"), (2, "c")]
    assert values(spark, lambda x: readers.fetch_outcome(x.cast("int")), "200", "403", "500", None) == ["ok", "refused", "unreachable", "unreachable"]
    found = values(spark, lambda x: readers.embedded_json(x, "a int"), '<script id="__NEXT_DATA__" type="x">{"a": 3}</script>', "none")
    assert found[0].a == 3
    good, bad = readers.isolated({"x": lambda: companies, "y": lambda: 1 / 0})
    assert list(good) == ["x"] and "ZeroDivisionError" in bad["y"]
    capture = spark.createDataFrame([([["urlkey"], ["20200103040506"], ["20190102030405"]],), ([["urlkey"]],), ([],), (None,)], "r array<array<string>>")
    assert [str(r[0]) for r in capture.select(readers.first_capture(F.col("r"))).collect()] == ["2019-01-02", "None", "None", "None"]


def test_signal_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    known = spark.createDataFrame([("a",)], "id string")
    for n in (1, 2):
        (tmp_path / f"in/{n}.json").write_text('{"company_id": "a", "type": "grant", "label": "x", "source": "s%d"}\n{"company_id": "zz", "type": "grant", "label": "x"}\n' % n)
        stream = ingest.signal_stream(spark, str(tmp_path / "in"))
        ingest.merge_stream(stream, known, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [(r.company_id, r.source) for r in ingest.current(spark, str(tmp_path / "out")).collect()] == [("a", "s1")]


def test_near_names(spark):
    rows = spark.createDataFrame([("1", "Grinntech Motors"), ("2", "Green Tech"), ("3", "Zzz"), ("4", "Grinntek")], "id string, name string")
    assert [r.id for r in link.near_names(rows, "grinntek!").collect()][:2] == ["4", "1"]
    assert link.near_names(rows, "g").count() == 0


def test_random_lists_contained(spark):
    rng = random.Random(2)
    lists = {i: {rng.randrange(40) for _ in range(rng.randrange(8, 35))} for i in range(12)}
    lists[12] = set(list(lists[0])[:12])
    rows = [(i, m) for i, own in lists.items() for m in own]
    expected = {(a, b) for a, x in lists.items() for b, y in lists.items() if a != b and len(x) >= 10 and x <= y and (len(y) > len(x) or b < a)}
    assert {tuple(r) for r in link.contained_lists(spark.createDataFrame(rows, "list int, member int")).collect()} == expected


def test_entry(spark):
    page = __spark_entry__.entry(spark)
    rows = page.collect()
    assert 0 < len(rows) <= 100 and [r.pos for r in rows] == sorted(r.pos for r in rows)
