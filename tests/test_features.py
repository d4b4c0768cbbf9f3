"""Classifier, searches in batches, page cache, record lists, sites, editions and the partitioned stream, on small odd inputs."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.awards import project_title
from lodestone.functions.entity import given_name, people_of
from lodestone.functions.text import founder_line, without_contacts
from lodestone.operators import classify, editions, frontier, link, steps, views
from lodestone.sources import html, listings, pagecache, readers, records, site
from lodestone.streaming import ingest

TERMS = "sector_id string, subsector_id string, project_type string, term string, weight int"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def terms(spark):
    rows = [("1", "1.1", "p", "Solar cell", 3), ("1", "1.1", None, "panel", 2), ("1", "1.2", "q", "battery", 4), ("2", "2.1", "r", "gene", 5), ("2", "2.1", "r", "--", 50), ("2", "2.2", "s", "solar", 1)]
    return spark.createDataFrame(rows, TERMS)


def test_keyword_classifier(spark):
    texts = ["SOLAR-cell panels and a panel", "battery", "gene battery", "nothing", None, "", "gene gene gene", "solar"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: tuple(r)[1:] for r in classify.KeywordClassifier(terms(spark), least=2).place(rows).collect()}
    none = (None,) * 4
    assert found[0] == ("1", "1.1", "p", "panel, solar cell") and found[1] == ("1", "1.2", "q", "battery")
    assert found[2] == ("2", "2.1", "r", "gene") and found[6] == ("2", "2.1", "r", "gene")
    assert found[3] == found[4] == found[5] == found[7] == none
    # not clear of the next sector by the margin; a sector whose sub-sectors tie keeps the sector alone
    apart = {r.id: tuple(r)[1:] for r in classify.KeywordClassifier(terms(spark), least=2, margin=2).place(rows).collect()}
    assert apart[2] == none and apart[1] == found[1]
    tied = spark.createDataFrame([("1", "1.1", "p", "x", 2), ("1", "1.2", "q", "y", 2)], TERMS)
    assert [tuple(r)[1:] for r in classify.KeywordClassifier(tied).place(spark.createDataFrame([(1, "x y")], "id int, text string")).collect()] == [("1", None, None, None)]
    assert classify.KeywordClassifier(terms(spark).limit(0)).place(rows).where("sector_id is not null").count() == 0
    assert classify.KeywordClassifier(terms(spark)).place(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        classify.KeywordClassifier(spark.createDataFrame([("1", "1.1", None, "a b c d e f g", 1)], TERMS)).place(rows)


def test_classifiers_are_asked_for_the_rest_only(spark):
    answer = "sector_id string, subsector_id string, project_type string, note string"
    rows = spark.createDataFrame([(1, "h1", "gene"), (2, "h2", "gene"), (3, "h3", "gene"), (4, "h4", "none of it"), (5, "h9", "x")], "id int, hash string, text string")
    cache = spark.createDataFrame([(2, "h2", "c", None, None, "cached"), (9, "h9", "d", None, None, None)], f"id int, hash string, {answer}")
    hand = spark.createDataFrame([(1, "h", None, None, "by hand")], f"id int, {answer}")
    found = {r.id: (r.sector_id, r.origin) for r in classify.classify(rows, cache, hand, classify.KeywordClassifier(terms(spark))).collect()}
    assert found == {1: ("h", "override"), 2: ("c", "cache"), 3: ("2", "asked"), 4: (None, "none"), 5: ("d", "hash")}
    taxonomy = spark.createDataFrame([("2", "2.1", ["r"])], "sector_id string, subsector_id string, projects array<string>")
    told = classify.Answered(spark.createDataFrame([(3, "2", "2.1", "no such", "why"), (4, "2", "9.9", None, None)], f"id int, {answer}"), taxonomy)
    found = {r.id: tuple(r)[1:] for r in classify.classify(rows, cache, hand, told).where("id in (3, 4)").collect()}
    assert found == {3: ("2", "2.1", None, "why", "asked"), 4: ("2", None, None, None, "asked")}


def test_batches_are_halved_until_they_fit(spark):
    """A plain recursion, with a needle that overflows alone, one that is broad, and some without a match."""
    rng = random.Random(3)
    sizes = {0: 4, 1: 0, 2: 25, 3: 3, 4: 130, 5: 6, 6: 7, 7: 2, 8: 9, 9: 0, 10: 9}
    works = {n: set(rng.sample(range(400), k)) for n, k in sizes.items()}
    expected, asked = {}, []

    def ask(lo, hi, number):
        total = len(set().union(*(works[n] for n in range(lo, hi))))
        single = hi - lo == 1
        asked.append((number, lo, hi, total, max(1, -(-total // 10)) if single and total <= 100 else 1))
        if total > 10 and not single:
            ask(lo, (lo + hi) // 2, number + 1)
            ask((lo + hi) // 2, hi, number + 1)
        else:
            expected.update({n: (lo, hi, total, "broad" if total > 100 else "ok") for n in range(lo, hi)})

    for lo in range(0, 11, 8):
        ask(lo, min(lo + 8, 11), 1)
    needles = frontier.numbered(spark.createDataFrame([(f"n{n:02d}",) for n in range(11)] * 2 + [(None,)], "needle string"))
    assert [tuple(r) for r in needles.orderBy("no").collect()] == [(n, f"n{n:02d}") for n in range(11)]
    matches = spark.createDataFrame([(n, w) for n, own in works.items() for w in own], "no bigint, work_id int")
    found = frontier.resolve(needles, matches.union(matches), batch=8, page=10, most=100)
    assert {r.no: (r.lo, r.hi, r.total, r.outcome) for r in found.needles.collect()} == expected
    assert sorted(tuple(r) for r in found.requests.collect()) == sorted(asked) and found.rounds == max(a[0] for a in asked)
    named = frontier.nominations(found, matches)
    got = {n: {r.work_id for r in named.where(F.col("no") == n).collect()} for n in (0, 2, 4)}
    assert got[4] == set() and got[2] == works[2] and works[0] <= got[0]
    assert frontier.resolve(needles.limit(0), matches).needles.count() == 0


def test_page_cache(spark):
    now = F.lit("2024-03-01").cast("timestamp")
    entry = "url string, body string, fetched_at string, response string, etag string, last_modified string, version bigint"
    rows = [("fresh", None, "2024-02-20", "a", "e1", None, 1), ("old", "q", "2024-01-01", "b", "e2", "d2", 3), ("plain", "", "2024-01-01", "c", None, None, 1), ("empty", None, "2024-01-01", None, "e4", None, 1)]
    cache = pagecache.keyed(spark.createDataFrame(rows, entry).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))).drop("body")
    asked = pagecache.keyed(spark.createDataFrame([("fresh", ""), ("old", "q"), ("old", "other"), ("plain", None), ("empty", None), ("new", None), ("new", "")], "url string, body string"))
    todo = sorted(((r.url, r.if_none_match, r.if_modified_since) for r in pagecache.to_ask(asked, cache, now).collect()), key=str)
    assert todo == sorted([("old", "e2", "d2"), ("old", None, None), ("plain", None, None), ("empty", None, None), ("new", None, None)], key=str)
    answer = "url string, body string, code int, response string, etag string, last_modified string, at string"
    told = [("old", "q", 304, None, None, None, "2024-03-01"), ("plain", None, 200, "c", "e5", None, "2024-03-01"), ("plain", None, 200, "stale", None, None, "2024-02-29"), ("empty", None, 500, "oops", None, None, "2024-03-01"), ("new", None, 304, None, None, None, "2024-03-01"), ("old", "other", 200, "d", None, "d6", "2024-03-01")]
    answers = pagecache.keyed(spark.createDataFrame(told, answer).withColumn("at", F.col("at").cast("timestamp"))).drop("body")
    after = pagecache.merged(cache, answers)
    found = sorted((r.url, str(r.fetched_at)[:10], r.response or "", r.etag or "", r.last_modified or "", r.version) for r in after.collect())
    assert found == [("empty", "2024-01-01", "", "e4", "", 1), ("fresh", "2024-02-20", "a", "e1", "", 1), ("old", "2024-03-01", "b", "e2", "d2", 3), ("old", "2024-03-01", "d", "", "d6", 1), ("plain", "2024-03-01", "c", "e5", "", 1)]
    assert pagecache.served(asked, after).where("url = 'plain'").first().response == "c"
    again = pagecache.merged(after, answers.withColumn("response", F.lit("changed")))
    assert again.where("url = 'plain'").first().version == 2


def test_archive_versions(spark):
    rows = [("a", "2020-01-05", "x", 200), ("a", "2022-05-01", "x", 200), ("a", "2023-05-01", "y", 200), ("a", "2023-06-01", "y", 200), ("a", "2019-01-01", "z", 404), ("a", "2025-01-01", "w", 200), ("b", "2024-05-01", "x", 301)]
    captures = spark.createDataFrame(rows, "url string, at string, digest string, status int").withColumn("at", F.col("at").cast("timestamp"))
    found = pagecache.versions(captures, F.lit("2024-05-01").cast("timestamp")).collect()
    assert [(r.url, str(r.first_capture)[:10], r.captures, r.versions) for r in found] == [("a", "2020-01-05", 3, 2)]


def plain_lists(node, keys, path="$"):
    if isinstance(node, list):
        if node and all(isinstance(x, dict) and keys <= x.keys() for x in node):
            return [(path, i, x) for i, x in enumerate(node)]
        return [r for i, x in enumerate(node) for r in plain_lists(x, keys, f"{path}.{i}")]
    if isinstance(node, dict):
        return [r for k, x in node.items() for r in plain_lists(x, keys, f"{path}.{k}")]
    return []


def test_record_lists(spark):
    rng = random.Random(5)

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            return rng.choice([None, 1, "x", True, [], {}])
        if kind < 0.5:
            return [{"t": i, "d": None, **({"more": tree(depth - 1)} if rng.random() < 0.3 else {})} for i in range(rng.randint(1, 3))] + ([{"t": 1}] if rng.random() < 0.2 else [])
        if kind < 0.75:
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        return {f"k{i}": tree(depth - 1) for i in range(rng.randint(0, 3))}

    trees = [tree(5) for _ in range(60)] + [[[{"t": 1, "d": 2}]]]
    docs = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(trees)] + [(1000, "{cut"), (1001, None), (1002, "")], "doc int, json string")
    found = sorted((r.doc, r.path, r.place, json.dumps(json.loads(r.record), sort_keys=True)) for r in records.record_lists(docs, ("t", "d")).collect())
    assert found == sorted((i, p, n, json.dumps(x, sort_keys=True)) for i, t in enumerate(trees) for p, n, x in plain_lists(t, {"t", "d"}))
    assert len(found) > 20 and records.record_lists(docs.limit(0), ("t",)).count() == 0


def test_site_of_a_page(spark):
    page = """<html><head><title> A  &amp; B </title><meta property="og:description" content="d e"></head><body><nav><a href="/team">People</a></nav>
    <a href="mailto:Sales%40Acme.in,other@acme.in?subject=x">mail</a> Reach info@mail.acme.in or me@gmail.com. <a href="http://[bad">x</a><a href="/about/old/page">Old</a><a href="/about">About</a>
    <a href="/jobs">All</a><a href="https://careers.keka.com/firm">Apply</a><a href="#contact">Contact</a><a href="https://elsewhere.in/contact">Contact</a><a href="reach-us.html">Hi</a>
    <a href="https://gitlab.com/acme-labs">git</a><h3>Research Fellow</h3><li>Job: Operators</li><li>operators</li><script>hello@acme.in</script><style>p{}</style></body></html>"""
    rows = [(1, "www.acme.in", page), (2, "https://linkedin.com/company/firm", page), (3, None, page), (4, "https://acme.in", None), (5, "https://gmail.com", page), (6, "https://acme.in", "<p>Coming soon <a href='/x'>unclosed")]
    found = {r.id: r for r in site.sites(spark.createDataFrame(rows, "id int, website string, html string")).collect()}
    one = found[1]
    assert (one.contact_email, one.contact_page, one.careers, one.team, one.about) == ("info@mail.acme.in", "https://www.acme.in/reach-us.html", "https://www.acme.in/jobs", "https://www.acme.in/team", "https://www.acme.in/about")
    assert (one.repo, one.roles, one.titles, one.title, one.meta, one.thin) == ("https://gitlab.com/acme-labs", 2, ["Research Fellow", "Operators"], "A & B", "d e", True)
    assert not one.parked and not one.says_none and found[6].parked and found[4].title is None and found[4].roles == 0
    assert all(found[i].contact_email is None and found[i].contact_page is None for i in (2, 3, 4, 5))


def test_copied_blocks_go(spark):
    rows = [("p1", 1, 2021, "Agri", "winner", "Alpha Ltd", "Agri – Seeds", None, 1), ("p1", 2, 2021, "Agri", "finalist", "alpha ltd", None, "Pune", 1), ("p1", 2, 2021, "Agri", "finalist", "Beta", "Soil", None, 2)]
    rows += [("p2", 1, 2022, "Water", "winner", "Gamma", "Energy - Wind", None, 1), ("p2", 2, 2022, "Water", "finalist", "Alpha Ltd", None, None, 1), ("p2", 2, 2022, "Water", "finalist", "Beta", "Soil", None, 2), ("p2", 1, 2022, "Water", "winner", "Delta", "Delta", "X", 2), ("p2", 1, 2022, "Water", "winner", None, "x", None, 3)]
    schema = "page string, block int, edition int, sector string, status string, name string, category string, city string, place int"
    found = sorted(tuple(r) for r in editions.awards(spark.createDataFrame(rows, schema)).select("edition", "key", "status", F.coalesce("category", F.lit("-")), F.coalesce("city", F.lit("-"))).collect())
    assert found == [(2021, "alphaltd", "winner", "Seeds", "Pune"), (2021, "beta", "finalist", "Soil", "-"), (2022, "delta", "winner", "-", "X")]
    assert editions.awards(spark.createDataFrame([], schema)).count() == 0


def test_pages_of_listings(spark):
    pages = spark.createDataFrame([("a", p, 5) for p in range(5)] + [("b", 0, 1), ("c", 0, 0)], "industry string, page int, total int")
    assert sorted(tuple(r)[:2] for r in readers.last_pages(pages, 2).collect()) == [("a", 3), ("a", 4), ("b", 0)]
    rows = [("a", 1, None, [1, 2]), ("a", 2, None, [3]), ("a", 3, None, [9, 9]), ("b", 1, 3, [1, 2]), ("b", 2, None, [3, 4]), ("b", 3, None, [5, 6]), ("c", 1, None, [])]
    found = readers.until_short(spark.createDataFrame(rows, "listing string, page int, total int, records array<int>"), 2)
    assert sorted((r.listing, r.record) for r in found.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3), ("b", 4)]
    lines = spark.createDataFrame([("k", 2, "A / B, C"), ("k", 1, "A, B / C"), ("k", 0, "A"), ("k", 3, None), ("n", 1, "x")], "key string, pos int, line string")
    assert {r.key: r.line for r in listings.fullest(lines, "key", "line", "pos").collect()} == {"k": "A, B / C", "n": "x"}


def test_partitioned_stream(spark, tmp_path):
    """Batches touch some parts only, a batch that comes again changes nothing, and old versions go."""
    (tmp_path / "in").mkdir()
    known = spark.createDataFrame([(f"c{i}",) for i in range(20)], "id string")
    target, seen = str(tmp_path / "out"), {}
    for n in range(4):
        lines = [{"company_id": f"c{i}", "type": "grant", "label": f"l{i % 3}", "source": f"s{n}"} for i in range(n, 20, n + 1)] + [{"company_id": "zz", "type": "grant", "label": "x"}]
        (tmp_path / f"in/{n}.json").write_text("\n".join(map(json.dumps, lines)))
        for x in lines[:-1]:
            seen.setdefault((x["company_id"], x["label"]), x["source"])
        ingest.merge_stream(ingest.signal_stream(spark, str(tmp_path / "in")), known, target, str(tmp_path / "ck"), n_parts=5).awaitTermination()
        assert {(r.company_id, r.label): r.source for r in ingest.current(spark, target).collect()} == seen
    assert ingest.commits(spark, target) == [2, 3]
    held = {(p.parent.name, p.name) for p in (tmp_path / "out/parts").glob("p=*/b=*")}
    named = {(f"p={p}", f"b={b}") for before in (3, 4) for p, b in ingest.versions(spark, target, before).items()}
    assert held == named
    # the same files under a new checkpoint: delivered again from the start
    ingest.merge_stream(ingest.signal_stream(spark, str(tmp_path / "in")), known, str(tmp_path / "again"), str(tmp_path / "ck2"), n_parts=5).awaitTermination()
    assert ingest.current(spark, str(tmp_path / "again")).count() == len(seen)


def test_near_pairs_fold_equal_names(spark):
    rows = [(1, "Abcdef"), (2, "abcdef"), (3, "abcdxf"), (4, "bcdef"), (5, "zzz"), (6, None), (7, "abcdef"), (8, "acdexf")]
    names = {i: n.lower() for i, n in rows if n}
    firsts = {n: min(i for i in names if names[i] == n) for n in names.values()}
    expected = {(firsts[n], i) for i, n in names.items() if firsts[n] != i}
    expected |= {(min(i, j), max(i, j)) for (a, i), (b, j) in itertools.combinations(firsts.items(), 2) if edit_distance(a, b) <= 2}
    found = {tuple(r) for r in steps.near_duplicate_pairs(spark.createDataFrame(rows, "id int, name string")).collect()}
    assert found == expected


def test_affiliations_keep_no_text(spark):
    parts = spark.createDataFrame([(1, "the centre of alpha robotics pune"), (2, "alpha of robotics"), (3, "robotics"), (4, "the the")], "part_id int, text string")
    needles = spark.createDataFrame([("a", "alpha robotics"), ("b", "the"), ("c", "none such"), ("d", "robotics")], "id string, needle string")
    assert sorted(tuple(r) for r in link.affiliations(needles, parts).collect()) == [("a", 1), ("b", 1), ("b", 4), ("d", 1), ("d", 2), ("d", 3)]


def test_rules_of_texts(spark):
    def of(f, values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]

    assert of(without_contacts, ["Makes pumps, e-mail: a@b.com", "Pumps; phone +91 98765 43210", "Call a@b.com , , b now", "Email ids: a@b.c, ", "Contact details", "other things", None, "A , b", "the other", "Pumps, other phone: 9876543210"]) == [
        "Makes pumps", "Pumps", "Call, b now", None, None, "other things", None, "A , b", "the other", "Pumps"]
    assert of(founder_line, ["Asha Rao/Ben Low", "Prof. A B Prof. C D", "Dr. A and Prof. B", "A B/handle-x/", None]) == ["Asha Rao, Ben Low", "Prof. A B, Prof. C D", "Dr. A and Prof. B", "A B", None]
    assert of(given_name, ["Dr. Asha Rao", "Prof. Dr. B", "ben", "", "123"]) == ["asha", "b", "ben", "", ""]
    assert of(people_of, ["Asha Rao, Dr. Ben Low and Cy/Di & Ed"]) == [["asha", "ben", "cy", "di", "ed"]]
    titles = ["Solar pumps.", "TDB supports M/s X Ltd for “Solar pumps for farms”", "M/s X signed for the project – Wind mills", "TDB helps M/s X", "M/s X for financial assistance for Boats", None]
    assert of(project_title, titles) == ["Solar pumps", "Solar pumps for farms", "Wind mills", None, "Boats", None]


def test_text_of_fragments(spark):
    rows = spark.createDataFrame([("<p>A &amp;amp; B&nbsp;c</p><script>x</script>",), (None,), ("",)], "h string")
    assert [r.t for r in html.text_of(rows, "h", "t").collect()] == ["A & B c", None, None]


def test_suggestions(spark):
    rows = spark.createDataFrame([("green-tech",), ("tech",), ("blue",), ("a-green-one",)], "id string")
    assert [r.id for r in views.suggestions(rows, "Green-tech-x").collect()] == ["tech", "green-tech", "a-green-one"]
    assert views.suggestions(rows, "-").count() == 0


def test_titles_as_written(spark):
    """Only `&amp;` is read in a written title; a reference that is cut off stays, where the shown title has it read."""
    given = {"<title>a  &amp;\t b</title>": ("a & b", "a & b"), "<title>t = &quot;x</title>": ("t = &quot;x", 't = "x'), "<title>and&amp</title><title>2</title>": ("and&amp", "and&"), "<p>x</p>": ("", "")}
    df = spark.createDataFrame([(k,) for k in given], "html string").select("html", html.written_title(F.col("html")).alias("w"), html.read_page("html").alias("p"))
    assert {r.html: (r.w, r.p.title) for r in df.collect()} == given


def test_contacts_are_looked_for_once(spark):
    """The patterns stand once in the plan, however often the rule refers to its words."""
    df = spark.createDataFrame([("builds pumps ,, ; mail other contact a@b.example",), ("  ",), (None,)], "t string").select(without_contacts(F.col("t")).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(r"(?:[\w-]+\.)+") == 1
    assert [r.t for r in df.collect()] == ["builds pumps", None, None]


def test_lists_are_judged_without_a_join(spark):
    """A list's own row tells whether it is one of records; equal names, null values and empty lists as before."""
    given = ['{"a":[{"k":null},{"k":2}],"b":[[{"k":1}],[]],"c":[{"k":1},{"x":1}]}', '[{"k":[{"k":3}]}]', "[1,{}]", "{", None, "7"]
    found = records.record_lists(spark.createDataFrame(list(enumerate(given)), "doc int, json string"), ("k",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, found.collect())) == [(0, "$.a", 0, '{"k":null}'), (0, "$.a", 1, '{"k":2}'), (0, "$.b.0", 0, '{"k":1}'), (1, "$", 0, '{"k":[{"k":3}]}')]


def by_rows(df):
    """The rows of df, whose plan must hand pages to Python by rows, not in Arrow batches of 10,000 pages."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    return df.collect()


def test_pages_are_read_by_rows(spark):
    df = spark.createDataFrame([("<title>T</title><h1>H</h1><p>P <a href='/x'>x</a></p>",), (None,)], "html string")
    found = [r.p for r in by_rows(df.select(html.read_page("html").alias("p")))]
    assert [(p.title, p.headings, p.paragraphs, p.links, p.visible, p.thin) for p in found] == [("T", ["H"], ["P x"], ["/x"], "H P x", True), ("", [], [], [], "", True)]


def test_cards_are_read_by_rows(spark):
    df = spark.createDataFrame([("<article><h2>A</h2>b<a href='/x'>c</a></article><table><tr><th>N<tr><td>1</table>",), (None,)], "html string")
    assert [[tuple(c) for c in r.c] for r in by_rows(df.select(listings.cards(F.col("html"), "article").alias("c")))] == [[("A", "b c", "/x")], []]
    assert [r.t for r in by_rows(df.select(listings.table_rows(F.col("html")).alias("t")))] == [[{"n": "1"}], []]


def test_sites_are_read_by_rows(spark):
    df = spark.createDataFrame([("<a href='/x#y'>c</a><h2>Engineer</h2>", "a.example"), (None, None)], "html string, website string")
    found = [r.s for r in by_rows(df.select(site.read_site("html", "website").alias("s")))]
    assert [([tuple(x) for x in s.links], s.bits, s.title, s.visible) for s in found] == [([("https://a.example/x", "https", "a.example", "/x", "", "y", "c")], ["c", "Engineer"], None, "c Engineer"), ([], [], None, "")]
