"""Listings, page layout and briefs on small pages."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import reports
from lodestone.plans import briefs
from lodestone.plans.proxies import Tables
from lodestone.sources import layout, listings


def test_cards(spark):
    page = "<div class='card x'><h3><a href='/a'></a><a href='/b'>Acme</a></h3><p>Makes <b>pumps</b></p></div><p>no</p><div class=card><h3>Two</h3><br>Text</div>"
    df = spark.createDataFrame([(page,), ("",), (None,)], "html string")
    rows = [r[0] for r in df.select(listings.cards(F.col("html"), "div", "card")).collect()]
    assert [(c.title, c.text, c.href) for c in rows[0]] == [("Acme", "Makes pumps", "/b"), ("Two", "Text", None)]
    assert rows[1:] == [[], []]


def test_tables(spark):
    page = "<table><tr><th>Company</th><th>Cost</th></tr><tr><td>A &amp; B</td><td> 1 </td></tr><tr><td>C</td></tr></table><table><tr><td>X</td></tr><tr><td>y</td></tr></table>"
    rows = spark.createDataFrame([(page,)], "html string").select(listings.table_rows(F.col("html"))).first()[0]
    assert rows == [{"company": "A & B", "cost": "1"}, {"company": "C"}, {"x": "y"}]


def test_fragments(spark):
    script = 'push([1,[{"id":1,"n":"a"}]]) push([1,[{"id":1}]]) push([1,oops])'
    df = spark.createDataFrame([(script,)], "s string").select(F.explode(listings.fragments(F.col("s"), r"push\(\[1,(.*?)\]\)(?: |$)", "struct<id:int,n:string>")).alias("r")).select("r.*")
    assert [(r.id, r.n) for r in df.collect()] == [(1, "a"), (1, None)]
    rows = spark.createDataFrame([(1, 1, "", "x"), (1, 2, "b", "y"), (1, 3, "c", None)], "id int, o int, a string, b string")
    assert [tuple(r) for r in listings.filled(rows, "id", "o").collect()] == [(1, "b", "x")]


def test_written_dates(spark):
    given = {
        "2020-03-04": ("2020-03-04", "2020-03-04", 2020),
        "04/03/2020 - 05-03-2021": ("2020-03-04", "2020-03-04 to 2021-03-05", 2020),
        "2020": ("2020", "2020", 2020),
        "1800": (None, "1800", None),
        "2020-21": (None, "2020-21", None),
        "2020 - 2021": (None, "2020-2021", None),
        "2020-23": (None, "2020-23", None),
        "2020-02-31": (None, "2020-02-31", None),
        "not funded yet": (None, "not funded yet", None),
        "": (None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in given], "t string").select("t", listings.written_date(F.col("t"), 2026).alias("w")).select("t", "w.*")
    assert {r.t: (r.date, r.label, r.year) for r in df.collect()} == given


def test_lines_and_margin(spark):
    words = [("d", 1, "b", 50.0, 60.0, 11.5, 20.0), ("d", 1, "a", 0.0, 9.0, 10.0, 20.0), ("d", 1, "c", 0.0, 9.0, 13.0, 22.0), ("d", 1, "d", 20.0, 29.0, 14.9, 22.0)]
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, top double, bottom double")
    assert [(r.line, r.text) for r in layout.page_lines(df).orderBy("line").collect()] == [(0, "a b"), (1, "c d")]
    chars = [("d", 1, 30.0, 100.0, 104.0, "A"), ("d", 1, 30.5, 95.0, 99.0, "b"), ("d", 1, 30.0, 80.0, 84.0, "C"), ("d", 1, 43.0, 100.0, 104.0, "D"), ("d", 1, 300.0, 1.0, 2.0, "x")]
    df = spark.createDataFrame(chars, "doc string, page int, x0 double, top double, bottom double, ch string")
    assert [r.name for r in layout.margin_names(df).collect()] == ["Ab C D"]


def test_assignment_is_least(spark):
    rng = random.Random(3)
    names = ["Acme", "Private Limited", "Labs and", "Foo Pvt", "Bar"]
    for _ in range(40):
        tops = sorted(rng.uniform(0, 60) for _ in range(rng.randrange(5)))
        lines = [(t, t + 8, rng.choice(names)) for t in tops]
        anchors = [(t, t + 8) for t in sorted(rng.uniform(0, 60) for _ in range(rng.randrange(1, 4)))]

        def cost(runs, lines=lines, anchors=anchors):
            used = sum(k - i for i, k in runs)
            return layout.SKIPPED * (len(lines) - used) + sum(layout.misfit(lines, anchors, i, k, j) for j, (i, k) in enumerate(runs))

        cuts = [(i, k) for i in range(len(lines) + 1) for k in range(i, len(lines) + 1)]
        every = [c for c in itertools.product(cuts, repeat=len(anchors)) if all(a[1] <= b[0] for a, b in itertools.pairwise(c))]
        assert abs(cost(layout.assign(lines, anchors)) - min(map(cost, every))) < 1e-9
    lines = spark.createDataFrame([("d", 1, 10.0, 18.0, "Acme"), ("d", 1, 20.0, 28.0, "Private Limited"), ("d", 1, 60.0, 68.0, "Foo")], "doc string, page int, top double, bottom double, text string")
    anchors = spark.createDataFrame([("d", 1, 15.0, 23.0), ("d", 1, 60.0, 68.0), ("e", 1, 1.0, 2.0)], "doc string, page int, top double, bottom double")
    assert sorted((r.doc, r.anchor, r.name) for r in layout.anchored_names(lines, anchors).collect()) == [("d", 0, "Acme Private Limited"), ("d", 1, "Foo"), ("e", 0, "")]


def test_brief(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = briefs.markdown(reports.with_signals(t.base, t.signals)).collect()
    assert len(rows) == 150 and all(r.brief.startswith("# ") and "## Evidence" in r.brief for r in rows)
    seen, counted = reports.metered(t.companies, "rows")
    seen.collect()
    assert counted.get["rows"] == 150


def test_deep_records(spark):
    df = spark.createDataFrame([('{"a": [{"t": 1, "d": 2}, {"t": 3}], "b": {"t": 4, "d": 5}}',), ("oops",), (None,)], "j string")
    rows = [r[0] for r in df.select(listings.deep_records(F.col("j"), ("t", "d"))).collect()]
    assert rows == [['{"t": 1, "d": 2}', '{"t": 4, "d": 5}'], [], []]


# words in rows of eight, forty rows a page; every other line is an anchor. The states of the partition are (line, anchor): from
# the last anchor on, the least cost of the rest, which line an anchor's run begins with, and where it ends
PARTITION = r"""
WITH RECURSIVE w AS (SELECT CAST(doc_id AS VARCHAR) AS doc, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS n FROM documents),
l AS (SELECT doc, (n // 320)::INT AS page, n // 8 % 40 AS i, min(n // 8 % 40 * 12.0 + n % 2)::DOUBLE AS top, (n // 8 % 40 * 12.0 + 10)::DOUBLE AS bottom, string_agg(word, ' ' ORDER BY n) AS text FROM w GROUP BY 1, 2, 3, 5),
a AS (SELECT doc, page, i // 2 AS j, top, (top + bottom) / 2 AS centre FROM l WHERE i % 2 = 0),
p AS (SELECT doc, page, count(*) AS n, count(*) FILTER (i % 2 = 0) AS m FROM l GROUP BY 1, 2),
away AS (SELECT l.doc, l.page, i, j, abs((l.top + bottom) / 2 - centre) AS d FROM l JOIN a USING (doc, page)),
two AS (SELECT doc, page, i, list_sort(list(d))[1] AS d1, list_sort(list(d))[2] AS d2 FROM away GROUP BY 1, 2, 3),
upto AS (SELECT doc, page, i, j, sum(greatest(0, d - CASE WHEN d = d1 THEN coalesce(d2, d) ELSE d1 END)) OVER (PARTITION BY doc, page, j ORDER BY i) AS s FROM away JOIN two USING (doc, page, i)),
misfit AS (
  SELECT f.doc, f.page, f.i, g.i + 1 AS k, a.j, least(abs((f.top + g.bottom) / 2 - a.centre), abs(f.top - a.top)) + gs.s - coalesce(fs.s, 0)
    + 50.0 * (regexp_matches(f.text, '^(private|limited|pvt\.?|ltd\.?|llp|\(opc\))(\s|$)', 'i')::INT + regexp_matches(g.text, '(\b(private|pvt\.?|and|of|&)|-)$', 'i')::INT) AS cost
  FROM l f JOIN l g ON f.doc = g.doc AND f.page = g.page AND g.i BETWEEN f.i AND f.i + 5 JOIN a ON a.doc = f.doc AND a.page = f.page
  JOIN upto gs ON gs.doc = g.doc AND gs.page = g.page AND gs.i = g.i AND gs.j = a.j LEFT JOIN upto fs ON fs.doc = f.doc AND fs.page = f.page AND fs.i = f.i - 1 AND fs.j = a.j
  UNION ALL SELECT doc, page, unnest(range(0, n + 1)), unnest(range(0, n + 1)), j, 200.0 FROM p JOIN a USING (doc, page)),
steps AS (
  SELECT doc, page, m AS j, unnest(range(0, n + 1)) AS i, 25.0 * (n - unnest(range(0, n + 1))) AS cost, 0::BIGINT AS start, 0::BIGINT AS stop FROM p
  UNION ALL
  SELECT doc, page, j, i, b.c - 25.0 * i, b.i, b.k FROM (
    SELECT doc, page, j, i, min({'c': r.c + 25.0 * i, 'i': i, 'k': r.k}) OVER (PARTITION BY doc, page, j ORDER BY i DESC) AS b FROM (
      SELECT x.doc, x.page, x.j, x.i, min({'c': x.cost + steps.cost, 'k': x.k}) AS r FROM steps JOIN misfit x ON x.doc = steps.doc AND x.page = steps.page AND x.j = steps.j - 1 AND x.k = steps.i GROUP BY ALL))),
path AS (
  SELECT doc, page, 0::BIGINT AS j, start, stop FROM steps WHERE j = 0 AND i = 0
  UNION ALL SELECT s.doc, s.page, s.j, s.start, s.stop FROM path JOIN steps s ON s.doc = path.doc AND s.page = path.page AND s.j = path.j + 1 AND s.i = path.stop JOIN p ON p.doc = s.doc AND p.page = s.page WHERE s.j < p.m)
SELECT path.doc, path.page, path.j::INT AS anchor, coalesce(string_agg(l.text, ' ' ORDER BY l.i), '') AS name
FROM path LEFT JOIN l ON l.doc = path.doc AND l.page = path.page AND l.i >= start AND l.i < stop GROUP BY 1, 2, 3
"""


def test_partition_equals_sql(spark):
    """Dynamic programming over (line, anchor) as a recursive query, on the pages of a third of the smallest documents."""
    import duckdb

    from lodestone.plans import catalog

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet' WHERE doc_id % 3 = 0")
    expected = sorted(con.execute(PARTITION).fetchall())
    wanted = {row[0] for row in expected}
    found = catalog.queries()["page_lines"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in found if r.doc in wanted) == expected and len(expected) > 1000


def test_lines_go_on_over_batches(spark):
    """The lines of pages that are cut into batches of three words, with words without a text, equal those of a plain loop."""
    rng = random.Random(3)
    words = [(f"d{i % 5}", i % 2, rng.choice(["a", "b", None]), float(rng.randrange(9)), 0.0, rng.randrange(40) * 0.75, float(rng.randrange(90))) for i in range(300)]
    words += [("long", 0, str(i), float(-i), 0.0, 1.0, 2.0) for i in range(20)]
    expected = []
    for page in sorted({w[:2] for w in words}):
        lines = []
        for w in sorted((w for w in words if w[:2] == page), key=lambda w: (w[5], w[3], w[6], w[2] is None, w[2] or "")):
            if not lines or abs(w[5] - lines[-1][0][5]) > layout.SAME_LINE:
                lines.append([])
            lines[-1].append(w)
        expected += [(*page, n, min(w[5] for w in x), max(w[6] for w in x), " ".join(w[2] for w in sorted(x, key=lambda w: w[3]) if w[2])) for n, x in enumerate(lines)]
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, top double, bottom double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        found = layout.page_lines(df)
        assert sorted(map(tuple, found.collect())) == expected
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()  # a call of Python a page takes longer than its words
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_pages_of_any_length_are_dealt(spark):
    """600 anchors among 1,200 lines, two of each: the plan by columns is that of single lines, and no call a line is left open."""
    lines = [(i * 12.0, i * 12.0 + 10, "Firm" if i % 2 == 0 else "Private Limited") for i in range(1200)]
    anchors = [(a, a + 22) for a, _, text in lines if text == "Firm"]
    runs = [(i, i + 2) for i in range(0, 1200, 2)]
    assert layout.assign(lines, anchors) == runs
    rows = [("d", page, *x) for page in range(3) for x in lines[: 40 * page + 2]]
    df = spark.createDataFrame(rows, "doc string, page int, top double, bottom double, text string")
    beside = spark.createDataFrame([("d", page, *a) for page in range(3) for a in anchors[: 20 * page + 1]] + [("e", None, 1.0, 2.0)], "doc string, page int, top double, bottom double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        found = layout.anchored_names(df, beside).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    expected = [("d", page, j, "Firm Private Limited") for page in range(3) for j in range(20 * page + 1)] + [("e", None, 0, "")]
    assert sorted(map(tuple, found)) == expected


def test_columns_equal_single_misfits():
    rng = random.Random(9)
    for _ in range(30):
        lines = sorted((rng.random() * 90, rng.random() * 99, rng.choice(["a", "pvt", "b and", "limited"])) for _ in range(rng.randrange(12)))
        anchors = sorted((rng.random() * 90, rng.random() * 99) for _ in range(rng.randrange(1, 5)))
        found = layout.misfits(lines, anchors, slice(0, len(anchors)))
        for i, k, j in itertools.product(range(len(lines) + 1), range(layout.MOST_LINES + 1), range(len(anchors))):
            assert found[i, k, j] == (layout.misfit(lines, anchors, i, i + k, j) if i + k <= len(lines) else float("inf"))


def test_pages_of_one_shape_equal_single_pages():
    """Costs with ties, lines that go on, and pages without lines or with a single anchor, dealt together as one by one."""
    rng = random.Random(4)
    for n, m in ((0, 2), (1, 1), (3, 1), (7, 3), (12, 6), (5, 8)):
        pages = []
        for i in range(9):
            lines = sorted((rng.randrange(40) * 2.5, rng.randrange(90) * 1.5, rng.choice([None, "a", "pvt x", "b and", "x" * 30 + " private\n", "limited"])) for _ in range(n)) if i % 2 else [(12.0 * k, 12.0 * k + 10, "a") for k in range(n)]
            anchors = sorted((rng.randrange(90) * 0.7, rng.randrange(90) * 1.1) for _ in range(m)) if i % 3 else [(24.0 * k, 24.0 * k + 10) for k in range(m)]
            pages.append(("d", i, lines, anchors))
        assert layout.assign_pages(pages) == [layout.assign(lines, anchors) for _, _, lines, anchors in pages]


def test_dense_lines_begin_like_single_words():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        new = rng.random(n) < 0.1
        top = rng.choice([0.5, 0.7, 2.0, 3.0], n).cumsum()
        top = np.concatenate([np.sort(x) for x in np.split(np.where(rng.random(n) < 0.1, np.nan, top), np.nonzero(new)[0])])
        # heights that are missing come last in a page
        new[0] |= rng.random() < 0.5
        first, want = (np.nan if new[0] else float(np.nanmin([*top, 9.0])) - 1.0), []
        open_at = first
        for i, x in enumerate(top.tolist()):
            if new[i] or abs(x - open_at) > layout.SAME_LINE:
                want.append(i)
                open_at = x
        assert layout.line_starts(top, new, first).tolist() == want


def test_lines_are_dealt_as_they_are_read(spark):
    """The lines that are anchors and the others go through one shuffle, with the names that two tables of lines give."""
    rng = random.Random(6)
    words = [(f"d{i % 7}" if i % 7 else None, i % 3, rng.choice(["a", "private", "and", None]), float(rng.randrange(9)), 0.0, rng.randrange(60) * 0.75, float(rng.randrange(90))) for i in range(900)]
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, top double, bottom double")
    lines = layout.page_lines(df)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = sorted(map(repr, layout.anchored_names(lines, lines.where("line % 2 = 0")).collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
        found = layout.names_of_words(df, lambda b: b.column("line").to_numpy() % 2 == 0)
        assert sorted(map(repr, found.collect())) == expected and len(expected) > 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    from lodestone.plans import catalog

    plan = catalog.queries()["page_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Generate") == 1, plan
