"""Steps around the merge, and award and affiliation rules, on small rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import awards
from lodestone.operators import link, steps
from lodestone.plans import export
from tests.test_engine import values


def test_award_names(spark):
    assert values(spark, awards.is_company, "Villgro Foundation Private Limited", "Dr. A B", "IIT Madras", "Ajaya P Katti", "Soil Genomics", "Madhumohan R", "Acme", None) == [True, False, False, False, True, False, True, True]
    assert values(spark, lambda x: awards.is_company(x, holds_people=False), "Soil Sathi") == [True]
    assert values(spark, awards.city_from, "Telangana, Hyderabad", "Rewari, (Haryana)", "India", None, "Bengaluru Rural, Karnataka") == ["Hyderabad", "Rewari", None, None, "Bengaluru Rural"]
    got = values(spark, awards.split_company, "M/s WellRx Technologies Pvt. Ltd. Rewari, (Haryana)", "Acme, Pune", "Solo")
    assert [(r.name, r.city) for r in got] == [("WellRx Technologies Pvt. Ltd.", "Rewari"), ("Acme", "Pune"), ("Solo", None)]
    assert values(spark, awards.project_title, "A pump.", 'TDB supports M/s X for "Better Pumps"', "TDB supports X for new pumps.", "M/s X Ltd", None) == ["A pump", "Better Pumps", "new pumps", None, None]


def test_affiliations(spark):
    generic = ("labs", "energy", "technologies")
    assert values(spark, lambda x: awards.needle(x, generic), "Foo (Barn Bazaar Limited)", "Asha Rao", "Acme", "Energy Labs", "Zymergenx Pvt Ltd", "KeraX Bio, A Subsidiary") == ["Barn Bazaar", None, None, None, "Zymergenx", "KeraX Bio"]
    works = spark.createDataFrame([(1, [(["Zymergenx Pvt Ltd, Pune; Other Institute, Paris"],)]), (2, [(["Zymergenx Trust and Company Law Tribunal, Delhi"],)]), (3, [(["Zymergenx Research Facility, Pune"],)])], "work_id int, authorships array<struct<raw_affiliation_strings:array<string>>>")
    parts = awards.affiliation_parts(works, r"\b(?:pune|delhi)\b")
    needles = spark.createDataFrame([("z", "zymergenx")], "id string, needle string")
    found = link.affiliations(needles, parts.select("part_id", "text")).join(parts, "part_id").where(awards.opens_part(F.col("raw"), F.lit("zymergenx")))
    assert [(r.id, r.work_id) for r in found.collect()] == [("z", 1)]


def test_guards_and_unions(spark):
    rows = spark.createDataFrame([(str(i), i) for i in range(5)], "id string, n int")
    assert steps.complete(rows, 10).count() == 5
    with pytest.raises(ValueError):
        steps.complete(rows, 5)
    assert steps.union_by_id(rows, rows).count() == 5
    out = steps.ordered_union(rows.where("n < 2"), rows.where("n > 0").withColumn("n", F.col("n") + 10), "id", "n")
    assert sorted(r.n for r in out.collect()) == [0, 1, 12, 13, 14]
    assert steps.replace_known(rows, rows.withColumn("n", F.lit(9)), rows.where("n = 1")).where("n = 9").count() == 1
    assert steps.slices(rows.withColumn("source", F.lit("s")), 2).agg(F.max("slice")).first()[0] == 2
    table = spark.createDataFrame([("cap", "5")], "key string, value string")
    assert [steps.setting(table, k, "1").first().value for k in ("cap", "other")] == ["5", "1"]


def test_sweep_and_numbers(spark):
    label = "DPIIT-recognised startup. Industry: Robotics. Stage: Scaling."
    rows = spark.createDataFrame([("a", "A", label, "1", "9.9", "register-label"), ("b", "B", label, "2", "2.7", "register-label"), ("c", "C", "prose", "1", "9.9", "register-label"), ("d", "D", label, "1", "9.9", "description")], "id string, name string, description string, sector_id string, subsector_id string, classify_basis string")
    assert [r.company_id for r in steps.stale_labels(rows, rows.limit(0)).collect()] == ["a"]
    assert steps.stale_labels(rows, rows).count() == 0
    signals = spark.createDataFrame([("a", "x (DIPP12)", 1), ("a", "x (DIPP13)", 2), ("b", "none", 1)], "company_id string, label string, found_at int")
    assert [tuple(r) for r in steps.held_numbers(signals).collect()] == [("a", "DIPP13")]


def test_awardees_and_hubs(spark):
    lists = spark.createDataFrame([(1, "Acme Ltd", "acme"), (1, "Foo", "foo-inc"), (2, "Bar", "bar")], "round int, name string, slug string")
    typed = spark.createDataFrame([(1, "foo")], "round int, slug string")
    assert [tuple(r) for r in steps.missing_awardees(lists, typed).collect()] == [(1, 1, 1)]
    events = spark.createDataFrame([("a", "h", None, 1), ("a", "h", "2021", 2), ("a", "h", "2020", 3), ("b", "h", None, 5), ("b", "h", None, 4)], "company_id string, hub string, date string, pos int")
    assert sorted(r.pos for r in steps.one_signal_per_hub(events).collect()) == [3, 4]
    finalists = spark.createDataFrame([("k", None), ("m", "Goa")], "key string, city string")
    winners = spark.createDataFrame([("k", "Pune", 2), ("k", "Delhi", 1), ("m", "x", 1)], "key string, city string, pos int")
    assert sorted((r.key, r.city) for r in steps.with_city(finalists, winners).collect()) == [("k", "Delhi"), ("m", "Goa")]


def test_queues_and_budgets(spark):
    domains = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "domain string")
    cache = spark.createDataFrame([("a", "empty", 1), ("b", "failed", 9), ("c", "empty", 0)], "domain string, outcome string, asked_at int")
    assert [r.domain for r in steps.lookup_queue(domains, cache).collect()] == ["d", "b", "c", "a"]
    rows = spark.createDataFrame([("x", 1), ("p", 2), ("q", 3)], "source string, seq int")
    assert [r.source for r in steps.by_priority(rows, ["q", "p"]).collect()] == ["q", "p", "x"]
    log = spark.createDataFrame([(1, "d", 1, 0.05), (2, "d", 2, None), (3, "d", 3, 0.0), (4, "e", 1, None)], "id int, day string, asked_at int, cost_usd double")
    assert [r.allowed for r in steps.reserved(log, 0.04, 0.1).orderBy("id").collect()] == [True, True, False, True]
    eligible = spark.createDataFrame([("a", "t", "w", "s"), ("b", None, "w", "s"), ("c", "t", "w", "held"), ("d", "t", "", "s")], "id string, description string, website string, source string")
    assert sorted(r.id for r in steps.eligible(eligible, spark.createDataFrame([("c",)], "id string"), ["held"]).collect()) == ["a", "c"]


def test_small_expressions(spark):
    assert values(spark, steps.short_date, "2023-08-25", "2023", None) == ["25 Aug 2023", "2023", None]
    assert values(spark, steps.basis_kind, "Self-reported", "government register", "site", None)[:3] == ["unverified", "record", "own"]
    names = [("incubator", "X startups", None), ("grant", "SINE IIT Bombay DST NIDHI-PRAYAS, Cohort 5", None), ("grant", "BIRAC BIG 21", None), ("dpiit", "", "expired"), ("award", "TDB, 2020", None), ("press", "", None), ("patent", "", None)]
    df = spark.createDataFrame(names, "k string, l string, s string").select(steps.trace_name(F.col("k"), F.col("l"), F.lit(None).cast("string"), F.col("s")))
    assert [r[0] for r in df.collect()] == ["X portfolio", "DST NIDHI PRAYAS", "BIRAC BIG", "DPIIT recognition", "TDB", "press mention", None]
    assert steps.canonical_query({"b": " 2 ", "a": "1", "x": "9", "c": ""}, ("a", "b", "c")) == "a=1&b=2"
    df = spark.createDataFrame([(["Data Engineer", "data  engineer", "Nurse"],)], "t array<string>").select(steps.distinct_roles(F.col("t"), 1).alias("r"))
    assert (df.first().r["count"], df.first().r["first"]) == (2, ["Data Engineer"])
    rows = spark.createDataFrame([("1", "Acme One"), ("2", "Acme On"), ("3", "Zed")], "id string, name string")
    assert [tuple(r) for r in steps.near_duplicate_pairs(rows).collect()] == [("1", "2")]
    changed = steps.migrated(rows, {"name": (F.col("id") == "3", F.lit("Z"))})
    assert [r.name for r in changed.orderBy("id").collect()][2] == "Z"
    status = spark.createDataFrame([("verified", "t", None, "p"), ("verified", "t", None, None), ("discovered", "t", None, None), (None, None, "refused", None)], "i string, t string, o string, p string")
    assert [r[0] for r in status.select(steps.product_status(*map(F.col, "itop"))).collect()] == ["read", "nothing-stated", "unverified", "refused"]


def test_placements(spark):
    taxonomy = spark.createDataFrame([("1", "1.1", ["x"]), ("2", "2.1", ["y"])], "sector_id string, subsector_id string, projects array<string>")
    answers = spark.createDataFrame([("a", "1", "1.1", "x"), ("b", "1", "2.1", "y"), ("c", "2", "2.1", "x"), ("d", "1", None, None)], "id string, sector_id string, subsector_id string, project_type string")
    found = {r.id: (r.subsector_id, r.project_type, r.on_map) for r in steps.valid_placements(answers, taxonomy).collect()}
    assert found == {"a": ("1.1", "x", True), "b": (None, None, False), "c": ("2.1", None, True), "d": (None, None, False)}
    labels = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "number int, label string")
    topics = spark.createDataFrame([(0, "T", [1, 2, 9]), (1, "U", [2])], "place int, topic string, numbers array<int>")
    assert sorted(map(tuple, steps.regrouped(labels, topics).collect())) == [("p", "T"), ("q", "T"), ("r", "r")]


def test_near_names_with_a_typo_in_the_first_word(spark):
    rows = spark.createDataFrame([("1", "Akme Labs"), ("2", "Acme Labs"), ("3", "Acme Lab"), ("4", "Bolt Works"), ("5", None), ("6", "a"), ("7", "")], "id string, name string")
    found = sorted(tuple(r) for r in steps.near_duplicate_pairs(rows).collect())
    assert found == [("1", "2"), ("1", "3"), ("2", "3"), ("6", "7")]


def test_export_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, '=1"', None), ("a", 0, "né", "verified")], "id string, place int, name string, website_identity string").withColumns({"product": F.lit("x"), "contact_email": F.lit("a@b.example")})
    export.write(rows, ["place"], "https://x.example", str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8", newline="") for p in sorted((tmp_path / "out").glob("part-*")))
    lines = text.split("\r\n")
    assert lines[0].startswith('\ufeff"name","builds"') and lines[0].count('","') == 40 and lines[3] == ""
    assert lines[1].startswith('"né","x","the company\'s own homepage"') and '"a@b.example"' in lines[1] and lines[1].endswith('"https://x.example/c/a"')
    assert lines[2].startswith('"\'=1"""') and "a@b.example" not in lines[2]
