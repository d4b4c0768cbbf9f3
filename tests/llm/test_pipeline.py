"""The corpus pipeline against a plain version of each stage, and the queries' registration."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lodestone.llm import langid, line_dedup, simhash
from tests.llm.test_operators import lower_words

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage, and the final rows."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars"] for df in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    before, after = rows(stages[0]), rows(stages[1])
    gone = set(before) - set(after)
    assert all(not langid.has_letter(before[i].text) for i in gone) and all(after[i] == before[i] for i in after)


def test_line_stage(spark, stages):
    before, after = rows(stages[1]), rows(stages[2])
    plain = {r.doc_id: r for r in line_dedup.dedup(stages[1]).collect()}
    for i, r in before.items():
        kept = plain[i].text
        assert (i in after) == (plain[i].n_removed == 0 or bool(kept.strip()))
        if i in after:
            assert after[i].text == kept and (after[i].text == r.text or after[i].n_chars == len(kept))


@pytest.mark.parametrize("at", [2, 0])
def test_near_duplicate_stage(spark, stages, at):
    """All pairs by brute force: five-word shingles at a similarity of 0.8, by chains; the smallest id of each group stays.

    The stage's own input, and the documents as they are, in which lines of copies haven't gone.
    """
    before = rows(stages[at])
    after = rows(stages[3] if at == 2 else corpus_pipeline.simhash_near_dedup(spark, stages[0], SMALL))
    ids = sorted(before)

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}

    own, root = [shingles(before[i].text) for i in ids], list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            both = len(own[a] & own[b])
            if both >= 0.8 * (len(own[a]) + len(own[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {ids[k] for k in range(len(ids)) if root[k] == k}
    assert set(after) == kept and (at == 2 or len(kept) < len(ids) - 5)


@pytest.mark.parametrize("few", [16, 1])
def test_near_copies_are_found(spark, few, monkeypatch):
    """Planted copies with 3 and 6 of 300 words replaced, alone and in a large group; clean texts that share a passage stay."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(41)

    def words(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]

    def copy(text, n):
        text = list(text)
        for i in rng.sample(range(len(text)), n):
            text[i] = f"new{rng.randrange(1000)}"
        return text

    texts, passage = [], words(60)
    for _ in range(60):
        own = words(300)
        texts += [own, copy(own, 3), copy(own, 6)]
    group = words(300)
    texts += [group, *(copy(group, 2) for _ in range(150))]
    clean = [words(120) + passage + words(120) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + clean)], "doc_id bigint, text string")
    found = {r.id: r.component_id for r in simhash.near_copies(docs).collect()}
    firsts = [3 * (i // 3) for i in range(180)] + [180] * 151
    for k in (1, 2):
        assert sum(found[i] == firsts[i] for i in range(k, 180, 3)) >= 0.95 * 60
    assert sum(found[i] == 180 for i in range(181, 331)) >= 0.99 * 150
    assert all(found[i] == i for i in range(331, 391))


@pytest.mark.parametrize("chunk", [1000, 25])
def test_pairs_of_large_bands_are_all_found(spark, chunk, monkeypatch):
    """Pairs whose texts share large bands only, with a least text that is near neither, beside a large group of near copies."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(17)

    def copy(text, n):
        text = list(text)
        for i in rng.sample(range(len(text)), n):
            text[i] = f"new{rng.randrange(10000)}"
        return text

    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [copy(base, 2) for _ in range(80)]
    for _ in range(150):
        own = copy(base, 14)
        texts += [own, copy(own, 4)]
    rng.shuffle(texts)
    keys = [set(simhash.bands(simhash.shingle_hashes(" ".join(t).encode(), 5)).tolist()) for t in texts]
    own = [{tuple(t[i : i + 5]) for i in range(296)} for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r.id: r.component_id for r in simhash.near_copies(docs).collect()}
    near = [(a, b) for a in range(len(texts)) for b in range(a) if 9 * len(own[a] & own[b]) >= 4 * (len(own[a]) + len(own[b]))]
    assert len(near) > 3000 and all(found[a] == found[b] for a, b in near if keys[a] & keys[b])
    assert all(found[i] == i or any(i in pair for pair in near) for i in found) and len(set(found.values())) > 100


def test_decontamination_stage(spark, stages):
    items = [lower_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = {tuple(x[k : k + min(10, len(x))]) for x in items for k in range(len(x) - min(10, len(x)) + 1) if x}
    before, after = rows(stages[3]), rows(stages[4])

    def dirty(t):
        w = lower_words(t)
        return any(tuple(w[s : s + n]) in grams for n in {len(g) for g in grams} for s in range(len(w) - n + 1))

    assert set(after) == {i for i, r in before.items() if not dirty(r.text)}


def test_encoding_stage(stages):
    before, after = rows(stages[4]), rows(stages[5])
    assert set(before) == set(after)
    assert all(after[i].decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest() for i in before)


def test_run_is_the_stages_in_order(spark, stages):
    found = rows(corpus_pipeline.run(spark, SMALL))
    assert found == rows(stages[-1])


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, stages, stage):
    """Null ids and texts, repeated rows, an empty table, and a column that clashes with the stage's own."""
    name, run = corpus_pipeline.STAGES[stage]
    some = stages[0].where("doc_id < 40")
    odd = spark.createDataFrame([(None, "the text of a row without an id", "en", "s", 31)] * 2 + [(1001, None, None, None, None), (1002, "", "en", "s", 0), (1003, " \n ", None, "s", 3)], some.schema)
    docs = some.union(some.where("doc_id < 5")).union(odd)
    for extra in ("score", "rejected", "n_removed", "n_tokens", "hits", "component_id", "kept"):
        docs = docs.withColumn(extra, F.lit("clash"))
    found = run(spark, docs, SMALL)
    assert found.columns == (["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] if stage == 4 else list(corpus_pipeline.COLUMNS))
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    assert set(ids) <= {*(r.doc_id for r in docs.select("doc_id").collect())}
    lost = {"language_id": {1001, 1002, 1003}, "line_dedup": set(), "simhash_near_dedup": {1002, 1003}, "decontamination": set(), "byte_level_bpe": set()}[name]
    assert not lost & set(ids) and (ids.count(None) == 2) == (stage in (0, 1, 2, 3, 4))
    if stage in (1, 3, 4):
        assert {1001, 1002, 1003} <= set(ids) or stage == 1
    assert run(spark, docs.limit(0), SMALL).count() == 0


def test_registration(spark):
    known = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in known) for n in range(1, 14)] == [1] * 13 and "pipeline" in known
    assert set(__spark_entry__.oracle_sql()) <= set(known)
