"""The ten operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import collections
import hashlib
import itertools
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, langid, license_scan, line_dedup, sharding, simhash, substring_dedup, token_counts, topk
from lodestone.llm.common import Workspace
from lodestone.llm.components import connected_components
from lodestone.llm.queries import PATTERN, RANKS
from lodestone.llm.sketch import bitmap, in_bitmap

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, langs=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentences(rng, n, words=40, vocabulary=200):
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words)) for _ in range(n)]


ODD = [None, "", "   ", "\n\n", "!!! ???", "a", "é", "x " * 5000, "日本語", "a\tb\x0bc"]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


# 1 ----------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, small):
    model = langid.fit(small.where(~langid.held_out()).select("text", "lang"))
    found = langid.identify(small.select("*", langid.held_out().alias("out")), model).where("out").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.9
    assert not any(r.rejected for r in found)


def test_language_odd_rows(spark, small):
    assert sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1000)) == spark.range(1000).where(langid.held_out("id")).count()
    model = langid.fit(small.select("text", "lang"))
    found = {r.doc_id: r for r in langid.identify(docs(spark, ODD).withColumn("score", F.lit("clash")), model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].rejected and found[i].score == 0 for i in (0, 1, 2, 3, 4))
    assert all(found[i].lang_pred != "und" and 0 <= found[i].score <= 1 for i in (5, 6, 7, 8, 9))
    far = ["Всем привет, это простой текст на русском языке. " * 5, "这是一个简单的中文句子" * 10, "qxzjkvwpgb" * 50]
    assert all(r.rejected and r.lang_pred != "und" for r in langid.identify(docs(spark, far), model).collect())
    assert not any(r.rejected for r in langid.identify(docs(spark, ["Re.", "A.", "Avec."]), model).collect())
    none = langid.fit(docs(spark, ODD[:4]).select("text", "lang"))
    assert {r.lang_pred for r in langid.identify(docs(spark, ODD), none).collect()} == {"und"}
    assert langid.identify(docs(spark, []), model).count() == 0


def test_language_is_the_nearest_centroid(spark, small, monkeypatch):
    """Brute force: dictionaries of n-grams, plain sums, every centroid against every text."""
    import math

    import numpy as np

    rows = small.where(~langid.held_out()).select("text", "lang")
    model = langid.fit(rows, per_lang=30)
    assert set(model.langs) == {r.lang for r in small.collect()} and all(model.langs.count(x) <= langid.CENTROIDS for x in model.langs)
    texts = [r.text for r in small.where(langid.held_out()).collect()][:25]

    def slow(text):
        flat = (" " + " ".join("".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).split()) + " ").encode()
        counts = {}
        for n in (2, 3):
            for i in range(len(flat) - n + 1):
                code = int.from_bytes(flat[i : i + n], "big") * 2654435761 % (1 << 32) >> 19
                counts[code] = counts.get(code, 0) + 1
        v = {k: (1 + math.log(n)) * float(model.idf[k]) for k, n in counts.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return [sum(x * float(c[k]) for k, x in v.items()) / length for c in model.centroids]

    for size in (64 << 20, 2 * langid.DIM):  # all centroids at once, and one after another
        monkeypatch.setattr(langid, "MODEL_BYTES", size)
        found = {r.doc_id: r for r in langid.identify(docs(spark, texts), model).collect()}
        for i, t in enumerate(texts):
            cosines = slow(t)
            assert model.langs[int(np.argmax(cosines))] == found[i].lang_pred and abs(found[i].score - min(1, max(cosines))) < 1e-4


def test_unlearned_language_is_rejected(spark, small):
    for left_out in ("es", "fr"):
        model = langid.fit(small.where(~langid.held_out() & (F.col("lang") != left_out)).select("text", "lang"))
        found = langid.identify(small.where("length(text) > 800"), model).collect()
        far, own = ([r.rejected for r in found if (r.lang == left_out) == x] for x in (True, False))
        assert len(far) > 3 and sum(far) >= 0.8 * len(far) and sum(own) <= 0.02 * len(own)


def test_language_sample_is_bounded(spark):
    rows = docs(spark, [f"text {i} " + "long words " * (i * 50) for i in range(80)], ["en"] * 80).select("text", "lang")
    sizes = [len(r.text) for r in langid.sample_rows(rows, 20, 30_000).collect()]
    assert 1 <= len(sizes) <= 20 and sum(sizes) < 30_000 + max(sizes)


def test_language_of_copies_is_learned(spark, small):
    """Thousands of copies of one text beside few others, and nothing but copies: both languages are learned and kept."""
    rng = random.Random(21)
    words = ["кот", "дом", "лес", "река", "поле", "город", "зима", "утро"]
    some = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    greek = ["αυτό είναι ένα μικρό κείμενο για τη γλώσσα " * 5]
    texts = [some[0]] * 20_000 + some + greek * 3_000
    rows = docs(spark, texts, ["ru"] * 20_030 + ["el"] * 3_000).select("text", "lang").union(small.select("text", "lang"))
    sample = [(r.lang, r.text) for r in langid.sample_rows(rows).collect()]
    assert len(set(sample)) == len(sample) and {t for x, t in sample if x == "ru"} == set(some) and [t for x, t in sample if x == "el"] == greek
    found = langid.identify(docs(spark, some + greek), langid.fit(rows)).collect()
    assert [r.lang_pred for r in sorted(found, key=lambda r: r.doc_id)] == ["ru"] * 30 + ["el"] and not any(r.rejected for r in found)


# 2 ----------------------------------------------------------------------------------------------------------------


def line_groups(texts):
    """Lines in groups by brute force: edit similarity over all pairs."""
    places = [(d, i, b" ".join(w)) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if (w := lower_words(x))]
    parent = list(range(len(places)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(places)), 2):
        a, b = places[i][2].decode(), places[j][2].decode()
        most = (1 - line_dedup.SIMILARITY) * max(len(a), len(b)) + 1e-9
        if a == b or abs(len(a) - len(b)) <= most and len(set(a.split()) ^ set(b.split())) <= 2 * most and distance(a, b) <= most:
            parent[root(i)] = root(j)
    groups = {}
    for i, p in enumerate(places):
        groups.setdefault(root(i), []).append(p[:2])
    return {p for g in groups.values() for p in g if p != min(g)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(enumerate(b, 1), lambda left, jy, old=row, x=x: min(left + 1, old[jy[0]] + 1, old[jy[0] - 1] + (x != jy[1])), initial=i))
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        for most in (0, 1, 3, 20):
            assert line_dedup.edit_distance(a, b, most) == min(distance(a, b), most + 1), (a, b, most)
    for _ in range(300):
        a = [rng.choice(["a", "bc", "def", "gh"]) for _ in range(rng.randrange(12))]
        b = [*a[rng.randrange(3) :], *(rng.choice(["a", "x", "def"]) for _ in range(rng.randrange(4)))]
        assert line_dedup.aligned_distance(a, b, 1000) >= distance(" ".join(a), " ".join(b)), (a, b)
    long = " ".join(f"word{rng.randrange(3000)}" for _ in range(60_000))
    cut = long.split()
    cut[5000:5100], cut[20_000:20_000] = [], ["new"] * 50
    began = time.process_time()
    assert line_dedup.similar(long, " ".join(cut)) and not line_dedup.similar(long, " ".join(sorted(cut)))
    assert time.process_time() - began < 20


def test_normal_lines():
    texts = [None, "", "One,  TWO\n\n--\nthree é!\r\n", "no feed", "\n\nlast\n"]
    lines = line_dedup.normal_lines([x and x.encode() for x in texts])
    assert [(int(d), int(p), lines[i].decode()) for i, (d, p) in enumerate(zip(lines.doc, lines.place, strict=True))] == [(2, 0, "one two"), (2, 3, "three é"), (3, 0, "no feed"), (4, 2, "last")]
    assert lines.sizes.tolist() == [2, 2, 2, 1]
    assert len(line_dedup.normal_lines([]).begin) == len(line_dedup.normal_lines([b" - "]).begin) == 0


@pytest.mark.parametrize("hot", [64, 3])
def test_line_dedup_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "CHUNK", 4)
    rng = random.Random(5)
    base = sentences(rng, 12, 60)
    lines = [*base]
    for _ in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] += "s"
        lines.append(" ".join(words))
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)] + ODD + ["Same, LINE!\nsame line\n\n--"]
    gone = line_groups(texts)
    found = line_dedup.dedup(docs(spark, texts).withColumn("n_lines", F.lit(-1))).collect()
    assert len(found) == len(texts)
    for r in found:
        own = (texts[r.doc_id] or "").split("\n")
        kept = [x for i, x in enumerate(own) if (r.doc_id, i) not in gone]
        assert r.n_removed == len(own) - len(kept)
        assert r.text == (None if texts[r.doc_id] is None else "\n".join(kept))
    assert line_dedup.dedup(docs(spark, [])).count() == 0
    assert [r.text for r in line_dedup.dedup(docs(spark, ["a b", "a b"], ids=[None, None])).collect()] == ["a b", "a b"]


def changed_lines(seed, sizes, kinds, each=12):
    """(line, near copy) pairs by edit similarity alone: words replaced, and characters replaced anywhere."""
    rng, letters, out = random.Random(seed), "abcdefghijklmnopqrstuvwxyz", []
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 10)))
    for n in sizes:
        for kind in kinds:
            found = 0
            while found < each:
                words = [word() for _ in range(n)]
                a = b = " ".join(words)
                if kind == "characters":
                    for _ in range(int(len(a) * 0.04)):
                        i = rng.randrange(len(b))
                        b = b[:i] + (rng.choice(letters) if b[i] != " " else " ") + b[i + 1 :]
                else:
                    for i in rng.sample(range(n), min(kind, n)):
                        words[i] = word()
                    b = " ".join(words)
                if a != b and distance(a, b) <= (1 - line_dedup.SIMILARITY) * max(len(a), len(b)) + 1e-9:
                    out.append((a, b))
                    found += 1
    return out


@pytest.mark.parametrize("hot", [64, 1])
def test_line_dedup_finds_near_lines_by_edit_similarity(spark, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    pairs = changed_lines(11, (10, 20, 30, 50), (1,)) + changed_lines(12, (30, 50), (2, 3, "characters"))
    found = {r.doc_id: r for r in line_dedup.dedup(docs(spark, [x for p in pairs for x in p])).collect()}
    assert all(found[2 * k].n_removed == 0 for k in range(len(pairs)))
    one = 4 * 12
    assert all(found[2 * k + 1].n_removed == 1 for k in range(one))  # one stretch: none is missed
    assert sum(found[2 * k + 1].n_removed for k in range(one, len(pairs))) >= 0.95 * (len(pairs) - one)


@pytest.mark.parametrize(("alphabet", "size"), [("cjk", 60), ("cjk", 150), ("cjk", 1000), ("cjk", 3000), ("url", 150), ("url", 1500), ("words", 1300), ("words", 5000)])
def test_line_dedup_finds_long_lines_and_lines_without_spaces(spark, alphabet, size):
    """Each class by itself: one to four characters in a hundred replaced, anywhere in the line."""
    rng = random.Random(size)
    letters = "".join(map(chr, range(0x4E00, 0x5E00))) if alphabet == "cjk" else "abcdefghijklmnopqrstuvwxyz0123456789" + ("" if alphabet == "url" else "     ")
    lines, n = [], 20
    for k in range(n):
        a = b = "".join(rng.choice(letters) for _ in range(size))
        for _ in range(max(1, size * (k % 4 + 1) // 100)):
            i = rng.randrange(size)
            b = b[:i] + rng.choice(letters.strip()) + b[i + 1 :]
        lines += [a, b]
    found = {r.doc_id: r.n_removed for r in line_dedup.dedup(docs(spark, lines)).collect()}
    assert not any(found[2 * k] for k in range(n)) and sum(found[2 * k + 1] for k in range(n)) >= 0.9 * n


def test_lines_are_compared_exactly(monkeypatch):
    """Long lines whose alignment by words shows nothing: one word, and words that are all different."""
    rng = random.Random(31)
    a = "".join(rng.choice("abcdef") for _ in range(9000))
    b = list(a)
    for i in rng.sample(range(9000), 850):
        b[i] = "x"
    assert line_dedup.similar(a, "".join(b)) and not line_dedup.similar(a, "".join(b[::-1]))
    b[::9] = ["y"] * 1000
    assert not line_dedup.similar(a, "".join(b))


def test_line_dedup_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 1000} of a text" for i in range(200_000))
    began = time.monotonic()
    found = line_dedup.dedup(docs(spark, [text])).collect()[0]
    assert found.n_lines == 200_000 and found.n_removed >= 199_000 and time.monotonic() - began < 120


def test_line_dedup_recall_on_documents(spark, small):
    """All pairs of distinct lines at an edit similarity of 0.9, by brute force, end in one group."""
    lines = sorted({b" ".join(lower_words(x)).decode() for r in small.collect() for x in (r.text or "").split("\n")} - {""}, key=len)
    lines = [x for x in lines if len(x) <= 700]
    words = [set(x.split()) for x in lines]
    near = []
    for j, b in enumerate(lines):
        most = int(0.1 * len(b) + 1e-9)
        for i in range(j - 1, -1, -1):
            if len(lines[i]) < len(b) - most:
                break
            if len(words[i] ^ words[j]) <= 2 * most and line_dedup.edit_distance(lines[i], b, most) <= most:
                near.append((i, j))
    found = line_dedup.dedup(docs(spark, lines)).collect()
    gone = {r.doc_id for r in found if r.n_removed}
    firsts = components_of(near, len(lines))
    assert len(near) > 10 and sum(j in gone for j in range(len(lines)) if firsts[j] != j) >= 0.95 * sum(firsts[j] != j for j in range(len(lines)))
    assert all(firsts[j] != j for j in gone)


# 3 ----------------------------------------------------------------------------------------------------------------


def removed_words(rows):
    """Kept words by brute force; rows: (id, text)."""
    first, words = {}, {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][s : s + 20]), (i, s))
    out = {}
    for i, own in words.items():
        gone = {k for s in range(len(own) - 19) if first[tuple(own[s : s + 20])] < (i, s) for k in range(s, s + 20)}
        out[i] = [w for k, w in enumerate(own) if k not in gone]
    return out


@pytest.mark.parametrize("hot", [256, 2])
def test_substring_dedup_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(hot)
    passages = sentences(rng, 6, 60, 40)
    texts = [*ODD, "same " * 70, "one two " * 40]
    for _ in range(60):
        words = sentences(rng, 1, rng.randrange(5, 60), 30)[0].split()
        if rng.random() < 0.7:
            at, p = rng.randrange(len(words)), rng.choice(passages).split()
            a = rng.randrange(30)
            words[at:at] = p[a : a + rng.randrange(15, 50)]
        texts.append(" ".join(words))
    texts += texts[-5:]
    expected = removed_words(list(enumerate(texts)))
    found = substring_dedup.dedup(docs(spark, texts).withColumn("kept", F.lit(1))).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.kept == " ".join(expected[r.doc_id]), r.doc_id
        assert r.n_removed == r.n_words - len(expected[r.doc_id])
    assert substring_dedup.dedup(docs(spark, [])).count() == 0
    assert all(r.n_removed == 0 for r in substring_dedup.dedup(docs(spark, ["same " * 30] * 2, ids=[None, None])).collect())


def test_reference_spans(spark):
    rng = random.Random(9)
    passage = sentences(rng, 1, 50)[0]
    text = f"start {' '.join(passage.split()[5:40])} end"
    out = substring_dedup.remove_reference(docs(spark, [text, passage[:30], None]), docs(spark, [passage, None]))
    assert [r.kept for r in out.orderBy("doc_id").collect()] == ["start end", passage[:30], None]
    assert substring_dedup.remove_reference(docs(spark, []), docs(spark, [passage])).count() == 0
    assert [r.kept for r in substring_dedup.remove_reference(docs(spark, ["a  b"]).withColumn("kept", F.lit(1)), docs(spark, [])).collect()] == ["a b"]


def test_reference_shards_by_brute_force(spark, monkeypatch):
    """A reference text that is cut, several shards, overlapping spans."""
    monkeypatch.setattr(substring_dedup, "REFERENCE_WORDS", 60)
    rng = random.Random(10)
    reference = sentences(rng, 3, 200, 300) + sentences(rng, 4, 25, 300) + [None, "", "short"]
    texts = [*ODD]
    for _ in range(30):
        words = sentences(rng, 1, 40, 300)[0].split()
        own = rng.choice(reference[:7]).split()
        a = rng.randrange(len(own))
        words[7:7] = own[a : a + rng.randrange(5, 90)]
        texts.append(" ".join(words))
    grams = {tuple(w[i : i + 20]) for x in reference if x for w in [x.split()] for i in range(len(w) - 19)}
    shards = [r.pieces for r in substring_dedup.reference_shards(docs(spark, reference), "text", 20).collect()]
    assert all(sum(len(x.split()) for x in p) <= 60 for p in shards)
    found = {r.doc_id: r.kept for r in substring_dedup.remove_reference(docs(spark, texts), docs(spark, reference)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = {k for s in range(len(words) - 19) if tuple(words[s : s + 20]) in grams for k in range(s, s + 20)}
        assert found[i] == (None if t is None else " ".join(w for k, w in enumerate(words) if k not in gone))


# 4 ----------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    texts = [
        *ODD,
        "Released under the MIT License. More, mit\nlicense",
        "licensed under the apache license, version 2.0 and the GNU General Public License",
        "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation",
        "mit licenses; MITLICENSE; mit-license",
    ]
    found = {r.doc_id: r for r in license_scan.scan(docs(spark, texts).withColumn("labels", F.lit(1))).collect()}
    n = len(ODD)
    assert [(found[i].n_base, found[i].labels, found[i].score) for i in range(n)] == [(0, "", 0.0)] * n
    assert (found[0].n_words, found[0].first_word, found[7].n_words) == (0, None, 5000)
    assert (found[n].n_base, found[n].first_word, found[n].last_word, found[n].base_labels) == (2, 3, 6, "mit")
    assert (found[n + 1].base_labels, found[n + 1].labels, found[n + 1].score) == ("apache,gpl", "apache,gpl", 1.0)
    assert (found[n + 2].base_labels, found[n + 2].labels) == ("", "cc-by-nc")
    assert found[n + 3].labels == "mit" and 0.9 <= found[n + 3].score < 1
    assert (found[n + 4].n_base, found[n + 4].labels) == (1, "mit")
    assert license_scan.scan(docs(spark, [])).count() == 0


@pytest.mark.parametrize("lead", ["", "# ", " * "])
def test_license_scan_wrapped_notices(spark, lead):
    wrap = lambda t, width: "\n".join(lead + x for x in textwrap.wrap(t, width))
    notices = [f"Some words before.\n\n{wrap(t, width)}\nand after" for _, t in license_scan.TEMPLATES for width in (30, 72)]
    apart = license_scan.TEMPLATES[7][1].split()
    spread = " ".join(w + "\n" + "filler " * 9 for w in apart)  # every word, but in no one place
    found = {r.doc_id: r for r in license_scan.scan(docs(spark, [*notices, spread])).collect()}
    for i in range(len(notices)):
        assert license_scan.TEMPLATES[i // 2][0] in found[i].labels.split(",") and found[i].score == 1.0
    assert (found[len(notices)].labels, found[len(notices)].score) == ("", 0.0)


# 5 ----------------------------------------------------------------------------------------------------------------


def test_sharding_table(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill(names, 1009)
    sizes = [table.count(i) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 1009  # besides the slots of the shard that went
    # the turns, slot by slot
    order = []
    for name in names:
        d = hashlib.md5(name.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % 1009, int.from_bytes(d[8:], "big") % 1008 + 1
        order.append(iter([(a + b * k) % 1009 for k in range(1009)]))
    taken = {}
    while len(taken) < 1009:
        for i, own in enumerate(order):
            if len(taken) < 1009:
                taken[next(s for s in own if s not in taken)] = i
    assert table == [taken[s] for s in range(1009)]
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(wrong)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 1000)


def test_sharding_rows(spark, tmp_path):
    rows = docs(spark, ["a", "b", "a", None], ids=[1, 2, 1, None]).withColumn("slot", F.lit("clash"))
    placed = sharding.place(rows, ["doc_id"], ["x", "y", "z"]).collect()
    assert len(placed) == 4 and len({(r.slot, r.shard) for r in placed if r.doc_id == 1}) == 1
    assert sharding.place(docs(spark, []), ["doc_id"], ["x"]).count() == 0
    sharding.write_sharded(docs(spark, ["a"] * 50), ["doc_id"], ["x", "y"], str(tmp_path / "out"), parts=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


# 6 ----------------------------------------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_words(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_decontamination_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(1)
    items = [*sentences(rng, 8, 25, 60), "short Item", "W1", None, "", "!!"]
    texts = [*ODD, "a SHORT, item.", "w1 w1"]
    for i in range(40):
        words = sentences(rng, 1, 30, 60)[0].split()
        if i % 2:
            own = items[rng.randrange(8)].split()
            words[10:10] = own[3 : 3 + rng.randrange(6, 16)]
        texts.append(" ".join(words).upper() if i % 3 else " ".join(words))
    texts += [" ".join(reversed(items[0].split())), items[1] + " " + items[1]]
    bench = spark.createDataFrame([*enumerate(items), (3, "w1 other words")], "item_id bigint, text string")
    texts += texts[-3:]
    found = {r.doc_id: r for r in decontaminate.find_matches(docs(spark, texts).withColumn("hits", F.lit(1)), bench).collect()}
    assert len(found) == len(texts)
    spread = collections.Counter(w for t in texts for w in lower_words(t))

    def near(words, window):
        """The window's rarest terms, by counts over all documents, stand around a place of the rarest."""
        own = sorted(range(len(window)), key=lambda k: (spread[window[k]], k))[: decontaminate.RARE]
        places = [[i for i, w in enumerate(words) if w == window[k]] for k in own]
        return any(all(any(abs(q - p) <= decontaminate.SLOP for q in x) for x in places[1:]) for p in places[0])

    for d, t in enumerate(texts):
        words, hit, ids, close = lower_words(t), set(), set(), set()
        for i, x in [*enumerate(items), (3, "w1 other words")]:
            own = lower_words(x)
            size = min(10, len(own))
            wanted = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            close |= {str(i) for w in wanted if near(words, w)}
            for s in range(len(words) - size + 1):
                if tuple(words[s : s + size]) in wanted:
                    hit |= set(range(s, s + size))
                    ids.add(str(i))
        assert (found[d].n_words, found[d].hits, found[d].items) == (len(words), sorted(hit), sorted(ids)), d
        assert set(found[d].items) <= set(found[d].near_items)
        if block > 300:  # one block: the counts of all terms are known together
            assert found[d].near_items == sorted(close), d
    empty = decontaminate.find_matches(docs(spark, ["w1 w2"]), bench.limit(0)).collect()
    assert empty[0].hits == [] and decontaminate.find_matches(docs(spark, []), bench).count() == 0


# 7 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, PATTERN)


def test_edits_equal_full_count(spark, small, codec):
    rng = random.Random(1)
    for text in [*(r.text for r in small.limit(40).collect()), "", "a b", "  \n  x  ", "x😀 é" * 20]:
        tree = token_counts.CountTree(text, codec, *codec.measure([text])[0])
        for _ in range(8):
            tree.edit(rng.randrange(len(tree.text) + 1), rng.choice([0, 1, 2, 5, 40]), rng.choice(["", " ", "  ", "x", "'re", "'", " the", "12 é", "\n\n ", " word" * 600]))
            chars, tokens = codec.measure([tree.text])[0]
            now = tree.arrays()
            assert now[0].tolist() == chars.tolist() and now[1].tolist() == tokens.tolist() and now[2].sum() == len(chars)
            assert tree.total == tokens.sum()
            half = len(tree.text) // 2
            assert tree.tokens_before(half) == sum(t for t, end in zip(tokens, chars.cumsum(), strict=True) if end <= half)


def test_edit_rows(spark):
    edit = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("length"), F.lit("xyz").alias("insert")), F.lit(None))
    found = token_counts.count_with_edits(docs(spark, ODD).withColumn("edits", edit).withColumn("n_tokens", F.lit(1)), RANKS, PATTERN).collect()
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for r in found:
        t = ODD[r.doc_id] or ""
        assert r.n_tokens == len(encoding.encode_ordinary(t))
        assert r.n_tokens_edited == len(encoding.encode_ordinary(t[:1] + "xyz" + t[3:]))
    assert token_counts.count_with_edits(docs(spark, []).withColumn("edits", edit), RANKS, PATTERN).count() == 0


def test_second_edits_start_from_kept_trees(spark, small, monkeypatch):
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = [*(r.text for r in small.limit(20).collect()), *ODD, *ODD, "word " * 90_000]
    step = lambda at, insert: F.array(F.struct(F.lit(at).alias("start"), F.lit(3).alias("length"), F.lit(insert).alias("insert")))
    first = docs(spark, texts).withColumn("edits", step(4, " the first")).withColumn("tree", F.lit("clash"))
    once = token_counts.count_with_edits(first, RANKS, PATTERN, keep="tree")
    # an encoding of texts with kept trees is an error: one null tree is built, the others are read
    mixed = once.withColumn("edits", step(-7, "2nd ")).withColumn("tree", F.when(F.col("doc_id") != 1, F.col("tree")))
    again = {r.doc_id: r for r in token_counts.count_with_edits(mixed, RANKS, PATTERN, tree="tree", keep="tree").collect()}
    assert len(again) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        one = t[:4] + " the first" + t[7:]
        two = "2nd " + one[3:]
        assert again[i].text == two and (again[i].n_tokens, again[i].n_tokens_edited) == tuple(len(encoding.encode_ordinary(x)) for x in (one, two))
        assert sum(again[i].tree.tokens) == again[i].n_tokens_edited and sum(again[i].tree.chars) == len(two)
        assert again[i].n_reencoded <= 8 and sum(again[i].tree.leaves) == len(again[i].tree.chars)


def test_kept_trees_are_not_encoded_again(codec):
    asked = []

    class Watched:
        pieces_from = codec.pieces_from

        def measured(self, pieces):
            asked.extend(pieces)
            return codec.measured(pieces)

    long = "some words of a text" * 500
    tree = token_counts.CountTree(long, Watched(), *codec.measure([long])[0])
    tree.edit(5000, 4, "more")
    assert len(asked) < 10


# 8 ----------------------------------------------------------------------------------------------------------------


def test_top_k_brute_force(spark):
    rng = random.Random(2)
    vectors = [[rng.gauss(0, 1) for _ in range(10)] for _ in range(180)] + [[0.5] * 10] * 30
    rows = list(enumerate(vectors)) + [(500, None), (501, [1.0, None] * 5), (502, [float("nan")] * 10), (503, [1.0] * 4), (504, [2.0] * 4), (505, []), (7, vectors[7])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = topk.top_k(df, df.where("vec_id % 50 in (0, 3, 7)")).collect()
    import numpy as np

    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and x == x for x in v)]
    expected = []
    for q in sorted({i for i, _ in ints if i % 50 in (0, 3, 7)}):
        own = next(v for i, v in ints if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in ints if i != q and len(v) == len(own))
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, found)) == expected
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


# 9 ----------------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, small):
    texts = [*(r.text for r in small.collect()), *[x or "" for x in ODD], "a" * 5000, " " * 3000 + "x", "ab" * 20000, "!?" * 1000, "日本語テキスト" * 200, "\x1c\x1d a\x85b\xa0 c", "it's I'LL we've", "½²Ⅷ ٣", "<|endoftext|>"]
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    found = bpe.encode_decode(docs(spark, texts).withColumn("n_tokens", F.lit("clash")), RANKS, PATTERN, ids=True).collect()
    for r in found:
        t = texts[r.doc_id]
        assert r.ids == encoding.encode_ordinary(t) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decode_ids(spark.createDataFrame([(1, found[0].ids), (2, None)], "k int, ids array<int>"), RANKS, PATTERN).orderBy("k").collect()
    assert [r.decoded for r in back] == [texts[found[0].doc_id], None]
    null = bpe.encode_decode(docs(spark, [None]), RANKS, PATTERN).collect()[0]
    assert (null.n_tokens, null.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.encode_decode(docs(spark, []), RANKS, PATTERN).count() == 0


def test_other_vocabulary():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(path, PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé 日本\n!1") for _ in range(300)) for _ in range(50)]
    assert [memoryview(x).cast("I").tolist() for x in codec.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_repeated_rows_and_slices(spark, monkeypatch):
    """Rows that repeat id and text, null ids, and texts longer than a slice, in the operators that keep every row."""
    from lodestone.llm import common

    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(500)} it's {i}" for i in range(3000))
    texts = ["same text of the MIT License", "same text of the MIT License", long, long, None, ""]
    rows = docs(spark, texts, ids=[7, 7, 8, None, None, 9]).repartition(1)
    plain = bpe.encode_decode(rows, RANKS, PATTERN).collect()
    edits = F.array(F.struct(F.lit(-5).alias("start"), F.lit(1 << 30).alias("length"), F.lit("x").alias("insert")))
    counts = token_counts.count_with_edits(rows.withColumn("edits", edits), RANKS, PATTERN).collect()
    monkeypatch.setattr(common.slices, "__defaults__", ("text", 1000))
    assert sorted(map(str, bpe.encode_decode(rows, RANKS, PATTERN).collect())) == sorted(map(str, plain))
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for found in (plain, counts):
        assert sorted(r.n_tokens for r in found) == sorted(len(encoding.encode_ordinary(t or "")) for t in texts)
    assert all(r.n_tokens_edited == 1 for r in counts)
    scanned = license_scan.scan(rows).collect()
    assert len(scanned) == len(texts) and sorted(str(r.doc_id) for r in scanned) == sorted(map(str, [7, 7, 8, None, None, 9]))
    assert [(r.n_base, r.labels) for r in scanned if r.doc_id == 7] == [(1, "mit")] * 2
    assert len(decontaminate.find_matches(rows, spark.createDataFrame([(1, "the mit license")], "item_id int, text string")).where("size(hits) = 3").collect()) == 2
    placed = sharding.place(docs(spark, ["x"] * 3, ids=[1, 1, 2]).withColumn("key", F.lit("é" * 20_000)), ["key"], ["a", "b"]).collect()
    assert len({(r.slot, r.shard) for r in placed}) == 1 and len(placed) == 3


# 10 ---------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(prints):
    """Smallest position in each one's component, over all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 2:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(prints))]


def components_of(edges, n):
    """The smallest node of each node's component."""
    out = list(range(n))
    while True:
        new = list(out)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == out:
            return out
        out = new


def test_golay_keys_meet():
    rng = random.Random(6)
    import numpy as np

    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for _ in range(2):
            b ^= 1 << rng.randrange(64)
        ka, kb = (set(simhash.keys(np.array([x], np.uint64).view(np.int64))[0].tolist()) for x in (a, b))
        assert ka & kb and len(ka) <= 18


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("hot", [32, 1])
def test_simhash_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(8)
    texts = [*ODD, *sentences(rng, 30, 120)]
    for _ in range(60):
        words = rng.choice(texts[len(ODD) :]).split()
        words[rng.randrange(len(words))] = "new"
        texts.append(" ".join(words))
    texts += texts[-10:]
    prints = [slow_fingerprint(t) for t in texts]
    found = {r.id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [found[i].fp & (1 << 64) - 1 for i in range(len(texts))] == prints
    assert [found[i].component_id for i in range(len(texts))] == components(prints)
    kept = {r.doc_id for r in simhash.first_of_group(docs(spark, texts)).collect()}
    assert kept == set(components(prints))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert {r.component_id for r in simhash.near_duplicates(docs(spark, ["a", "a"], ids=[None, 4])).collect()} == {4}


@pytest.mark.parametrize("hot", [32, 1])
def test_links_of_near_prints(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(hot)
    prints = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(200):
        x = rng.choice(prints)
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    prints = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    work = Workspace(spark, "test")
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), work)
    roots = {r.node: r.root for r in connected_components(edges, work).collect()}
    own, groups = components(prints), {}
    for i, x in enumerate(signed):
        groups.setdefault(own[i], set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


# shared parts -----------------------------------------------------------------------------------------------------


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 300), (401, 400), (400, 401), (None, 5)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Workspace(spark, "test")).collect()}
    assert found == {**dict.fromkeys(range(1, 201), 0), 401: 400}


def test_bitmap_has_its_keys(spark):
    import numpy as np

    rng = random.Random(1)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    words = bitmap(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k", len(keys))
    assert in_bitmap(words, np.array(keys)).all()
    others = np.array([rng.getrandbits(64) - (1 << 63) for _ in range(3000)])
    assert in_bitmap(words, others).mean() < 0.2


def test_lines_of_any_length_are_compared_exactly():
    """Lines of one word each that differ over more than EXACT characters: no alignment shows that they are near."""
    rng = random.Random(2)
    a = "".join(rng.choices("abcd", k=45_000))
    b = "".join(c for i, c in enumerate(a) if i % 25 or i == 0)
    assert min(map(len, line_dedup.core(a, b))) > line_dedup.EXACT
    assert line_dedup.similar(a, b) and not line_dedup.similar(a, "".join(rng.choices("abcd", k=45_000)))


def test_bounds_of_letters_never_part_similar_lines(monkeypatch):
    rng = random.Random(21)
    monkeypatch.setattr(line_dedup, "LONG", 60)  # some pairs on either side of it
    a, b = [], []
    for size in (1, 2, 3, 20, 55, 80, 300) * 12:
        x = rng.choices("ab \u00e9\u4e2d\U0001f600", k=size)
        y = list(x)
        for _ in range(rng.choice([0, size // 20, size // 10, size // 8, size])):
            i = rng.randrange(len(y) or 1)
            y[i : i + rng.randrange(2)] = rng.choices("abc", k=rng.randrange(2))
        a, b = [*a, "".join(x)], [*b, "".join(y)]
    most = np.array([int((1 - line_dedup.SIMILARITY) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)])
    near = np.array([distance(x, y) <= m for x, y, m in zip(a, b, most, strict=True)])
    assert 10 < near.sum() < len(a) - 10
    assert not (line_dedup.apart(a, b, most) & near).any()
    assert (line_dedup.similar_pairs(a, b) == near).all()
    assert [len(line_dedup.similar_pairs([], [])), list(line_dedup.bounded([("x" * line_dedup.BLOCK, ""), ("a", "b")]))] == [0, [(0, 1), (1, 2)]]


def test_candidates_of_blocks_over_several_batches():
    rng = np.random.default_rng(4)
    n = 300
    block = np.sort(rng.integers(0, 40, n))
    rows = {"block": block, "node": rng.permutation(n), "sim": rng.integers(0, 8, n), "size": rng.integers(80, 130, n).astype(np.int32)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, mask=rng.random(n) < 0.2 if k == "sim" else None) for k, v in rows.items()})
    sims = batch.column("sim").to_pylist()
    want = set()
    for i in range(n):
        for j in range(i + 1, n):
            z = sorted([int(rows["size"][i]), int(rows["size"][j])])
            bits = 0 if sims[i] is None or sims[j] is None else (sims[i] ^ sims[j]).bit_count()
            if block[i] == block[j] and (bits <= line_dedup.DIFFER or z[0] < line_dedup.SHORT) and z[1] - z[0] <= (1 - line_dedup.SIMILARITY) * z[1] + 1e-9:
                want.add(tuple(sorted([int(rows["node"][i]), int(rows["node"][j])])))
    for size in (1, 7, 64, n):
        found = [r for x in line_dedup.candidates(iter([batch.slice(i, size) for i in range(0, n, size)])) for r in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)]
        assert set(found) == want and len(found) == len(want), size
    assert [x.num_rows for x in line_dedup.candidates(iter([batch.slice(0, 0)]))] == [0, 0]


def test_tables_of_bits_equal_distances():
    """Near ends of the band, bands of one to four words, alphabets beyond LETTERS, letters beyond 16 bits, empty sides."""
    rng = random.Random(8)
    for alphabet, size, many in (("ab", 40, 30), ("abcdefgh ", 700, 20), ("abc ", 1800, 6), ([chr(0x4E00 + i) for i in range(400)], 150, 20), ("x\U0001f600￿", 60, 20)):
        a, b = [""], ["".join(alphabet[:2])]
        for _ in range(many):
            text = rng.choices(alphabet, k=rng.randrange(1, size))
            other, at = [c if rng.random() > 0.06 else rng.choice(alphabet) for c in text], rng.randrange(len(text))
            cut = other[at : at + size // 30]
            other[at : at + size // 30] = []
            other += cut * rng.randrange(2)
            a, b = [*a, "".join(text)], [*b, "".join(other)]
        gap = np.array([abs(len(x) - len(y)) for x, y in zip(a, b, strict=True)])
        for most in (gap, gap + 1, gap + size // 15, gap + size // 8):
            want = [line_dedup.edit_distance(x, y, int(m)) <= m for x, y, m in zip(a, b, most, strict=True)]
            assert line_dedup.within(a, b, most).tolist() == line_dedup.within(b, a, most).tolist() == want
            assert not (line_dedup.strange(a, b, most) & want).any()


@pytest.mark.parametrize("together", [7, 1 << 18])
def test_unlike_lines_of_a_large_block_are_hardly_compared(monkeypatch, together):
    """300 lines of common words and copies of some, in two chunks: their near pairs are joined, and few others reach a table."""
    rng = random.Random(5)
    common = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 8))) for _ in range(220)]
    lines = [" ".join(rng.choices(common, k=150))[:800] for _ in range(300)]
    lines += [x[: 10 * i] + "zz" + x[10 * i :] for i, x in enumerate(lines[:20])]
    rows = {"node": range(len(lines)), "normal": lines, "sim": 0, "size": [len(x) for x in lines], "block": 7, "chunk": [i // 7 % 2 for i in range(len(lines))]}
    group = pd.DataFrame(rows | {k: 7 if k == "k0" else 0 for k in line_dedup.KEYS})
    compared = []
    similar_pairs = line_dedup.similar_pairs
    monkeypatch.setattr(line_dedup, "similar_pairs", lambda a, b, judged: compared.append(len(a)) or similar_pairs(a, b, judged=judged))
    monkeypatch.setattr(line_dedup, "PAIRS", together)
    want = {(i, 300 + i) for i in range(20)}
    found = [line_dedup.forest(group[(group["chunk"] == c1) | (group["chunk"] == c2)].assign(c1=c1, c2=c2)) for c1, c2 in ((0, 0), (0, 1), (1, 1))]
    assert {tuple(sorted(x)) for f in found for x in f.itertuples(index=False)} == want and sum(map(len, found)) == len(want)
    assert len(want) <= sum(compared) < 1000  # letters and pairs of letters alone leave some 4000
