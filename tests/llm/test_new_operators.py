"""Embedding whitening, suffix-array dedup and conversation repair against plain versions, with odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversations, oracles, queries, suffix_dedup, whitening

SMALL = "/root/testdata/sf0.001"


def plain_sql(sql, **views):
    con = duckdb.connect()
    for name, source in views.items():
        if isinstance(source, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
        else:
            con.register(name, source)
    return con.execute(sql).fetchdf()


# 11 ---------------------------------------------------------------------------------------------------------------


def plain_whitening(x, k=16):
    """Eigenvectors of the covariance of the distinct integer vectors."""
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    c = distinct - distinct.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x], (x - sums / n) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def same_up_to_sign(a, b):
    return all(min(np.abs(a[:, i] - b[:, i]).max(), np.abs(a[:, i] + b[:, i]).max()) < 1e-6 for i in range(a.shape[1]))


def test_whitening_equals_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 37)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 20)) * np.linspace(3, 0.3, 20) + 5
    vectors = np.concatenate([base, np.repeat(base[:1], 300, axis=0)])  # a vector that very many rows have
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, component string").repartition(9)
    found = whitening.whiten(rows).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * vectors.astype(np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, deviation, whitened, explained = plain_whitening(x)
    assert (found["n"] == n).all() and found["component"].tolist() == list(range(1, 17)) * len(x)
    assert found["deviation"].tolist() == [d for d in deviation for _ in range(16)]
    assert same_up_to_sign(found["whitened"].to_numpy().reshape(-1, 16), whitened)
    assert np.abs(found["explained"].to_numpy()[:16] / explained - 1).max() < 1e-9 and found["identity_error"].max() < 1e-9


def test_whitening_merges_lose_nothing():
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, size=(90, 7)) + 1_000_000
    x[:, 6] = 1_000_000 + x[:, 0] - x[:, 1]  # dependent entries
    whole = whitening.of_rows(x)
    halves = whitening.merged([whitening.merged([whitening.of_rows(x[:1]), whitening.of_rows(x[1:40])]), whitening.of_rows(x[40:])])
    assert whole.n == halves.n and (whole.sums == halves.sums).all()
    assert np.allclose(whole.axes.T @ whole.axes, halves.axes.T @ halves.axes, rtol=1e-9)
    assert np.linalg.matrix_rank(halves.axes, tol=1e-6) == 6 and halves.axes.shape == (7, 7)


def test_whitening_odd_rows(spark):
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1e30, 1.0]]
    good = [[0.0, 1.0], [1.0, 1.0], [0.5, 1.0], [0.5, 1.0]]
    rows = [(i, v) for i, v in enumerate(bad + good)] + [(None, [0.0, 1.0]), (20, [3.0]), (21, [3.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.vec_id].append(r)
    assert set(by) == {6, 7, 8, 9, None, 20, 21} and all(len(v) == (1 if k in (20, 21) else 2) for k, v in by.items())
    assert all(r.whitened == 0 and r.explained == 0 and r.n == 1 and r.deviation == 0 for k in (20, 21) for r in by[k])
    second = [r for k in (6, 7, 8, 9, None) for r in by[k] if r.component == 2]
    assert all(r.whitened == 0 and r.explained == 0 and r.identity_error < 1e-9 for r in second)  # an entry that never changes
    assert by[8][0].whitened == by[9][0].whitened and by[6][0].n == 3 and by[6][0].deviation == (3 * 0 - 96) ** 2
    assert whitening.whiten(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows[:6], "vec_id bigint, embedding array<double>")).count() == 0


def test_whitening_deviation_beyond_a_long():
    w = whitening.Whitener(1 << 20, np.array([0, 0]), np.eye(2), np.ones(2), 2.0)
    assert w.deviations(np.array([[1 << 20, 0], [3, 4]])) == [None, 25 << 40]


# 12 ---------------------------------------------------------------------------------------------------------------


def plain_suffixes(texts, length):
    own = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + length] for x in own for i in range(len(x) - length + 1))
    out = []
    for x in own:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), sum(k for k, _ in itertools.groupby(gone)), kept))
    return out


def spliced(rng, length, n, alphabet="abcdefgh é"):
    """Texts of random letters with passages around the length, some of them broken by one letter."""

    def letters(k):
        return "".join(rng.choice(alphabet) for _ in range(k))

    passages = [letters(rng.randint(length // 2, 3 * length)) for _ in range(8)]
    out = []
    for _ in range(n):
        text = letters(rng.randint(0, 2 * length))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            p = p[a : a + rng.randint(length - 5, 2 * length)]
            if rng.random() < 0.4 and p:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            text += p + letters(rng.randint(0, length // 2))
        out.append(text)
    return out


def suffix_dedup_of(spark, texts, length):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(rows, length=length).collect()}
    return [found[i] for i in range(len(texts))]


@pytest.mark.parametrize(("seed", "length", "n"), [(1, 40, 60), (2, 400, 70), (3, 133, 50)])
def test_suffix_dedup_equals_brute_force(spark, seed, length, n, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 7 if seed == 1 else 1024)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50 if seed == 1 else 1 << 22)
    texts = spliced(random.Random(seed), length, n)
    texts += texts[-5:] + [texts[-1][3:], None, "", "short", "a" * length, "a" * (length + 3), "a" * (5 * length), "ab" * length, "abc" * length, "日本語" * length]
    assert suffix_dedup_of(spark, texts, length) == plain_suffixes(texts, length)


def test_suffix_dedup_of_one_document(spark):
    rng = random.Random(6)
    p = "".join(rng.choice("abcdef ") for _ in range(700))
    texts = ["x" + p + "y" * 3 + p + "z", "unrelated " * 3]
    assert suffix_dedup_of(spark, texts, 400) == plain_suffixes(texts, 400)
    assert suffix_dedup_of(spark, ["a" * 399 + "b" + "a" * 399], 400) == [(799, 0, 0, b"a" * 399 + b"b" + b"a" * 399)]
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup(spark.createDataFrame([], "doc_id bigint, text string"), length=39)


def test_suffix_dedup_hot_passage_and_null_ids(spark):
    """A passage in very many texts, each time with other neighbours, and rows that repeat id and text."""
    rng = random.Random(7)
    p = "".join(rng.choice("abcdef ") for _ in range(90))
    texts = [f"{rng.random()}{p}{rng.random()}" for _ in range(1500)] + ["w" * 20 + p[:45]] * 3
    rows = spark.createDataFrame([(None if i % 7 == 0 else i % 50, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = sorted((r.text, r.n_removed) for r in suffix_dedup.dedup(rows, length=60).collect())
    assert found == sorted((t, w[1]) for t, w in zip(texts, plain_suffixes(texts, 60), strict=True))


def test_suffix_dedup_sql(spark):
    texts = spliced(random.Random(8), 400, 40) + [None, ""]
    import pandas as pd

    expected = plain_sql(oracles.OP12, documents=pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    plain = plain_suffixes(texts, 400)
    for r in expected.itertuples():
        n, gone, runs, kept = plain[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, runs, hashlib.sha256(kept).hexdigest())


# 13 ---------------------------------------------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def plain_repair(turns):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired of (turn, role, text), by trying every edit."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    faults, seen = [], set()
    for _, role, text in turns:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0

    def go(said, role, state):
        initial = role[:1]
        if (initial, state) in (("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)):
            return said + (role,), {"s": 1, "u": 2, "a": 3}[initial]

    # by state: every (cost, audit, lines) worth keeping, Dijkstra-like over places
    best = {0: (0, "", ())}
    for place in range(len(turns) + 1):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                role = "assistant" if state == 2 else "user"
                new = (cost + 5, audit + "I", lines + (f"{role}:",))
                to = 3 if state == 2 else 2
                best[to] = min(best.get(to, new), new)
        if place == len(turns):
            break
        _, role, text = turns[place]
        after = {}
        for state, (cost, audit, lines) in best.items():
            options = [(state, (cost + 2, audit + "D", lines))]
            if faults[place] not in ("blank", "duplicate"):
                more = 5 if faults[place] == "truncated" else 0
                for letter, new, price in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    done = go((), new, state)
                    if done:
                        options.append((done[1], (cost + more + price, audit + letter, lines + (f"{new}:{text}",))))
            for to, option in options:
                after[to] = min(after.get(to, option), option)
        best = after
    cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
    return (gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, "\n".join(lines))


SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, audit string"


def repaired(spark, rows):
    found = conversations.repair_damaged(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


def plainly(rows):
    out = {conv: [] for conv, *_ in rows}
    for conv, *turn in plain_damage(rows):
        out[conv].append(tuple(turn))
    return {conv: plain_repair(turns) if turns else (0,) * 6 + ("", "") for conv, turns in out.items()}


def conversations_of(rng, n, most, spread):
    texts = ["Yes.", "No", "", " \t", "Well!", "Why?", "and so on", "Fine. "]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            number = None if rng.random() < 0.05 else turn * rng.randint(1, spread)
            text = None if rng.random() < 0.05 else rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}{rng.choice('.x')}"
            rows.append((conv, number, rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2], text))
    return rows


def test_repair_equals_a_plain_search(spark):
    rows = conversations_of(random.Random(11), 150, 12, 2)
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (900, 1, "system", "Be kind."), *[(901, 3, "user", "Same.")] * 4]
    assert repaired(spark, rows) == plainly(rows)


def test_repair_across_blocks(spark, monkeypatch):
    """Blocks of three turn numbers: folds of blocks strung together are the fold of the whole."""
    monkeypatch.setattr(conversations, "BLOCK", 3)
    rows = conversations_of(random.Random(12), 40, 40, 3)
    assert repaired(spark, rows) == plainly(rows)


def test_repair_of_a_long_conversation_and_no_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1500)]
    assert repaired(spark, rows) == plainly(rows)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", "")}
    wide = repaired(spark, [(5, -(1 << 62) * 2 + 1, "user", "Hi."), (5, (1 << 63) - 1, "assistant", "Ho.")])
    assert wide[5][0] in (0, (1 << 63) - 1)
    assert repaired(spark, []) == {}


def test_new_queries_agree_with_sql(spark):
    for name, table, sql in (("op13_conversation_repair", "conversations", oracles.OP13), ("op12_suffix_array_dedup", "documents", oracles.OP12)):
        found = queries.queries()[name](spark, SMALL).toPandas()
        expected = plain_sql(sql, **{table: f"{SMALL}/{table}.parquet"})
        assert sorted(found.columns) == sorted(expected.columns)
        assert sorted(map(tuple, found[sorted(found.columns)].to_numpy().tolist())) == sorted(map(tuple, expected[sorted(found.columns)].to_numpy().tolist()))
    rows = queries.queries()["op11_embedding_whitening"](spark, SMALL)
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert rows.count() == 16 * vectors.count() and rows.agg(F.max("identity_error")).first()[0] < 1e-4
