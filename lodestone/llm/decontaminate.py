"""Benchmark decontamination with a positional inverted index that is distributed by documents.

Each slice of documents stores the postings (term, position) of the benchmark's terms. A window of benchmark words is
looked up from its globally rarest term: that list, adjusted by the term's place in the window, is intersected with
the lists of the next rarer terms, until every word stands where the window has it (exact phrase). A proximity match
asks for the RARE rarest terms of a window within SLOP words of each other, in any order. The index never moves: only
global counts of the benchmark's own terms are shuffled, and the windows are sent to the documents in blocks of a
fixed number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ALNUM, Workspace, raw, slices

WINDOW = 10
RARE = 4
SLOP = 30
#: Bytes of benchmark text that are broadcast at once; more items are looked up block after block.
BLOCK_BYTES = 4 << 20
#: Candidates that are held at once in a task.
HELD = 1 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


class Windows:
    """A block of benchmark items: their terms, numbered, and their windows as rows of term numbers, -1 behind the end."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.terms: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        found = set()
        for item, text in items:
            own = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text.encode())]
            found |= {(*own[i : i + size], *repeat(-1, size - len(own)), number[item]) for i in range(max(1, len(own) - size + 1)) if own}
        rows = np.array(sorted(found), np.int32).reshape(-1, size + 1)
        self.rows, self.item = rows[:, :size], rows[:, size]
        self.length = (self.rows >= 0).sum(axis=1)

    def rank(self, counts: np.ndarray) -> Windows:
        """Order each window's places by the global counts of their terms, the rarest first."""
        seen = np.where(self.rows < 0, np.iinfo(np.int64).max, np.append(counts, 0)[self.rows])
        self.places = np.argsort(seen, axis=1, kind="stable").astype(np.int32)
        first = self.rows[np.arange(len(self.rows)), self.places[:, 0]] if len(self.rows) else np.zeros(0, np.int32)
        order = np.argsort(first, kind="stable")
        self.rows, self.item, self.length, self.places, first = (x[order] for x in (self.rows, self.item, self.length, self.places, first))
        self.begin = np.searchsorted(first, np.arange(len(self.terms) + 1))
        return self


class Postings:
    """The postings of one slice: term numbers by position and positions by term."""

    def __init__(self, docs: list[list[bytes]], terms: dict[bytes, int]):
        self.sizes = np.array([len(x) for x in docs], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.n = int(self.sizes.sum())
        self.term = np.fromiter(map(terms.get, (w for x in docs for w in x), repeat(-1)), np.int64, self.n)
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        at = np.nonzero(self.term >= 0)[0]
        self.at = at[np.argsort(self.term[at], kind="stable")]
        self.keys = self.term[self.at] * (self.n + 1) + self.at

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term's list has a position from low to high."""
        k = np.searchsorted(self.keys, term * (self.n + 1) + np.clip(low, 0, self.n))
        return (k < len(self.keys)) & (np.append(self.keys, -1)[k] <= term * (self.n + 1) + np.clip(high, -1, self.n))

    def lookup(self, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, window) of the exact matches, (position, window) of the proximity matches, in portions."""
        per_term = np.diff(w.begin)
        lists = np.nonzero(per_term[self.term[self.at]])[0]
        at = self.at[lists]
        many = per_term[self.term[at]]
        cut = np.searchsorted(np.cumsum(many), np.arange(HELD, int(many.sum()) + HELD, HELD), side="right")
        for part in np.split(np.arange(len(at)), cut):
            if not len(part):
                continue
            p = np.repeat(at[part], many[part])
            ends = np.cumsum(many[part])
            v = np.repeat(w.begin[self.term[at[part]]], many[part]) + np.arange(len(p)) - np.repeat(ends - many[part], many[part])
            start = p - w.places[v, 0]
            inside = (start >= 0) & (start + w.length[v] <= self.n)
            inside[inside] = self.doc[start[inside]] == self.doc[start[inside] + w.length[v[inside]] - 1]
            s, x = start[inside], v[inside]
            for r in range(1, w.rows.shape[1]):
                place = w.places[x, r]
                want = w.rows[x, place]
                ok = want < 0
                ok[~ok] = self.term[s[~ok] + place[~ok]] == want[~ok]
                s, x = s[ok], x[ok]
            near = np.ones(len(p), bool)
            begin, size = self.first[self.doc[p]], self.sizes[self.doc[p]]
            low, high = np.maximum(p - SLOP, begin), np.minimum(p + SLOP, begin + size - 1)
            for r in range(1, min(RARE, w.rows.shape[1])):
                left = np.nonzero(near)[0]
                want = w.rows[v[left], w.places[v[left], r]]
                near[left] = (want < 0) | self.holds(np.maximum(want, 0).astype(np.int64), low[left], high[left])
            yield s, x, p[near], v[near]


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items, as (id, text), in blocks of about BLOCK_BYTES."""
    held = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    n = 1 + (held.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES
    for b in range(n):
        yield [(r.i, r.t) for r in held.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def term_counts(docs: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """How often each term stands in all documents (column `text`)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total = sent.value.get, np.zeros(len(sent.value) + 1, np.int64)
        for batch in slices(batches):
            for x in raw(batch):
                own = words_of(x)
                total += np.bincount(np.fromiter(map(get, own, repeat(len(total) - 1)), np.int64, len(own)), minlength=len(total))
        seen = np.nonzero(total[:-1])[0]
        yield pa.RecordBatch.from_pydict({"term": seen, "n": total[seen]})

    out = np.zeros(len(terms), np.int64)
    for r in docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs with n_words, hits (places of words inside an exact match), items and near_items (ids as strings).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Null
    texts have no words; items with a null id or text are left out; items that share an id count as one. Every row
    stays, repeated ones too; columns of docs with one of the new names are replaced. Both tables may be empty.
    """
    new = {"n_words": "bigint", "hits": "array<int>", "items": "array<string>", "near_items": "array<string>"}
    out, work, spark = None, Workspace(docs.sparkSession, "decontaminate"), docs.sparkSession
    docs = docs.drop(*(set(new) - {text}))
    for k, block in enumerate(blocks(benchmark, item, item_text)):
        w = Windows(block, window)
        sent = spark.sparkContext.broadcast(w.rank(term_counts(docs.select(F.col(text).alias("text")), w.terms)))
        before = docs if out is None else work.table(out) if k % 4 == 0 else out

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            w = sent.value
            for batch in slices(batches, text):
                held = [words_of(x) for x in raw(batch, text)]
                index = Postings(held, w.terms)
                cover = np.zeros(index.n + 1, np.int64)
                pairs, near = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
                for s, x, p, v in index.lookup(w):
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + w.length[x], -1)
                    pairs.append(np.unique(np.stack([index.doc[s], w.item[x]], 1), axis=0))
                    near.append(np.unique(np.stack([index.doc[p], w.item[v]], 1), axis=0))
                places = np.nonzero(np.cumsum(cover)[: index.n] > 0)[0]
                got = [([], [], []) for _ in held]
                for at in places:
                    got[index.doc[at]][0].append(int(at - index.first[index.doc[at]]))
                for n, found in ((1, pairs), (2, near)):
                    for d, i in np.unique(np.concatenate(found), axis=0):
                        got[d][n].append(w.items[i])
                cols = {n: batch.column(n) for n in batch.schema.names}
                cols["n_words"] = pa.array(index.sizes)
                for n, name, kind in ((0, "hits", pa.int32()), (1, "items", pa.string()), (2, "near_items", pa.string())):
                    had = batch.column(name).to_pylist() if name in cols else repeat([])
                    cols[name] = pa.array([sorted({*a, *b[n]}) for a, b in zip(had, got, strict=False)], pa.list_(kind))
                yield pa.RecordBatch.from_pydict(cols)

        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in new] + [f"{k} {v}" for k, v in new.items()])
        out = before.mapInArrow(run, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark window occurs."""
    return find_matches(docs, benchmark, text).where(F.size("hits") == 0).select(docs.columns)
