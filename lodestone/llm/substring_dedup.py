"""Substring dedup by suffix automata of reference shards.

`remove_reference` streams documents against a reference table: its shards become suffix automata that are broadcast
one after another, and every maximal span of matching statistics above the threshold goes.

`dedup` takes the documents themselves as the reference, of which an automaton shard for all documents would mean all
pairs. Every 20-word window has an anchor, its smallest 5-gram hash (the leftmost of equals), so equal windows have
equal anchors. The windows of one anchor lie side by side and form a unit of 20 to 35 words. Only units whose anchor
occurs again are shuffled, by the anchor: shards of the reference are co-located with the units to be streamed instead
of broadcast, since they grow with the input. In a shard the distinct units are put into an automaton in the order of
their first places and streamed through it; the state of each window knows the first place of that window. An anchor
with one distinct unit needs no automaton, and one with more than HOT (a passage in very many contexts) is resolved
window by window through keyed minima, so no task holds an unbounded group.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, raw, slices
from lodestone.llm.sketch import bitmap, in_bitmap

WINDOW, GRAM = 20, 5
#: Distinct units of an anchor that one automaton takes.
HOT = 256
#: Words of an automaton, at least, when there are more; and words of a reference shard.
SHARD_WORDS, REFERENCE_WORDS = 20_000, 200_000
#: Words whose hashes a worker remembers.
CACHE = 200_000


class SuffixAutomaton:
    """A suffix automaton of word sequences; each state knows where its words first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = array("q", [-1]), array("q", [0]), array("q", [-1])

    def state(self, length: int, link: int, after: dict, first: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.next) - 1

    def add(self, words: list, place: int) -> None:
        """Add a sequence; word i has the place `place + i`. Sequences come in the order of their places."""
        last = 0
        for w in words:
            last = self.extend(last, w, place)
            place += 1

    def split(self, p: int, w, q: int) -> int:
        """The part of q that has one word more than p; q's transitions that p's suffixes share move to it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self.state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def extend(self, p: int, w, place: int) -> int:
        q = self.next[p].get(w)
        if q is not None:
            return self.split(p, w, q)
        new = self.state(self.length[p] + 1, 0, {}, place)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self.split(p, w, self.next[p][w])
        return new

    def stream(self, words: list) -> Iterator[tuple[int, int]]:
        """Matching statistics: at each word, the state of the longest match that ends there, and its length."""
        v = n = 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if w in self.next[v]:
                v = self.next[v][w]
                n += 1
            else:
                n = 0
            yield v, n

    def windows(self, words: list, size: int = WINDOW) -> list[int]:
        """The first place where each window of the sequence ends, -1 where it doesn't occur."""
        out, link, length = [], self.link, self.length
        for i, (v, n) in enumerate(self.stream(words)):
            while v and length[link[v]] >= size:
                v = link[v]
            if i >= size - 1:
                out.append(self.first[v] if n >= size else -1)
        return out


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def units(words: list[list[bytes]], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, document, first word, end) of every unit; the place is in the document."""
    sizes = np.array([len(x) for x in words], np.int64)
    n = int(sizes.sum())
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 4
    if len(known) > CACHE:
        known.clear()
    h = np.fromiter(map(known.__getitem__, (w for x in words for w in x)), np.uint64, n)
    gram = h[: n - GRAM + 1].copy()
    for j in range(1, GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[j : n - GRAM + 1 + j]
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    gram ^= gram >> np.uint64(32)
    doc, first = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    anchor = np.lib.stride_tricks.sliding_window_view(gram, WINDOW - GRAM + 1).argmin(axis=1) + np.arange(n - WINDOW + 1)
    start = np.nonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])[0]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    anchor = anchor[start]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[start[1:]] != doc[start[:-1]]))
    low = start[new]
    high = start[np.append(np.nonzero(new)[0][1:], len(start)) - 1]
    own = doc[low]
    return gram[anchor[new]].view(np.int64), own, low - first[own], high - first[own] + WINDOW


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, n) of every slice; add up n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            h, n = np.unique(units([(x or b"").split() for x in raw(batch)], known)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": h, "n": n})

    return docs.select("text").mapInArrow(run, "anchor bigint, n bigint")


def repeated_units(docs: DataFrame, repeated: np.ndarray) -> DataFrame:
    """(anchor, unit, words, id, row, start) of the units whose anchor is in the bitmap; unit hashes the words to 128 bits."""
    sent = docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            words = [(x or b"").split() for x in raw(batch)]
            h, own, low, high = units(words, known)
            hit = np.nonzero(in_bitmap(sent.value, h))[0]
            text = [b" ".join(words[own[i]][low[i] : high[i]]) for i in hit]
            yield pa.RecordBatch.from_pydict({"anchor": h[hit], "unit": pa.array([xxhash.xxh3_128_digest(x) for x in text], pa.binary()), "words": pa.array(text, pa.binary()).cast(pa.string()), "id": batch.column("id").take(own[hit]), "row": batch.column("row").take(own[hit]), "start": pa.array(low[hit].astype(np.int32))})

    return docs.mapInArrow(run, "anchor bigint, unit binary, words string, id bigint, row bigint, start int")


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For distinct units sorted by anchor: (anchor, unit, ids, starts), the first place of each of the unit's windows.

    Whole anchors are gathered until they have SHARD_WORDS; then their automaton is built and used.
    """
    held: list[tuple] = []
    total, last = 0, None
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "unit", "words", "id", "start")), strict=True):
            if total >= SHARD_WORDS and r[0] != last:
                yield resolve(held)
                held, total = [], 0
            words = r[2].encode().split()
            held.append((*r[:2], words, *r[3:]))
            total, last = total + len(words), r[0]
    if held:
        yield resolve(held)


def resolve(held: list[tuple]) -> pa.RecordBatch:
    held = sorted(held, key=lambda r: (r[3], r[4]))
    automaton, begin, where = SuffixAutomaton(), 0, []
    for k, r in enumerate(held):
        automaton.add(r[2], begin)
        where += [(k, begin)] * len(r[2])
        begin += len(r[2])
    ids, starts = [], []
    for r in held:
        found = [(held[where[end][0]], end - where[end][1] - WINDOW + 1) for end in automaton.windows(r[2])]
        ids.append([f[3] for f, _ in found])
        starts.append([f[4] + at for f, at in found])
    return pa.RecordBatch.from_pydict({"anchor": pa.array([r[0] for r in held], pa.int64()), "unit": pa.array([r[1] for r in held], pa.binary()), "ids": pa.array(ids, pa.list_(pa.int64())), "starts": pa.array(starts, pa.list_(pa.int32()))})


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of units: (anchor, unit, offset, window, id, start)."""
    for batch in batches:
        rows = []
        for anchor, unit, text, id_, start in zip(*(batch.column(c).to_pylist() for c in ("anchor", "unit", "words", "id", "start")), strict=True):
            words = text.encode().split()
            rows += [(anchor, unit, i, xxhash.xxh3_128_digest(b" ".join(words[i : i + WINDOW])), id_, start + i) for i in range(len(words) - WINDOW + 1)]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("anchor", "unit", "offset", "window", "id", "start"), cols, kinds, strict=True)})


def first_places(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The units that may occur again, and (anchor, unit, ids, starts): the first place of each window of the distinct units."""
    repeated = work.table(anchors(docs).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    placed = work.table(repeated_units(docs, bitmap(repeated, "anchor", repeated.count())))
    distinct = placed.groupBy("anchor", "unit").agg(F.min(F.struct("id", "start", "words")).alias("f"), F.count("*").alias("n")).select("anchor", "unit", "n", "f.*")
    distinct = work.table(distinct)
    # a table of its own, so that the join below can split an anchor with very many units
    groups = work.table(distinct.groupBy("anchor").agg(F.count("*").alias("units"), F.sum("n").alias("total")).where("total > 1"))
    counted = distinct.withColumn("windows", F.size(F.split("words", " ")) - (WINDOW - 1)).drop("n").join(groups, "anchor")
    sized = work.table(counted.withColumn("words", F.when(F.col("units") > 1, F.col("words"))))  # the words are for automata only
    work.drop(distinct)
    spans = F.sequence(F.lit(0), F.col("windows") - 1)
    one = sized.where("units = 1").select("anchor", "unit", F.transform(spans, lambda i: F.col("id")).alias("ids"), F.transform(spans, lambda i: (F.col("start") + i).cast("int")).alias("starts"))
    cold = sized.where(f"units between 2 and {HOT}").repartition("anchor").sortWithinPartitions("anchor").select("anchor", "unit", "words", "id", "start")
    cold = cold.mapInArrow(shards, "anchor bigint, unit binary, ids array<bigint>, starts array<int>")
    hot = work.table(sized.where(f"units > {HOT}").select("anchor", "unit", "words", "id", "start").mapInArrow(single_windows, "anchor bigint, unit binary, offset int, window binary, id bigint, start int"))
    least = hot.groupBy("window").agg(F.min(F.struct("id", "start")).alias("f"))
    hot = hot.join(least, "window").groupBy("anchor", "unit").agg(F.array_sort(F.collect_list(F.struct("offset", "f"))).alias("all"))
    hot = hot.select("anchor", "unit", F.col("all.f.id").alias("ids"), F.col("all.f.start").alias("starts"))
    return placed, one.union(cold).union(hot)


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with n_words, n_removed and kept (the words that stay, joined by one space).

    Words are runs of anything but ASCII white space. A word goes if a window of 20 words over it also starts earlier:
    in a row with a smaller id, or earlier in the same row. Rows with a null id keep all words and are no reference;
    rows that share an id are compared by the place in their text. A null text has no words, and kept is empty.
    """
    work = Workspace(docs.sparkSession, "substring")
    names = {"n_words", "n_removed", "kept"}
    rows = docs.drop(*(names - {id_col, text}))
    held = rows.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    placed, places = first_places(held.where("id is not null"), work)
    both = placed.drop("words").join(places, ["anchor", "unit"])
    offsets = F.sequence(F.lit(0), F.size("ids") - 1)
    earlier = F.filter(offsets, lambda i: (F.get("ids", i) < F.col("id")) | ((F.get("ids", i) == F.col("id")) & (F.get("starts", i) < F.col("start") + i)))
    gone = both.select("id", "row", F.transform(earlier, lambda i: F.col("start") + i).alias("gone")).where(F.size("gone") > 0)
    gone = gone.groupBy("id", "row").agg(F.flatten(F.collect_list("gone")).alias("__gone")).withColumnsRenamed({"id": "__id", "row": "__row"})
    joined = rows.join(gone, (F.col(id_col).cast("bigint") == F.col("__id")) & (F.xxhash64(text) == F.col("__row")), "left").drop("__id", "__row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = [(x or b"").split() for x in raw(batch, text)]
            kept = []
            for own, starts in zip(words, batch.column("__gone").to_pylist(), strict=True):
                if starts:
                    cover = np.zeros(len(own) + 1, np.int64)
                    starts = np.unique(starts)
                    cover[starts] += 1
                    np.add.at(cover, starts + WINDOW, -1)
                    own = [own[i] for i in np.nonzero(np.cumsum(cover)[:-1] == 0)[0]]
                kept.append(own)
            cols = {n: batch.column(n) for n in batch.schema.names if n != "__gone"}
            cols["n_words"] = pa.array([len(x) for x in words], pa.int64())
            cols["n_removed"] = pa.array([len(x) - len(y) for x, y in zip(words, kept, strict=True)], pa.int64())
            yield pa.RecordBatch.from_pydict(cols | {"kept": pa.array([b" ".join(x) for x in kept], pa.binary()).cast(pa.string())})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["n_words bigint, n_removed bigint, kept string"])
    return joined.mapInArrow(run, schema)


def reference_shards(reference: DataFrame, text: str, least: int) -> DataFrame:
    """(pieces): the reference's texts in shards of at most REFERENCE_WORDS words.

    A longer text is cut into pieces that have least - 1 words in common, so each run of `least` words is in one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in slices(batches, text):
            for x in raw(batch, text):
                words = x.split()
                for i in range(0, max(1, len(words) - least + 1), REFERENCE_WORDS - least + 1):
                    piece = words[i : i + REFERENCE_WORDS]
                    if held and total + len(piece) > REFERENCE_WORDS:
                        yield pa.RecordBatch.from_pydict({"pieces": pa.array([held], pa.list_(pa.string()))})
                        held, total = [], 0
                    held.append(b" ".join(piece).decode())
                    total += len(piece)
        if held:
            yield pa.RecordBatch.from_pydict({"pieces": pa.array([held], pa.list_(pa.string()))})

    return reference.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "pieces array<string>")


def remove_reference(docs: DataFrame, reference: DataFrame, text: str = "text", least: int = WINDOW) -> DataFrame:
    """docs with `kept`: texts without the maximal spans of `least` or more words that occur in a reference text.

    The reference (column text) is dealt into shards of REFERENCE_WORDS words at most. Each shard is broadcast, its
    automaton is built once a task and streams all documents, so this is for a reference that is small against the
    documents. A null text gives null; a column named kept is replaced. Both tables may be empty.
    """
    work = Workspace(docs.sparkSession, "reference")
    shards = work.table(reference_shards(reference, text, least))
    out = docs.drop(*({"kept"} - {text})).withColumn("__gone", F.array().cast("array<int>"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for s, shard in enumerate(shards.toLocalIterator()):
        sent = docs.sparkSession.sparkContext.broadcast(shard.pieces)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton()
            for x in sent.value:
                automaton.add(x.encode().split(), 0)
            for batch in slices(batches, text):
                gone = []
                for x, before in zip(raw(batch, text), batch.column("__gone").to_pylist(), strict=True):
                    ends = [i for i, (_, m) in enumerate(automaton.stream((x or b"").split())) if m >= least]
                    gone.append(sorted({*before, *(i - least + 1 for i in ends)}))  # where removed runs begin
                yield batch.set_column(batch.schema.get_field_index("__gone"), "__gone", pa.array(gone, pa.list_(pa.int32())))

        out = out.mapInArrow(run, schema)
        if s % 4 == 3:
            out = work.table(out)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            kept = []
            for x, starts in zip(raw(batch, text), batch.column("__gone").to_pylist(), strict=True):
                words = (x or b"").split()
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, np.array(starts, np.int64), 1)
                np.add.at(cover, np.array(starts, np.int64) + least, -1)
                kept.append(None if x is None else b" ".join(words[i] for i in np.nonzero(np.cumsum(cover)[:-1] == 0)[0]))
            cols = {n: batch.column(n) for n in batch.schema.names if n != "__gone"}
            yield pa.RecordBatch.from_pydict(cols | {"kept": pa.array(kept, pa.binary()).cast(pa.string())})

    final = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name != "__gone"] + ["kept string"])
    return out.mapInArrow(keep, final)
