"""Fuzzy line dedup: block keys of normalised lines, SimHash as a filter, edit similarity, one line per connected group.

A line's normal form is its lower-case words, without punctuation, joined by one space. A pair stands if the edit
similarity of the normal forms is SIMILARITY or more. Pigeonhole blocks of a 64-bit SimHash can't find such pairs: they
differ in 2 to 20 of its bits, and blocks that survive 10 wrong bits are far too short to tell lines apart. So lines meet
on blocks of their words instead, some of which a few edits leave alone:

- Under each of MINIMA orders, the run of RUN words whose hash is least.
- Lines of fewer than SHORT characters have ENDS keys of another kind among them: lines whose lengths are within the
  similarity share a length bucket, and if they differ in one stretch only, the text before or after it is at least 0.45
  of the longer line, so they share the first or last 0.45 of the bucket's least length. No such pair is missed.

- Lines of few words for their length (scripts without spaces, addresses, minified code) have the least GRAM-byte runs
  under each order as keys instead, or as every other key where it isn't clear which they are.

Pairs must then have SimHashes of their words within DIFFER bits: few others do. Short lines and those of few words aren't
held to that, since an edit changes too many of their words. Only hashes are shuffled: lines of one normal form are one
node, and the texts of the few nodes that have a candidate are fetched by a second pass.

The lines of a key are told apart by length bucket as well. Where more than HOT share one (a line in very many versions)
they are not paired up: they are dealt into chunks, each pair of chunks is one bounded task, and a pair of lines that is
already connected there is not compared; what comes out is a spanning forest.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ALNUM, Workspace, raw, slices
from lodestone.llm.components import connected_components
from lodestone.llm.sketch import bitmap, in_bitmap

#: Bits in which fingerprints may differ, and the least edit similarity of normal forms.
DIFFER, SIMILARITY = 20, 0.9
#: Lines with fewer characters meet on their ends as well, and aren't held to DIFFER.
SHORT, ENDS = 100, 4
#: Words of a run that is a key, and keys of a line.
RUN, MINIMA = 3, 8
#: Characters a word from which some keys, and from which all keys, are runs of GRAM bytes (two words of 64 bits).
DENSE, DENSER, GRAM = 10, 24, 16
#: A key with more lines is dealt into chunks of about CHUNK lines, of fewer if they have more than CHUNK_BYTES, but not of
#: fewer than LEAST_CHUNK for that.
HOT, CHUNK, CHUNK_BYTES, LEAST_CHUNK = 64, 2000, 1 << 22, 100
#: Lines with more characters are aligned by words first, and compared one by one; an alignment that isn't close enough
#: is followed by the exact distance of the lines. Its gaps of over EXACT characters count as rewritten.
LONG, EXACT = 1200, 40_000
#: Candidates of a hot key that are compared together.
TOGETHER = 256
#: Pairs of lines of a hot key that are looked at together.
PAIRS = 1 << 18
#: Pairs that are compared together, places of their lines, and different letters; most words of 64 bits that the tables of a
#: pair take.
TABLES, PLACES, LETTERS, WORDS = 4096, 1 << 20, 256, 4
#: Bits by which runs of one, two and three letters are told apart where they are counted.
GRAM_BITS = {1: 7, 2: 9, 3: 12}
#: Pairs with as many letters are told apart by runs of letters, if their tables take no more than WORDS.
RUNS = 400
#: Letters of such a run, in lines of fewer than SHORT letters and in others; bits for a letter of the line; bits of a line
#: at least and at most, and of the lines that are looked at together (logarithms).
PRESENT, ROOM, LEAST_BITS, MOST_BITS, TABLE_BITS = (3, 5), 4, 9, 16, 18
#: Bytes, bytes of words, and groups of words, that are hashed at a time.
BLOCK, HASHED, GROUPS = 1 << 20, 1 << 16, 1 << 14
#: The keys of a line.
KEYS = [f"k{i}" for i in range(MINIMA)]

#: The same table as for words, with line feeds left in.
LINES = ALNUM[:10] + b"\n" + ALNUM[11:]
#: The bits of a byte as eight bytes of one integer.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: Factors of hashes (any odd numbers).
ODD, ODD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@dataclass
class Lines:
    """The lines with words of some texts, as their normal forms in one buffer."""

    text: bytes
    doc: np.ndarray  # of each line
    place: np.ndarray  # in its text, from 0
    begin: np.ndarray
    end: np.ndarray
    words: np.ndarray  # first byte of each word
    first: np.ndarray  # first word of each line

    @property
    def sizes(self) -> np.ndarray:
        """Words of each line."""
        return np.diff(np.append(self.first, len(self.words)))

    def __getitem__(self, i: int) -> bytes:
        return self.text[self.begin[i] : self.end[i]]


def normal_lines(texts: list[bytes | None]) -> Lines:
    flat = np.frombuffer(b"\n".join([x or b"" for x in texts] + [b""]).translate(LINES), np.uint8)
    feed, word = flat == 10, (flat != 10) & (flat != 32)
    ends = np.zeros(len(flat), bool)  # what stands right behind a word
    ends[1:] = word[:-1] & ~word[1:]
    line = np.repeat(np.arange(np.count_nonzero(feed)), np.diff(np.searchsorted(np.nonzero(ends)[0], np.nonzero(feed)[0], "right"), prepend=0))
    kept = flat[word | ends]
    stop = np.nonzero(ends[word | ends])[0]
    kept[stop] = 32
    words = np.append(0, stop + 1)[:-1]
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    first = np.nonzero(new)[0]
    feeds = np.cumsum([0, *(1 + (x or b"").count(b"\n") for x in texts)])
    doc = np.searchsorted(feeds, line[first], "right") - 1
    last = np.append(first[1:], len(words))[: len(first)] - 1
    return Lines(kept.tobytes(), doc, line[first] - feeds[doc], words[first], stop[last], words, first)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(ODD)
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)), dtype=np.uint64)


def word_hashes(lines: Lines) -> np.ndarray:
    """A hash of each word, from a polynomial over its bytes."""
    flat, out, k = np.frombuffer(lines.text, np.uint8), [np.zeros(0, np.uint64)], 0
    up = down = np.zeros(0, np.uint64)
    while k < len(lines.words):
        begin = lines.words[k]
        n = max(k + 1, int(np.searchsorted(lines.words, begin + HASHED)))
        own = flat[begin : lines.words[n] if n < len(lines.words) else len(flat)]
        if len(own) > len(up):
            up, down = powers(ODD, len(own)), powers(ODD_INVERSE, len(own))
        at = lines.words[k:n] - begin
        out.append(mixed(np.add.reduceat(np.where(own == 32, np.uint64(0), own) * up[: len(own)], at) * down[at]))
        k = n
    return np.concatenate(out)


def simhashes(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of lines with `sizes` words each, one at least: a bit is set if over half of the words' hashes have it."""
    # sums of up to 255 words don't overflow a byte
    parts = -(-sizes // 255)
    line = np.repeat(np.arange(len(sizes)), parts)
    begin = (np.cumsum(sizes) - sizes)[line] + 255 * (np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts))
    bits, counts = h.view(np.uint8).reshape(-1, 8), [np.zeros((0, 64), np.uint8)]
    for i in range(0, len(begin), GROUPS):
        at = begin[i : i + GROUPS]
        stop = begin[i + GROUPS] if i + GROUPS < len(begin) else len(h)
        counts.append(np.add.reduceat(SPREAD[bits[at[0] : stop]], at - at[0], axis=0).view(np.uint8).reshape(-1, 64))
    counts = np.concatenate(counts)
    if len(line) > len(sizes):
        counts = np.add.reduceat(counts, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    return np.packbits(counts.astype(np.int64) * 2 > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def least_runs(m: np.ndarray, line: np.ndarray, first: np.ndarray, run: int, orders: int) -> list[np.ndarray]:
    """By each of some orders, the least hash of a line's runs of `run` words, of all its words if it has fewer."""
    hashes, whole = m.copy(), np.ones(len(m), bool)
    for j in range(1, run):
        same = line[j:] == line[:-j]
        hashes[:-j] += np.where(same, m[j:] * np.uint64(2 * j + 1), np.uint64(0))
        whole[:-j] &= same
        whole[-j:] = False
    whole[first] = True
    out = []
    for k in range(orders):
        x = mixed(hashes ^ np.uint64((k + 1) * ODD & (1 << 64) - 1))
        x[~whole] = np.uint64((1 << 64) - 1)
        out.append(np.minimum.reduceat(x, first))
    return out


def buckets(size: int) -> tuple[int, int]:
    """The two length buckets of a line: lines within the similarity share one at least."""
    level = int(math.log(size + 1e-6) / -math.log(SIMILARITY))
    return level, level - 1


def end_keys(text: str) -> list[int]:
    """Keys of a line's first and last characters in its two length buckets."""
    out = []
    for bucket in buckets(len(text)):
        n = max(1, int(SIMILARITY / 2 * SIMILARITY**-bucket))
        out += [xxhash.xxh64_intdigest(text[:n], 2 * bucket), xxhash.xxh64_intdigest(text[-n:], 2 * bucket + 1)]
    return out


def gram_minima(line: bytes, orders: int) -> np.ndarray:
    """By each of some orders, the least hash of a line's runs of GRAM bytes; lines have twice as many at least."""
    x = np.ndarray(len(line) - 7, "<u8", buffer=line, strides=(1,)) * np.uint64(ODD)
    out = np.full(orders, (1 << 64) - 1, np.uint64)
    for i in range(0, len(x) - 8, BLOCK):
        h = mixed(x[i : i + BLOCK + 8][:-8] + mixed(x[i + 8 : i + BLOCK + 8]))
        for k in range(orders):
            out[k] = min(out[k], mixed(h ^ np.uint64((k + 1) * ODD & (1 << 64) - 1)).min())
    return out


def block_keys(lines: Lines, h: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """The keys of the lines; null for lines in which no edit is allowed."""
    if not len(size):
        return [pa.array([], pa.int64())] * len(KEYS)
    line = np.repeat(np.arange(len(size)), lines.sizes)
    found = np.array(least_runs(h, line, lines.first, RUN, MINIMA))
    edits = size * (1 - SIMILARITY) + 1e-9 >= 1
    few = np.nonzero((size >= DENSE * lines.sizes) & (lines.end - lines.begin >= 2 * GRAM) & edits)[0]
    for i in few.tolist():
        own = gram_minima(lines[i], MINIMA)
        found[:: 1 if size[i] >= DENSER * lines.sizes[i] else 2, i] = own[:: 1 if size[i] >= DENSER * lines.sizes[i] else 2]
    short = np.nonzero((size < SHORT) & edits)[0]
    if len(short):
        found[:ENDS, short] = np.array([end_keys(lines[i].decode()) for i in short], np.uint64).T
    return [pa.array(x.view(np.int64), mask=~edits) for x in found]


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, row, line, key, sim, size, the keys) of every line that has words; key hashes the normal form to 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = normal_lines(raw(batch))
            h = word_hashes(lines)
            letters = (np.frombuffer(lines.text, np.uint8) & 0xC0) != 0x80
            size = np.add.reduceat(letters, lines.begin, dtype=np.int32) - 1 if len(lines.begin) else np.zeros(0, np.int32)
            own = pa.array(lines.doc)
            digests = [xxhash.xxh3_128_digest(lines[i]) for i in range(len(size))]
            few = (size >= DENSE * lines.sizes) & (size >= SHORT)
            sims = pa.array(simhashes(h, lines.sizes) if len(size) else np.zeros(0, np.int64), mask=few)
            cols = {"id": batch.column("id").take(own), "row": batch.column("row").take(own), "line": pa.array(lines.place.astype(np.int32)), "key": pa.array(digests, pa.binary()), "sim": sims, "size": size}
            yield pa.RecordBatch.from_pydict(cols | dict(zip(KEYS, block_keys(lines, h, size), strict=True)))

    return docs.mapInArrow(run, f"id bigint, row bigint, line int, key binary, sim bigint, size int, {', '.join(f'{k} bigint' for k in KEYS)}")


def tail(key: Column) -> Column:
    """Eight of the key's bytes as a bigint."""
    return F.conv(F.substring(F.hex(key), 17, 16), 16, -10).cast("bigint")


def normal_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, normal) of the wanted lines (key, node): a pass that lets only lines through whose key is in a bitmap, then the keys themselves."""
    n = wanted.count()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(tail(F.col("key")).alias("t")), "t", n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = normal_lines(raw(batch))
            digests = [xxhash.xxh3_128_digest(lines[i]) for i in range(len(lines.begin))]
            tails = np.frombuffer(b"".join(digests), ">i8")[1::2].astype(np.int64)
            found = list({digests[i]: i for i in np.nonzero(in_bitmap(sent.value, tails))[0]}.values())
            yield pa.RecordBatch.from_pydict({"key": pa.array([digests[i] for i in found], pa.binary()), "normal": pa.array([lines[i] for i in found], pa.binary()).cast(pa.string())})

    return docs.select("text").mapInArrow(run, "key binary, normal string").join(wanted, "key").groupBy("key").agg(F.min("node").alias("node"), F.min("normal").alias("normal")).drop("key")


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger; bit-parallel in the shorter string's length."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    m, full = len(b), (1 << len(b)) - 1
    plus, minus, score, top = full, 0, m, 1 << max(0, m - 1)
    for left, c in zip(range(len(a) - 1, -1, -1), a, strict=True):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((eq & plus) + plus ^ plus | eq) & full
        hp, hn = minus | ~(d | plus) & full, plus & d
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1 | 1) & full, hn << 1 & full
        plus, minus = hn | ~(x | hp) & full, hp & x
        if score - left > most:
            return most + 1
    return min(score if m else len(a), most + 1)


def gaps(a: list[str], b: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    """What differs between two word lists, by an alignment of the words and three-word runs that both hold once."""
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    e = 0
    while e < most - k and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    if not a or not b:
        if a or b:
            yield a, b
        return
    for n in (1, 3):
        x, y = (list(zip(*(w[i:] for i in range(n)), strict=False)) for w in (a, b))
        many, other = Counter(x), Counter(y)
        places = {w: j for j, w in enumerate(y) if other[w] == 1}
        # the longest run of growing places
        tails, ends, back = [], [], []
        pairs = [(i, places[w]) for i, w in enumerate(x) if many[w] == 1 and w in places]
        for at, (_, j) in enumerate(pairs):
            q = bisect_left(tails, j)
            back.append(ends[q - 1] if q else -1)
            tails[q : q + 1], ends[q : q + 1] = [j], [at]
        if ends:
            chain, at = [], ends[-1]
            while at >= 0:
                chain.append(pairs[at])
                at = back[at]
            i = j = 0
            for p, q in [*chain[::-1], (len(a), len(b))]:
                if a[i:p] != b[j:q]:
                    yield a[i:p], b[j:q]
                i, j = p + (p < len(a)), q + (q < len(b))
            return
    yield a, b


def aligned_distance(x: list[str], y: list[str], most: int) -> int:
    """An upper bound of the edit distance, from the distances of the gaps of an alignment; it stops beyond `most`."""
    total = 0
    for a, b in gaps(x, y):
        a, b = f" {' '.join(a)}" if a else "", f" {' '.join(b)}" if b else ""
        whole = max(len(a), len(b))
        total += min(whole, edit_distance(a, b, most - total)) if 0 < whole <= EXACT and a and b else whole
        if total > most:
            break
    return total


def shared_length(a: str, b: str) -> int:
    """How many characters two strings have in common from the start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def core(a: str, b: str) -> tuple[str, str]:
    """Two strings without what they have in common at their beginning and end."""
    k = shared_length(a, b)
    a, b = a[k:], b[k:]
    k = shared_length(a[::-1], b[::-1])
    return a[: len(a) - k], b[: len(b) - k]


def plainly(a: str, b: str, most: int) -> bool:
    """Whether rewriting everything, or the words that differ one by one, takes no more than `most` edits."""
    x, y = a.split(" "), b.split(" ")
    return max(len(a), len(b)) <= most or (len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y, strict=True) if v != w) <= most)


def edits(a: str, b: str) -> int:
    """Edits that the similarity allows, -1 if the lengths differ by more."""
    most = int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)
    return most if abs(len(a) - len(b)) <= most else -1


def similar(a: str, b: str) -> bool:
    """Whether the edit similarity is SIMILARITY or more. An alignment may show it; where none does, the distance decides, at any length."""
    most, (x, y) = edits(a, b), core(a, b)
    if most < 0 or plainly(x, y, most):
        return most >= 0
    if max(len(a), len(b)) > LONG and aligned_distance(a.split(" "), b.split(" "), most) <= most:
        return True
    return edit_distance(x, y, most) <= most


def counts(texts: list[str], size: int) -> np.ndarray:
    """How often each of the texts, a row each, has the runs of `size` letters, told apart by GRAM_BITS bits."""
    bits = GRAM_BITS[size]
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)) << bits, [len(t) for t in texts])
    if size > 1:
        # a run lies in one text if its ends do
        n = max(0, len(letters) - size + 1)
        code = np.zeros(n, np.int64)
        for k in range(size):
            code = code * 31 + letters[k : k + n]
        same = owner[:n] == owner[size - 1 :]
        letters, owner = code[same], owner[:n][same]
    return np.bincount(owner + (letters & (1 << bits) - 1), minlength=len(texts) << bits).astype(np.int32).reshape(-1, 1 << bits)


def beyond(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether one of two rows of counts has more than `most` that the other hasn't."""
    more = a - b
    return (np.abs(more).sum(axis=1) + np.abs(more.sum(axis=1))) // 2 > most


def apart(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the letters, or the runs of letters, that only one of two strings has show that they are over `most` edits apart.

    An edit takes away or adds n runs of n letters at most. Where two runs are taken for one, the bound is only lower.
    Longer runs are counted where shorter ones leave it open, those of three in lines of more than LONG characters alone:
    others are compared as fast.
    """
    out, long = np.zeros(len(a), bool), np.array([max(len(x), len(y)) > LONG for x, y in zip(a, b, strict=True)], bool)
    for size in GRAM_BITS:
        left = np.nonzero(~out & (long | (size < 3)))[0]
        if len(left):
            x, y = ([side[i] for i in left] for side in (a, b))
            out[left] = beyond(counts(x, size), counts(y, size), size * most[left])
    return out


def presence(texts: list[str], size: int, bits: int) -> np.ndarray:
    """Which runs of `size` letters each of the texts, a row each, has: a bit of 1 << bits for each."""
    out, step = [np.zeros((0, 1 << bits - 6), np.uint64)], max(1, 1 << TABLE_BITS - bits)
    for at in range(0, len(texts), step):
        own = texts[at : at + step]
        letters = np.frombuffer("".join(own).encode("utf-32-le"), "<u4")
        lengths = np.array([len(t) for t in own])
        code, run = letters, 1
        while 2 * run <= size:
            code, run = code[:-run] * np.uint32(0x01000193 + 2 * run) + code[run:], 2 * run
        for k in range(run, size):
            code = code[: max(0, len(letters) - k)] * np.uint32(0x01000193) + letters[k:]
        code = code * np.uint32(ODD & 0xFFFFFFFF) >> np.uint32(32 - bits)
        place = np.repeat(np.arange(len(own)) << bits, lengths)[: len(code)] + code
        # runs that reach into the next text go to a bit behind all others
        across = np.cumsum(lengths)[:, None] - np.arange(1, size)
        place[across[(across >= 0) & (across < len(code))]] = len(own) << bits
        has = np.zeros((len(own) << bits) + 1, bool)
        has[place] = True
        out.append(np.packbits(has[:-1]).view(np.uint64).reshape(len(own), -1))
    return np.concatenate(out)


def runs_and_bits(size: int) -> tuple[int, int]:
    """Letters of a run and the logarithm of the bits for lines of up to `size` letters."""
    return PRESENT[size >= SHORT], min(MOST_BITS, max(LEAST_BITS, (ROOM * size - 1).bit_length()))


def lacking(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether one of two rows of bits has more than `most` that the other hasn't."""
    both = a & b
    return np.maximum(np.bitwise_count(a ^ both).sum(axis=1, dtype=np.int64), np.bitwise_count(b ^ both).sum(axis=1, dtype=np.int64)) > most


def strange(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the runs of letters that one of two strings lacks show that they are over `most` edits apart.

    An edit takes away n runs of n letters at most, so this is never true of closer ones. A text is cut into runs once for
    all pairs that follow it.
    """
    out = np.zeros(len(a), bool)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        kinds.setdefault(runs_and_bits(max(len(x), len(y))), []).append(i)
    for (size, bits), at in kinds.items():
        step = max(16, 1 << 20 - bits)
        for k in range(0, len(at), step):
            own, places = at[k : k + step], {}
            left, right = ([places.setdefault(side[i], len(places)) for i in own] for side in (a, b))
            held = presence(list(places), size, bits)
            out[own] = lacking(held[left], held[right], size * most[own])
    return out


def bounded(pairs: list[tuple[str, str]]) -> Iterator[tuple[int, int]]:
    """Ranges of at most TOGETHER pairs, and of about BLOCK characters where there are more than one."""
    start = total = 0
    for i, (x, y) in enumerate(pairs):
        if i - start == TOGETHER or total and total + len(x) + len(y) > BLOCK:
            yield start, i
            start, total = i, 0
        total += len(x) + len(y)
    if start < len(pairs):
        yield start, len(pairs)


def similar_pairs(a: list[str], b: list[str], judged: bool = False) -> np.ndarray:
    """`similar` of many pairs: those that letters don't show to be apart and that aren't plain go through one table together.

    judged: the letters have been looked at before.
    """
    out, allowed = np.zeros(len(a), bool), np.array([edits(x, y) for x, y in zip(a, b, strict=True)], np.int64)
    left = np.nonzero(allowed >= 0)[0]
    if not judged:
        # runs of letters part lines of some length best, counts the others
        runs = np.array([max(len(a[i]), len(b[i])) >= RUNS for i in left], bool) & (allowed[left] < 64 * WORDS)
        held, left = left[runs], left[~runs]
        held = held[~strange([a[i] for i in held], [b[i] for i in held], allowed[held])]
        some = [(a[i], b[i]) for i in left]
        far = [apart([x for x, _ in some[i:k]], [y for _, y in some[i:k]], allowed[left[i:k]]) for i, k in bounded(some)]
        left = np.concatenate([held, left[~np.concatenate([np.zeros(0, bool), *far])]])
    rest = []
    for i in left.tolist():
        most, (u, v) = int(allowed[i]), core(a[i], b[i])
        if plainly(u, v, most):
            out[i] = True
        elif most >= 64 * WORDS:
            out[i] = similar(a[i], b[i])
        else:
            rest.append((most // 64, min(len(u), len(v)), most, i, u, v))
    rest.sort()
    at = 0
    while at < len(rest):
        n = min(TABLES, bisect_left(rest, (rest[at][0] + 1,)) - at)
        while n > 1 and n * (rest[at + n - 1][1] + 64) * (rest[at][0] + 1) > PLACES:
            n = n * 3 // 4
        part = rest[at : at + n]
        out[[r[3] for r in part]] = within([r[4] for r in part], [r[5] for r in part], np.array([r[2] for r in part]))
        at += n
    return out


def numbered(text: str, number: np.ndarray, size: int) -> np.ndarray:
    """The numbers of the letters of strings of `size` letters each, a column a string."""
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.ascontiguousarray(number[flat].reshape(-1, size).T) if size else np.zeros((0, 0), number.dtype)


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each pair's edit distance is `most` or less: all pairs' tables row by row, in a band around the diagonal.

    With m edits at most and b longer by d, no place in a is more than (m - d) / 2 ahead of the one in b. A row is held as
    the bits of its differences along b (`up` and `down` by one), which move on by one place with each letter of a; the
    distance is counted along the diagonal on which the pair ends.
    """
    letters = np.frombuffer("".join([*a, *b]).encode("utf-32-le"), "<u4")
    filler = int(letters.max(initial=31)) + 1
    number = np.zeros(filler + 1, np.uint32)
    number[letters], number[filler] = 1, 1
    kinds = int(number.sum())
    if kinds > LETTERS and len(a) > 1:
        half = len(a) // 2
        return np.concatenate([within(a[:half], b[:half], most[:half]), within(a[half:], b[half:], most[half:])])
    number = (np.cumsum(number) - 1).astype(np.uint8 if kinds <= 256 else np.uint32)
    # the shorter of each pair first, the shortest pairs in front
    order = sorted(range(len(a)), key=lambda i: min(len(a[i]), len(b[i])))
    a, b = zip(*[(a[i], b[i]) if len(a[i]) <= len(b[i]) else (b[i], a[i]) for i in order], strict=True)
    la, lb, most, one = np.array([len(x) for x in a]), np.array([len(x) for x in b]), most[order], np.uint64(1)
    ahead, rows = np.maximum(0, most - lb + la) // 2, int(la[-1])
    words, last = int((lb - la + 2 * ahead).max()) // 64 + 1, lb - la + ahead
    # letters by numbers, a column a string, then the places of each letter in each b as bits
    pad, size = chr(filler), int((lb + ahead).max())
    x = numbered("".join([t.ljust(rows, pad) for t in a]), number, rows)
    y = numbered("".join([(pad * k + t).ljust(size, pad) for k, t in zip(ahead.tolist(), b, strict=True)]), number, size)
    pair = np.arange(len(a))
    places = np.zeros((max(rows, size) // 64 + words + 2, kinds * len(a)), np.uint64)
    for j in range(size):
        places[j >> 6][y[j] * np.int64(len(a)) + pair] |= one << np.uint64(j & 63)
    places[:, (kinds - 1) * len(a) :] = 0
    up = np.zeros((words, len(a)), np.uint64)
    for k in range(words):
        up[k] = np.where(ahead <= 64 * k, ~np.uint64(0), np.where(ahead >= 64 * k + 64, np.uint64(0), ~np.uint64(0) << (ahead & 63).astype(np.uint64)))
    down, kept, live, of = np.zeros_like(up), np.zeros(len(a), np.uint64), np.array(order), np.int64(len(a))
    # of the letters of a, as many must be kept, or the distance is too large
    word, bit, spare, good = last >> 6, (last & 63).astype(np.uint64), most - (lb - la), np.zeros(len(a), bool)
    for i in range(rows + 1):
        if la[0] == i or i % 16 == 0:
            near = kept.astype(np.int64) + spare >= i
            done = int(np.searchsorted(la, i, "right"))
            good[live[:done]] = near[:done]
            if done == len(live):
                break
            on = slice(done, None)
            if i % 16 == 0 and 4 * near[done:].sum() < 3 * len(live):
                on = done + np.nonzero(near[done:])[0]
                if not len(on):
                    break
            live, pair, la, spare, kept, word, bit = (v[on] for v in (live, pair, la, spare, kept, word, bit))
            up, down, x = up[:, on], down[:, on], x[:, on]
        same = places[i >> 6 : (i >> 6) + words + 1].take(x[i] * of + pair, axis=1)
        same = same[:-1] >> np.uint64(i & 63) | same[1:] << np.uint64(64 - (i & 63)) if i & 63 else same[:-1]
        total = (same & up) + up
        if words > 1:
            carry = total[0] < up[0]
            for k in range(1, words):
                over = total[k] < up[k]
                total[k] += carry
                carry = over | (carry & (total[k] == 0))
        # where the distance is that of the diagonal neighbour before
        diagonal = (total ^ up) | same | down
        more, less, moved = down | ~(diagonal | up), diagonal & up, diagonal >> one
        if words > 1:
            moved[:-1] |= diagonal[1:] << np.uint64(63)
        up, down = less | ~(moved | more), moved & more
        kept += ((diagonal[0] if words == 1 else diagonal[word, np.arange(len(live))]) >> bit) & one
    return good


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = similar_pairs(batch.column("na").to_pylist(), batch.column("nb").to_pylist())
        yield batch.select(["a", "b"]).filter(pa.array(good))


def forest(group: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) of a spanning forest of the near lines among two chunks of one block key.

    Candidates are compared some at a time, the closest fingerprints first; those that are connected by then are left out.
    """
    keys, texts, chunk = group["node"].tolist(), group["normal"].tolist(), group["chunk"].to_numpy()
    loose, sims, sizes = group["sim"].isna().to_numpy(), group["sim"].fillna(0).to_numpy().astype(np.int64).view(np.uint64), group["size"].to_numpy()
    loose |= sizes < SHORT
    c1, c2, block = (group[c].iloc[0] for c in ("c1", "c2", "block"))
    blocks = group[KEYS].to_numpy(np.int64, na_value=0)
    run, bits = runs_and_bits(int(sizes.max()))
    rules = [(run, lacking, presence(texts, run, bits))]
    rules += [(size, beyond, np.concatenate([counts(texts[x : x + 16], size) for x in range(0, len(texts), 16)])) for size in (1, 2)]
    rows, others, root, out = np.nonzero(chunk == c1)[0], np.nonzero(chunk == c2)[0], np.arange(len(keys)), []
    step = max(1, PAIRS // len(others))
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        ones = np.bitwise_count(sims[own, None] ^ sims[others])
        i, j = np.nonzero((ones <= DIFFER) | loose[own, None] | loose[others])
        bits = np.where(loose[own[i]] | loose[others[j]], np.uint8(0), ones[i, j])
        i, j = own[i], others[j]
        largest = np.maximum(sizes[i], sizes[j])
        near = (np.abs(sizes[i] - sizes[j]) <= (1 - SIMILARITY) * largest + 1e-9) & (root[i] != root[j]) & ((i < j) if c1 == c2 else True)
        i, j, bits, most = i[near], j[near], bits[near], ((1 - SIMILARITY) * largest[near] + 1e-9).astype(np.int64)
        # runs and letters are looked for once a line, not once a pair
        for size, rule, table in rules:
            far = [rule(table[i[x : x + 512]], table[j[x : x + 512]], size * most[x : x + 512]) for x in range(0, len(i), 512)]
            near = ~np.concatenate([np.zeros(0, bool), *far])
            i, j, bits, most = i[near], j[near], bits[near], most[near]
        # a pair belongs to the least key that it shares
        near = np.where((blocks[i] == blocks[j]) & (blocks[i] != 0), blocks[i], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == block
        order = np.nonzero(near)[0][np.argsort(bits[near], kind="stable")]
        i, j = i[order], j[order]
        while len(apart_yet := np.nonzero(root[i] != root[j])[0]):
            i, j = i[apart_yet], j[apart_yet]
            good = similar_pairs([texts[x] for x in i[:TOGETHER]], [texts[x] for x in j[:TOGETHER]], judged=True)
            for x, y in zip(i[:TOGETHER][good].tolist(), j[:TOGETHER][good].tolist(), strict=True):
                if root[x] != root[y]:
                    root[root == root[x]] = root[y]
                    out.append((keys[x], keys[y]))
            i, j = i[TOGETHER:], j[TOGETHER:]
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def shared_blocks(distinct: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, sim, size, block, level) of the blocks that several lines have, and of few others: most blocks aren't shuffled.

    level: null for blocks that have no more than HOT lines. In others a line stands twice, in its two length buckets: lines
    that may be near share one, and few other lines do.
    """
    hot = shared.where(F.col("n") > HOT)
    sent = distinct.sparkSession.sparkContext.broadcast((bitmap(shared.select("block"), "block", shared.count()), bitmap(hot.select("block"), "block", hot.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, many = sent.value
        for batch in batches:
            for k in KEYS:
                block = batch.column(k)
                good = in_bitmap(known, block.fill_null(0).to_numpy()) & block.is_valid().to_numpy(zero_copy_only=False)
                part = batch.select(["node", "sim", "size", k]).filter(pa.array(good))
                hot = in_bitmap(many, part.column(k).to_numpy())
                twice = pa.array(np.repeat(np.arange(part.num_rows), 1 + hot))
                upper = np.floor(np.log(part.column("size").to_numpy() + 1e-6) / -math.log(SIMILARITY)).astype(np.int64)
                lower = np.diff(twice.to_numpy(), prepend=-1) == 0
                yield pa.RecordBatch.from_arrays([*part.take(twice).columns, pa.array(np.repeat(upper, 1 + hot) - lower, mask=~np.repeat(hot, 1 + hot))], ["node", "sim", "size", "block", "level"])

    return distinct.select("node", "sim", "size", *KEYS).mapInArrow(run, "node bigint, sim bigint, size int, block bigint, level bigint")


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, long): the pairs of each block whose fingerprints and lengths are near. Rows are sorted by block; blocks are small.

    long: pairs that no table of WORDS is enough for, which are compared one by one.
    """

    def pairs(block: np.ndarray, node: np.ndarray, sim: np.ndarray, loose: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        found, i, step = [np.zeros((3, 0), np.int64)], np.arange(len(block)), 1
        while len(i):
            i = i[i + step < len(block)]
            i = i[block[i] == block[i + step]]
            j = i + step
            least, largest = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            near = (np.bitwise_count((sim[i] ^ sim[j]).view(np.uint64)) <= DIFFER) | (least < SHORT) | loose[i] | loose[j]
            near &= largest - least <= (1 - SIMILARITY) * largest + 1e-9
            found.append(np.stack([np.minimum(node[i[near]], node[j[near]]), np.maximum(node[i[near]], node[j[near]]), largest[near]]))
            step += 1
        a, b, largest = np.concatenate(found, axis=1)
        long = (1 - SIMILARITY) * largest + 1e-9 >= 64 * WORDS
        return pa.RecordBatch.from_pydict({"a": a[a < b], "b": b[a < b], "long": long[a < b]})

    held = None
    for batch in batches:
        sim = batch.column("sim")
        now = [batch.column("block").to_numpy(), batch.column("node").to_numpy(), sim.fill_null(0).to_numpy(), sim.is_null().to_numpy(zero_copy_only=False), batch.column("size").to_numpy()]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        # the last block may go on in the next batch
        n = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        held = [x[n:] for x in now]
        yield pairs(*[x[:n] for x in now])
    if held is not None:
        yield pairs(*held)


def near_lines(docs: DataFrame, distinct: DataFrame, work: Workspace) -> DataFrame:
    """Edges (a, b) between nodes of distinct lines that connect the near ones that share a key, by chains at least."""
    shared = work.table(distinct.select(F.explode(F.array(*KEYS)).alias("block")).where("block is not null").groupBy("block").agg(F.count("*").alias("n")).where("n > 1"))
    kept = work.table(shared_blocks(distinct, shared))
    work.drop(shared)
    many = kept.where("level is not null")
    many = work.table(many.join(many.groupBy("block", "level").agg(F.count("*").alias("n")).where("n > 1"), ["block", "level"]))
    hot = many.where(F.col("n") > HOT)
    cold = kept.where("level is null").select("block", "node", "sim", "size").union(many.where(F.col("n") <= HOT).select(F.xxhash64("block", "level"), "node", "sim", "size"))
    pairs = work.table(cold.repartition("block").sortWithinPartitions("block").mapInArrow(candidates, "a bigint, b bigint, long boolean").distinct())
    work.drop(kept)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(hot.select("node")).distinct()
    wanted = work.table(distinct.select("key", "node").join(nodes, "node"))
    texts = work.table(normal_texts(docs, wanted))
    work.drop(wanted)
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(x), F.col("normal").alias(f"n{x}")), x)
    # long pairs and pairs of chunks take more time than their bytes tell, so they are dealt out by number
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain, long = (pairs.where(c).select("a", "b", "na", "nb") for c in ("not long", "long"))
    cold_edges = plain.union(long.repartition(parts, "a", "b")).mapInArrow(verified, "a bigint, b bigint")
    # lines of a length bucket have fewer letters than the one after the next begins with
    few = F.greatest(F.lit(LEAST_CHUNK), F.lit(CHUNK_BYTES) * F.pow(F.lit(SIMILARITY), F.col("level") + 2))
    chunks = F.ceil(F.col("n") / F.least(F.lit(CHUNK), few)).cast("bigint")
    hot = hot.join(distinct.select("node", *KEYS), "node").join(texts, "node").withColumn("chunk", F.pmod(F.xxhash64("node"), chunks))
    span = F.transform(F.sequence(F.lit(0).cast("bigint"), chunks - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("c1"), F.greatest(c, F.col("chunk")).alias("c2")))
    hot = hot.select("block", "level", "node", "sim", "size", *KEYS, "normal", "chunk", F.inline(span))
    hot_edges = hot.repartition(parts, "block", "level", "c1", "c2").groupBy("block", "level", "c1", "c2").applyInPandas(forest, "a bigint, b bigint")
    return cold_edges.union(hot_edges)


def removals(docs: DataFrame, work: Workspace) -> DataFrame:
    """(id, row, gone): the lines of each document that aren't the first of their group. docs: id, row, text."""
    read = work.table(occurrences(docs))
    lines = read.groupBy("key").agg(F.count("*").alias("n"), F.min("sim").alias("sim"), F.min("size").alias("size"), *[F.min(k).alias(k) for k in KEYS])
    # numbered as they are written: numbers are shorter than keys, and faster to sort and to group
    lines = work.table(lines.withColumn("node", F.monotonically_increasing_id()))
    # without the keys, which are most of their bytes
    found = work.table(read.select("id", "row", "line", "key"))
    work.drop(read)
    roots = connected_components(near_lines(docs, lines, work), work)
    heads = roots.select(F.col("root").alias("node"), "root").distinct().union(roots)
    many = lines.select("key", "node", "n").join(heads, "node", "left").where("n > 1 or root is not null").select("key", F.coalesce("root", "node").alias("root"))
    # tables of their own, so that the joins can split a large group
    places = work.table(found.join(work.table(many), "key").drop("key"))
    keep = work.table(places.groupBy("root").agg(F.min(F.struct("id", "row", "line")).alias("keep")))
    gone = places.join(keep, "root").where(F.struct("id", "row", "line") != F.col("keep"))
    return gone.groupBy("id", "row").agg(F.collect_list("line").alias("__gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with `text` replaced by the lines that stay, and n_lines and n_removed.

    The first line of each group stays, by (id, hash of the text, line number). Lines without a letter or digit always
    stay. Rows with a null id keep all their lines and take no part; rows that repeat id and text keep the same lines.
    A null text has no lines and stays null. Columns named n_lines or n_removed are replaced.
    """
    work = Workspace(docs.sparkSession, "lines")
    rows = docs.drop(*({"n_lines", "n_removed"} - {id_col, text}))
    held = rows.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text")).where("id is not null")
    gone = removals(held, work).withColumnsRenamed({"id": "__id", "row": "__row"})
    joined = rows.join(gone, (F.col(id_col).cast("bigint") == F.col("__id")) & (F.xxhash64(text) == F.col("__row")), "left")
    # sets of places and a column of lines, so that a document of very many lines is rewritten in linear time
    joined = joined.withColumn("__lines", F.split(text, "\n"))
    lines = F.col("__lines")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    stay = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    new = {text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(stay)}
    counts = {"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("bigint"), "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns], *[F.when(F.col(text).isNull(), F.lit(0).cast("bigint")).otherwise(v).alias(k) for k, v in counts.items()])
