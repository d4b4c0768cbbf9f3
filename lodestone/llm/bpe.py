"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens of a slice of texts lie in one buffer, as linked lists of positions. Buckets, one per merge rank, hold
the positions whose neighbours merge at that rank; a two-level bitmap marks the buckets that are not empty, and
find-first-set on it gives the next rank. Entries that a merge has made stale are skipped when they are taken out.
A pre-token of n bytes costs O(n log n) at most, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices

#: Pre-tokens that a worker remembers, with their ids.
CACHE = 250_000
#: Characters of a pre-token up to which it is worth remembering.
LONG = 64
#: Short pre-tokens that are merged at once.
ROWS = 4096
#: Bits of a bitmap word.
WIDTH = 256
#: Characters beyond the basic multilingual plane.
BEYOND = re.compile("[\U00010000-\U0010ffff]")


class RankQueue:
    """Buckets of positions by merge rank under a two-level bitmap."""

    def __init__(self, ranks: np.ndarray):
        """Position i waits at ranks[i], if that is 0 or more."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        found, starts = np.unique(ranks[order], return_index=True)
        self.buckets = {r: part.tolist() for r, part in zip(found.tolist(), np.split(order, starts[1:]), strict=True)} if len(found) else {}
        self.words: dict[int, int] = {}
        self.top = 0
        for r in self.buckets:
            self.mark(r)

    def mark(self, rank: int) -> None:
        word = rank // WIDTH
        self.words[word] = self.words.get(word, 0) | 1 << rank % WIDTH
        self.top |= 1 << word

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            self.mark(rank)
        else:
            bucket.append(at)

    def pop(self) -> tuple[int, list[int]]:
        """The smallest rank and its positions, from the left."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        bit = bits & -bits
        bits ^= bit
        self.words[word] = bits
        if not bits:
            self.top ^= 1 << word
        rank = word * WIDTH + bit.bit_length() - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], first: np.ndarray) -> list[list[int]]:
    """Ids of each piece: in a piece, the neighbours of lowest rank merge first, the leftmost of equals first.

    first: the rank of each two bytes, -1 if they have none. Pieces are not empty.
    """
    buf, get = b"".join(pieces), ranks.get
    n = len(buf)
    ends = np.cumsum([len(x) for x in pieces])
    codes = np.frombuffer(buf, np.uint8).astype(np.int32)
    waits = np.append(first[codes[:-1] * 256 + codes[1:]], -1)
    waits[ends - 1] = -1  # no merge goes over the end of a piece
    due, ends = waits.tolist(), ends.tolist()
    head = bytearray(n + 1)  # marks where a piece begins
    for i in [0, *ends]:
        head[i] = 1
    after, before = list(range(1, n + 1)), list(range(-1, n))
    queue = RankQueue(waits)
    push = queue.push
    while queue.top:
        rank, bucket = queue.pop()
        until, held = 0, []
        for i in bucket:
            if due[i] != rank:
                continue
            if i < until:  # this piece has a lower rank now, which goes first
                held.append(i)
                continue
            j = after[i]
            k = after[i] = after[j]
            due[j], lower = -2, False
            if head[k]:
                due[i] = -1
            else:
                before[k] = i
                new = get(buf[i : after[k]], -1)
                due[i] = new
                if new >= 0:
                    push(new, i)
                    lower = new < rank
            if not head[i]:
                h = before[i]
                new = get(buf[h:k], -1)
                due[h] = new
                if new >= 0:
                    push(new, h)
                    lower = lower or new < rank
            if lower:
                until = ends[bisect_right(ends, i)]
        for i in held:
            push(rank, i)
    out, i = [], 0
    for end in ends:
        ids = []
        while i < end:
            ids.append(ranks[buf[i : after[i]]])
            i = after[i]
        out.append(ids)
    return out


class ShortMerges:
    """Merges many short pieces at once: one row a piece, and in each round every row's pair of lowest rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes((b,))] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[x] for x in self.pairs.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what left and right make, n if they don't merge or one of them is -1."""
        code = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.ranks[at], self.n)

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Ids of pieces that aren't empty, one row each, -1 behind the last."""
        width = max(map(len, pieces))
        codes = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(-1, width)
        columns = np.arange(width)
        ids = np.where(columns < np.array([len(x) for x in pieces])[:, None], self.bytes[codes], -1)
        ids = np.append(ids, np.full((len(ids), 2), -1), axis=1)  # so that there is always a next one
        waits = self.rank(ids[:, :-1], ids[:, 1:])
        out, row = np.full((len(ids), width), -1), np.arange(len(ids))
        while len(ids):
            j = waits.argmin(axis=1)
            here = np.arange(len(ids))
            low = waits[here, j]
            done = low == self.n
            if done.any():
                out[row[done]] = ids[done, :width]
                left = ~done
                ids, waits, row, j, low, here = ids[left], waits[left], row[left], j[left], low[left], here[: left.sum()]
            ids[here, j] = low
            behind = np.minimum(np.arange(1, ids.shape[1] + 1), ids.shape[1] - 1)
            moved = np.arange(ids.shape[1]) > j[:, None]
            ids = np.where(moved, ids[:, behind], ids)
            waits = np.where(moved[:, :-1], waits[:, behind[: waits.shape[1]].clip(max=waits.shape[1] - 1)], waits)
            waits[here, j] = self.rank(ids[here, j], ids[here, j + 1])
            waits[here[j > 0], j[j > 0] - 1] = self.rank(ids[here[j > 0], j[j > 0] - 1], ids[here[j > 0], j[j > 0]])
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=64)
def class_ranges(escape: str) -> str:
    """The characters up to U+FFFF that a class such as \\p{L} or \\s has, as ranges for use in a set."""
    parts = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x10000)))
    runs = [x for part in parts for x in regex.findall(f"{escape}+", part)]
    return "".join(re.escape(x[0]) + (f"-{re.escape(x[-1])}" if len(x) > 1 else "") for x in runs)


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern in `re`, which is faster, for texts without characters beyond U+FFFF; None if it can't be said there."""
    out, inside = [], False
    for token in re.findall(r"\\[pP]\{\^?\w+\}|\\.|.", pattern, re.DOTALL):
        if re.match(r"\\[pPsSwWdD]", token):
            token = class_ranges(token) if inside else f"[{class_ranges(token)}]"
        inside = token[:1] == "[" and len(token) == 1 or inside and token != "]"
        out.append(token)
    try:
        return re.compile("".join(out))
    except re.error:
        return None


class Codec:
    """Encodes and decodes texts by a rank file; remembers about CACHE pre-tokens. short: merge pre-tokens of up to so many bytes all at once."""

    def __init__(self, path: str, pattern: str, short: int = 0):
        self.ranks, self.short = load_ranks(path), short
        self.together = ShortMerges(self.ranks) if short else None
        self.first = np.full(1 << 16, -1, np.int32)
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
            if len(token) == 2:
                self.first[token[0] * 256 + token[1]] = rank
        self.blob = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pattern = regex.compile(pattern)
        self.plain = plain_pattern(pattern)
        self.known: dict[str, bytes] = {}

    def matcher(self, text: str) -> re.Pattern:
        return self.pattern if self.plain is None or BEYOND.search(text) else self.plain

    def look_up(self, texts: list[str]) -> tuple[list[str], list[bytes], list[int]]:
        """The pre-tokens of all texts, their ids as little-endian unsigned 32-bit integers, and where each text's end."""
        if len(self.known) > CACHE:
            self.known = dict(list(self.known.items())[CACHE // 2 :])
        own = [self.matcher(x).findall(x) for x in texts]
        pieces = list(chain.from_iterable(own))
        ids = list(map(self.known.get, pieces))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            found = self.learn({pieces[i] for i in new})
            for i in new:
                ids[i] = found[pieces[i]]
        return pieces, ids, list(accumulate(map(len, own)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        _, ids, ends = self.look_up(texts)
        return [b"".join(ids[a:b]) for a, b in pairwise([0, *ends])]

    def measure(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Characters and tokens of each text's pre-tokens."""
        pieces, ids, ends = self.look_up(texts)
        chars = np.fromiter(map(len, pieces), np.int32, len(pieces))
        tokens = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        return [(chars[a:b], tokens[a:b]) for a, b in pairwise([0, *ends])]

    def pieces_from(self, text: str, place: int) -> Iterator[str]:
        """The pre-tokens of the text from `place` on, one by one."""
        return (x.group() for x in self.matcher(text).finditer(text, place))

    def measured(self, pieces: list[str]) -> list[tuple[int, int]]:
        """(characters, tokens) of some pre-tokens."""
        return [(len(x), len(self.known.get(x) or self.learn({x})[x]) >> 2) for x in pieces]

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of new pre-tokens; those of short ones are remembered."""
        whole = {x: self.ranks.get(x.encode()) for x in new}
        found = {x: array("I", (rank,)).tobytes() for x, rank in whole.items() if rank is not None}
        rest = [x for x, rank in whole.items() if rank is None]
        small = sorted((x for x in rest if len(x.encode()) <= self.short), key=len)
        for i in range(0, len(small), ROWS):
            own = self.together.merge([x.encode() for x in small[i : i + ROWS]])
            flat, n = own[own >= 0].astype("<u4").tobytes(), 4 * np.cumsum((own >= 0).sum(axis=1))
            found |= {x: flat[a:b] for x, a, b in zip(small[i : i + ROWS], [0, *n[:-1].tolist()], n.tolist(), strict=True)}
        if rest := [x for x in rest if x not in found]:
            found |= {x: array("I", ids).tobytes() for x, ids in zip(rest, merge_all([x.encode() for x in rest], self.ranks, self.first), strict=True)}
        self.known |= {x: ids for x, ids in found.items() if len(x) <= LONG}
        return found

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@lru_cache(maxsize=2)
def codec(name: str, pattern: str, short: int = 0) -> Codec:
    """The worker's codec for a rank file that Spark has sent to every machine."""
    return Codec(SparkFiles.get(name), pattern, short)


def send_ranks(df: DataFrame, path: str) -> str:
    """Ship the rank file (under 1 MB, fixed) to the executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every text; one row per input row, in one narrow stage.

    Adds n_tokens, ids_sha256 (of the ids as little-endian uint32), decoded_sha256 and, with `ids`, the ids as
    array<int>. A null text counts as empty. The other columns stay; a column of one of these
    names is replaced. Texts are taken whole; a pre-token of any length is one piece.
    """
    name = send_ranks(docs, ranks_path)
    new = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if ids else {})
    kept = docs.drop(*(set(new) - {text}))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name not in new] + [f"{k} {v}" for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, pattern)
        for batch in slices(batches, text):
            encoded = c.encode([x or "" for x in batch.column(text).to_pylist()])
            decoded = [c.decode(x) for x in encoded]
            cols = {n: batch.column(n) for n in batch.schema.names if n not in new}
            cols["n_tokens"] = pa.array([len(x) // 4 for x in encoded], pa.int64())
            cols["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in encoded])
            cols["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in decoded])
            if ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in encoded)], dtype=np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
            yield pa.RecordBatch.from_pydict(cols)

    return kept.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Texts of array<int> ids; null ids give null. Bytes that are no UTF-8 become U+FFFD."""
    name = send_ranks(df, ranks_path)

    @F.pandas_udf("string")
    def decoded(x):
        c = codec(name, pattern)
        return x.map(lambda v: None if v is None else c.decode(array("I", v.tolist()).tobytes()).decode(errors="replace"))

    return df.withColumn(out, decoded(ids))
