"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a 23-bit word of the binary Golay
code [23, 12, 7]. A word maps to the indices of all codewords within distance 4 of it: one index if it lies within
2 of its nearest codeword, six otherwise. Two words that differ in at most 2 bits have a midpoint within 1 of each,
whose codeword lies within 4 of both: they share an index. Of three segments, 2 errors leave one untouched
(pigeonhole), so fingerprints at 2 or fewer differing bits agree on (a segment, an index of the next segment): keys of
33 or 34 bits, 16 a fingerprint on average. Pairs that share a key are verified by their differing bits.

Keys that hold more than HOT fingerprints (a large group of near copies) are not paired up: their fingerprints are
linked through one-bit variants, since two fingerprints are at 2 or fewer bits exactly if one variant is within a bit
of both. That is 65 rows a fingerprint however large the group is, and as exact.

`near_copies` is for copies that differ in more: at a shingle similarity of 0.8, fingerprints are some ten bits apart, where
no segment of a code word survives. So texts meet on their fingerprints' links and on BANDS bands of ROWS least shingle
hashes as well, and every pair that meets is verified by its whole shingle sets. The texts of a key with more than FEW
first meet the key's least text, and the least text of each pair of this key and another of theirs. Most are in one
component by then. Texts of such a key that are still in different ones are all compared (`rest`): dealt into chunks of
bounded size, a pair of chunks a task, so that no pair of a key is left out, however many texts it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, raw, slices
from lodestone.llm.components import connected_components
from lodestone.llm.sketch import bitmap, in_bitmap

#: Generator polynomial of the binary Golay code (fixed value).
GENERATOR = 0xAE3
#: First bit and length of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A key with more fingerprints is linked by variants instead of pairs.
HOT = 32
#: Bands of least shingle hashes, and hashes a band: of pairs at a similarity of 0.8, one in 300 shares none.
BANDS, ROWS = 8, 3
#: Texts of a band that are paired up at once, at most.
FEW = 16
#: Texts, and bytes of their sets, of a chunk of a larger band.
CHUNK, CHUNK_BYTES = 1000, 4 << 20
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 16


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the nearest error pattern, and the five patterns of weight 4 (or zeros); syndromes of 12 bits."""
    high = np.zeros(1 << 12, np.int64)
    for x in range(1 << 12):
        v = x << 11
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << bit - 11
        high[x] = v
    leader, more, filled = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64), np.zeros(2048, np.int64)
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = high[e >> 11] ^ e & 2047
            if weight < 4:
                leader[s] = e
            else:
                more[s, filled[s]] = e
                filled[s] += 1
    return high, leader, more


def indices(words: np.ndarray) -> np.ndarray:
    """Codeword indices of 23-bit words, six a row; where there is one only, it stands in the first place, then -1."""
    high, leader, more = golay()
    syndrome = high[words >> 11] ^ words & 2047
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = (words ^ leader[syndrome]) >> 11
    far = more[syndrome, 0] > 0
    out[far, 1:] = (words[far, None] ^ more[syndrome[far]]) >> 11
    return out


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of every key of every fingerprint (int64)."""
    bits = prints.astype(np.uint64)
    cut = [(bits >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    found, owner = [], []
    for i in range(3):
        index = indices(cut[(i + 1) % 3])
        row, col = np.nonzero(index >= 0)
        found.append(i << 36 | cut[i][row] << 12 | index[row, col])
        owner.append(prints[row])
    return np.concatenate(found), np.concatenate(owner)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit integer; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        flat, digest, at, bounds = b" ".join(words), xxhash.xxh64_intdigest, 0, []
        for w in words:
            bounds.append(at)
            at += len(w) + 1
        hashes = [digest(flat[a : b - 1], 42) for a, b in zip(bounds, [*bounds[shingle:], at], strict=False)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.array(hashes[i : i + BLOCK], np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row, read from whole texts in one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "fp": pa.array([fingerprint(x, shingle) for x in raw(batch)], pa.int64())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def near(a: Column, b: Column, most: int = 2) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def links(prints: DataFrame, work: Workspace) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints `fp` that connect exactly those within 2 bits, by chains at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                key, fp = keys(batch.column("fp")[i : i + BLOCK].to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_pydict({"key": key, "fp": fp})

    keyed = prints.select("fp").mapInArrow(run, "key bigint, fp bigint")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = work.table(keyed.join(shared, "key"))
    cold = held.where(F.col("n") <= HOT)
    pairs = cold.select("key", F.col("fp").alias("a")).join(cold.select("key", F.col("fp").alias("b")), "key").where(F.col("a") < F.col("b")).where(near(F.col("a"), F.col("b"))).select("a", "b")
    hot = held.where(F.col("n") > HOT).select("fp").distinct()
    bits = F.array(F.lit(0).cast("bigint"), *[F.lit(-(1 << 63) if i == 63 else 1 << i).cast("bigint") for i in range(64)])
    variants = work.table(hot.select("fp", F.explode(bits).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("variant")))
    middle = variants.groupBy("variant").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("variant", "b")
    stars = variants.join(middle, "variant").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row: rows whose fingerprints are within 2 bits, by chains, form a component.

    component_id is the smallest id in the component (null if it has null ids only). Null, empty and blank texts
    have fingerprint 0, which links like any other. Repeated rows stay repeated. An empty table gives no rows.
    Copies are grouped by fingerprint before any join, so a group of copies of any size is one fingerprint.
    """
    work = Workspace(docs.sparkSession, "simhash")
    rows = work.table(fingerprints(docs, id_col, text, shingle))
    prints = work.table(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(links(prints, work), work)
    owned = work.table(prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    groups = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(owned.select("fp", "root").join(groups, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; of its whole sequence of words if they are fewer."""
    words = (text or b"").lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - shingle + 1].copy()
    for j in range(1, shingle):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + h[j : len(h) - shingle + 1 + j]
    return np.unique(out)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key of each band: of the least hashes under ROWS orders."""
    out = np.zeros(BANDS, np.uint64)
    for i in range(BANDS * ROWS):
        x = (hashes ^ np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        least = int((x ^ x >> np.uint64(32)).min())
        out[i // ROWS] = xxhash.xxh64_intdigest(least.to_bytes(8, "little"), int(out[i // ROWS]) ^ i // ROWS)
    return out


def met(nodes: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes (node, keys) that share a band, and (key, node) of the bands of more than FEW.

    All pairs of a band of up to FEW; else each node with the least one of the band, and with the least one of each two bands
    that it shares. `rest` compares what that leaves.
    """
    each = nodes.select("node", F.explode("keys").alias("key"))
    sizes = each.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    held = work.table(each.join(sizes, "key"))
    cold = held.where(F.col("n") <= FEW)
    pairs = cold.select("key", F.col("node").alias("a")).join(cold.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    hot = held.where(F.col("n") > FEW)
    stars = hot.where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    own = work.table(hot.select("node", "key").join(nodes, "node").select("node", F.explode(F.transform(F.array_remove("keys", F.col("key")), lambda x: F.xxhash64("key", x))).alias("both")))
    least = work.table(own.groupBy("both").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("both", "a"))
    finer = own.join(least, "both").where("node > a").select("a", F.col("node").alias("b"))
    return pairs.union(stars).union(finer).distinct(), hot.select("key", "node")


def bridges(group: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Edges (a, b) between the components of near texts in two chunks of a band (or one); connected ones aren't compared."""
    group = group.sort_values("chunk", ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    size, chunk, upper = np.array([len(x) for x in sets]), group["chunk"].to_numpy(), group["upper"].to_numpy() > group["level"].to_numpy()
    roots, root = group["root"].tolist(), pd.factorize(group["root"])[0]
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    # shingles of one text alone aren't shared
    kept = np.bincount(code)[code] > 1
    code, first = code[kept], np.append(0, np.cumsum(kept))[np.append(0, np.cumsum(size))]
    asked, out = np.zeros(int(code.max(initial=0)) + 1, bool), []
    one, begin = chunk[0] == chunk[-1], int(np.searchsorted(chunk, chunk[-1]))
    for i in range(begin, len(sets)):
        j = np.arange(i if one else begin)
        # texts of the upper bucket meet in that one
        j = j[(root[j] != root[i]) & ~(upper[j] & upper[i]) & (np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]))]
        asked[code[first[i] : first[i + 1]]] = True
        n = first[j + 1] - first[j]
        at = np.repeat(first[j] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(np.repeat(np.arange(len(j)), n), asked[code[at]], minlength=len(j))
        asked[code[first[i] : first[i + 1]]] = False
        for k in j[both >= similarity * (size[i] + size[j] - both)].tolist():
            if root[k] != root[i]:
                out.append((roots[k], roots[i]))
                root[root == root[k]] = root[i]
    return pd.DataFrame(out, columns=["a", "b"])


def rest(hot: DataFrame, owned: DataFrame, sets: DataFrame, similarity: float, work: Workspace) -> DataFrame:
    """Edges (a, b) between the roots of nodes that share a band of `hot` (key, node) and are near, though in different components.

    owned: node, size, root; sets: node, shingles. Each node stands in two buckets of its band by the size of its set: those
    that may be near share one. The nodes of a bucket's largest component are compared with the others only, so a large group
    of near copies with a few strangers takes time in proportion.
    """
    upper = F.floor(F.log(F.col("size") + 1e-6) / -math.log(similarity))
    placed = hot.join(owned, "node").withColumn("upper", upper).withColumn("level", F.explode(F.array("upper", F.col("upper") - 1)))
    placed = work.table(placed)
    counted = placed.groupBy("key", "level", "root").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("upper").alias("upper"))
    groups = counted.groupBy("key", "level").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most"), F.max("size").alias("largest"), F.min("upper").alias("least"), F.count("*").alias("roots"))
    groups = groups.where("roots > 1 and least = level").withColumn("per", F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(CHUNK_BYTES / 8 / F.col("largest")))))
    large = F.col("most.n") > F.col("per")
    groups = groups.select("key", "level", F.when(large, F.col("most.root")).alias("main"), F.when(large, F.ceil(F.col("most.n") / F.col("per"))).otherwise(0).alias("mains"), F.ceil(F.when(large, F.col("all") - F.col("most.n")).otherwise(F.col("all")) / F.col("per")).alias("others"))
    found = placed.join(work.table(groups), ["key", "level"]).withColumn("own", F.col("root").eqNullSafe(F.col("main")))
    found = found.withColumn("chunk", F.when(F.col("own"), F.pmod(F.xxhash64("node"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), "others")))
    found = work.table(found.join(sets, "node"))
    span = F.transform(F.sequence(F.when(F.col("own"), F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1), lambda c: F.struct(F.least(c, "chunk").alias("c1"), F.greatest(c, "chunk").alias("c2")))
    tasks = found.select("key", "level", "root", "upper", "shingles", "chunk", F.inline(span)).groupBy("key", "level", "c1", "c2")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return bridges(group, similarity)

    return tasks.applyInPandas(run, "a binary, b binary")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) for every row: texts whose sets of word shingles have a Jaccard similarity of `similarity` or more,
    by chains, form a component.

    Texts of the same words are one node before anything is joined. Every link is verified by whole sets; of the pairs at the
    threshold one in 300 doesn't meet, of closer ones fewer. component_id is the smallest id in the component, null if it has
    null ids only. Null, empty and blank texts are copies of each other; texts of fewer words than a shingle are compared as
    a whole. Repeated rows stay repeated, and an empty table gives no rows.
    """
    work, kind = Workspace(docs.sparkSession, "copies"), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = raw(batch)
            nodes = [xxhash.xxh3_128_digest(b" ".join((t or b"").lower().split())) for t in own]
            hashes = [shingle_hashes(t, shingle) for t in own]
            keys = [bands(h).view(np.int64).tolist() for h in hashes]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "node": pa.array(nodes, pa.binary()), "fp": pa.array([fingerprint(t, shingle) for t in own], pa.int64()), "size": pa.array([len(h) for h in hashes], pa.int32()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    held = work.table(rows.mapInArrow(read, f"id {kind}, node binary, fp bigint, size int, keys array<bigint>"))
    # rows of one node have one fingerprint, one size and one list of keys
    nodes = work.table(held.groupBy("node", "fp", "size", "keys").agg(F.min("id").alias("first")))
    prints = work.table(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    same = nodes.join(prints.where("n > 1").select("fp", F.col("node").alias("a")), "fp").where("node > a").select("a", F.col("node").alias("b"))
    close = links(prints, work)
    for x in "ab":
        close = close.join(prints.select(F.col("fp").alias(x), F.col("node").alias(f"n{x}")), x)
    close = close.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    pairs, hot = met(nodes.select("node", "keys"), work)
    pairs = work.table(pairs.union(same).union(close).distinct())
    wanted = work.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    half = F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("bigint")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(half.alias("h")), "h", wanted.count()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = raw(batch)
            nodes = [xxhash.xxh3_128_digest(b" ".join((t or b"").lower().split())) for t in own]
            asked = in_bitmap(sent.value, np.array([int.from_bytes(n[:8], "big") >> 4 for n in nodes], np.int64))
            some = list({nodes[i]: i for i in np.flatnonzero(asked).tolist()}.values())
            yield pa.RecordBatch.from_pydict({"node": pa.array([nodes[i] for i in some], pa.binary()), "shingles": pa.array([shingle_hashes(own[i], shingle).tobytes() for i in some], pa.binary())})

    found = rows.select("text").mapInArrow(sets, "node binary, shingles binary").join(wanted, "node", "left_semi")
    found = work.table(found.groupBy("node").agg(F.min("shingles").alias("shingles")))
    for x in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")), x)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                u, v = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if min(len(u), len(v)) < similarity * max(len(u), len(v)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(both >= similarity * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    edges = work.table(pairs.select("a", "b", "sa", "sb").mapInArrow(verified, "a binary, b binary"))
    roots = connected_components(edges, work)
    owned = work.table(nodes.select("node", "size", "first").join(roots, "node", "left").select("node", "size", "first", F.coalesce("root", "node").alias("root")))
    more = work.table(rest(hot, owned.select("node", "size", "root"), found, similarity, work))
    joined = connected_components(more, work).select(F.col("node").alias("root"), F.col("root").alias("top"))
    owned = work.table(owned.join(joined, "root", "left").select("node", "first", F.coalesce("top", "root").alias("root")))
    groups = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    return held.select("id", "node").join(owned.select("node", "root").join(groups, "root").select("node", "component_id"), "node").select("id", "component_id")


def first_of_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", grouping: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The rows of docs that stay: one of each component that `grouping` finds, the one with the smallest id.

    grouping: `near_duplicates` or `near_copies`. Rows with a null id, and further rows of a kept id, can't be told apart by
    id: they stay.
    """
    gone = grouping(docs, id_col, text).where("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
