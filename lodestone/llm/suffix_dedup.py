"""Suffix-array dedup: every byte of a string of LENGTH bytes that starts at more than one place, by distributed prefix doubling.

Sorting a suffix for each byte would shuffle many times the input, so the suffixes that are sorted are those at cut points,
which the text itself sets (least hashes of 8-byte grams among 64), and only where text may be repeated:

1. Any string of LENGTH bytes has an anchor, its least 64-byte gram by hash. Anchors are counted; windows whose anchor
   occurs once are unique. The others lie in few stretches, which are written out as pieces of bounded size.
2. Prefix doubling over the cut points of the pieces: a position's first rank is that of the two chunks that begin there.
   In each round Spark sorts the distinct pairs (rank, rank 2^k chunks further on) and their places in the order are the
   new ranks. Positions with a unique pair leave; a position stops once its run of chunks would pass the threshold. Two
   ranks of one level, overlapping, stand for a run of any number of chunks.
3. A window that starts at s belongs to the first cut point at s + w - 1 or later, a, where w is the least distance from
   an edge at which a cut point depends on the window alone. All its equals do likewise. The windows of a cut point all have
   the bytes from a - w + 1 to a + LENGTH - 2 w + 2 in common: the run of chunks, known by its ranks, and the bytes at both
   its ends. So the windows of two cut points can be equal only if these are, and then they are if the at most w - 1
   bytes beyond are. Cut points that agree in all bytes of their windows are settled at once; in the classes that
   have others as well, each window's bytes beyond make a key, and keys are counted.

Equal texts are one text throughout, so a group of copies of any size is sorted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, raw, slices
from lodestone.llm.sketch import bitmap, in_bitmap

#: Bytes of a repeated string.
LENGTH = 400
#: Grams among which the least is a cut point, and bytes of a gram.
NEAR, GRAM = 64, 8
#: Bytes of an anchor, at most.
ANCHOR = 64
#: Positions whose windows a piece has, at most, and bits of a position's place in its piece: those that they need follow.
PIECE, PLACES = 1024, 11
#: Hashes that are compared at a time; a place among them takes 24 bits.
BLOCK = 1 << 22
PLACE = np.uint64((1 << 24) - 1)
#: Factors of hashes (any odd numbers).
ODD, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Bytes of texts whose anchors are found together, and copied texts of which a task remembers that it has cut them.
TOGETHER, SEEN = 1 << 17, 100_000
#: The columns of a piece that have a value for each of its positions.
EACH = {"at": "int", "m": "int", "deep": "tinyint", "name": "bigint", "tail": "int", "lo": "int", "hi": "int"}
PIECES = f"k1 bigint, k2 bigint, first int, begin int, bytes binary, copied boolean, {', '.join(f'{c} array<{t}>' for c, t in EACH.items())}"
KINDS = {"int": np.int32, "tinyint": np.int8, "bigint": np.int64}


def window(length: int) -> int:
    """w: small enough that at least two chunks lie between the edges of a window."""
    return min(NEAR, (length - GRAM + 3) // 5)


def grams(text: bytes, size: int) -> np.ndarray:
    """A hash of each run of `size` bytes, 8 times a power of two."""
    x = np.ndarray(max(0, len(text) - 7), "<u8", buffer=text if len(text) >= 8 else bytes(8), strides=(1,)) * ODD
    x ^= x >> np.uint64(29)
    n = 8
    while n < size:
        x = x[:-n] * OTHER + x[n:]
        x ^= x >> np.uint64(31)
        n *= 2
    return x * ODD


def least(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes the place of the least one, the leftmost of equals."""
    out = [np.zeros(0, np.int64)]
    for i in range(0, max(0, len(h) - w + 1), BLOCK):
        part = h[i : i + BLOCK + w - 1]
        x, n = part & ~PLACE | np.arange(len(part), dtype=np.uint64), 1
        while 2 * n <= w:
            x = np.minimum(x[:-n], x[n:])
            n *= 2
        if n < w:
            x = np.minimum(x[: n - w], x[w - n :])
        out.append((x & PLACE).astype(np.int64) + i)
    return np.concatenate(out)


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each anchor of some texts in order, how many windows in a row have it, and whose it is."""
    size = GRAM
    while 2 * size <= min(ANCHOR, length // 4):
        size *= 2
    sizes = np.array([len(t) for t in texts], np.int64)
    begin, windows = np.cumsum(sizes) - sizes, np.maximum(0, sizes - length + 1)
    h = grams(b"".join(texts), size)
    at = least(h, length - size + 1)
    # the places at which a window of one text begins
    at = at[np.arange(windows.sum()) + np.repeat(begin - np.cumsum(windows) + windows, windows)]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return h[at[new]].view(np.int64), np.diff(np.append(new, len(at))), np.searchsorted(begin + sizes, at[new], "right")


def together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about TOGETHER bytes, one at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > TOGETHER:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def stretches(text: bytes, length: int, again: np.ndarray) -> Iterator[tuple[int, int, bytes, dict]]:
    """The pieces of a text: the positions that are to be sorted, and the bytes of the windows that belong to them.

    The last positions of a piece are those that its runs of chunks reach, and begin the next one again.
    again: whether the anchor of each window, in order, occurs elsewhere.
    """
    w, last = window(length), len(text) - length
    reach = length - 3 * w - GRAM + 3
    cut = np.unique(least(grams(text, GRAM), w))
    lo = np.maximum(0, np.append(0, cut[:-1] - w + 2))
    hi = np.minimum(cut - w + 1, last)
    before = np.append(0, np.cumsum(again))
    asked = np.flatnonzero((lo <= hi) & (before[np.maximum(hi, -1) + 1] > before[np.minimum(lo, last + 1)]))
    m = np.zeros(len(cut), np.int64)
    m[asked] = np.searchsorted(cut, cut[asked] + reach, "right") - 1 - asked
    level = np.frexp(np.maximum(m, 1))[1] - 1
    deep = np.zeros(len(cut), np.int64)
    for k in np.unique(level[asked]):
        edge = np.zeros(len(cut) + 1, np.int64)
        some = asked[level[asked] == k]
        np.add.at(edge, some, 1)
        np.add.at(edge, some + m[some] - 1, -1)
        deep[np.cumsum(edge)[:-1] > 0] = k
    js = np.flatnonzero(deep)
    for block in np.split(js, np.flatnonzero(np.diff(js) != 1) + 1):
        for i in range(0, len(block), PIECE):
            j = block[i : i + PIECE]
            mine = j[m[j] > 0]
            if not len(mine):
                continue
            j, n = np.arange(j[0], max(j[-1] + 1, (mine + m[mine]).max() - 1)), len(j)
            own = np.where(np.arange(len(j)) < n, m[j], 0)
            begin, end = int(lo[mine].min()), int(hi[mine].max()) + length
            digest = xxhash.xxh3_64_intdigest
            names = [digest(text[a:b]) for a, b in zip(cut[j].tolist(), cut[j + 2].tolist(), strict=True)]
            cols = {"at": cut[j], "m": own, "deep": deep[j], "name": np.array(names, np.uint64).view(np.int64), "tail": cut[j + own], "lo": lo[j], "hi": hi[j]}
            yield int(j[0]), begin, text[begin:end], cols


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    """(k1, k2, copied, first, begin, bytes, columns) of some pieces as rows of PIECES."""
    k1, k2, copied, first, begin, own, cols = zip(*rows, strict=True) if rows else [()] * 7
    ends = np.cumsum([0, *(len(c["at"]) for c in cols)]).astype(np.int32)
    lists = {n: pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, KINDS[t]), *(c[n] for c in cols)]).astype(KINDS[t])) for n, t in EACH.items()}
    plain = {"k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "first": pa.array(first, pa.int32()), "begin": pa.array(begin, pa.int32()), "bytes": pa.array(own, pa.binary()), "copied": pa.array(copied, pa.bool_())}
    return pa.RecordBatch.from_pydict(plain | lists)


def pieces(texts: DataFrame, copies: DataFrame, length: int, work: Workspace) -> DataFrame:
    """The pieces of each distinct text, as a table. copies: k1 of texts that stand more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = raw(batch)
            yield pa.RecordBatch.from_pydict({"h": np.concatenate([np.zeros(0, np.int64), *[anchors(own[i:k], length)[0] for i, k in together(own)]])})

    again = work.table(texts.select("text").mapInArrow(count, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    sent = texts.sparkSession.sparkContext.broadcast((bitmap(again, "h", again.count()), bitmap(copies, "k1", copies.count())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, copied = sent.value
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            own, k1, k2 = raw(batch), batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            also, rows = in_bitmap(copied, batch.column("k1").to_numpy()), []
            for i, k in together(own):
                hashes, times, whose = anchors(own[i:k], length)
                found = in_bitmap(known, hashes)
                for x in np.unique(whose[found]).tolist():
                    mine, row = whose == x, i + x
                    if also[row]:
                        if (k1[row], k2[row]) in seen:
                            continue
                        if len(seen) < SEEN:
                            seen.add((k1[row], k2[row]))
                    rows += [(k1[row], k2[row], bool(also[row]), *p) for p in stretches(own[row], length, np.repeat(found[mine], times[mine]))]
                if sum(len(r[6]["at"]) for r in rows) > 16 * PIECE:
                    yield piece_batch(rows)
                    rows = []
            yield piece_batch(rows)

    raws = work.table(texts.mapInArrow(cut, PIECES).withColumn("p", F.monotonically_increasing_id()))
    once = work.table(raws.where("copied").dropDuplicates(["k1", "k2", "first"]))
    return raws.where("not copied").union(once)


def ranked(rows: DataFrame, by: list[str], work: Workspace) -> DataFrame:
    """rows with `by` replaced by `rank`, their place among the distinct values in order; rows whose value is unique are left out."""
    many = work.table(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    places = work.table(many.orderBy(*by).select(*by, F.monotonically_increasing_id().alias("rank")))
    out = work.table(rows.join(places, by).drop(*by))
    work.drop(many)
    work.drop(places)
    return out


def runs(cut: DataFrame, work: Workspace) -> DataFrame:
    """(own, ra, rb): the ranks of the run of chunks of each position that has windows and whose run may be repeated.

    A position is its piece's number and its place in it, as one integer, so that the next ones are the next integers.
    """
    m, deep = F.shiftright("held", 4), F.col("held").bitwiseAND(F.lit(15))
    each = F.transform(F.arrays_zip("m", "deep", "name"), lambda x, i: F.struct((F.shiftleft("p", PLACES) + i).alias("at"), (x["m"] * 16 + x["deep"]).alias("held"), x["name"].alias("name")))
    now = ranked(cut.select(F.inline(each)), ["name"], work)
    found, k = None, 1
    while True:
        # m chunks are 2^k from the first on and 2^k up to the last
        ends = now.where((m >= 1 << k) & (m < 2 << k)).select(F.col("at").alias("own"), F.col("rank").alias("ra"), (F.col("at") + m - (1 << k)).alias("at"))
        ended = work.table(ends.join(now.select("at", F.col("rank").alias("rb")), "at").select("own", "ra", "rb"))
        found = ended if found is None else found.union(ended)
        more = now.where(deep > k)
        if more.isEmpty():
            return found
        following = now.select((F.col("at") - (1 << k)).alias("at"), F.col("rank").alias("next"))
        now, last = ranked(more.withColumnRenamed("rank", "here").join(following, "at"), ["here", "next"], work), now
        work.drop(last)
        k += 1


KEY = ["c1", "c2", "u1", "u2"]


def longs(digests: list[bytes], names: tuple[str, str]) -> dict[str, np.ndarray]:
    """128-bit digests as two bigint columns."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return {n: both[:, i].copy() for i, n in enumerate(names)}


def units(cut: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi, low, c1, c2, u1, u2, left, right): the windows lo to hi of a cut point.

    c1, c2 (the class) stand for the bytes that all of them have, left and right are those beyond, of which the window at s
    has hi + low - s and w - 1 less that many; u1, u2 (the unit) stand for those and their number.
    """
    w = window(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            own = batch.column("own")
            many, flat = own.value_lengths().to_numpy(), own.flatten()
            row = np.repeat(np.arange(batch.num_rows), many)
            j, ra, rb = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("j", "ra", "rb"))
            begins, sizes = batch.column("begin").to_numpy(), batch.column("at").value_lengths().to_numpy()
            i = (np.cumsum(sizes) - sizes)[row] + j
            at, lo, hi, tail, m = (batch.column(c).flatten().to_numpy()[i].astype(np.int64) for c in ("at", "lo", "hi", "tail", "m"))
            texts, classes, kinds, lefts, rights = batch.column("bytes").to_pylist(), [], [], [], []
            first, end, off = at - w + 1, at + length - 2 * w + 2, begins[row].astype(np.int64)
            low = first - hi
            ends = np.stack([first - off, at - off, tail - off, end - off, lo - off, hi + length - off, ra, rb, m, low], axis=1).tolist()
            for r, (f, a, t, e, x, z, p, q, n, short) in zip(row.tolist(), ends, strict=True):
                text = texts[r]
                left, right = text[x:f], text[e:z]
                classes.append(digest(b"%d,%d,%d," % (p, q, n) + text[f:a] + text[t:e]))
                kinds.append(digest(b"%d,%d," % (len(left), short) + left + right))
                lefts.append(left)
                rights.append(right)
            k1, k2 = (batch.column(c).to_numpy()[row] for c in ("k1", "k2"))
            ints = {"lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "low": low.astype(np.int32)}
            yield pa.RecordBatch.from_pydict({"k1": k1, "k2": k2} | ints | longs(classes, ("c1", "c2")) | longs(kinds, ("u1", "u2")) | {"left": pa.array(lefts, pa.binary()), "right": pa.array(rights, pa.binary())})

    place = F.col("own").bitwiseAND(F.lit((1 << PLACES) - 1)).cast("int")
    asked = found.groupBy(F.shiftright("own", PLACES).alias("p")).agg(F.collect_list(F.struct(place.alias("j"), "ra", "rb")).alias("own"))
    held = cut.select("p", "k1", "k2", "begin", "bytes", "at", "m", "tail", "lo", "hi").join(asked, "p")
    return held.mapInArrow(run, "k1 bigint, k2 bigint, lo int, hi int, low int, c1 bigint, c2 bigint, u1 bigint, u2 bigint, left binary, right binary")


def contested(rows: DataFrame, counts: DataFrame, length: int, work: Workspace) -> DataFrame:
    """(the unit, first, last): runs of places among the windows of units that stand once, where a window of another unit is equal."""
    w, spark = window(length), rows.sparkSession
    classes = work.table(counts.groupBy("c1", "c2").agg(F.count("*").alias("units"), F.min("n").alias("fewest")).where("units > 1 and fewest = 1").select("c1", "c2"))
    some = spark.sparkContext.broadcast(bitmap(classes, "c1", classes.count()))

    @F.pandas_udf("boolean")
    def may_be_open(c):
        return pd.Series(in_bitmap(some.value, c.to_numpy(np.int64)))

    # most classes have one unit, and aren't shuffled with their bytes
    near = rows.select(*KEY, "low", "left", "right").where(may_be_open("c1")).join(classes, ["c1", "c2"])
    # each unit once before it meets its count, so that a unit of very many places is no large group
    open_units = work.table(work.table(near.dropDuplicates(KEY)).join(counts, KEY))

    def keys(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
        """The key of each window; with a bitmap, of the windows of single units whose key is in it."""
        for batch in batches:
            for i in range(0, batch.num_rows, PIECE):
                part, digests, owner, place = batch.slice(i, PIECE), [], [], []
                cols = [part.column(c).to_pylist() for c in ("c1", "c2", "left", "right", "low", "n")]
                for row, (c1, c2, left, right, low, n) in enumerate(zip(*cols, strict=True)):
                    if known is not None and n > 1:
                        continue
                    head = b"%d,%d," % (c1, c2)
                    for x in range(low, len(left) + 1):
                        digests.append(xxhash.xxh3_128_digest(head + left[len(left) - x :] + b"%d|" % x + right[: w - 1 - x]))
                        owner.append(row)
                        place.append(x)
                both = longs(digests, ("a", "b"))
                if known is not None:
                    good = np.flatnonzero(in_bitmap(known.value, both["a"]))
                    at = np.array(owner, np.int64)[good]
                    both = {n: v[good] for n, v in both.items()} | {n: part.column(n).take(pa.array(at)) for n in KEY} | {"place": np.array(place, np.int32)[good]}
                yield pa.RecordBatch.from_pydict(both)

    read = open_units.select(*KEY, "left", "right", "low", "n")
    again = work.table(read.mapInArrow(lambda x: keys(x, None), "a bigint, b bigint").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"))
    sent = spark.sparkContext.broadcast(bitmap(again, "a", again.count()))
    hits = read.mapInArrow(lambda x: keys(x, sent), f"a bigint, b bigint, {', '.join(f'{c} bigint' for c in KEY)}, place int").join(again, ["a", "b"])
    places = hits.groupBy(*KEY).agg(F.array_sort(F.collect_list("place")).alias("p"))
    # places of one run differ from their index by the same number
    run = F.transform("p", lambda x, i: F.struct((x - i).alias("run"), x.alias("x")))
    return places.select(*KEY, F.explode(run).alias("r")).groupBy(*KEY, "r.run").agg(F.min("r.x").alias("first"), F.max("r.x").alias("last")).select(*KEY, "first", "last")


def repeated(texts: DataFrame, length: int, work: Workspace) -> DataFrame:
    """(k1, k2, spans): for each distinct text, the ranges (lo, hi) of starts of windows that stand elsewhere as well.

    texts: k1, k2 (two hashes of the text), text.
    """
    copies = work.table(texts.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where((F.col("n") > 1) & (F.col("size") >= length)))
    cut = pieces(texts.where(F.octet_length("text") >= length), copies, length, work)
    rows = work.table(units(cut, runs(cut, work), length))
    counts = work.table(rows.groupBy(*KEY).agg(F.count("*").alias("n")))
    # a table of its own, so that Spark can split the join at a unit that very many places have; null stands for all windows
    whole = counts.where("n > 1").select(*KEY, F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    settled = work.table(whole.union(contested(rows, counts, length, work)))
    at = F.col("hi") + F.col("low")
    spans = rows.select("k1", "k2", "lo", "hi", "low", *KEY).join(settled, KEY).select("k1", "k2", F.coalesce(at - F.col("last"), "lo").alias("lo"), F.coalesce(at - F.col("first"), "hi").alias("hi"))
    copied = copies.select("k1", "k2", F.lit(0).alias("lo"), (F.col("size") - length).alias("hi"))
    return work.table(spans.union(copied).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))


def without(text: bytes, spans: list[dict], length: int) -> tuple[bytes, int, int]:
    """The text without the windows that start in the spans, how many bytes go, and in how many runs."""
    kept, at, runs, gone = [], 0, 0, 0
    for lo, hi in sorted((s["lo"], s["hi"] + length) for s in spans):
        if lo > at or not runs:
            kept.append(text[at:lo])
            runs += 1
            gone += hi - lo
        else:
            gone += max(0, hi - at)
        at = max(at, hi)
    return b"".join([*kept, text[at:]]), gone, runs


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with kept (the bytes that stay), n_bytes, n_removed and n_spans; columns of these names are replaced.

    A byte goes if a string of `length` bytes (40 at least) covers it that starts anywhere else too, in the same document
    or another; matches never cross documents. All occurrences go, the first included. Texts are UTF-8 bytes, and a
    null counts as empty; kept is binary, since a character may lose part of its bytes. Every row is a document of its own,
    whatever its id, so repeated rows are copies of each other. A text shorter than `length` loses nothing. An
    empty table gives no rows.
    """
    if length < 40:
        raise ValueError("length must be 40 or more")
    new = {"kept": "binary", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint"}
    work = Workspace(docs.sparkSession, "suffixes")
    if text in new:
        raise ValueError(f"the text column can't be named {text}")
    rows = docs.drop(*new)
    names = rows.columns
    keys = [F.xxhash64(F.coalesce(text, F.lit(""))), F.xxhash64(F.lit(1), F.coalesce(text, F.lit("")))]
    found = repeated(rows.where(F.col(text).isNotNull()).select(keys[0].alias("k1"), keys[1].alias("k2"), F.col(text).cast("string").alias("text")), length, work)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(found.select("k1"), "k1", found.count()))

    @F.pandas_udf("boolean")
    def may_lose(k):
        return pd.Series(in_bitmap(sent.value, k.to_numpy(np.int64)))

    # only texts that may lose something are shuffled
    marked = rows.withColumns({"__k1": keys[0], "__k2": keys[1]}).withColumn("__hit", may_lose("__k1"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    same = marked.where(~F.col("__hit")).select(*rows.columns, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("kept"), size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"))
    spans = found.withColumnsRenamed({"k1": "__k1", "k2": "__k2", "spans": "__spans"})
    hit = marked.where("__hit").join(spans, ["__k1", "__k2"], "left").select(*rows.columns, "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            own, lost = [t or b"" for t in raw(batch, text)], batch.column("__spans").to_pylist()
            done = [without(t, s or [], length) for t, s in zip(own, lost, strict=True)]
            cols = {c: batch.column(c) for c in names}
            ints = {n: pa.array([d[i] for d in done], pa.int64()) for n, i in (("n_removed", 1), ("n_spans", 2))}
            yield pa.RecordBatch.from_pydict(cols | {"kept": pa.array([d[0] for d in done], pa.binary()), "n_bytes": pa.array(list(map(len, own)), pa.int64())} | ints)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"{k} {v}" for k, v in new.items()])
    return same.union(hit.mapInArrow(run, schema))
