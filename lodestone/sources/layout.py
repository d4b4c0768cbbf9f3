"""Positioned words and characters of document pages: lines, margins and names beside their anchors (W-06, W-07, E-20, S-14, S-16)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points: words this near in height to a line's first word are on that line (fixed value).
SAME_LINE = 2.0
# Costs of an assignment in points, and the most lines that a name takes.
SKIPPED, EMPTY, BROKEN, MOST_LINES = 25.0, 200.0, 50.0, 6
#: Numbers worked on at a time.
BLOCK = 1 << 20
CONTINUES = re.compile(r"^(?:private|limited|pvt\.?|ltd\.?|llp|\(opc\))(?:\s|$)", re.IGNORECASE)
UNFINISHED = re.compile(r"(?:\b(?:private|pvt\.?|and|of|&)|-)$", re.IGNORECASE)


def changes(batch: pa.RecordBatch, key: tuple | None) -> np.ndarray:
    """Whether each row's (doc, page) is another one than the row's before, the first row's another than `key`."""
    new = np.zeros(batch.num_rows, bool)
    for name in ("doc", "page"):
        column = batch.column(name)
        now, before = column.slice(1), column.slice(0, max(0, len(column) - 1))
        other = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
        new[1:] |= other | (now.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
    if len(new):
        new[0] = key != (batch.column("doc")[0].as_py(), batch.column("page")[0].as_py())
    return new


def line_starts(top: np.ndarray, new: np.ndarray, first: float) -> np.ndarray:
    """The rows at which a line begins; heights grow within a page. first: of the line that is open before the first row."""
    with np.errstate(invalid="ignore"):
        begins = new | (np.diff(top, prepend=first) > SAME_LINE)
        # only stretches without a gap that are higher than a line are walked through
        at = np.nonzero(begins)[0]
        at = at if len(at) and at[0] == 0 else np.append(0, at)
        firsts = top[at].copy()
        if not begins[0]:
            firsts[0] = first
        high = np.nonzero(np.fmax.reduceat(top, at) - firsts > SAME_LINE)[0]
    ends = np.append(at[1:], len(top))
    for k in high.tolist():
        first = float(firsts[k])
        for i, x in enumerate(top[at[k] : ends[k]].tolist(), int(at[k])):
            if abs(x - first) > SAME_LINE:
                begins[i], first = True, x
    return np.nonzero(begins)[0]


def read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines (doc, page, line, top, bottom, text) of words that are sorted by page and height."""
    key, number, first, held = None, -1, np.nan, []

    def closed(batch: pa.RecordBatch, starts: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        """The lines that begin at the rows `starts`, each with its words by x0."""
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
        x0, top, bottom = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "top", "bottom"))
        order = np.lexsort((x0, of))
        words = batch.column("text").take(pa.array(order))
        there = words.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.bincount(of[there], minlength=len(starts))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), words.drop_null()), " ")
        docs, pages = (batch.column(c).take(pa.array(starts)) for c in ("doc", "page"))
        columns = [docs, pages, pa.array(numbers, pa.int32()), pa.array(np.fmin.reduceat(top, starts)), pa.array(np.fmax.reduceat(bottom, starts)), texts]
        return pa.RecordBatch.from_arrays(columns, ["doc", "page", "line", "top", "bottom", "text"])

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        new, top = changes(batch, key), batch.column("top").to_numpy(zero_copy_only=False)
        starts = line_starts(top, new, first)
        key = (batch.column("doc")[-1].as_py(), batch.column("page")[-1].as_py())
        if not len(starts):
            held.append(batch)
            continue
        # lines are counted from the last start that is a page's
        places = np.arange(len(starts))
        of_page = np.maximum.accumulate(np.where(new[starts], places, -1))
        numbers = np.where(of_page < 0, number + 1 + places, places - of_page)
        if held:  # the line left open ends before the first start
            whole = joined([*held, batch.slice(0, starts[0])] if starts[0] else held)
            yield closed(whole, np.zeros(1, np.int64), np.array([number]))
        if len(starts) > 1:
            yield closed(batch.slice(starts[0], starts[-1] - starts[0]), starts[:-1] - starts[0], numbers[:-1])
        held, number, first = [batch.slice(starts[-1])], int(numbers[-1]), float(top[starts[-1]])
    if held:
        yield closed(joined(held), np.zeros(1, np.int64), np.array([number]))


def words_by_page(words: DataFrame) -> DataFrame:
    """The words of each page in one task, by height."""
    kept = words.select(F.col("doc").cast("string").alias("doc"), F.col("page").cast("int").alias("page"), *[F.col(c).cast("double").alias(c) for c in ("top", "x0", "bottom")], "text")
    return kept.repartition("doc", "page").sortWithinPartitions(*[F.asc_nulls_last(c) for c in ("doc", "page", "top", "x0", "bottom", "text")])


def page_lines(words: DataFrame) -> DataFrame:
    """(doc, page, line, top, bottom, text) of positioned words (doc, page, text, x0, x1, top, bottom).

    A line begins where a word's top is further from the line's first word than SAME_LINE. The words are sorted by page and
    height and read in one pass, which holds a batch and the words of the line that is open.
    """
    return words_by_page(words).mapInArrow(read_lines, "doc string, page int, line int, top double, bottom double, text string")


def margin_names(chars: DataFrame, margin: float = 120.0, pitch: float = 6.0, gap: float = 1.5) -> DataFrame:
    """(doc, page, name): characters (doc, page, x0, top, bottom, ch) set upwards in the left margin, column by column."""
    column = F.round(F.col("x0") / pitch).cast("int")
    up = Window.partitionBy("doc", "page", "column").orderBy(F.desc("top"), "x0")
    held = chars.where(F.col("x0") < margin).withColumn("column", column)
    held = held.withColumn("place", F.row_number().over(up)).withColumn("space", F.lag("top").over(up) - F.col("bottom") > gap)
    piece = F.concat(F.when(F.col("space"), " ").otherwise(""), "ch")
    columns = held.groupBy("doc", "page", "column").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", piece.alias("p"))))["p"], "").alias("text"))
    names = columns.groupBy("doc", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("column", "text")))["text"], " ").alias("name"))
    return names.withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " ")))


def misfit(lines: list[tuple], anchors: list[tuple], i: int, k: int, j: int) -> float:
    """How badly lines i to k (top, bottom, text) fit anchor j (top, bottom); `misfits` works it out for many."""
    if i == k:
        return EMPTY
    centre = [(a + b) / 2 for a, b in anchors]
    top, bottom = lines[i][0], lines[k - 1][1]
    cost = min(abs((top + bottom) / 2 - centre[j]), abs(top - anchors[j][0]))
    for a, b, _ in lines[i:k]:
        away = [abs((a + b) / 2 - c) for c in centre]
        cost += max(0.0, away[j] - min(away[:j] + away[j + 1 :], default=away[j]))
    return cost + BROKEN * (bool(CONTINUES.match(lines[i][2])) + bool(UNFINISHED.search(lines[k - 1][2])))


def misfits(lines: list[tuple], anchors: list[tuple], js: slice) -> np.ndarray:
    """[line, k, anchor]: how badly the k lines (top, bottom, text) from a line on fit each anchor (top, bottom) of `js`; without
    end where the page has fewer lines."""
    n = len(lines)
    top, bottom = (np.array([x[c] for x in lines], float) for c in (0, 1))
    middle, centre = (top + bottom) / 2, np.array([(a + b) / 2 for a, b in anchors])
    near, head = centre[js], np.array([a for a, _ in anchors])[js]
    # an anchor's distance beyond that of the nearest other one
    further = np.zeros((n, len(near)))
    step = max(1, BLOCK // len(anchors))
    for i in range(0, n if len(anchors) > 1 else 0, step):
        away = np.abs(middle[i : i + step, None] - centre)
        best, (low, second) = away.argmin(1), np.partition(away, 1, axis=1)[:, :2].T
        other = np.where(np.arange(len(anchors))[js] == best[:, None], second[:, None], low[:, None])
        further[i : i + step] = np.fmax(0.0, away[:, js] - other)
    broken = np.array([bool(CONTINUES.match(x[2] or "")) for x in lines], int), np.array([bool(UNFINISHED.search(x[2] or "")) for x in lines], int)
    out = np.full((n + 1, MOST_LINES + 1, len(near)), np.inf)
    out[:, 0] = EMPTY
    for k in range(1, min(n, MOST_LINES) + 1):
        m = n - k + 1
        cost = np.minimum(np.abs(((top[:m] + bottom[k - 1 :]) / 2)[:, None] - near), np.abs(top[:m, None] - head))
        for i in range(k):
            cost = cost + further[i : i + m]
        out[:m, k] = cost + (BROKEN * (broken[0][:m] + broken[1][k - 1 :]))[:, None]
    return out


def assign(lines: list[tuple], anchors: list[tuple]) -> list[tuple[int, int]]:
    """The run of lines, as (from, to), of each anchor: in order, lines may be left out, at the least total cost.

    Anchor by anchor from the last one, best[i] is the least cost of the lines from i on and the anchors from this one on.
    Of equal costs the fewest lines count, and leaving a line out counts last.
    """
    n, m = len(lines), len(anchors)
    best = np.append(SKIPPED * (n - np.arange(n + 1)), np.full(MOST_LINES, np.inf))
    ahead = np.arange(n + 1)[:, None] + np.arange(MOST_LINES + 1)
    taken = np.zeros((m, n + 1), np.int8)  # how many lines anchor j takes at line i, -1 to leave line i out
    width = max(1, BLOCK // ((n + 1) * (MOST_LINES + 1)))
    for stop in range(m, 0, -width):
        start = max(0, stop - width)
        costs = misfits(lines, anchors, slice(start, stop))
        for j in range(stop - 1, start - 1, -1):
            total = costs[:, :, j - start] + best[ahead]
            take = total.argmin(1)
            least, skipped = total[np.arange(n + 1), take].tolist(), []
            for i in range(n - 1, -1, -1):
                if SKIPPED + least[i + 1] < least[i]:
                    least[i] = SKIPPED + least[i + 1]
                    skipped.append(i)
            take[skipped] = -1
            taken[j], best[: n + 1] = take, least
    runs, i = [], 0
    for j in range(m):
        while taken[j, i] < 0:
            i += 1
        runs.append((i, i + int(taken[j, i])))
        i = runs[-1][1]
    return runs


def assign_pages(pages: list[tuple]) -> list[list[tuple[int, int]]]:
    """`assign` for pages (doc, page, lines, anchors) that have as many lines each and as many anchors each, worked out together."""
    n, m, count = len(pages[0][2]), len(pages[0][3]), len(pages)
    if count == 1 or not n:
        return [assign(lines, anchors) for _, _, lines, anchors in pages]
    top, bottom = (np.array([[x[c] for x in lines] for _, _, lines, _ in pages], float) for c in (0, 1))
    head, foot = (np.array([[x[c] for x in anchors] for _, _, _, anchors in pages], float) for c in (0, 1))
    middle, near = (top + bottom) / 2, ((head + foot) / 2)[:, None]
    further = np.zeros((count, n, m))
    if m > 1:
        away = np.abs(middle[:, :, None] - near)
        best, least = away.argmin(2), np.partition(away, 1, axis=2)
        other = np.where(np.arange(m) == best[:, :, None], least[:, :, 1:2], least[:, :, :1])
        further = np.fmax(0.0, away - other)
    begins = np.array([[bool(CONTINUES.match(x[2] or "")) for x in lines] for _, _, lines, _ in pages], int)
    # what makes a line unfinished is in its last ten letters
    ends = np.array([[bool(UNFINISHED.search((x[2] or "")[-10:])) for x in lines] for _, _, lines, _ in pages], int)
    costs = np.full((count, n + 1, MOST_LINES + 1, m), np.inf)
    costs[:, :, 0] = EMPTY
    for k in range(1, min(n, MOST_LINES) + 1):
        w = n - k + 1
        cost = np.minimum(np.abs(((top[:, :w] + bottom[:, k - 1 :]) / 2)[:, :, None] - near), np.abs(top[:, :w, None] - head[:, None]))
        for i in range(k):
            cost = cost + further[:, i : i + w]
        costs[:, :w, k] = cost + (BROKEN * (begins[:, :w] + ends[:, k - 1 :]))[:, :, None]
    costs = np.ascontiguousarray(costs.transpose(3, 1, 2, 0))  # [anchor, line, lines taken, page]
    best = np.repeat(np.append(SKIPPED * (n - np.arange(n + 1)), np.full(MOST_LINES, np.inf))[:, None], count, axis=1)
    ahead, taken = np.arange(n + 1)[:, None] + np.arange(MOST_LINES + 1), np.zeros((m, n + 1, count), np.int8)
    for j in range(m - 1, -1, -1):
        total = costs[j] + best[ahead]
        take, least = total.argmin(1), total.min(1)
        for i in range(n - 1, -1, -1):
            skip = SKIPPED + least[i + 1]
            less = skip < least[i]
            if less.any():
                least[i][less], take[i][less] = skip[less], -1
        taken[j], best[: n + 1] = take, least
    runs, at, page = np.zeros((m, 2, count), int), np.zeros(count, int), np.arange(count)
    for j in range(m):
        while (skip := taken[j, at, page] < 0).any():
            at = at + skip
        runs[j, 0], runs[j, 1] = at, at + taken[j, at, page]
        at = runs[j, 1]
    return [list(map(tuple, x)) for x in runs.transpose(2, 0, 1).tolist()]


def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, page, anchor, name) of rows (doc, page, anchor, top, bottom, text) sorted by page: its lines, then its anchors.

    Pages of as many lines and anchors are worked out together; all that are held have at most BLOCK costs, or are one page.
    """
    names = pa.schema([("doc", pa.string()), ("page", pa.int32()), ("anchor", pa.int32()), ("name", pa.string())])
    held: dict[tuple[int, int], list[tuple]] = {}
    open_page, size = None, 0

    def dealt() -> Iterator[pa.RecordBatch]:
        out = []
        for pages in held.values():
            for (doc, page, lines, _), runs in zip(pages, assign_pages(pages), strict=True):
                out += [(doc, page, j, " ".join([x[2] for x in lines[i:k] if x[2] is not None])) for j, (i, k) in enumerate(runs)]
        held.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), names, strict=True)], schema=names)

    def closed() -> int:
        _, _, lines, anchors = open_page
        if not anchors:
            return 0
        held.setdefault((len(lines), len(anchors)), []).append(open_page)
        return (len(lines) + 1) * (MOST_LINES + 1) * len(anchors)

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.nonzero(changes(batch, open_page and open_page[:2]))[0].tolist()
        docs, pages = (batch.column(c).take(pa.array(starts, pa.int64())).to_pylist() for c in ("doc", "page"))
        top, bottom, text, anchor = (batch.column(c).to_pylist() for c in ("top", "bottom", "text", "anchor"))
        rows = list(zip(top, bottom, text, strict=True))
        for i, k, doc, page in zip([0, *starts], [*starts, batch.num_rows], [None, *docs], [None, *pages], strict=True):
            # the rows before the first start go on with the page that is open
            if i or starts[:1] == [0] and k:
                if open_page:
                    size += closed()
                    if size > BLOCK:
                        yield from dealt()
                        size = 0
                open_page = (doc, page, [], [])
            if k > i:
                flags = anchor[i:k]
                n = flags.index(True) if True in flags else k - i
                if all(flags[n:]):
                    open_page[2].extend(rows[i : i + n])
                    open_page[3].extend([x[:2] for x in rows[i + n : k]])
                else:
                    open_page[2].extend([x for x, f in zip(rows[i:k], flags, strict=True) if not f])
                    open_page[3].extend([x[:2] for x, f in zip(rows[i:k], flags, strict=True) if f])
    if open_page:
        closed()
    yield from dealt()


DEALT = "doc string, page int, anchor int, name string"


def anchored_names(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc, page, anchor, name): the lines (doc, page, top, bottom, text) dealt to the anchors (doc, page, top, bottom) of their page.

    Lines and anchors are sorted by page and read in one pass, which holds some pages and a batch.
    """

    def rows(of: DataFrame, anchor: bool, text: Column) -> DataFrame:
        return of.select(F.col("doc").cast("string").alias("doc"), F.col("page").cast("int").alias("page"), F.lit(anchor).alias("anchor"), F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"), text.alias("text"))

    both = rows(lines, False, F.col("text")).union(rows(anchors, True, F.lit(None).cast("string")))
    ordered = both.repartition("doc", "page").sortWithinPartitions(*[F.asc_nulls_last(c) for c in ("doc", "page", "anchor", "top", "bottom", "text")])
    return ordered.mapInArrow(deal, DEALT)


def names_of_words(words: DataFrame, anchors: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """`anchored_names` of `page_lines` where the anchors are some of the lines: those of a batch of lines that `anchors` tells.

    Words are sorted by page once, and their lines are dealt as they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flagged() -> Iterator[pa.RecordBatch]:
            for lines in read_lines(batches):
                some = np.asarray(anchors(lines), bool)
                rows = np.repeat(np.arange(lines.num_rows), 1 + some)
                flags = np.diff(rows, prepend=-1) == 0
                yield lines.select(["doc", "page", "top", "bottom", "text"]).take(pa.array(rows)).append_column("anchor", pa.array(flags))

        return deal(flagged())

    return words_by_page(words).mapInArrow(run, DEALT)
