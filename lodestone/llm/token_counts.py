"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A leaf holds up to LEAF pre-tokens with their characters and tokens; inner nodes hold sums of both. An edit finds its
leaves by characters, splits and encodes only the text from the pre-token before it to where old and new boundaries meet
again, and updates the sums on the way up. What lies behind isn't touched: matching from a boundary depends on the text
behind it only.

A tree can be kept as a column, and the next edits start from it: nothing but what they touch is encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.bpe import Codec, codec, send_ranks
from lodestone.llm.common import slices

LEAF = 32
#: Bytes of a pre-token up to which new ones are encoded many at once.
TOGETHER = 32
#: Characters behind a pre-token that the pattern may look at before it ends the pre-token.
CONTEXT = 3
#: A kept tree: characters and tokens of the pre-tokens, and how many of them each leaf has.
TREE = "struct<chars: array<int>, tokens: array<int>, leaves: array<int>>"


@dataclass
class Cut:
    """New pre-tokens, where they begin (leaf, place in it), and the old pre-token that follows them."""

    fresh: list[str]
    leaf: int
    at: int
    until: int
    rest: int


class CountTree:
    """Token counts of one text under edits. Leaves that no edit has touched stay slices of the arrays given."""

    def __init__(self, text: str, codec: Codec, chars: np.ndarray, tokens: np.ndarray, leaves: np.ndarray | None = None):
        self.text, self.codec, self.chars, self.tokens = text, codec, chars, tokens
        if leaves is None:
            leaves = np.diff([*range(0, len(chars), LEAF), len(chars)])
        if not len(leaves):
            leaves = np.zeros(1, np.int64)
        self.ends = np.cumsum(leaves)
        self.begins = self.ends - leaves
        self.n = len(leaves)
        self.changed: dict[int, list[tuple[int, int]]] = {}
        self.size = 1 << (self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        total = np.zeros((len(chars) + 1, 2), np.int64)
        np.cumsum(chars, out=total[1:, 0])
        np.cumsum(tokens, out=total[1:, 1])
        self.sums[self.size : self.size + self.n] = total[self.ends] - total[self.begins]
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def leaf(self, i: int) -> list[tuple[int, int]]:
        """(characters, tokens) of the pre-tokens of a leaf."""
        if i not in self.changed:
            a, b = self.begins[i], self.ends[i]
            self.changed[i] = list(zip(self.chars[a:b].tolist(), self.tokens[a:b].tolist(), strict=True))
        return self.changed[i]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters and tokens of all pre-tokens, and the number of them in each leaf, as they are now."""
        chars, tokens, sizes, at = [], [], (self.ends - self.begins).astype(np.int32), 0
        for i in sorted(self.changed):
            own = np.array(self.changed[i], np.int32).reshape(-1, 2)
            chars += [self.chars[at : self.begins[i]], own[:, 0]]
            tokens += [self.tokens[at : self.begins[i]], own[:, 1]]
            sizes[i], at = len(own), self.ends[i]
        return np.concatenate([*chars, self.chars[at:]]), np.concatenate([*tokens, self.tokens[at:]]), sizes

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at `place` (the last one, behind the end), and its first character."""
        i, begin, chars = 1, 0, self.sums[:, 0]
        while i < self.size:
            i *= 2
            if place - begin >= chars[i] and chars[i + 1]:
                begin += int(chars[i])
                i += 1
        return i - self.size, begin

    def tokens_before(self, place: int) -> int:
        """Tokens of the pre-tokens that end at `place` or before."""
        i, begin, n = 1, 0, 0
        while i < self.size:
            i *= 2
            if place - begin >= self.sums[i, 0]:
                begin += int(self.sums[i, 0])
                n += int(self.sums[i, 1])
                i += 1
        for c, t in self.leaf(i - self.size) if i - self.size < self.n else []:
            if begin + c > place:
                break
            begin, n = begin + c, n + t
        return n

    def set_leaf(self, i: int, leaf: list[tuple[int, int]]) -> None:
        self.changed[i] = leaf
        i += self.size
        more = np.array([sum(c for c, _ in leaf), sum(t for _, t in leaf)]) - self.sums[i]
        while i:
            self.sums[i] += more
            i //= 2

    def edit(self, start: int, length: int, insert: str) -> int:
        """Replace `length` characters from `start` (clipped to the text) by `insert`; how many pre-tokens were encoded anew."""
        return self.put(self.cut(start, length, insert))

    def cut(self, start: int, length: int, insert: str) -> Cut | None:
        """Change the text, and split it anew around the edit; the sums wait for `put`."""
        start = min(max(start, 0), len(self.text))
        length = min(max(length, 0), len(self.text) - start)
        if not length and not insert:
            return None
        i, place = self.leaf_at(max(0, start - CONTEXT))
        first, at = self.leaf(i), 0
        while at < len(first) and place + first[at][0] <= start - CONTEXT:
            place += first[at][0]
            at += 1
        self.text = self.text[:start] + insert + self.text[start + length :]
        shift, edge = len(insert) - length, start + len(insert)
        j, k, old, fresh = i, at, place, []  # the next old pre-token, and where it begins in the old text
        for x in self.codec.pieces_from(self.text, place):
            while place >= edge and old < place - shift and j < self.n:
                if k < len(self.leaf(j)):
                    old += self.leaf(j)[k][0]
                    k += 1
                else:
                    j, k = j + 1, 0
            if place >= edge and old == place - shift:
                break
            fresh.append(x)
            place += len(x)
        else:
            j, k = self.n, 0
        return Cut(fresh, i, at, j, k)

    def put(self, cut: Cut | None) -> int:
        """Put the pre-tokens of a cut in the place of those it replaces; how many they are."""
        if not cut:
            return 0
        i, j = cut.leaf, cut.until
        behind = self.leaf(j)[cut.rest :] if j < self.n else []
        for x in range(i + 1, min(j + 1, self.n)):
            self.set_leaf(x, behind if x == j else [])
        self.set_leaf(i, self.leaf(i)[: cut.at] + self.codec.measured(cut.fresh) + (behind if i == j else []))
        if len(self.changed[i]) > 16 * LEAF:
            chars, tokens, _ = self.arrays()
            self.__init__(self.text, self.codec, chars, tokens)
        return len(cut.fresh)


def flat(lists: list[np.ndarray]) -> pa.Array:
    """Rows of integers as array<int>."""
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32)))


def kept_trees(column: pa.StructArray) -> list[tuple[np.ndarray, ...] | None]:
    """Characters, tokens and leaf sizes of each kept tree; None where the column is null."""
    parts = [[np.asarray(x, np.int32) for x in column.field(k).fill_null([]).to_numpy(zero_copy_only=False)] for k in range(3)]
    return [x if here else None for here, x in zip(column.is_valid().to_pylist(), zip(*parts, strict=True), strict=True)]


def count_with_edits(docs: DataFrame, ranks_path: str, pattern: str, edits: str = "edits", text: str = "text", tree: str | None = None, keep: str | None = None) -> DataFrame:
    """The rows of docs with n_tokens, n_tokens_edited, n_reencoded and n_pretokens, in one narrow stage.

    `edits` is array<struct<start int, length int, insert string>>: places in characters of the text as the edits
    before have left it; places beyond the text are clipped, null edits and null fields count as nothing. A null text
    is empty. Columns of these names are replaced. n_reencoded are the pre-tokens encoded anew by all edits; repeated
    rows are counted each.

    keep: a column that gets the edited text's tree; `text` becomes the edited text then. tree: a column that an earlier
    call has kept; its rows are not encoded again, but for what the edits touch. Null trees are built from the text.
    """
    name = send_ranks(docs, ranks_path)
    new = ["n_tokens", "n_tokens_edited", "n_reencoded", "n_pretokens", *([keep] if keep else [])]
    kept = docs.drop(*(set(new) - {text, edits, tree}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, pattern, TOGETHER)
        for batch in slices(batches, text):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            held = kept_trees(batch.column(tree)) if tree else [None] * len(texts)
            fresh = iter(c.measure([x for x, own in zip(texts, held, strict=True) if own is None]))
            trees = [CountTree(x, c, *(own or next(fresh))) for x, own in zip(texts, held, strict=True)]
            values = np.array([(t.total, 0, 0, t.ends[-1]) for t in trees], np.int64).reshape(-1, 4)
            todo = [[e for e in x or [] if e] for x in batch.column(edits).to_pylist()]
            for step in range(max(map(len, todo), default=0)):  # one edit of each row at a time, so that their pre-tokens are encoded together
                cuts = {i: trees[i].cut(x[step]["start"] or 0, x[step]["length"] or 0, x[step]["insert"] or "") for i, x in enumerate(todo) if step < len(x)}
                c.learn({x for cut in cuts.values() if cut for x in cut.fresh}.difference(c.known))
                for i, cut in cuts.items():
                    values[i, 2] += trees[i].put(cut)
            values[:, 1] = [t.total for t in trees]
            cols = {n: batch.column(n) for n in batch.schema.names if n not in new}
            cols |= {n: pa.array(values[:, i]) for i, n in enumerate(new[:4])}
            if keep:
                parts = [flat(x) for x in zip(*(t.arrays() for t in trees), strict=True)] or [flat([])] * 3
                cols[keep] = pa.StructArray.from_arrays(parts, ["chars", "tokens", "leaves"])
                cols[text] = pa.array([t.text for t in trees], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name not in new] + [f"`{n}` {TREE if n == keep else 'bigint'}" for n in new])
    return kept.mapInArrow(run, schema)
