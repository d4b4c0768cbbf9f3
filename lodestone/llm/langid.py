"""Language identification by the nearest of several clustered centroids per language.

A text is a TF-IDF vector of hashed byte bigrams and trigrams of its letters, normalised to length 1. Each language
has up to CENTROIDS centroids, found by spherical k-means on a bounded sample of labelled rows. A text gets the
language of the centroid with the highest cosine, and is rejected if that cosine is below the language's floor, which
comes from the distances of the sample's own rows. The model has at most CENTROIDS times 16 KB a language and is broadcast
in blocks; prediction is one narrow stage over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, slices
from lodestone.llm.sketch import bitmap, in_bitmap

#: Length of a vector.
DIM = 1 << 13
#: Labelled rows that the classifier is fitted on, at most, per language, and the bytes of text after which no more are taken.
SAMPLE, SAMPLE_BYTES = 600, 16 << 20
#: Languages up to which their counts are broadcast.
FEW = 10_000
#: Bytes of centroids that are broadcast at a time; more languages are compared block after block.
MODEL_BYTES = 64 << 20
#: Centroids per language, rounds of k-means, and the share of a language's sample that a centroid must hold.
CENTROIDS, ROUNDS, SHARE = 4, 10, 0.1
#: A text is rejected below this part of the lowest cosine that a sample row of the language has; texts of a language that
#: wasn't learned reach less. The fewer n-grams a text has, the lower its cosines are: below FULL n-grams the floor falls
#: with the square root of their number.
FLOOR, FULL = 0.5, 500
#: Bytes of a text whose n-grams are counted at a time.
BLOCK = 1 << 20

LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram stands in the text: its letters in lower case, one space for anything between."""
    flat = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" ", np.uint8)
    out = np.zeros(DIM, np.int64)
    for i in range(0, max(1, len(flat) - 2), BLOCK):
        part = flat[i : i + BLOCK + 2].astype(np.uint32)
        two = part[:-1] << np.uint32(8) | part[1:]
        three = two[:-1] << np.uint32(8) | part[2:]
        for grams in (two[: BLOCK], three):
            out += np.bincount(grams * np.uint32(2654435761) >> np.uint32(19), minlength=DIM)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF vectors, one row a text, and how many n-grams each text has."""
    out, sizes = np.empty((len(texts), DIM), np.float32), np.zeros(len(texts))
    for i, text in enumerate(texts):
        counts = gram_counts(text)
        sizes[i] = counts.sum()
        seen = np.nonzero(counts)[0]
        out[i] = 0
        out[i, seen] = (1 + np.log(counts[seen])) * idf[seen]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), sizes


def cluster(x: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, float]:
    """Centroids of unit vectors by spherical k-means from the farthest points, and the lowest cosine of a row to its nearest.

    Centroids that hold less than SHARE of the rows go: they stand for mislabelled or odd rows, which then don't count
    for the lowest cosine either.
    """
    def unit(v):
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)

    heart = [unit(x.mean(axis=0))]
    while len(heart) < min(k, len(x)):
        heart.append(x[np.argmin(np.max(x @ np.array(heart).T, axis=1))])
    c = np.array(heart)
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([unit(x[own == j].mean(axis=0)) if (own == j).any() else c[j] for j in range(len(c))])
    size = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    keep = size >= min(size.max(), SHARE * len(x))
    own = np.argmax(x @ c.T, axis=1)
    lowest = (x @ c.T).max(axis=1)[keep[own]].min()
    return c[keep], float(lowest)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    floors: np.ndarray  # of each centroid

    def blocks(self) -> Iterator[LanguageModel]:
        """The model in parts of MODEL_BYTES at most; one part if nothing was learned."""
        n = max(1, MODEL_BYTES // (2 * DIM))
        for i in range(0, max(1, len(self.langs)), n):
            yield LanguageModel(self.idf, self.centroids[i : i + n], self.langs[i : i + n], self.floors[i : i + n])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine (0 to 1) and whether the text is rejected. Without a letter: und, 0, rejected."""
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        lang, score, out = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        centroids = self.centroids.astype(np.float32).T
        for i in range(0, len(known), 64):
            some = known[i : i + 64]
            x, sizes = vectors([texts[k] for k in some], self.idf)
            cosine = x @ centroids
            best = cosine.argmax(axis=1)
            floors = self.floors[best] * np.minimum(1, np.sqrt(sizes / FULL))
            for k, b, c, floor in zip(some, best.tolist(), cosine.max(axis=1).tolist(), floors.tolist(), strict=True):
                lang[k], score[k], out[k] = self.langs[b], min(1.0, max(0.0, c)), c < floor
        return lang, score, out


def sample_rows(rows: DataFrame, per_lang: int = SAMPLE, most: int = SAMPLE_BYTES) -> DataFrame:
    """Distinct texts of each language: the per_lang ones of least hash, and none after the first `most` bytes.

    Texts are counted and drawn by hash, so a language of copies gives as many texts as it has; only the chosen texts are
    shuffled, once a task. About four times per_lang hashes a language are numbered.
    """
    work = Workspace(rows.sparkSession, "languages")
    hashed = rows.withColumn("h", F.xxhash64("text", F.lit(7)))
    texts = work.table(hashed.select("lang", "h").distinct())
    counts = work.table(texts.groupBy("lang").agg(F.count("*").alias("n")))
    if counts.limit(FEW + 1).count() <= FEW:
        counts = F.broadcast(counts)
    draw = F.shiftrightunsigned("h", 40) / (1 << 24)
    order = Window.partitionBy("lang").orderBy("draw", "h")
    drawn = texts.withColumn("draw", draw).join(counts, "lang").where(F.col("draw") * F.col("n") < 4 * per_lang)
    chosen = work.table(drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).select("lang", "h", "draw"))
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(chosen, "h", chosen.count()))

    @F.pandas_udf("boolean")
    def may_be_chosen(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(sent.value, h.to_numpy(np.int64)))

    first = hashed.where(may_be_chosen("h")).join(chosen, ["lang", "h"]).select("text", "lang", "draw").distinct()
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("draw", "text").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).select("text", "lang")


def fit(rows: DataFrame, per_lang: int = SAMPLE) -> LanguageModel:
    """Fit on the labelled rows (columns text, lang); rows whose text is null or has no letter, or whose lang is null, are left out.

    Every language is learned. Only sums and centroids come to the driver, as bytes.
    """
    work = Workspace(rows.sparkSession, "langid")
    held = work.table(sample_rows(rows.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull()).select("text", "lang"), per_lang))

    def frequencies(group: pd.DataFrame) -> pd.DataFrame:
        seen = sum((gram_counts(t) > 0).astype(np.int64) for t in group["text"])
        return pd.DataFrame({"n": [len(group)], "seen": [seen.astype(np.int32).tobytes()]})

    spread = held.groupBy("lang").applyInPandas(frequencies, "n bigint, seen binary").toLocalIterator()
    total, seen = 0, np.zeros(DIM, np.int64)
    for r in spread:
        total, seen = total + r.n, seen + np.frombuffer(r.seen, np.int32)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        c, lowest = cluster(vectors(group.sort_values("text")["text"].tolist(), idf)[0])
        return pd.DataFrame({"lang": group["lang"].iloc[0], "floor": FLOOR * lowest, "centroid": [v.astype(np.float16).tobytes() for v in c]})

    found = sorted((r.lang, r.floor, bytes(r.centroid)) for r in held.groupBy("lang").applyInPandas(centroids, "lang string, floor double, centroid binary").toLocalIterator())
    return LanguageModel(idf, np.frombuffer(b"".join(c for *_, c in found), np.float16).reshape(len(found), DIM), [x for x, *_ in found], np.array([f for _, f, _ in found]))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; columns of these names are replaced.

    A text that is null or has no letter, or any text if no language was learned, is und with score 0, and rejected.
    """
    new = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    out = docs.drop(*(set(new) - {text}))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields] + [f"{k} {v}" for k, v in new.items()])
    for part in model.blocks():
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                found = list(zip(*sent.value.predict(batch.column(text).to_pylist()), strict=True))
                cols = {n: batch.column(n) for n in batch.schema.names if n not in new}
                if "score" in batch.schema.names:  # from the blocks before: the higher cosine stays, the first of equals
                    before = zip(*(batch.column(n).to_pylist() for n in new), strict=True)
                    found = [x if x[1] > y[1] or y[0] == "und" else y for x, y in zip(found, before, strict=True)]
                values = zip(*found, strict=True) if found else [[]] * 3
                yield pa.RecordBatch.from_pydict(cols | {n: pa.array(list(v), k) for (n, v), k in zip(zip(new, values, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)})

        out = out.mapInArrow(run, schema)
    return out


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
