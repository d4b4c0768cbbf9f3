"""Placing records in a two-level taxonomy by a classifier that can be exchanged (E-13, J-15, A.20).

A classifier answers (id, sector_id, subsector_id, project_type, note). The keyword form needs no model: weighted terms of
one or more words stand under the taxonomy's projects, and a text's terms choose a sector, then a sub-sector within it, then
a project within that; each step may answer none. `classify` asks a classifier only for records that neither a hand-made
override nor the cache answers.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.link import cache_probe
from lodestone.operators.steps import valid_placements

ANSWER = ("sector_id", "subsector_id", "project_type", "note")
#: Words of a term at most, and terms up to which their table is broadcast.
MOST_WORDS, MOST_BROADCAST = 6, 200_000


class Classifier(Protocol):
    def place(self, rows: DataFrame) -> DataFrame:
        """(id, sector_id, subsector_id, project_type, note) of rows (id, text); nulls where there is no answer."""


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def runs_of(words: Column, n: int) -> Column:
    """Each run of n words, joined by a space, once."""
    if n == 1:
        return F.array_distinct(words)
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.array_distinct(F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>")))


@dataclass
class KeywordClassifier:
    """terms: sector_id, subsector_id, project_type (or null), term, weight (a whole number).

    A term counts once however often a text has it, under every place it stands for. A sector needs a score of `least`
    and must lead the next one by `margin`, else the answer is none; a sub-sector within it likewise, of those with a
    score; a project needs a term of its own. Equal scores go to the smaller id. Terms with no word match nothing.
    """

    terms: DataFrame
    least: int = 1
    margin: int = 1

    def matches(self, rows: DataFrame) -> DataFrame:
        """(id, sector_id, subsector_id, project_type, term, weight) of each term that a text has."""
        terms = self.terms.withColumn("term", F.array_join(words_of(F.col("term")), " ")).where("term <> ''").distinct()
        widths = sorted(r.n for r in terms.select(F.size(F.split("term", " ")).alias("n")).distinct().limit(MOST_WORDS + 1).collect())
        if widths and widths[-1] > MOST_WORDS:
            raise ValueError(f"a term has more than {MOST_WORDS} words")
        if terms.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
            terms = F.broadcast(terms)  # so that only words that are terms are shuffled
        words = rows.select("id", words_of(F.col("text")).alias("words"))
        runs = F.flatten(F.array(*[runs_of(F.col("words"), n) for n in widths])) if widths else F.array().cast("array<string>")
        return words.select("id", F.explode(runs).alias("term")).join(terms, "term")

    def clear(self, options: Column) -> Column:
        """The first of some (minus score, ...) in order, if it is clear of the second."""
        first, second = F.get(options, F.lit(0)), F.get(options, F.lit(1))
        return F.when((-first["minus"] >= self.least) & (second.isNull() | (second["minus"] - first["minus"] >= self.margin)), first)

    def place(self, rows: DataFrame) -> DataFrame:
        """(id, sector_id, subsector_id, project_type, note) of every row; the note names the terms of the sub-sector."""
        # dealt by id once; the sums below need no further shuffle. Lists are as long as the taxonomy at most
        hits = self.matches(rows).repartition("id")
        projects = hits.groupBy("id", "sector_id", "subsector_id", "project_type").agg(F.sum("weight").alias("score"), F.array_sort(F.collect_set("term")).alias("terms"))
        own = F.when(F.col("project_type").isNotNull(), F.struct((-F.col("score")).alias("minus"), "project_type"))
        subs = projects.groupBy("id", "sector_id", "subsector_id").agg(F.sum("score").alias("score"), F.min(own).alias("project"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
        option = F.struct((-F.col("score")).alias("minus"), "subsector_id", F.col("project.project_type").alias("project_type"), "terms")
        sectors = subs.groupBy("id", "sector_id").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(option)).alias("subs"))
        best = sectors.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "sector_id", "subs"))).alias("sectors"))
        chosen = best.select("id", self.clear(F.col("sectors")).alias("s")).withColumn("u", self.clear(F.col("s.subs")))
        note = F.when(F.col("u").isNotNull(), F.array_join(F.slice("u.terms", 1, 5), ", "))
        found = chosen.select("id", "s.sector_id", "u.subsector_id", "u.project_type", note.alias("note"))
        return rows.select("id").join(found, "id", "left")


@dataclass
class Answered:
    """A classifier whose answers were given elsewhere, such as a batch of model calls; those off the taxonomy are mended (A.20)."""

    answers: DataFrame
    taxonomy: DataFrame

    def place(self, rows: DataFrame) -> DataFrame:
        mended = valid_placements(self.answers, self.taxonomy).drop("on_map").join(self.answers.select("id", "note"), "id")
        return rows.select("id").join(mended, "id", "left").select("id", *ANSWER)


def classify(rows: DataFrame, cache: DataFrame, overrides: DataFrame, classifier: Classifier) -> DataFrame:
    """(id, sector_id, subsector_id, project_type, note, origin) of rows (id, hash, text).

    origin: override, cache (same id and hash), hash (same hash), or asked, for which the classifier is asked, or none if
    it has no sector. cache: id, hash and the answer's columns; overrides: id and the answer's columns.
    """
    def answer(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, F.struct(*ANSWER).alias("answer"))

    probed = cache_probe(rows.select("id", "hash"), answer(cache, "id", "hash"), answer(overrides, "id"))
    held = probed.where("origin <> 'todo'").select("id", "answer.*", "origin")
    todo = rows.join(probed.where("origin = 'todo'").select("id"), "id", "left_semi")
    asked = classifier.place(todo.select("id", "text")).select("id", *ANSWER, F.when(F.col("sector_id").isNull(), "none").otherwise("asked").alias("origin"))
    return held.union(asked)
