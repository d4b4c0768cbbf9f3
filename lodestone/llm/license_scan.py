"""License scan: phrases, and an exact set-similarity join of text blocks with license templates. SQL functions only.

A text block is a line. It matches a template if it holds at least CONTAINMENT of the template's distinct tokens.
Tokens are ordered by their number of lines in the whole table, the rarest first. A match must hold one of the first
`m - need + 1` tokens of a template with m tokens of which `need` must be there (prefix filter), have at least `need`
tokens (length filter), and enough template tokens must be left after the first one found, in the template and in the
block (positional filter). What passes is counted exactly. Blocks meet templates by a broadcast join on prefix tokens;
the templates are constants, so their size is fixed.

A notice may be wrapped over several lines. A template that no line of a document matches is looked for in windows of
words across line feeds, as long as the template and a tenth more. Only documents that hold enough of its tokens are cut
into windows, which start at its tokens.
"""

from __future__ import annotations

import math
import string
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace

#: Phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Share of a template's distinct tokens that a block must hold.
CONTAINMENT = 0.9
#: License notices and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: ASCII characters that stand between words, line feed apart.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c not in "\n")


def spaced(text: Column) -> Column:
    """A-Z in lower case, and spaces for what stands between words; lines stay."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + BETWEEN, string.ascii_lowercase + " " * len(BETWEEN))


def words(spaced_text: Column) -> Column:
    return F.array_remove(F.split(spaced_text, " "), "")


def template_tokens(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """(label, distinct words) of each template."""
    clean = str.maketrans({c: " " for c in BETWEEN + "\n"})
    return [(label, sorted(set(text.lower().translate(clean).split()))) for label, text in templates]


def rows(spark: SparkSession, values: list[tuple], names: list[str]) -> DataFrame:
    """A table of constants."""
    structs = [F.struct(*[(F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)).alias(n) for n, v in zip(names, value, strict=True)]) for value in values]
    return spark.range(1).select(F.inline(F.array(*structs)))


def sizes(templates, containment: float) -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, distinct tokens, how many must be there, words of a window) of each template."""
    clean = str.maketrans({c: " " for c in BETWEEN + "\n"})
    return [(k, label, tokens, math.ceil(containment * len(tokens) - 1e-9), math.ceil(len(text.translate(clean).split()) / containment - 1e-9)) for k, ((label, tokens), (_, text)) in enumerate(zip(template_tokens(templates), templates, strict=True))]


def matches(read: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, row, label, template, score): every block and template that meet the threshold. read: doc_id, row, blocks."""
    spark, parsed = read.sparkSession, sizes(templates, containment)
    vocabulary = sorted({t for _, _, own, _, _ in parsed for t in own})
    blocks = read.select("doc_id", "row", F.explode("blocks").alias("tokens"))
    # spread the tokens' counts over the whole table
    seen = {r.token: r.n for r in read.select(F.explode("blocks").alias("tokens")).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda t: (seen.get(t, 0), t))
    place = {t: i for i, t in enumerate(order)}
    prefixes = []
    for k, label, own, need, _ in parsed:
        own = sorted(own, key=place.get)
        prefixes += [(t, k, label, own, need, len(own) - i, order[place[t] + 1 :]) for i, t in enumerate(own[: len(own) - need + 1])]
    prefix = rows(spark, prefixes, ["token", "template", "label", "own", "need", "left", "later"])
    found = blocks.select("doc_id", "row", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(prefix), "token")
    found = found.where(F.size("tokens") >= F.col("need")).where(1 + F.least(F.col("left") - 1, F.size(F.array_intersect("tokens", "later"))) >= F.col("need"))
    overlap = F.size(F.array_intersect("tokens", "own"))
    return found.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need")).select("doc_id", "row", "label", "template", (F.col("overlap") / F.size("own")).alias("score"))


def wrapped(read: DataFrame, lines: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Matches of `templates` in windows across line feeds, where `lines` (the matches within lines) has none. read: doc_id, row, wrapped."""
    constants = rows(read.sparkSession, sizes(templates, containment), ["template", "label", "own", "need", "span"])
    near = read.where("wrapped is not null").join(F.broadcast(constants), F.size(F.array_intersect("wrapped", "own")) >= F.col("need"))
    done = lines.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("template").alias("t")).distinct()
    near = near.join(done, near.doc_id.eqNullSafe(done.d) & (near.row == done.r) & (near.template == done.t), "left_anti")
    starts = F.filter(F.sequence(F.lit(1), F.size("wrapped")), lambda i: F.array_contains("own", F.get("wrapped", i - 1)))
    overlap = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("wrapped", i, F.col("span")), "own"))))
    return near.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need")).select("doc_id", "row", "label", "template", (F.col("overlap") / F.size("own")).alias("score"))


def stands_at(phrase: list[str]):
    """Whether the phrase stands in `words` from a place on."""
    return lambda i: reduce(and_, [F.get("words", i + j) == w for j, w in enumerate(phrase)])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts are empty. A document's template labels join its phrase labels; score is 1 if a phrase stands in it,
    else its best containment that met the threshold, else 0. Rows that share id and text get the same result;
    a null id is an id like any other. Other columns of docs are not read.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"), spaced(F.col(text)).alias("spaced"))
    parsed = sizes(templates, containment)
    vocabulary = F.array(*map(F.lit, sorted({t for _, _, own, _, _ in parsed for t in own}))).cast("array<string>")
    least = min((need for *_, need, _ in parsed), default=1)
    # each text is cut into words once: the lines that may match, and the words of texts that may hold a wrapped notice
    own = held.withColumn("lines", F.transform(F.split("spaced", "\n"), words))
    blocks = F.filter(F.transform("lines", lambda x: F.array_intersect(x, vocabulary)), lambda x: F.size(x) >= least)
    own = own.select("doc_id", "row", "spaced", F.flatten("lines").alias("words"), blocks.alias("blocks")).withColumn("seen", F.array_intersect("words", vocabulary))
    near = reduce(or_, [F.size(F.array_intersect("seen", F.array(*map(F.lit, tokens)))) >= need for _, _, tokens, need, _ in parsed], F.lit(False))
    places = []
    for phrase in phrases:
        want = phrase.split()
        starts = F.sequence(F.lit(0), F.size("words") - len(want))
        stands = stands_at(want)
        nothing = F.array().cast("array<int>")
        here = F.contains("spaced", F.lit(want[-1])) & (F.size("words") >= len(want))
        places.append(F.when(here, F.filter(starts, stands)).otherwise(nothing))
    read = own.select("doc_id", "row", F.size("words").cast("bigint").alias("n_words"), *[p.alias(f"p{k}") for k, p in enumerate(places)], "blocks", F.when(near, F.col("words")).alias("wrapped"))
    read = Workspace(docs.sparkSession, "licenses").table(read)
    at = F.concat(*[F.col(f"p{k}") for k in range(len(places))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, label) for k, label in enumerate(phrases.values())]))
    base = read.select("doc_id", "row", "n_words", F.size(at).cast("bigint").alias("n_base"), F.array_min(at).cast("bigint").alias("first_word"), F.array_max(at).cast("bigint").alias("last_word"), labels.alias("base"))
    lines = matches(read, templates, containment)
    found = lines.union(wrapped(read, lines, templates, containment)).groupBy("doc_id", "row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    found = found.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "more", "best")
    both = base.join(found, base.doc_id.eqNullSafe(found.d) & (base.row == found.r), "left")
    text_of = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", text_of(F.col("base")).alias("base_labels"), text_of(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
