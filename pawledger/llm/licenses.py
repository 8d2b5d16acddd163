"""License texts in documents by diagonal voting.

Every run of WIDTH words of a document, and every pair of words, is hashed and joined to the places
where templates have it. A match votes for its diagonal, document place less template place; votes
are added up by diagonal, neighbouring diagonals (words left out or put in) are merged, and a span
counts if enough of its template is there, with a second hash of every run of words agreeing.
Short phrases of a template are found whole: all their votes lie on one diagonal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .columns import OUTSIDE_WORDS, let, lower_ascii, upto, words

WIDTH = 4


@dataclass(frozen=True)
class Template:
    """A text and its label; a phrase counts wherever all its words stand one after the other."""

    label: str
    text: str
    phrase: bool = False


# The phrases and their labels.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
#: Opening words of well-known licenses and notices.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)
#: Share of a notice's runs of words that a span must have.
COVER = 0.5
#: Words that may be left out or put in between two diagonals of a span.
GAP = 4


def code(items: list[Column]) -> tuple[Column, Column]:
    """Two hashes of a run of words that do not depend on each other."""
    return F.xxhash64(*items, F.lit(len(items))), F.hash(*items)


def template_table(spark: SparkSession, templates: tuple[Template, ...], width: int) -> DataFrame:
    """code, check, template, label, phrase, place, runs: one row for each run of words of a template."""
    rows = []
    for number, template in enumerate(templates):
        found = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), template.text))
        size = 2 if template.phrase or len(found) < width else width
        runs = len(found) - size + 1
        if runs < 1:
            raise ValueError(f"a template needs two words: {template.text!r}")
        rows += [(number, template.label, template.phrase, at, runs, found[at : at + size]) for at in range(runs)]
    names = ("template", "label", "phrase", "place", "runs")
    literals = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)], F.array(*map(F.lit, row[5])).alias("run")) for row in rows]
    table = spark.range(1).select(F.inline(F.array(*literals)))
    short = code([F.get("run", F.lit(i)) for i in range(2)])
    full = code([F.get("run", F.lit(i)) for i in range(width)])
    pick = F.size("run") == 2
    table = table.withColumn("code", F.when(pick, short[0]).otherwise(full[0])).withColumn("check", F.when(pick, short[1]).otherwise(full[1]))
    return table.drop("run")


def runs_of(text: Column, width: int) -> Column:
    """n_words, and place, code and check of each run of two and of `width` words; first comes one
    with place -1, so that every document has a row."""

    def coded(parts: Column) -> Column:
        def runs(size: int) -> Column:
            def one(i: Column) -> Column:
                first, second = code([F.get(parts, i + k) for k in range(size)])
                return F.struct(i.alias("place"), first.alias("code"), second.alias("check"))

            return F.transform(upto(F.size(parts) - (size - 1)), one)

        none = F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("code"), F.lit(0).alias("check"))
        all_runs = F.concat(F.array(none), runs(2), runs(width))
        return F.struct(F.size(parts).cast("long").alias("n_words"), all_runs.alias("runs"))

    return let(words(lower_ascii(text), OUTSIDE_WORDS), coded)


def found_licenses(
    documents: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, width: int = WIDTH, cover: float = COVER, gap: int = GAP
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    n_base counts the places of phrases, first_word and last_word are the smallest and largest of
    them (words from 0). score is the largest share of a template found. Null and empty texts have
    no words: counts and score are 0, labels empty, places null. Repeated rows and rows without an
    id have a row each. Other columns are ignored; an empty table gives no rows.
    """
    rows = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", runs_of(F.col("text"), width).alias("found"))
    rows = rows.select("row", "doc_id", "found.n_words", F.explode("found.runs").alias("run")).select("row", "doc_id", "n_words", "run.*")
    table = template_table(documents.sparkSession, templates, width)
    none = documents.sparkSession.range(1).selectExpr(
        "-1 as template", "'' as label", "false as phrase", "0 as at", "1 as runs", "0L as code", "0 as agrees"
    )
    table = table.withColumnRenamed("place", "at").withColumnRenamed("check", "agrees").select(*none.columns).union(none)
    # The templates are a parameter: a few hundred rows.
    votes = rows.join(F.broadcast(table), "code").where("check = agrees and (template < 0) = (place < 0)")
    by_diagonal = votes.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "runs", (F.col("place") - F.col("at")).alias("diagonal"))
    by_diagonal = by_diagonal.agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"))
    order = Window.partitionBy("row", "template").orderBy("diagonal", "first")
    moved = F.col("diagonal") - F.lag("diagonal").over(order)
    apart = F.col("phrase") | moved.isNull() | (moved > gap)
    spans = by_diagonal.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    spans = spans.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "runs", "span")
    spans = spans.agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("start"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.least(F.col("votes") / F.col("runs"), F.lit(1.0))
    real = F.col("template") >= 0
    whole = real & F.col("phrase") & (F.col("votes") == F.col("runs"))
    near = real & ~F.col("phrase") & (share >= cover) & (F.col("last") - F.col("first") <= 2 * (F.col("runs") + width))
    by_row = spans.groupBy("row", "doc_id", "n_words").agg(
        F.sum(F.when(whole, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(whole, F.col("label"))).alias("base"),
        F.collect_set(F.when(whole | near, F.col("label"))).alias("all"),
        F.max(F.when(whole | near, share).otherwise(0.0)).alias("score"),
    )
    joined = lambda name: F.array_join(F.array_sort(name), ",")
    return by_row.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        joined("base").alias("base_labels"), joined("all").alias("labels"), "score",
    )
