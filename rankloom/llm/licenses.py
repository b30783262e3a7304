"""License scan by diagonal voting.

Every pair of neighbouring words of a text is hashed and equi-joined to the
positions at which the same pair stands in a template. A hit at text position
p and template position t votes for the diagonal p - t, the place where the
template would begin. Votes are gathered as bits, one for each template
position; neighbouring diagonals (words put in or left out) are merged, and a
merged span is verified by how many of the template's words it covers.

DataFrame functions only; the words of a hit are compared beside their hash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LICENSE_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = -7046029254386353131  # hash value of the row that ends a text
_MOST_PAIRS = 62

# Phrases that must stand word by word, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wordings of notices, found with gaps too, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("apache license version 2 0 january 2004", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu general public license as published by the free software foundation either version 3", "gpl-3.0"),
    ("gnu general public license as published by the free software foundation either version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    exact: bool


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    """Templates of at least two words; longer ones are cut into pieces that the 62 vote bits can hold."""
    out = []
    for pairs, exact in ((phrases, True), (notices, False)):
        for text, label in pairs:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
            if len(words) < 2 or exact and len(words) > _MOST_PAIRS:
                raise ValueError(f"template of {len(words)} words: {text[:60]}")
            pieces = -(-len(words) // _MOST_PAIRS)
            step = -(-len(words) // pieces)
            out += [Template(tuple(words[k : k + step]), label, exact) for k in range(0, len(words), step)]
    return out


def license_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, LICENSE_BREAKS), lambda w: w != "")


def _positions(spark: SparkSession, known: list[Template]) -> DataFrame:
    rows = [(k, t, w[t], w[t + 1]) for k, w in enumerate(x.words for x in known) for t in range(len(w) - 1)]
    table = spark.createDataFrame(rows, "template int, at int, word string, next string").select(F.xxhash64("word", "next").alias("pair"), "*")
    end = spark.range(1).select(F.lit(_END).alias("pair"), F.lit(-1).alias("template"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("next"))
    return table.unionByName(end)


def votes(docs: DataFrame, known: list[Template]) -> DataFrame:
    """One row per (doc_id, content, template, diagonal): the bits of the template positions that voted, and where.

    template -1 is the end of the text: its diagonal is the number of words,
    its ``hits`` the number of equal rows. The positions table comes from
    literals, so its broadcast is bounded by them.
    """
    # the words are bound by a lambda, so that they are split once a text and not once a pair
    paired = F.transform(F.array(license_words(F.col("text"))), lambda ws: F.struct(
        ws.alias("words"), F.concat(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1))), F.array(F.lit(_END))).alias("pairs")
    ))
    pairs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), F.inline(paired))
    hits = (
        pairs.select("doc_id", "content", "words", F.posexplode("pairs").alias("place", "pair"))
        .join(F.broadcast(_positions(docs.sparkSession, known)), "pair")
        .filter((F.col("template") == -1) & (F.col("place") == F.size("words")) | (F.get("words", F.col("place")) == F.col("word")) & (F.get("words", F.col("place") + 1) == F.col("next")))
    )
    return hits.groupBy("doc_id", "content", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"), F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("hits")
    )


def spans(voted: DataFrame, known: list[Template], *, gap: int = 3, least: float = 0.75, short: int = 10) -> DataFrame:
    """Verified spans: doc_id, content, template, label, exact, start, stop (word positions), coverage, hits; ends of texts pass through.

    A phrase needs all its pairs on one diagonal. For a notice, diagonals at most ``gap`` apart are one
    span; it needs ``least`` of the notice's words (all of them for notices of
    up to ``short`` words, which differ from one another in one word) and may
    be no longer than the notice and half as much again.
    """
    about = _about(voted.sparkSession, known)
    order = Window.partitionBy("doc_id", "content", "template").orderBy("diagonal")
    steps = (
        voted.join(F.broadcast(about), "template")
        .withColumn("opens", (F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))).cast("int"))
        .withColumn("run", F.sum("opens").over(order))
    )
    covered = F.expr("bit_count(bits | shiftleft(bits, 1))")
    return (
        steps.groupBy("doc_id", "content", "template", "label", "exact", "n_words", "run")
        .agg(F.bit_or("bits").alias("bits"), F.min("low").alias("start"), (F.max("high") + 2).alias("stop"), F.sum("hits").alias("hits"))
        .withColumn("coverage", covered / F.col("n_words"))
        .filter(F.when(F.col("exact"), F.expr("bit_count(bits)") == F.col("n_words") - 1).otherwise((F.col("coverage") >= F.when(F.col("n_words") <= short, 1.0).otherwise(least)) & (F.col("stop") - F.col("start") <= 1.5 * F.col("n_words") + gap)))
        .select("doc_id", "content", "template", "label", "exact", "start", "stop", "coverage", "hits")
    )


def _about(spark: SparkSession, known: list[Template]) -> DataFrame:
    """Label, kind and length of every template; the end of a text is one of a single pair."""
    rows = [(k, t.label, t.exact, len(t.words)) for k, t in enumerate(known)]
    return spark.createDataFrame([(-1, None, True, 2), *rows], "template int, label string, exact boolean, n_words int")


def scan_licenses(docs: DataFrame, known: list[Template] | None = None, *, gap: int = 3, least: float = 0.75) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    Null and empty texts have no words: counts 0, first and last null, labels
    empty, score 0. Documents of one id are told apart by their text; equal
    rows come out as often as they came in. The score is the best coverage
    of a span. Texts are scanned whole, in one pass, and only hits are
    shuffled.
    """
    known = templates() if known is None else known
    found = spans(votes(docs, known), known, gap=gap, least=least).withColumn("end", F.col("template") == -1)
    base = F.when(F.col("exact") & ~F.col("end"), F.col("start").cast("long"))
    whole = found.groupBy("doc_id", "content").agg(
        F.max(F.when(F.col("end"), F.col("start").cast("long"))).alias("n_words"), F.max(F.when(F.col("end"), F.col("hits"))).alias("copies"),
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max(F.when(~F.col("end"), F.col("coverage"))), F.lit(0.0)).alias("score"), F.count("label").alias("n_spans"),
    )
    return whole.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_", "copies", "content")
