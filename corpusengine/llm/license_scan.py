"""License scans: exact set-similarity join of text blocks with license templates.

Blocks are windows of words, each twice as long as the longest template and starting half a
window after the one before, so a passage as long as a template lies whole in some block.
A block meets a template when it holds at least the threshold's share of the template's
distinct words (containment). Words are ordered by their frequency in all documents, rarest
first, which leaves each template a short prefix of rare words of which every matching
block has one. Blocks meet templates by equality of such a word; length and positional
bounds drop pairs that can't reach the threshold, and what is left is verified exactly.
Phrases are templates with threshold 1 whose words must also stand consecutively.

Defined results: a null text counts as empty (no words, no labels, score 0); repeated rows
and null ids give a row each; extra columns of the input are not read. An empty table gives
an empty result. Texts are never cut: a long text has more blocks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_TEMPLATES = 10_000


class Template(NamedTuple):
    label: str
    text: str
    threshold: float = 0.8
    phrase: bool = False


# The phrases and labels that are always looked for.
PHRASES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
)
# Notices that public licenses ask for, and usual one-line statements.
NOTICES = (
    Template("mit-notice", "released under the mit license"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "licensed under the gnu lesser general public license", 1.0),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", 0.9),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", 0.9),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved no part of this publication may be reproduced without written permission", 0.9),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _template_words(t: Template) -> list[str]:
    return t.text.lower().split()


def word_order(docs: DataFrame, templates, text: str = "text") -> list[str]:
    """The templates' words, rarest in ``docs`` first; as long as the templates are, whatever ``docs`` holds."""
    vocabulary = sorted({w for t in templates for w in _template_words(t)})
    # only texts with a word that is not in every text can matter, but frequencies cover them all
    found = docs.select(F.explode(F.filter(words_of(F.col(text)), lambda w: w.isin(*vocabulary))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_index(spark, templates, order: list[str]) -> DataFrame:
    """One row per template and prefix word: the word's place among the template's words in the global order."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for k, t in enumerate(templates):
        tokens = sorted(set(_template_words(t)), key=rank.__getitem__)
        need = math.ceil(t.threshold * len(tokens) - 1e-9)
        rows += [(tokens[i], i, k, t.label, t.phrase, tokens, need, _template_words(t)) for i in range(len(tokens) - need + 1)]
    return spark.createDataFrame(rows, "token string, at int, template int, label string, phrase boolean, tokens array<string>, need int, sequence array<string>")


def scan_licenses(docs: DataFrame, templates=PHRASES + NOTICES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    Texts are read twice (word frequencies, scan) and never shuffled; only one thin row per
    document and matching block is. The index of templates is bounded by ``templates``.
    """
    order = word_order(docs, templates, text)
    index = template_index(docs.sparkSession, templates, order)
    prefix = sorted({r["token"] for r in index.select("token").distinct().collect()})
    stride = max(len(_template_words(t)) for t in templates)
    known, rare = F.array(*map(F.lit, order)), F.array(*map(F.lit, prefix))

    rows = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words")).withColumns({"row": F.monotonically_increasing_id(), "n_words": F.size("words").cast("long")})
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(stride))
    blocks = F.filter(
        F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, F.lit(2 * stride)).alias("words"))),
        lambda b: F.arrays_overlap(b["words"], rare),
    )
    rows = rows.withColumn("block", F.explode_outer(F.when(F.arrays_overlap("words", rare), blocks))).drop("words")

    # the block's words that any template has, in the global order
    rows = rows.withColumn("shared", F.array_intersect(known, "block.words"))
    rows = rows.withColumn("token", F.explode_outer(F.array_intersect(F.col("shared"), rare)))
    met = rows.join(F.broadcast(index), "token", "left")

    before = F.array_position("shared", F.col("token")).cast("int") - 1
    reach = F.least("at", before) + 1 + F.least(F.size("tokens") - 1 - F.col("at"), F.size("shared") - 1 - before)
    overlap = F.array_intersect("tokens", "shared")
    met = met.withColumn("overlap", F.when((F.size("shared") >= F.col("need")) & (reach >= F.col("need")), overlap))
    # a pair that shares several prefix words counts at the first of them
    hit = (F.size("overlap") >= F.col("need")) & (F.element_at("overlap", 1) == F.col("token"))
    met = met.withColumn("hit", F.coalesce(hit, F.lit(False)))

    w, seq = F.col("block.words"), F.col("sequence")
    place = F.sequence(F.lit(1), F.least(F.size(w) - F.size(seq) + 1, F.lit(stride)))
    found = F.filter(place, lambda p: F.slice(w, p, F.size(seq)) == seq)
    places = F.when(F.col("hit") & F.col("phrase") & (F.size(w) >= F.size(seq)), F.transform(found, lambda p: (p + F.col("block.start") - 1).cast("long")))
    met = met.withColumn("places", places)
    phrase = F.col("hit") & F.col("phrase") & (F.size("places") > 0)
    notice = F.col("hit") & ~F.col("phrase")
    met = met.select(
        "row",
        "doc_id",
        "n_words",
        F.greatest(F.size("places"), F.lit(0)).alias("n"),
        F.array_min("places").alias("low"),
        F.array_max("places").alias("high"),
        F.when(phrase, F.col("label")).alias("base"),
        F.when(phrase | notice, F.col("label")).alias("any"),
        F.when(phrase, F.lit(1.0)).when(notice, F.size("overlap") / F.size("tokens")).alias("share"),
        F.when(phrase | notice, F.col("block.start")).alias("start"),
    )
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        met.groupBy("row", "doc_id", "n_words")
        .agg(F.sum("n").cast("long").alias("n_base"), F.min("low").alias("first_word"), F.max("high").alias("last_word"), joined("base").alias("base_labels"), joined("any").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"), F.count_distinct("start").alias("n_blocks"))
        .drop("row")
    )
