"""License scans by diagonal voting.

All rolling k-grams of words of a text are joined to their positions in license templates. A copy of a
template lies on one diagonal (position in the text less position in the template); insertions and
deletions move it by a few. Matches are counted by diagonal, diagonals nearer than ``SLACK`` are merged,
and a merged span is verified: the share of the template's words that its matches cover, k-grams being
compared as text, must reach ``SHARE``.

The templates are a fixed list, so their index is small at any size of the input and is broadcast.

Defined cases: a null text has no words and no license; equal rows get equal results; a license that
stands several times has a span for each place; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import NON_WORD_RUN, ascii_lower, row_key, split_words, text_of
from termloom.session import checkpointed

GRAM = 4
SLACK = 3
SHARE = 0.7

#: Phrases that name a license wherever they stand (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Words of public license notices, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction including without limitation the rights"
     " to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
     " with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
     " license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the"
     " following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), NON_WORD_RUN)


def grams(docs: DataFrame) -> DataFrame:
    """(row, at, gram) of every rolling k-gram, places from 0."""
    texts = docs.select(row_key("doc_id", "text").alias("row"), words_of(text_of()).alias("words"))
    n = F.size("words")
    rolled = F.when(
        n >= GRAM,
        F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.array_join(F.slice("words", i, GRAM), " ")),
    ).otherwise(F.array().cast("array<string>"))
    return texts.select("row", F.posexplode(rolled).alias("at", "gram"))


def template_index(docs: DataFrame) -> DataFrame:
    """(gram, template, label, place, n): every k-gram of every template."""
    rows = []
    for k, (label, text) in enumerate(TEMPLATES):
        words = text.split()
        rows += [(" ".join(words[i : i + GRAM]), k, label, i, len(words)) for i in range(len(words) - GRAM + 1)]
    return docs.sparkSession.createDataFrame(rows, "gram string, template int, label string, place int, n int")


def matches(docs: DataFrame) -> DataFrame:
    """(row, label, start, end, share): verified spans of words, end exclusive."""
    hits = checkpointed(grams(docs).join(F.broadcast(template_index(docs)), "gram").drop("gram").distinct())
    votes = hits.groupBy("row", "template", "label", "n", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places")  # of one template
    )
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > SLACK, F.lit(True))
    merged = (
        votes.withColumn("_new", apart.cast("int"))
        .withColumn("_span", F.sum("_new").over(by_diagonal))
        .groupBy("row", "template", "label", "n", "_span")
        .agg(F.min("first").alias("start"), (F.max("last") + GRAM).alias("end"), F.collect_set("places").alias("places"))
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform(F.flatten("places"), lambda p: F.sequence(p, p + (GRAM - 1)))))
    )
    return merged.withColumn("share", covered / F.col("n")).filter(F.col("share") >= SHARE).select(
        "row", "label", "start", "end", "share"
    )


def phrase_places(words: str, text: Column, phrase: str) -> Column:
    """Where the words of a phrase stand in a row; ``text`` is the words between single spaces."""
    parts = phrase.split()
    here = lambda i: F.forall(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(parts)]),
        lambda p: F.coalesce(F.get(words, i + p["k"]) == p["w"], F.lit(False)),
    )
    none = F.array().cast("array<int>")
    return F.when(
        F.contains(text, F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    ).otherwise(none)


def scanned(docs: DataFrame) -> DataFrame:
    """Per document: base places and labels, labels with those of verified spans, score."""
    texts = docs.select("doc_id", row_key("doc_id", "text").alias("row"), words_of(text_of()).alias("words"))
    spaced = texts.withColumn("_text", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    for k, phrase in enumerate(PHRASES):
        spaced = spaced.withColumn(f"_p{k}", phrase_places("words", F.col("_text"), phrase))
    places = F.concat(*[F.col(f"_p{k}") for k in range(len(PHRASES))])
    labels = F.array_compact(
        F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])
    )
    base = spaced.select(
        "doc_id", "row", F.size("words").cast("long").alias("n_words"), places.alias("places"), labels.alias("base")
    )
    spans = matches(docs).groupBy("row").agg(
        F.collect_set("label").alias("own"), F.max("share").alias("share"), F.count("*").alias("n_spans")
    )
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("base", F.coalesce("own", none)))
    return base.join(spans, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
    )
