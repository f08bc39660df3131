"""License phrases and notices in texts: k-gram hits vote for diagonals. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesaudit.llm.shared import ROW, numbered, whole_text

K = 3  # words of a gram
DRIFT = 4  # words by which neighbouring diagonals may differ
LEAST_SHARE = 0.6  # of a notice's grams that a span must have
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that give a base label wherever their words stand together: fixed values.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Sentences of well-known notices that give a label even with some words changed: fixed values.
NOTICES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction"
    ),
    "apache-2": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0"
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation"
    ),
    "gpl-named": "licensed under the gnu general public license version",
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met"
    ),
    "cc-by-nc": "creative commons attribution noncommercial international license",
    "cc-by-sa": "creative commons attribution sharealike international license",
    "proprietary": "all rights reserved",
}


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD, -1), "")


def _grams(words: Column) -> Column:
    """(place, gram) of each run of K words."""
    last = F.size(words) - K
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    join = lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(K)))
    return F.transform(places, lambda i: F.struct(i.alias("place"), join(i).alias("gram")))


def _templates(spark: SparkSession) -> DataFrame:
    """(label, base, grams, at, gram): each gram of each phrase and notice. A fixed list."""
    kinds = [(phrase, label, True) for phrase, label in PHRASES.items()]
    kinds += [(notice, label.removesuffix("-named"), False) for label, notice in NOTICES.items()]
    rows = []
    for number, (template, label, base) in enumerate(kinds):
        words = template.split()
        grams = [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]
        rows += [(number, label, base, len(grams), at, gram) for at, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int, at int, t_gram string")


def license_spans(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The spans of each row of ``docs``: row, doc_id, n_words, label, base, first, last, share.

    Each run of three words is joined by its hash with the same runs of the
    phrases and notices and compared with them; a hit votes for the diagonal
    (place in the text less place in the template). A phrase is found where all
    its runs lie on one diagonal. For a notice, hits on diagonals at most four
    words apart form a span, which counts if it holds 60% of the notice's runs.
    first and last are the places of its first and last word, from 0.

    Each row of ``docs`` is also there once with a NULL label. NULL texts are empty.
    Only the templates are broadcast: they are a fixed list. Hits are few and
    meet per row of the table, so no label or phrase becomes a hot key.
    """
    spark = docs.sparkSession
    rows = numbered(docs, F.col(id_column).alias("doc_id"), words_of(whole_text(text)).alias("words"))
    # The first entry has no gram and keeps the row when nothing is found.
    start = F.array(F.struct(F.lit(-1).alias("place"), F.lit("").alias("gram")))
    exploded = rows.select(ROW, "doc_id", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(start, _grams(F.col("words")))).alias("x"))
    exploded = exploded.select(ROW, "doc_id", "n_words", "x.place", "x.gram").withColumn("hash", F.xxhash64("gram"))
    none = spark.createDataFrame([(-1, None, None, 0, 0, "")], "template int, label string, base boolean, grams int, at int, t_gram string")
    templates = _templates(spark).unionByName(none).withColumn("t_hash", F.xxhash64("t_gram"))
    hits = exploded.join(F.broadcast(templates), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    key = [ROW, "doc_id", "n_words", "template", "label", "base", "grams"]
    diagonals = hits.groupBy(*key, (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("found"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    # Phrases need a whole diagonal; notices may drift from one to the next.
    near = W.partitionBy(ROW, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(near)
    begins = F.coalesce(F.col("base") | (apart > DRIFT), F.lit(True)) | apart.isNull()
    spans = diagonals.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(near))
    spans = spans.groupBy(*key, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_found"),
        F.min("low").cast("long").alias("first"),
        (F.max("high") + (K - 1)).cast("long").alias("last"),
    )
    share = F.try_divide(F.col("n_found"), F.col("grams"))
    counts = F.when(F.col("base"), F.col("n_found") == F.col("grams")).otherwise(share >= LEAST_SHARE)
    spans = spans.withColumn("share", share).filter(counts | F.col("label").isNull())
    return spans.select(ROW, "doc_id", "n_words", "label", "base", "first", "last", "share")


def license_labels(spans: DataFrame) -> DataFrame:
    """One row per row of the documents: its labels and the places of its base phrases."""
    base = F.col("base") & F.col("label").isNotNull()
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    return spans.groupBy(ROW, "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        listed(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        listed(F.collect_set("label")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"),
    )
