"""Operator 1: license scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import words

#: Words of a rolling gram.
K = 2
#: Diagonals at most so far apart are one span (words inserted or left out).
GAP = 3
#: Share of a template's grams that a verified span must show.
COVERAGE = 0.6

#: Fixed values: (label, notice, whether the phrase itself, at every place, is asked for).
TEMPLATES = (
    ("mit", "mit license", True),
    ("apache", "apache license", True),
    ("gpl", "general public license", True),
    ("mit-notice", "released under the mit license", False),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", False),
    ("apache-2.0", "licensed under the apache license version 2 0", False),
    ("apache-text", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", False),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", False),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", False),
    ("lgpl", "gnu lesser general public license", False),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", False),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", False),
    ("unlicense", "this is free and unencumbered software released into the public domain", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", False),
)


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(tid, label, base, m grams, tpos, a, b, h) of every template gram; as many rows as the templates have words."""
    rows = [F.struct(F.lit(i).alias("tid"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.array(*map(F.lit, text.split())).alias("w")) for i, (label, text, base) in enumerate(templates)]
    t = spark.range(1).select(F.inline(F.array(*rows)))
    t = t.select("tid", "label", "base", "w", F.posexplode(F.slice("w", 1, F.size("w") - 1)).alias("tpos", "a"))
    t = t.select("tid", "label", "base", (F.size("w") - 1).alias("m"), "tpos", "a", F.get("w", F.col("tpos") + 1).alias("b"))
    return t.withColumn("h", F.xxhash64("a", "b"))


def license_votes(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Every document's grams joined to template positions: (row, doc_id, n_words, tid, label, base, m, tpos, diag).

    A row with null tid stands for the document itself, so that none is lost.
    """
    t = template_grams(docs.sparkSession, templates)
    d = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    d = d.withColumn("grams", F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.xxhash64(a, b)))
    d = d.select("row", "doc_id", "w", F.posexplode_outer("grams").alias("pos", "g"))
    hit = (F.col("g") == F.col("h")) & (F.get("w", F.col("pos")) == F.col("a")) & (F.get("w", F.col("pos") + 1) == F.col("b"))
    d = d.join(F.broadcast(t), hit, "left").where("tid IS NOT NULL OR coalesce(pos, 0) = 0")
    d = d.select("row", "doc_id", F.size("w").alias("n_words"), "tid", "label", "base", "m", "tpos", (F.col("pos") - F.col("tpos")).alias("diag"))
    return d.repartition("row")


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """License notices of documents (doc_id, text): one row per input row.

    Words are rolled into grams, grams joined to template positions (templates are constants of the call, so their
    broadcast is bounded), votes counted by diagonal; neighbouring diagonals merge into a span, which is verified: it
    must show COVERAGE of the template's grams, each checked word by word, within one and a half times its length.
    A base phrase's place is a diagonal with all of its grams. Null or empty texts have no words and no labels;
    repeated rows are scanned each on its own; other columns are not looked at; an empty table gives no rows.

    Returns doc_id, n_words, places (sorted starts of base phrases with label), spans (label, start, end, coverage).
    """
    row = ["row", "doc_id", "n_words"]
    votes = license_votes(docs, templates)
    diag = votes.groupBy(*row, "tid", "label", "base", "m", "diag").agg(F.collect_list("tpos").alias("tps"))
    diag = diag.withColumn("strong", F.col("tid").isNotNull() & (F.size("tps") >= F.least(F.lit(2), F.col("m"))))
    full = F.when(F.col("base") & (F.size("tps") == F.col("m")), F.struct(F.col("diag").cast("long").alias("start"), "label"))
    w = Window.partitionBy("row", "tid", "strong").orderBy("diag")
    diag = diag.withColumn("place", full).withColumn("new", F.when(F.col("diag") - F.lag("diag").over(w) <= GAP, 0).otherwise(1))
    diag = diag.withColumn("island", F.sum("new").over(w))
    span = diag.groupBy(*row, "tid", "label", "base", "m", "strong", "island").agg(
        F.collect_list("place").alias("places"),
        F.size(F.array_distinct(F.flatten(F.collect_list("tps")))).alias("votes"),
        F.min(F.col("diag") + F.array_min("tps")).alias("start"),
        F.max(F.col("diag") + F.array_max("tps") + K).alias("end"),
    )
    ok = F.col("strong") & ~F.col("base") & (F.col("votes") >= COVERAGE * F.col("m")) & (F.col("end") - F.col("start") <= 1.5 * (F.col("m") + 1) + GAP)
    one = F.struct("label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("votes") / F.col("m")).alias("coverage"))
    out = span.groupBy(*row).agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"), F.array_sort(F.collect_list(F.when(ok, one))).alias("spans"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "places", "spans")


def op1_license_scans(docs: DataFrame) -> DataFrame:
    """The digest of scan_licenses: one row per document."""
    some = F.size("places") > 0
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"]))))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.when(some, F.array_min("places")["start"]).alias("first_word"), F.when(some, F.array_max("places")["start"]).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(some, F.lit(1.0)).otherwise(best).alias("score"),
    )
