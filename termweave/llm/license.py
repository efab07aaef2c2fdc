"""License scan by diagonal voting.

Templates are short phrases and longer passages. The rolling k-gram hashes of a text are
joined with those of the templates; a match votes for the diagonal (place in the text
minus place in the template) it lies on. Votes are summed per diagonal, neighbouring
diagonals of a template are merged (a text may have a word more or less), and a span
counts if enough of the template is covered by matches whose words were compared. Only
DataFrame functions are used.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.llm.common import same_text

#: Phrases that must stand word by word, and the label each gives (fixed values).
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: More phrases of licenses (fixed values).
MORE_PHRASES = (
    ("bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("cc by nc", "cc-by-nc"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
)
#: Opening passages of license texts (fixed values).
PASSAGES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either "
        "version 2 of the license or at your option any later version",
        "gpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer",
        "bsd",
    ),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
)
PHRASE_GRAM, PASSAGE_GRAM = 2, 4
#: Diagonals at most so far apart are one span; the share of a passage that must be covered.
SLACK, LEAST_COVERED = 3, 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_column(text: Column) -> Column:
    """Words: runs of letters and digits and of characters beyond ASCII, case as in the text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def gram_hash(words: list[Column]) -> Column:
    """Hash of consecutive words, lower-cased; null if one is missing."""
    known = functools.reduce(lambda a, b: a & b, [w.isNotNull() for w in words])
    return F.when(known, F.xxhash64(F.lit(len(words)), *[F.lower(w) for w in words]))


def template_grams(spark, phrases, passages) -> DataFrame:
    """`(template, label, base, words, gram, at, t1..t4)`: every k-gram of every template with its place; as many rows as the templates have words."""
    rows = []
    listed = [(text, label, True, PHRASE_GRAM) for text, label in phrases[0]] + [(text, label, False, PHRASE_GRAM) for text, label in phrases[1]] + [(text, label, False, PASSAGE_GRAM) for text, label in passages]
    for number, (text, label, base, size) in enumerate(listed):
        own = text.split()
        if len(own) < size:
            raise ValueError(f"a template needs {size} words: {text}")
        for at in range(len(own) - size + 1):
            rows.append((number, label, base, len(own), size, at, *(own[at : at + size] + [None] * (PASSAGE_GRAM - size))))
    return spark.createDataFrame(rows, "template int, label string, base boolean, words int, gram int, at int, t1 string, t2 string, t3 string, t4 string").withColumn(
        "hash", F.coalesce(*[F.when(F.col("gram") == n, gram_hash([F.col(f"t{i}") for i in range(1, n + 1)])) for n in (PHRASE_GRAM, PASSAGE_GRAM)])
    )


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE_PHRASES, more=MORE_PHRASES, passages=PASSAGES) -> DataFrame:
    """`(key, text_hash, template, label, base, start, end, score)`: verified spans, in words from 0, end exclusive.

    A phrase must be there word by word (score 1). A passage counts if its matched
    different k-grams, over diagonals at most `SLACK` apart, cover `LEAST_COVERED` of it; the score is the
    covered share. Case of A-Z is ignored. Null and empty texts have no spans. Rows with one key and one text are one.
    """
    templates = template_grams(docs.sparkSession, (base, more), passages)
    # The templates are a parameter; their hashes, as many as they have words, first sift the rolling hashes of the texts.
    hashes = [r["hash"] for r in templates.select("hash").distinct().collect()]
    words = docs.select(F.col(key).alias("_key"), same_text(text).alias("text_hash"), words_column(F.col(text)).alias("w"))
    later = [F.slice("w", i, F.greatest(F.size("w"), F.lit(1))).alias(f"w{i}") for i in range(2, PASSAGE_GRAM + 1)]
    rolled = words.select("_key", "text_hash", F.col("w").alias("w1"), *later)
    rolled = rolled.select("_key", "text_hash", F.posexplode(F.arrays_zip("w1", "w2", "w3", "w4")).alias("pos", "g")).select("_key", "text_hash", "pos", "g.*")
    own = [gram_hash([F.col(f"w{i}") for i in range(1, n + 1)]) for n in (PHRASE_GRAM, PASSAGE_GRAM)]
    sifted = rolled.where(own[0].isin(hashes) | own[1].isin(hashes))
    grams = sifted.withColumn("hash", F.explode(F.array_distinct(F.array(*own)))).where("hash IS NOT NULL")
    plain = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    equal = functools.reduce(lambda a, b: a & b, [F.col(f"t{i}").isNull() | (plain(F.col(f"w{i}")) == F.col(f"t{i}")) for i in range(1, PASSAGE_GRAM + 1)])
    votes = grams.join(F.broadcast(templates), "hash").where(equal).withColumn("diagonal", F.col("pos") - F.col("at"))
    span = ["_key", "text_hash", "template", "label", "base", "words", "gram"]
    # Distinct, as equal rows vote alike.
    lines = votes.groupBy(*span, "diagonal").agg(F.collect_set("at").alias("places"), F.min("at").alias("low"), F.max("at").alias("high")).withColumn("votes", F.size("places"))
    phrases = lines.where((F.col("gram") == PHRASE_GRAM) & (F.col("votes") == F.col("words") - F.col("gram") + 1))
    phrases = phrases.select(*span[:5], F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("words")).alias("end"), F.lit(1.0).alias("score"))
    order = W.partitionBy(*span).orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order)) > SLACK
    merged = lines.where(F.col("gram") == PASSAGE_GRAM).withColumn("group", F.sum(F.coalesce(fresh, F.lit(False)).cast("int")).over(order))
    # A place of the template that several diagonals of a span hold counts once.
    merged = merged.withColumn("at", F.explode("places")).groupBy(*span, "group").agg(
        F.count_distinct("at").alias("votes"), F.min(F.col("diagonal") + F.col("low")).alias("start"), (F.max(F.col("diagonal") + F.col("high")) + F.first("gram")).alias("end")
    )
    score = F.least(F.lit(1.0), (F.col("votes") + F.col("gram") - 1) / F.col("words"))
    longer = merged.withColumn("score", score).where(F.col("score") >= LEAST_COVERED).select(*span[:5], "start", "end", "score")
    return phrases.unionByName(longer).withColumnRenamed("_key", key)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", **templates) -> DataFrame:
    """One row per row of `docs`: `key`, `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`.

    `n_base` counts the places of base phrases, `first_word` and `last_word` are their
    smallest and largest start (null without one); labels are distinct, sorted and
    joined by commas; `score` is the best span's (0 without one). Other columns are not read.
    """
    found = spans(docs, key, text, **templates).withColumnRenamed(key, "_key")
    label = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.when(F.col("base"), F.col("start"))
    summed = found.groupBy("_key", "text_hash").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"), label(F.when(F.col("base"), F.col("label"))).alias("base_labels"), label("label").alias("labels"), F.max("score").alias("score")
    )
    rows = docs.select(F.col(key).alias("_key"), same_text(text).alias("text_hash"), F.size(words_column(F.col(text))).cast("long").alias("n_words"))
    rows, summed = rows.alias("r"), summed.alias("s")
    out = rows.join(summed, F.col("r._key").eqNullSafe(F.col("s._key")) & (F.col("r.text_hash") == F.col("s.text_hash")), "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select(F.col("r._key").alias(key), "n_words", zero("n_base", 0), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0))
