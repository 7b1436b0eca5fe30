"""License scans by diagonal voting, with DataFrame operations only.

Words are hashed in rolling k-grams, all of which are joined to the places where the same k-gram stands in a template.  A
hit votes for the diagonal (place in the text less place in the template); votes on one diagonal are one alignment, and
neighbouring diagonals of a template, which an inserted or missing word sets apart, are merged.  A merged alignment is
verified by the share of the template's words that its hits cover, each hit having been compared word by word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import repeated, text_of

# The phrases of the contract, and what they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Usual notices, as public licenses ask for them.
NOTICES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Places of a template in one mask.
BITS = 62
#: Diagonals this near are merged; a merged alignment is a find if its hits cover this share of the notice.
NEAR, COVER = 4, 0.6
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    gram: int
    base: bool


def templates(phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> list[Template]:
    base = [Template(label, tuple(text.split()), PHRASE_GRAM, True) for text, label in phrases.items()]
    return base + [Template(label, tuple(text.split()), NOTICE_GRAM, False) for label, text in notices]


def words_of(text: Column) -> Column:
    """Runs of digits, letters (A-Z lower-cased) and all characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), WORD_GAP), "")


def _gram_hash(size: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(size), *words)


def gram_places(spark: SparkSession, known: list[Template]) -> DataFrame:
    """A row for each k-gram of a template: its hash, the template ``t``, the place ``at``, its words w0, w1, ... (null past the
    gram), and as bits of m0, m1, ... the places in the template that it covers.  As large as the templates, a fixed list.

    One row more, t = -1, is met by each document once.
    """
    most = max((x.gram for x in known), default=1)
    masks = _masks(known)
    rows = [(-1, 0, 0, [None] * most, [0] * masks)]
    for t, x in enumerate(known):
        for at in range(len(x.words) - x.gram + 1):
            covered = range(at, at + x.gram)
            rows.append((t, at, x.gram, [*x.words[at : at + x.gram], *[None] * (most - x.gram)], [sum(1 << w % BITS for w in covered if w // BITS == k) for k in range(masks)]))
    places = spark.createDataFrame(rows, "t int, at int, gram int, words array<string>, masks array<bigint>")
    hashes = [F.when(F.col("gram") == size, _gram_hash(size, [F.get("words", F.lit(k)) for k in range(size)])) for size in sorted({0, *(x.gram for x in known)})]
    words = [F.get("words", F.lit(k)).alias(f"w{k}") for k in range(most)]
    return places.select(F.coalesce(*hashes).alias("hash"), "t", "at", "gram", *words, *[F.get("masks", F.lit(k)).alias(f"m{k}") for k in range(masks)])


def _masks(known: list[Template]) -> int:
    return -(-max((len(x.words) for x in known), default=1) // BITS)


def hits(docs: DataFrame, known: list[Template]) -> DataFrame:
    """doc_id, text_hash, n_words, and for each verified hit t, diagonal, word (its first in the text), last, m0, m1, ...

    Every row of ``docs`` has a row with t = -1 besides.  A gram is hashed where it is rolled, and compared word by word with the
    template's where the hashes are equal; no row past that holds the words of its text, and all is done in one stage.
    """
    spark = docs.sparkSession
    sizes = sorted({x.gram for x in known})
    most, masks = max(sizes, default=1), [f"m{k}" for k in range(_masks(known))]
    split = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    rolled = split.select("doc_id", "text_hash", "words", F.posexplode_outer("words").alias("word", "_"))
    word = F.coalesce(F.col("word"), F.lit(0))
    grams = [_gram_hash(size, [F.get("words", word + k) for k in range(size)]) for size in sizes]
    asked = rolled.withColumn("hash", F.explode(F.when(word == 0, F.array(*grams, _gram_hash(0, []))).otherwise(F.array(*grams))))
    met = asked.join(F.broadcast(gram_places(spark, known)), "hash")
    same = [(F.col("gram") <= k) | F.coalesce(F.get("words", word + k) == F.col(f"w{k}"), F.lit(False)) for k in range(most)]
    true = reduce(and_, same)
    return met.where(true).select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "t", (word - F.col("at")).alias("diagonal"), word.alias("word"), (word + F.col("gram") - 1).alias("last"), *masks)


def scan(docs: DataFrame, known: list[Template] | None = None, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` has for each find its label, first and last word, and cover.  ``score`` is the largest cover of the finds, 0
    without any.  A null text is empty: no words, no finds.  A very long text costs in proportion to its words and finds: its
    words are held once, and its hits are spread over rows, of which the row returned has the finds.  Ties, that is finds of
    one place, are all kept.  Rows alike in doc_id and text have the same result, are as many as there were, and are written
    in parts.  An empty table gives an empty one.  Columns other than doc_id and text aren't read, so names can't clash.
    """
    known = templates() if known is None else known
    identity = ["doc_id", "text_hash", "n_words"]
    masks = [f"m{k}" for k in range(_masks(known))]
    lengths = F.array(*[F.lit(len(x.words)) for x in known])
    labels = F.array(*[F.lit(x.label) for x in known])
    bases = F.array(*[F.lit(x.base) for x in known])
    spread = [F.min("word").alias("word"), F.max("last").alias("last"), *[F.bit_or(m).alias(m) for m in masks]]
    # One row for each document, template and diagonal; a row that repeats adds nothing to its bits.
    diagonal = hits(docs, known).groupBy(*identity, "t", "diagonal").agg(*spread, F.count("*").alias("rows"))
    run = Window.partitionBy("doc_id", "text_hash", "t").orderBy("diagonal")
    own = lambda values: F.get(values, F.when(F.col("t") >= 0, F.col("t")))
    base = F.coalesce(own(bases), F.lit(False))
    apart = F.when(base | F.lag("diagonal").over(run).isNull() | (F.col("diagonal") - F.lag("diagonal").over(run) > near), 1).otherwise(0)
    merged = diagonal.withColumn("apart", apart).withColumn("group", F.sum("apart").over(run))
    merged = merged.groupBy(*identity, "t", "group").agg(*spread, F.max(F.when(F.col("t") < 0, F.col("rows"))).alias("rows"))
    covered = reduce(add, [F.bit_count(F.col(m)) for m in masks]) / own(lengths)
    finds = merged.select(*identity, "rows", F.col("word").alias("first"), "last", covered.alias("cover"), base.alias("base"), own(labels).alias("label"))
    good = finds.withColumn("good", F.coalesce(F.when(F.col("base"), F.col("cover") == 1.0).otherwise(F.col("cover") >= cover), F.lit(False)))
    is_base = F.col("good") & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    spans = F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("first", "last", "label", "cover"))))
    result = good.groupBy(*identity).agg(
        F.max("rows").alias("rows"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("good"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("good"), F.col("cover"))), F.lit(0.0)).alias("score"),
        spans.alias("spans"),
    )
    return repeated(result, "rows", ["doc_id", "text_hash"]).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def scan_digest(docs: DataFrame) -> DataFrame:
    """``scan`` with its spans as one string, label:first:end of each, end exclusive."""
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first"], s["last"] + 1))
    return scan(docs).withColumn("spans", F.array_join(spans, ","))
