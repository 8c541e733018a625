"""License scan by diagonal voting, with DataFrame functions only.

Words are the runs of letters and digits, A-Z in lower case, and of all characters beyond ASCII. All rolling k-grams of words
(k = 2) of all documents are joined by hash with the places of the templates' k-grams; the words are compared as well, so a
collision of hashes counts nothing. A hit at word p of a document and word q of a template votes for the diagonal p - q, where the
template would start. The votes are added up by document, template and diagonal.

Base phrases stand where one diagonal holds all their k-grams. Longer notices may be edited: a word put in or left out moves the rest
of the notice to a neighbouring diagonal. Diagonals with at least ``MIN_VOTES`` votes are merged with those at most a
tolerance away, and the strongest of a neighbourhood (ties: the first) is the place of the notice. Its span, from the first to the
last word hit, is verified word by word: the hits must cover ``COVER`` hundredths of the template's words and of the span's words.

The templates are a fixed list, some hundred rows, and broadcast; no document is shuffled, only hits are. A document with
very many hits is counted by diagonal before its diagonals meet.

Defined cases: a null or empty text has no words; a null id stays null; rows that repeat an id, or are equal, are scanned each
by itself; words of very long texts are exploded row by row, a text itself is held once. An empty table gives no rows.
Only the columns named are read, so extra columns do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.llm.common import written

#: Characters between words, as a character class; A-Z belong to words and are put in lower case one word at a time.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
K = 2
MIN_VOTES = 3
#: Hundredths of words that hits must cover, of the template and of the span.
COVER = 80


@dataclass(frozen=True)
class Template:
    """A phrase or notice in lower-case ASCII words. A base phrase must stand word by word."""

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def tolerance(self) -> int:
        """How far diagonals of one place may lie apart: an eighth of the words, 1 at least."""
        return max(1, len(self.words) // 8)


# The base phrases, and notices by which licenses ask to be named, in their words.
TEMPLATES = [
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-or-later", "under the terms of the gnu general public license as published by the free software foundation "
             "either version 3 of the license or at your option any later version"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(template, q, w0, w1): every k-gram of every template at its place."""
    rows = []
    for number, t in enumerate(templates):
        if len(t.words) < K or not t.text.isascii() or t.text != t.text.lower():
            raise ValueError(f"a template needs {K} or more lower-case ASCII words: {t.text!r}")
        rows += [(number, q, *t.words[q : q + K]) for q in range(len(t.words) - K + 1)]
    return spark.createDataFrame(rows, "template int, q int, w0 string, w1 string")


def words_of(text: Column) -> Column:
    """The words of a text in their own case. Only the ends of a split can be empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case. Words with other characters are left: no template has any, and lower() would change those as well."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(word)


def hits(docs: DataFrame, templates: list[Template], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, template, p, q) of all k-gram hits, and one row without template per document; written.

    One scan: words are exploded, hashed with the next one and met with the broadcast templates in one stage.
    """
    grams = template_grams(docs.sparkSession, templates)
    grams = F.broadcast(grams.withColumn("hash", F.xxhash64("w0", "w1")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    # A null behind the last word: one row is left for every document.
    each = rows.select(
        "row", "doc_id", "words", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("p", "word")
    )
    nxt = lower_ascii(F.get("words", F.col("p") + 1))
    each = each.select(
        "row", "doc_id", "p", F.size("words").cast("long").alias("n_words"), lower_ascii(F.col("word")).alias("a"), nxt.alias("b")
    )
    # Grams of a null have a hash as well, but equal no template's words.
    found = each.withColumn("hash", F.xxhash64("a", "b")).join(
        grams.withColumnsRenamed({"w0": "t0", "w1": "t1"}), "hash", "left"
    ).where("a IS NULL OR (a = t0 AND b = t1)")
    return written(found.select("row", "doc_id", "n_words", F.when(F.col("a").isNotNull(), F.col("template")).alias("template"), "p", "q"), "licenses")


def diagonals(found: DataFrame) -> DataFrame:
    """(row, template, diagonal, votes, first, last, qs): the votes of every diagonal; ``qs`` has a template's length at most."""
    return found.where("template IS NOT NULL").groupBy("row", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"), F.collect_list("q").alias("qs")
    )


def spans(voted: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, template, base, start, end, score) of all verified places, in words, end exclusive."""
    facts = voted.sparkSession.createDataFrame(
        [(i, t.base, len(t.words), t.tolerance) for i, t in enumerate(templates)],
        "template int, base boolean, length int, tolerance int",
    )
    voted = voted.join(F.broadcast(facts), "template")
    exact = voted.where(F.col("base") & (F.col("votes") == F.col("length") - (K - 1))).select(
        "row", "template", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("end"), F.lit(1.0).alias("score")
    )
    strong = voted.where(~F.col("base") & (F.col("votes") >= MIN_VOTES))
    # One window frame for each width: the tolerance of a template is that of its diagonals.
    parts = []
    for width in sorted({t.tolerance for t in templates if not t.base}):
        near = W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-width, width)
        merged = strong.where(F.col("tolerance") == width).select(
            "row", "template", "base", "length", "diagonal", F.sum("votes").over(near).alias("votes"),
            F.min("first").over(near).alias("start"), (F.max("last").over(near) + K).alias("end"),
            F.array_distinct(F.flatten(F.collect_list("qs").over(near))).alias("qs"),
        )
        strongest = F.max(F.struct("votes", -F.col("diagonal"))).over(near)
        best = merged.withColumn("best", strongest).where(F.struct("votes", -F.col("diagonal")) == F.col("best"))
        covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + (K - 1))))))
        longer = F.greatest(F.col("length"), F.col("end") - F.col("start"))
        parts.append(best.withColumn("covered", covered).where(100 * F.col("covered") >= COVER * longer).select(
            "row", "template", "base", "start", "end", (F.col("covered") / longer).alias("score")
        ))
    for part in parts:
        exact = exact.unionByName(part)
    return exact


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[Template] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): one row (row, doc_id, n_words) per document, and all verified places with their labels."""
    found = hits(docs, templates, doc_id, text)
    labels = docs.sparkSession.createDataFrame([(i, t.label) for i, t in enumerate(templates)], "template int, label string")
    placed = spans(diagonals(found), templates).join(F.broadcast(labels), "template").drop("template")
    return found.where("template IS NULL").select("row", "doc_id", "n_words"), placed


def report(documents: DataFrame, placed: DataFrame) -> DataFrame:
    """Counts, places and labels by document. ``score`` is that of the best place, 0 without one."""
    base = F.col("base")
    by_row = placed.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )
    joined = documents.join(by_row, "row", "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
