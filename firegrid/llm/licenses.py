"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a line, a window of a long line, or a window of the whole text across its line
breaks. A block matches a template if it holds at
least THRESHOLD of the template's distinct words. Blocks are projected on the templates'
words, which no other word can change; the words of all surviving blocks and templates are
ordered by their global frequency, rarest first. Length, prefix and positional filters
leave few candidates, which are verified exactly. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import checkpoint

#: Words of the lower-cased text; A-Z stands here for texts that are not lower-cased.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases and their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Templates of the usual notices and their labels, lower-cased words only (fixed values).
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("this library is free software under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
    ("all rights reserved", "all-rights-reserved"),
)
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
#: Words of a block at most, and the step between the blocks of a longer line: any BLOCK_WORDS - BLOCK_STEP words in a row
#: stand in one block, which is more than the longest template has.
BLOCK_WORDS, BLOCK_STEP = 96, 48
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased as far as ASCII letters go: the two other characters that lower to ASCII stay out."""
    odd = F.contains(text, F.lit("\u212A")) | F.contains(text, F.lit("\u0130"))
    return F.lower(F.when(odd, F.regexp_replace(text, "[\u212A\u0130]", "\u00E0")).otherwise(text))


def count_words(text: Column) -> Column:
    """Words of a text: the pieces between separators without the empty ones at its ends."""
    pieces = F.split(text, _SEPARATOR + "+", -1)
    ends = (F.element_at(pieces, 1) == "").cast("int") + (F.element_at(pieces, -1) == "").cast("int")
    return F.greatest(F.size(pieces) - ends, F.lit(0)).cast("long")


def _holds_all(low: Column, words: list[str]) -> Column:
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out & F.contains(low, F.lit(w))
    return out


def _firsts(sets, needed) -> list[str]:
    """The words of the templates' prefixes in the order by length.

    A block with `need` of a template's n words holds one of any n - need + 1 of them, so
    what holds none cannot match; long words are rare before frequencies are known.
    """
    return sorted({w for s, need in zip(sets, needed, strict=True) for w in sorted(s, key=lambda w: (-len(w), w))[: len(s) - need + 1]})


def _may_match(low: Column, firsts: list[str]) -> Column:
    """Whether a text holds a word of some template's prefix in the order by length."""
    out = F.lit(False)
    for w in firsts:
        out = out | F.contains(low, F.lit(w))
    return out


def _phrase(words: str) -> str:
    inside = LICENSE_WORD[1:-2]
    return rf"(?i){words.split()[0]}{''.join(_SEPARATOR + '+' + w for w in words.split()[1:])}(?![{inside}])".replace("(?i)", rf"(?i)(?<![{inside}])", 1)


def _starts(text: Column, low: Column, phrase: str) -> Column:
    """Word numbers at which the phrase begins: the words in the pieces between the matches, summed up."""
    pieces = F.transform(F.split(text, _phrase(phrase), -1), lambda x: F.regexp_count(x, F.lit(LICENSE_WORD)))
    n = len(phrase.split())
    found = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda a, x: a + x) + (k - 1) * n
    )
    return F.when(_holds_all(low, phrase.split()) & text.rlike(_phrase(phrase)), found).otherwise(F.array().cast("array<int>"))


def _blocks(low: Column, vocabulary: list[str], least: int, firsts: list[str]) -> Column:
    """(line, window, words) of every block with at least `least` distinct template words and one of `firsts`.

    words is projected. Windows of a text of several lines have line -1; step and length let any
    BLOCK_WORDS - BLOCK_STEP words in a row stand in one of them.
    """
    known = F.array(*map(F.lit, vocabulary))
    step = lambda n: F.sequence(F.lit(0), F.greatest(n - BLOCK_WORDS + BLOCK_STEP - 1, F.lit(0)), F.lit(BLOCK_STEP))

    def windows(line: Column, at: Column) -> Column:
        words = F.regexp_extract_all(line, F.lit(LICENSE_WORD), 0)
        own = F.when(F.size(words) <= BLOCK_WORDS, F.array(F.struct(at.alias("line"), F.lit(0).alias("window"), F.array_intersect(words, known).alias("words"))))
        return own.otherwise(
            F.transform(step(F.size(words)), lambda s: F.struct(at.alias("line"), s.alias("window"), F.array_intersect(F.slice(words, s + 1, BLOCK_WORDS), known).alias("words")))
        )

    lines = F.split(low, "\n", -1)
    across = F.when(F.size(lines) > 1, F.array(low)).otherwise(F.array().cast("array<string>"))
    cut = F.flatten(F.concat(F.transform(lines, windows), F.transform(across, lambda x: windows(x, F.lit(-1)))))
    return F.filter(cut, lambda b: (F.size(b["words"]) >= least) & F.arrays_overlap(b["words"], F.array(*map(F.lit, firsts))))


def scan_licenses(docs: DataFrame, templates=NOTICES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(documents, matches).

    documents: row, doc_id, n_words, n_base, first_word, last_word, base_labels (array).
    matches: row, doc_id, line, window, template, label, containment: every pair of block
    and template that meets the threshold. Null texts count as empty: no word and no
    match. Repeated rows and null ids keep a row each; other columns are ignored.
    """
    sets = [sorted({*text.split()}) for text, _ in templates]
    needed = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    vocabulary = sorted({w for s in sets for w in s})
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.col("low")
    starts = {f"at_{k}": _starts(F.col("text"), low, phrase) for k, (phrase, _) in enumerate(PHRASES)}
    firsts = _firsts(sets, needed)
    blocks = F.when(_may_match(low, firsts), _blocks(low, vocabulary, min(needed), firsts))
    lowered = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row")).withColumn("low", ascii_lower(F.col("text")))
    rows = checkpoint(lowered.select("row", "doc_id", count_words(F.col("text")).alias("n_words"), *(x.alias(k) for k, x in starts.items()), blocks.alias("blocks")))
    places = F.concat(*(F.col(k) for k in starts))
    labels = F.array_compact(F.array(*(F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES))))
    documents = rows.select(
        "row", "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_labels"),
    )
    blocks = rows.select("row", "doc_id", F.explode("blocks").alias("b")).select("row", "doc_id", "b.*")
    return documents, similarity_join(blocks, templates, sets, needed, vocabulary)


def similarity_join(blocks: DataFrame, templates, sets, needed, vocabulary) -> DataFrame:
    """Every (block, template) whose overlap reaches `needed`.

    The order of the words is collected; it has no more rows than the templates have
    words. The index of template prefixes has at most as many, and is broadcast.
    """
    spark = blocks.sparkSession
    counts = {r["word"]: r["count"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    ranked = [sorted(s, key=rank.get) for s in sets]
    index = spark.createDataFrame(
        [
            (rank[w], k, at, len(s), need, templates[k][1], [rank[x] for x in s])
            for k, (s, need) in enumerate(zip(ranked, needed, strict=True))
            for at, w in enumerate(s[: len(s) - need + 1])
        ],
        "token int, template int, template_at int, template_size int, needed int, label string, template_words array<int>",
    )
    ordered = F.array(*map(F.lit, order))
    numbered = blocks.withColumn("words", F.array_sort(F.transform("words", lambda w: (F.array_position(ordered, w) - 1).cast("int"))))
    # A match shares one of the block's first |block| - least + 1 words with a template's prefix.
    prefix = numbered.select("row", "doc_id", "line", "window", "words", F.posexplode(F.slice("words", 1, F.greatest(F.size("words") - min(needed) + 1, F.lit(0)))).alias("block_at", "token"))
    candidates = (
        prefix.join(F.broadcast(index), "token")
        .filter(F.size("words") >= F.col("needed"))
        .filter(1 + F.least(F.col("template_size") - F.col("template_at"), F.size("words") - F.col("block_at")) - 1 >= F.col("needed"))
    )
    overlap = F.size(F.array_intersect("words", "template_words"))
    return (
        candidates.filter(overlap >= F.col("needed"))
        .groupBy("row", "doc_id", "line", "window", "template", "label")
        .agg(F.max(overlap / F.col("template_size")).alias("containment"))
    )


def license_report(docs: DataFrame) -> DataFrame:
    """One row a document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 with a base phrase, else the largest containment of a match, else 0.
    """
    documents, matches = scan_licenses(docs)
    found = matches.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = documents.join(found, "row", "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


