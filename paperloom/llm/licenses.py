"""License scans by diagonal voting.

Templates (phrases of a few words, and notices) and documents are cut into rolling grams of GRAM words, or of all words of a
shorter template. A Spark join meets the documents' gram hashes with the template positions; only grams that a bit map of the
templates' hashes lets through are sent to it. A meeting at document word p and template word q votes for the diagonal p - q. Votes
are summed by diagonal, neighbouring diagonals (a few words inserted or left out) are merged to a span, and the span is verified:
its grams are compared as text, and the share of the template's words that they cover must reach LEAST. A phrase needs all of
its words in a row. Of notices whose spans overlap, the one with most words found counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bits, Texts, batch_of, blocks, column, cut, documents, ints, join_hot, mix, randoms, small_batches

GRAM = 4
#: Share of a notice's words that a span must cover.
LEAST = 0.7
#: Diagonals of a template of n words are neighbours up to n // DRIFT apart, and up to MOST_DRIFT.
DRIFT, MOST_DRIFT = 8, 4
#: Template positions that are broadcast; a larger table is joined by a shuffle with split hot grams.
BROADCAST = 50_000

#: Phrases with their labels, which are the base.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: Opening notices of licenses, as published with them.
NOTICES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)

_R = randoms(GRAM, 23)
#: What parts words: every ASCII character but digits and letters.
_APART = np.zeros(256, bool)
_APART[:128] = [not chr(c).isalnum() for c in range(128)]

GRAMS = pa.list_(pa.struct([("k", pa.int32()), ("pos", pa.int32()), ("hash", pa.int64()), ("gram", pa.string())]))
SCANNED = pa.schema([("uid", pa.int64()), ("n_words", pa.int64()), ("grams", GRAMS)])


def _scan(ks: list[int] | None, bits: Bits | None):
    """Words of every text and its grams of each length in ks that pass the bit map; ks None: the longest a text has, up to GRAM."""

    def scan(batches):
        for b in blocks(batches):
            texts = Texts(column(b, "text"))
            starts, lengths, doc, h = texts.words(apart=_APART)
            n = np.bincount(doc, minlength=texts.n)
            at = np.concatenate(([0], np.cumsum(n)))
            place = np.arange(len(doc)) - at[doc]
            left = at[doc + 1] - np.arange(len(doc)) if len(doc) else place
            parts = []
            for k in range(1, GRAM + 1) if ks is None else ks:
                first = np.flatnonzero(left >= k)
                if ks is None:
                    first = first[np.minimum(n[doc[first]], GRAM) == k]
                if not len(first):
                    continue
                gram = np.zeros(len(first), np.uint64)
                for j in range(k):
                    gram += h[first + j] * _R[j]
                gram = mix(gram + np.uint64(k)).view(np.int64)
                if bits is not None:
                    near = bits.has(gram)
                    first, gram = first[near], gram[near]
                parts.append((np.full(len(first), k), first, gram))
            ks_, first, gram = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
            order = np.argsort(first, kind="stable")
            ks_, first, gram = ks_[order], first[order], gram[order]
            low = lambda w: texts.data[starts[w] : starts[w] + lengths[w]].tobytes().lower()
            words = [b" ".join(low(w + j) for j in range(k)).decode() for w, k in zip(first.tolist(), ks_.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=texts.n)))) if len(first) else np.zeros(texts.n + 1), pa.int32()),
                pa.StructArray.from_arrays([pa.array(ks_, pa.int32()), pa.array(place[first], pa.int32()), pa.array(gram, pa.int64()), pa.array(words, pa.string())], ["k", "pos", "hash", "gram"]),
            )
            yield batch_of(SCANNED, ints(b, "uid"), n, lists)

    return scan


SCHEMA = "uid long, n_words long, grams array<struct<k:int,pos:int,hash:bigint,gram:string>>"


def template_table(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    rows = [(k, label, text, k < len(phrases)) for k, (label, text) in enumerate([*phrases, *notices])]
    return spark.createDataFrame(rows, "template long, label string, text string, phrase boolean")


def find_spans(docs: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """docs: doc_id, text. Returns a row for every row of docs: uid, doc_id, n_words and spans (sorted; start, end, label, phrase, likeness), null if there are none.

    templates: template, label, text, phrase. Words are counted from 0, ends are exclusive.
    """
    small_batches(docs.sparkSession)
    grams = templates.select(F.col("template").alias("uid"), "text").mapInArrow(_scan(None, None), SCHEMA)
    grams = grams.join(templates.select(F.col("template").alias("uid"), "label", "phrase"), "uid").select(F.col("uid").alias("template"), "label", "phrase", F.col("n_words").cast("int").alias("n"), F.explode("grams").alias("g"))
    grams = cut(grams.select("template", "label", "phrase", "n", "g.k", F.col("g.pos").alias("q"), "g.hash", "g.gram"))
    bits, ks = Bits.of(grams, "hash"), sorted(r.k for r in grams.select("k").distinct().collect())  # GRAM lengths at most
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    ids = rows.select("uid", "doc_id", F.col("text"))
    scan = _scan(ks, bits)

    def keep_ids(batches):
        for b in blocks(batches):
            for out in scan([b]):
                yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *out.columns], ["doc_id", *out.schema.names])

    scanned = cut(ids.mapInArrow(keep_ids, "doc_id long, " + SCHEMA))
    hits = scanned.select("uid", F.explode("grams").alias("g")).select("uid", "g.k", "g.pos", "g.hash", "g.gram")
    votes = hits.join(F.broadcast(grams), ["k", "hash", "gram"]) if grams.count() <= BROADCAST else join_hot(cut(hits), grams, ["k", "hash", "gram"], by="uid")
    same = ["template", "label", "phrase", "n", "k"]
    diagonal = votes.groupBy("uid", *same, (F.col("pos") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("at"))
    near = F.when(F.col("phrase"), 0).otherwise(F.least(F.floor(F.col("n") / DRIFT), F.lit(MOST_DRIFT)))
    line = Window.partitionBy("uid", "template").orderBy("diagonal")
    diagonal = diagonal.withColumn("apart", (F.col("diagonal") - F.lag("diagonal").over(line) > near).cast("int")).withColumn("place", F.sum(F.coalesce("apart", F.lit(0))).over(line))
    merged = diagonal.groupBy("uid", *same, "place").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min(F.col("diagonal") + F.array_min("at")).alias("start"), F.max(F.col("diagonal") + F.array_max("at") + F.col("k")).alias("end")
    )
    found = F.size(F.array_distinct(F.flatten(F.transform("at", lambda q: F.sequence(q, q + F.col("k") - 1)))))
    spans = merged.withColumn("found", found).withColumn("likeness", F.col("found") / F.col("n"))
    spans = spans.filter(F.col("likeness") >= F.when(F.col("phrase"), 1.0).otherwise(least))
    by_start = Window.partitionBy("uid", "phrase").orderBy("start", "end", "template")
    spans = spans.withColumn("reach", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("group", F.sum(F.when(F.col("phrase") | F.col("reach").isNull() | (F.col("start") >= F.col("reach")), 1).otherwise(0)).over(by_start))
    best = Window.partitionBy("uid", "phrase", "group").orderBy(F.desc("found"), F.desc("likeness"), "label", "start", "template")
    spans = spans.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    each = spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "phrase", "likeness"))).alias("spans"))
    return scanned.select("uid", "doc_id", "n_words").join(each, "uid", "left")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """The license phrases and notices of every whole text: a row for each row of docs.

    n_base counts the places of phrases, first_word and last_word are their smallest and largest start (null if there are none). base_labels and
    labels are empty without any. score is the greatest likeness: the share of its template's words that a span covers, 1 for a phrase.
    spans lists label:start:end of all spans. Null and empty texts have no words. Long texts are read whole. Rows that repeat an id and null ids each
    keep their row. Notices that overlap with equally many words and likeness go to the label first in the alphabet, then to the first start. An
    empty table gives an empty result; other columns, whatever their names, are left alone.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = find_spans(rows, template_table(docs.sparkSession) if templates is None else templates, least)
    none = F.array().cast("array<struct<start:int,end:int,label:string,phrase:boolean,likeness:double>>")
    found = found.withColumn("spans", F.coalesce("spans", none))
    base = F.filter("spans", lambda s: s.phrase)
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    starts = F.transform(base, lambda s: s.start.cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.likeness)), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.label, s.start.cast("string"), s.end.cast("string"))), ",").alias("spans"),
    )


def query(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))
