"""License scans by diagonal voting.

Templates are the words of license notices and of whole license texts. All rolling word ``K``-gram hashes of a document
are joined to the template positions that have the hash; a match at document word p and template word t votes for the
diagonal p - t. Votes are summed by (document, template, diagonal). Diagonals at most ``SHIFT`` apart are merged, since
a word put in or left out moves the rest to a neighbouring diagonal, but only over a drift of a quarter of the
template's words: a longer chain is cut into ranges that overlap by half. A merged span is verified by aligning it: the
longest run of matched words whose places rise in the document and in the template alike. Its share is that of the template's words or of the
span's, whichever are more, so text put between the words counts against it as words left out do, or that of the
template's grams, if less. A notice gets its label at a share of ``VERIFIED``; a phrase at an exact place only, which is a diagonal with all of its grams.

Grams that occur in no template are left out where they are made (a semi-join with the template table, whose
size is fixed), so what is joined and shuffled follows the license text in the corpus, not the corpus.

Defined cases: null text is empty (no words, no labels, score 0); repeated rows and equal ids are rows of their
own; of equally long alignments of a span one is told, by the order of places; a text of any length is read whole, in a block of its own (some ten
bytes a byte), and no span is longer than its template and the drift; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadloom.llm.columnar import ALNUM, Words, blocks
from roadloom.session import cut

K, SHIFT, VERIFIED = 3, 3, 0.75

# Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Sentences of well-known license notices, and their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution 4 0 international license", "cc-by-4"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa-4"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
]
# The words of whole license texts and file headers, and their labels.
TEXTS = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including "
        "all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any "
        "damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions "
        "of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the "
        "above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license "
        "at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and "
        "limitations under the license",
        "apache-2",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl-3",
    ),
]


def template_grams(templates: list[tuple[str, str]], k: int = K) -> list[tuple[int, int, int]]:
    """(template, first word, hash as a signed long) of every k-gram."""
    column = pa.array([t for t, _ in templates])
    out = []
    for first, data, offsets in blocks(column):
        words = Words(data, offsets, ALNUM)
        hashes, at = words.runs(words.hashes(), k)
        doc = words.doc[at]
        out += zip((first + doc).tolist(), (at - words.bounds[doc]).tolist(), hashes.view(np.int64).tolist())
    return out


def votes(docs: DataFrame, templates: list[tuple[str, str]], k: int = K) -> tuple[DataFrame, DataFrame]:
    """The documents (``row, doc_id, n_words``) and the votes (``row, template, diagonal, votes, tpos``)."""
    grams = template_grams(templates, k)
    known = np.unique(np.array([h for _, _, h in grams], np.int64))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                hashes, at = words.runs(words.hashes(), k)
                hashes = hashes.view(np.int64)
                spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[spot] == hashes)
                doc = words.doc[at[hit]]
                splits = pa.array(np.searchsorted(doc, np.arange(words.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(splits, pa.array(x)) for x in (at[hit] - words.bounds[doc], hashes[hit])]
                yield pa.record_batch([batch.column(0).slice(first, words.n), pa.array(words.counts), *lists], ["doc_id", "n_words", "pos", "gram"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(find, "doc_id long, n_words long, pos array<long>, gram array<long>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    places = docs.sparkSession.createDataFrame(grams, "template int, tpos long, gram long")  # as many rows as the templates have words
    found = rows.where(F.size("gram") > 0).select("row", F.explode(F.arrays_zip("pos", "gram")).alias("x")).select("row", "x.pos", "x.gram")
    cast = found.join(F.broadcast(places), "gram").groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    return rows.select("row", "doc_id", "n_words"), cast.agg(F.count(F.lit(1)).alias("votes"), F.collect_set("tpos").alias("tpos"))


def drift(words: int) -> int:
    """How far diagonals of one span may stand apart."""
    return max(SHIFT, words // 4)


def align(hits: list[tuple[int, int]], k: int = K) -> tuple[int, int, int]:
    """The most words in rising places of gram matches (document word, template word); the first and the last such document word."""
    words = sorted({(p + i, t + i) for p, t in hits for i in range(k)}, key=lambda x: (x[0], -x[1]))
    tails: list[int] = []  # least template word that ends a run of each length
    ends: list[tuple[int, int]] = []  # first and last document word of that run
    for p, t in words:
        at = bisect_left(tails, t)
        run = (ends[at - 1][0] if at else p, p)
        if at == len(tails):
            tails.append(t)
            ends.append(run)
        else:
            tails[at], ends[at] = t, run
    return (len(tails), *ends[-1])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, template, label, words, hits): the share and first word of each span."""
    for batch in batches:
        share, first = [], []
        for words, hits in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            held, begin, end = align([(h["diagonal"] + t, t) for h in hits for t in h["tpos"]])
            grams = len({t for h in hits for t in h["tpos"]})
            share.append(min(held / max(words, end - begin + 1), grams / max(words - K + 1, 1)))
            first.append(begin)
        yield pa.record_batch([*batch.columns[:3], pa.array(share, pa.float64()), pa.array(first, pa.int64())], ["row", "template", "label", "share", "first"])


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = [*NOTICES, *TEXTS]) -> DataFrame:  # noqa: B006
    """One row per document: exact places of the phrases, labels of phrases and verified notices, and a score.

    ``score`` is the best share of a span, 1 for an exact place. ``spans`` lists the verified spans as label:first
    word:share.
    """
    templates = [*phrases, *notices]
    rows, cast = votes(docs, templates)
    about = [(k, label, len(text.split()), drift(len(text.split())), k < len(phrases)) for k, (text, label) in enumerate(templates)]
    cast = cut(cast.join(F.broadcast(docs.sparkSession.createDataFrame(about, "template int, label string, words int, drift int, phrase boolean")), "template"))
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > SHIFT, F.lit(True)).cast("int")
    chains = cast.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(near))
    chain = Window.partitionBy("row", "template", "chain")
    half = F.col("drift") + 1 - F.floor(F.col("drift") / 2)
    nth = F.floor((F.col("diagonal") - F.col("low")) / half)
    parts = F.when(F.col("high") - F.col("low") <= F.col("drift"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.greatest(nth - 1, F.lit(0).cast("long")), nth))
    chains = chains.withColumns({"low": F.min("diagonal").over(chain), "high": F.max("diagonal").over(chain)}).withColumn("part", F.explode(parts))
    spans = chains.groupBy("row", "template", "label", "words", "chain", "part").agg(F.collect_list(F.struct("diagonal", "tpos")).alias("hits"))
    spans = spans.select("row", "template", "label", "words", "hits").mapInArrow(_align, "row long, template int, label string, share double, first long")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    whole = cast.where(F.col("phrase") & (F.col("votes") == F.col("words") - K + 1))
    exact = whole.groupBy("row").agg(F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base"))
    verified = (F.col("template") >= len(phrases)) & (F.col("share") >= VERIFIED)
    found = spans.groupBy("row").agg(
        F.collect_set(F.when(verified, F.col("label"))).alias("more"),
        F.max("share").alias("score"),
        joined(F.when(verified, F.concat_ws(":", "label", F.col("first").cast("string"), F.format_number("share", 3)))).alias("spans"),
    )
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base", none), F.coalesce("more", none)
    return rows.join(found, "row", "left").join(exact, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
