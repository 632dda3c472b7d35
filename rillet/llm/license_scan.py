"""License scan by diagonal voting.

Every word k-gram of a document (k = 2 for the base phrases, 3 for whole notices) is joined in
Spark to the k-gram positions of all templates. A match of document position p with template position t votes for the diagonal
p - t. Votes are gathered per (document, template, diagonal); a diagonal holds each template
position at most once. Neighbouring diagonals (shifted by a few inserted or dropped words) are
merged, and each group of them is verified: the best span is the one with the longest chain of
matches whose document and template positions both rise, within a window of the template's
length plus its allowed edits. A phrase repeated many times therefore counts once.

Base phrases need all of their k-grams on one diagonal (score 1). Longer templates need a
share of ``MIN_SHARE`` of their k-grams in such a chain; their label and best share follow.

Defined cases: null and empty texts have no words and no labels (score 0); rows repeated in
full, or with one id, are counted as one document each by a row key; null ids are kept; texts
are read whole, and a document's k-grams leave its scan only where they match a template.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.words import ALNUM, pieces, windows, words_of

PHRASE_K, NOTICE_K = 2, 3
#: Diagonals this near to each other are one span.
MERGE = 3
MIN_SHARE = 0.6

# Phrases and labels of the base, and wordings of common license notices and of whole short licenses.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
        "OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        "HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "gpl-notice": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "cc-notice": [
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "copyright": ["Copyright (c) the authors. All rights reserved."],
}
#: A document's mark that matches a row of its own, so that documents without a match stay.
_ROW = 0


def templates() -> list[tuple[str, str, bool]]:
    """(label, wording, is a base phrase); a template's number is its index."""
    return [(label, text, True) for text, label in PHRASES.items()] + [
        (label, text, False) for label, texts in TEMPLATES.items() for text in texts
    ]


def _template_grams() -> list[list[int]]:
    out = []
    for _, text, is_base in templates():
        words = words_of(pa.array([text]), ALNUM)
        out.append(windows(words.hashes(), words.counts, PHRASE_K if is_base else NOTICE_K)[0].view(np.int64).tolist())
    return out


def _document_grams():
    schema = pa.schema([("n_words", pa.int64()), ("doc_id", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = words_of(batch.column("text"), ALNUM)
            hashes = words.hashes()
            # Each document's list: the mark, its k-grams for phrases, then those for notices.
            sizes = [np.ones(words.n, np.int64), *(np.maximum(words.counts - k + 1, 0) for k in (PHRASE_K, NOTICE_K))]
            offsets = np.concatenate([[0], np.cumsum(sum(sizes))])
            flat = np.full(int(offsets[-1]), _ROW, np.int64)
            for k, before in ((PHRASE_K, sizes[0]), (NOTICE_K, sizes[0] + sizes[1])):
                grams, row, at = windows(hashes, words.counts, k)
                flat[(offsets[:-1] + before)[row] + at] = np.where(grams == _ROW, 1, grams.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(words.counts.astype(np.int64)), batch.column("doc_id").cast(pa.int64()), lists], schema=schema)

    return run, "n_words long, doc_id long, grams array<long>"


def votes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, template, diagonal, held): matches of each document by diagonal; a row without, too.

    ``held``: the template positions matched on the diagonal, each once.
    """
    spark = docs.sparkSession
    rows = [(_ROW, -1, 0)]
    for number, grams in enumerate(_template_grams()):
        rows += [(g, number, at) for at, g in enumerate(grams)]
    # A fixed table: one row for each word of the templates.
    table = F.broadcast(spark.createDataFrame(rows, "gram long, template int, at long"))
    grams = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(*_document_grams())
    keyed = grams.withColumn("row", F.monotonically_increasing_id())
    matched = keyed.select("row", "doc_id", "n_words", F.posexplode("grams").alias("place", "gram")).join(table, "gram")
    # The k-grams of notices come after the mark and the n_words - 1 of phrases.
    n_phrase = F.greatest(F.col("n_words") - (PHRASE_K - 1), F.lit(0))
    is_phrase = F.col("template") < len(PHRASES)
    start = F.col("place") - 1 - F.when(is_phrase, F.lit(0)).otherwise(n_phrase) - F.col("at")
    # A phrase's hash among the notices' k-grams, or the other way round, is no match.
    right = (F.col("template") < 0) | (is_phrase == (F.col("place") <= n_phrase))
    return (
        matched.where(right)
        .groupBy("row", "doc_id", "n_words", "template", F.when(F.col("template") >= 0, start).alias("diagonal"))
        .agg(F.collect_list("at").alias("held"))
    )


def _chain(span: list[tuple[int, int]]) -> int:
    """The most matches of a span, (document position, template position), that rise in both."""
    tails: list[int] = []
    # At one document position only one match counts: falling template positions can't follow each other.
    for _, t in sorted(span, key=lambda x: (x[0], -x[1])):
        i = bisect_left(tails, t)
        tails[i : i + 1] = [t]
    return len(tails)


def verified(diagonals: list[tuple[int, list[int]]], size: int) -> int:
    """The longest chain of a template's matches within one span; ``diagonals``: (diagonal, template positions held).

    A span lies on diagonals at most ``MERGE`` apart, one by one, and is as long as the template's
    ``size`` k-grams plus the share of them that may be missing. Only spans with enough distinct
    template positions to beat the best one so far are searched.
    """
    length = size + max(MERGE, math.ceil((1 - MIN_SHARE) * size))
    groups: list[list[tuple[int, int]]] = []
    last = None
    for d, held in sorted(diagonals):
        if last is None or d - last > MERGE:
            groups.append([])
        groups[-1] += [(d + t, t) for t in held]
        last = d
    best = 0
    for points in groups:
        points.sort()
        inside: Counter[int] = Counter()
        begin = 0
        for end, (p, t) in enumerate(points):
            inside[t] += 1
            while points[begin][0] <= p - length:
                inside[points[begin][1]] -= 1
                if not inside[points[begin][1]]:
                    del inside[points[begin][1]]
                begin += 1
            if len(inside) > best:
                best = max(best, _chain(points[begin : end + 1]))
    return best


def _judge():
    listed = templates()
    sizes = [max(len(g), 1) for g in _template_grams()]

    @F.pandas_udf("n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def judge(found: pd.Series) -> pd.DataFrame:
        out = []
        for own in found:
            by: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
            for v in own:
                by[v["template"]].append((int(v["diagonal"]), [int(t) for t in v["held"]]))
            places, base, labels, score = [], set(), set(), 0.0
            for number, diagonals in by.items():
                label, _, is_base = listed[number]
                if is_base:
                    starts = [d for d, held in diagonals if len(held) == sizes[number]]
                    if starts:
                        places += starts
                        base.add(label)
                        score = 1.0
                    continue
                share = verified(diagonals, sizes[number]) / sizes[number]
                if share >= MIN_SHARE:
                    labels.add(label)
                    score = max(score, share)
            out.append(
                (
                    len(places),
                    min(places, default=None),
                    max(places, default=None),
                    ",".join(sorted(base)),
                    ",".join(sorted(base | labels)),
                    score,
                )
            )
        frame = pd.DataFrame(out, columns=["n_base", "first_word", "last_word", "base_labels", "labels", "score"])
        return frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return judge


def digest(docs: DataFrame) -> DataFrame:
    """Every row's n_words, phrase places, labels and score."""
    vote = F.when(F.col("template") >= 0, F.struct("template", "diagonal", "held"))
    found = votes(docs).groupBy("row", "doc_id", "n_words").agg(F.collect_list(vote).alias("votes"))
    return found.select("doc_id", "n_words", _judge()("votes").alias("j")).select("doc_id", "n_words", "j.*")
