"""Operator 9. License scans by diagonal voting. DataFrame functions only.

Texts become words, and all rolling k-grams of words are hashed. They are joined to the places of the templates' k-grams
by hash, and the words compared; a match votes for the diagonal: its place in the document less its place in the
template. Votes are counted by diagonal. A base phrase stands wherever its diagonal has all its votes.

Of the longer templates, neighbouring diagonals are merged, which bridges words put in or left out. They are dealt to bins
twice as wide as the drift that a template's size allows, and again to bins moved by half, so diagonals no further apart
than the drift share a bin, and no cluster is wider than a bin. A cluster whose votes cover at least `enough` of the
template's words is a candidate. Its span, from its first vote to its last, is then verified as a whole: the words of span
and template are aligned by edit distance, each template word standing for a character. Edits may be at most 1 - `least`
of the longer one's words; a template of fewer than ten words must stand as it is. Of spans that overlap, the one with
most words aligned stays, so a notice that is a part of another, or differs from it by a word, isn't told twice.

Two-word phrases have two-grams, all other templates three-grams. Two-grams are taken only from texts that contain the
last word of such a phrase. Templates are a fixed, short list, which is what makes their broadcast small. One row
for each document goes through the join beside its k-grams, so texts are split into words once; only texts with a
candidate are read again, each different one once.

Defined results: a null text has no words; documents without a match have n_base 0, no places, empty labels and the score
0. The score is the largest share of words aligned, 1 for a base phrase. Every row of a repeated id is judged by
itself. An empty table gives an empty table. Columns other than the id and the text are not read, and may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The phrases of the contract and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Texts and notices of public licenses, and their labels. Only their words count.
TEXTS = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""", "mit"),
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction""", "mit"),
    ("Released under the MIT License", "mit"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""", "apache"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "gpl"),
    ("This work is licensed under the GNU General Public License", "gpl"),
    ("""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""", "lgpl"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "agpl"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.""", "bsd"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met""", "bsd"),
    ("""THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", "bsd"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.""", "isc"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely""", "zlib"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "mpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl"),
    ("""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software""", "bsl"),
    ("""This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available
at""", "epl"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means.""", "unlicense"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("Licensed under CC0 1.0", "cc0"),
)
#: The licenses of Creative Commons by their short and long names.
COMMONS = (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivatives"), ("by-nc", "attribution noncommercial"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"))


def plain_words(text: str) -> str:
    """A template's words, joined by blanks."""
    return " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower()))


NOTICES = (
    *((plain_words(text), label) for text, label in TEXTS),
    *((plain_words(f"licensed under CC {short}"), f"cc-{short}") for short, _ in COMMONS),
    *((plain_words(f"licensed under a Creative Commons {long}"), f"cc-{short}") for short, long in COMMONS),
)
#: Words of a k-gram; the share of a template's words that may be edited, and that votes must cover; words of drift at most,
#: and of a template for each word of drift.
K, LEAST, ENOUGH, DRIFT, DRIFT_WORDS = 3, 0.8, 0.5, 16, 8
ROW = "a row for each document"


def words_of(text: Column) -> Column:
    """Runs of digits, letters in lower case, and all that isn't ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def drift_of(size: int) -> int:
    """How far apart the diagonals of a cluster may be; repetitions of a template are further apart than two such."""
    return min(DRIFT, size // DRIFT_WORDS)


def templates(spark, base, notices) -> DataFrame:
    """(k, gram, at, template, is_base, drift) for each k-gram of each template, and the row of k = 0."""
    rows = [(0, [ROW], 0, -1, False, 0)]
    for i, (text, _) in enumerate([*base, *notices]):
        words = text.split(" ")
        if len(words) < 2 or not re.fullmatch("[0-9a-z\x80-\U0010ffff ]+", text):
            raise ValueError(f"{text!r}: words in lower case, two at least")
        if len(set(words)) > 255 or (len(words) < K and i >= len(base)):
            raise ValueError(f"{text!r}: a notice has three words at least, and 255 different ones at most")
        k = min(K, len(words))
        rows += [(k, words[p : p + k], p, i, i < len(base), drift_of(len(words))) for p in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "k int, gram array<string>, at int, template int, is_base boolean, drift int")
    return df.withColumn("hash", F.when(F.col("k") == 0, F.lit(0).cast("long")).when(F.col("k") == 2, gram_hash(F.col("gram"), F.lit(0), 2)).otherwise(gram_hash(F.col("gram"), F.lit(0), K)))


def whole_templates(spark, base, notices) -> DataFrame:
    """(template, label, size, vocabulary, code): a template's different words, and the template with each word as the character
    of its place among them."""
    rows = []
    for i, (text, label) in enumerate([*base, *notices]):
        words = text.split(" ")
        vocabulary = list(dict.fromkeys(words))
        rows.append((i, label, len(words), vocabulary, "".join(chr(vocabulary.index(w) + 1) for w in words)))
    return spark.createDataFrame(rows, "template int, label string, size int, vocabulary array<string>, code string")


def gram_hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def clusters_of(docs: DataFrame, base, notices, id_col: str, text_col: str) -> DataFrame:
    """(row, id, hash, bytes, n_words, template, is_base, k, bin, ats, first, last): merged votes with the first and last places of
    matched k-grams, and the row of k = 0 of each document."""
    ends = sorted({t.split(" ")[-1] for t, _ in base if t.count(" ") == 1})
    n = F.size("words")
    rolling = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: gram_hash(F.col("words"), i, k))).otherwise(F.array().cast("array<bigint>"))
    some = F.lit(False)
    for word in ends:
        some = some | F.array_contains("words", word)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.octet_length(text_col).alias("bytes"), words_of(F.col(text_col)).alias("words"))
    zero = F.array(F.lit(0).cast("long"))
    twos = F.when(some, rolling(2)).otherwise(F.array().cast("array<bigint>"))
    exploded = texts.select("row", "id", "text_hash", "bytes", "words", n.alias("n_words"), F.posexplode(F.concat(zero, rolling(K), twos)).alias("i", "hash"))
    threes = F.greatest(F.col("n_words") - (K - 1), F.lit(0))
    place = F.when(F.col("i") == 0, 0).when(F.col("i") <= threes, F.col("i") - 1).otherwise(F.col("i") - 1 - threes)
    votes = (
        exploded.join(F.broadcast(templates(docs.sparkSession, base, notices)), "hash")
        .withColumn("place", place)
        .filter((F.col("k") == 0) | (F.slice("words", F.col("place") + 1, F.col("k")) == F.col("gram")))
        .withColumn("diagonal", F.col("place") - F.col("at"))
    )
    width = 2 * F.col("drift")
    bins = F.when((F.col("k") == 0) | F.col("is_base") | (width == 0), F.array(F.struct(F.lit(0).alias("turn"), F.col("diagonal").cast("long").alias("at")))).otherwise(
        F.array(*[F.struct(F.lit(turn).alias("turn"), F.floor((F.col("diagonal") + turn * F.col("drift")) / width).alias("at")) for turn in (0, 1)])
    )
    key = ["row", "id", "text_hash", "bytes", "n_words", "template", "is_base", "k"]
    return votes.select(*key, "at", "place", F.explode(bins).alias("bin")).groupBy(*key, "bin").agg(F.collect_set("at").alias("ats"), F.min("place").alias("first"), F.max("place").alias("last"))


def covered(ats: Column, k: Column) -> Column:
    """How many words of a template the k-grams at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(ats, lambda p: F.sequence(p, p + k - 1)))))


def verified(docs: DataFrame, candidates: DataFrame, whole: DataFrame, least: float, text_col: str) -> DataFrame:
    """(row, spans): the candidates' spans whose words align with their template's, none of two that overlap."""
    spans = candidates.select("text_hash", "bytes", "template", "first", "last").distinct()
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.octet_length(text_col).alias("bytes"), F.col(text_col).alias("text"))
    # Copies become one before they are dealt out by their hash.
    texts = texts.groupBy("text_hash", "bytes").agg(F.first("text").alias("text")).join(spans.select("text_hash", "bytes").distinct(), ["text_hash", "bytes"])
    of = spans.join(texts, ["text_hash", "bytes"]).join(F.broadcast(whole), "template")
    own = F.slice(words_of(F.col("text")), F.col("first") + 1, F.col("last") - F.col("first"))
    coded = F.array_join(F.transform(own, lambda w: F.char(F.array_position(F.col("vocabulary"), w))), "")
    longer = F.greatest("size", F.col("last") - F.col("first"))
    edits = F.levenshtein(coded, F.col("code"))
    few = F.when(F.col("size") * (1 - least) < 2 - 1e-9, F.lit(0)).otherwise(F.floor(longer * (1 - least) + 1e-9))
    sound = of.withColumn("edits", edits).filter(F.col("edits") <= few).select("text_hash", "bytes", "template", "first", "last", "label", (longer - F.col("edits")).alias("aligned"), ((longer - F.col("edits")) / longer).alias("share"))
    span = F.struct("label", F.col("first").cast("long").alias("first"), (F.col("last") - 1).cast("long").alias("last"), "share", "aligned")
    by_row = candidates.join(sound, ["text_hash", "bytes", "template", "first", "last"]).groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    better = lambda s, t: (t["first"] <= s["last"]) & (s["first"] <= t["last"]) & (t["aligned"] > s["aligned"])
    return by_row.select("row", F.filter("spans", lambda s: ~F.exists("spans", lambda t: better(s, t))).alias("spans"))


def scan(docs: DataFrame, base=BASE, notices=NOTICES, least: float = LEAST, enough: float = ENOUGH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row; spans are those of the
    notices: label, first word, last word, share and number of words aligned."""
    whole = whole_templates(docs.sparkSession, base, notices)
    clusters = written(clusters_of(docs, base, notices, id_col, text_col), "license-votes").join(F.broadcast(whole.select("template", "label", "size")), "template", "left")
    shares = clusters.withColumn("covered", covered(F.col("ats"), F.col("k")) / F.col("size"))
    candidates = shares.filter(~F.col("is_base") & (F.col("covered") >= enough)).select("row", "text_hash", "bytes", "template", "first", (F.col("last") + F.col("k")).alias("last"))
    start = F.when(F.col("is_base") & (F.col("covered") == 1), F.col("first"))
    by_row = shares.filter("is_base or k = 0").groupBy("row", F.col("id").alias(id_col), "n_words").agg(
        F.count(start).alias("n_base"),
        F.min(start).cast("long").alias("first_word"),
        F.max(start).cast("long").alias("last_word"),
        F.collect_set(F.when(start.isNotNull(), F.col("label"))).alias("base"),
    )
    joined = by_row.join(verified(docs, candidates, whole, least, text_col), "row", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<label: string, first: bigint, last: bigint, share: double, aligned: int>>"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return joined.withColumn("spans", spans).select(
        id_col,
        F.col("n_words").cast("long").alias("n_words"),
        "n_base",
        "first_word",
        "last_word",
        text(F.col("base")).alias("base_labels"),
        text(F.array_union("base", "spans.label")).alias("labels"),
        F.greatest((F.col("n_base") > 0).cast("double"), F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
        "spans",
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
