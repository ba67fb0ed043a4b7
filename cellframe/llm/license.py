"""Licence scans by a positional index of rare words, in DataFrame functions only.

Templates are runs of words with mandatory key phrases.  One pass over the texts writes, for each document, the
distinct licence words that it has, and its words in order where all key-phrase words of some template are among
them.  The licence words' inverse document frequencies are counted from that table over all documents.  Then, in
each such document, the places of its highest-IDF licence words are looked up; each place and each posting of its
word in a template imply a start by their relative position; starts on which two different words agree are where
the postings intersect.  There the key phrases must stand, word by word, and a share of the words must agree.

Base phrases go the same way, but each place of a phrase's rarest word is a start, and all words must agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, ship

#: Phrases whose every occurrence counts (base), with their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Texts of public licences and their usual notices (label, key phrases, text).
TEMPLATES = [
    ("mit", ["permission is hereby granted free of charge", "the software is provided as is"],
     """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
     this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
     "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
     FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
     CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
     CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", ["redistribution and use in source and binary forms", "redistributions of source code must retain"],
     """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
     conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
     this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
     distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
     WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
     ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
     SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"""),
    ("apache", ["licensed under the apache license version 2 0", "except in compliance with the license"],
     """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
     License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
     law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
     OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
     limitations under the License."""),
    ("gpl-notice", ["this program is free software", "under the terms of the gnu general public license"],
     """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
     version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
     implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
     details."""),
    ("lgpl-notice", ["this library is free software", "gnu lesser general public license"],
     """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
     Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
     later version."""),
    ("mpl", ["subject to the terms of the mozilla public license"],
     """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("isc", ["permission to use copy modify and or distribute this software"],
     """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
     provided that the above copyright notice and this permission notice appear in all copies."""),
    ("zlib", ["this software is provided as is without any express or implied warranty"],
     """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
     for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
     purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
     restrictions"""),
    ("unlicense", ["free and unencumbered software released into the public domain"],
     """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
     compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
     commercial or non-commercial, and by any means."""),
    ("cc0", ["dedicated to the public domain"], "This work is dedicated to the public domain under CC0"),
    ("cc", ["creative commons attribution"], "This work is licensed under a Creative Commons Attribution International License"),
    ("mit-line", ["under the mit license"], "Released under the MIT License"),
    ("apache-line", ["under the apache license"], "Licensed under the Apache License Version 2.0"),
]
#: The most highest-IDF licence words that are looked up in a document, words that a key phrase may be moved by,
#: and the share of a template's words that must agree.
RARE, SLACK, SHARE = 32, 8, 0.3
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spelled(text: str) -> list[str]:
    """The words of a template or phrase."""
    return [w for w in re.split(_SEPARATORS, text.lower()) if w]


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing; null is empty.

    The two non-ASCII capitals whose lower-case form begins with an ASCII letter are first replaced by
    letters that have none, so that ASCII words are those of an A-Z lower-casing."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    return F.filter(F.split(F.lower(plain), _SEPARATORS), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _text(ws: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in ws])


def _stands(ws: Column, phrase: Column, at: Column) -> Column:
    return (at >= 0) & (F.slice(ws, F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase)


def scanned(docs: DataFrame, known: list[tuple[list[str], list[list[str]]]]) -> DataFrame:
    """doc_id, n_words, found (distinct licence words) and ws (all words in order, where all words of the key phrases of
    one of the `known` templates (words, key phrases) are found; else null)."""
    vocabulary = _text(sorted({w for ws, _ in known for w in ws}))
    needed = F.array(*[_text(sorted({w for k in keys for w in k})) for _, keys in known])
    able = lambda found: F.exists(needed, lambda t: F.forall(t, lambda w: F.array_contains(found, w)))
    row = _let(words(F.col("text")), lambda ws: _let(F.array_intersect(ws, vocabulary), lambda found: F.struct(
        F.size(ws).alias("n_words"), found.alias("found"), F.when(able(found), ws).alias("ws"))))
    return docs.select("doc_id", row.alias("r")).select("doc_id", "r.n_words", "r.found", "r.ws")


def by_rarity(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The licence words, highest inverse document frequency first (words of equal frequency in their own order)."""
    found = rows.select(F.explode("found").alias("word")).groupBy("word").count()
    df = {r[0]: r[1] for r in found.collect()}  # the vocabulary's size at most
    return sorted(vocabulary, key=lambda w: (df.get(w, 0), w))


def _starts(ws: Column, rare: Column, template: list[str]) -> Column:
    """Starts of a template on which two different rare words of the document agree (one, if the template has one)."""
    t, indexes = _text(template), F.sequence(F.lit(0), F.lit(len(template) - 1))
    places = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.array_contains(rare, F.get(ws, i)))
    postings = lambda i: F.filter(indexes, lambda a: F.get(t, a) == F.get(ws, i))
    votes = F.flatten(F.transform(places, lambda i: F.transform(
        postings(i), lambda a: F.struct((i - a).alias("start"), F.get(ws, i).alias("word")))))
    if len(set(template)) == 1:
        return F.array_distinct(F.transform(votes, lambda v: v["start"]))
    return _let(F.array_sort(F.array_distinct(votes)), lambda all_: F.array_distinct(F.transform(
        F.filter(all_, lambda v, n: (n > 0) & (F.get(all_, n - 1)["start"] == v["start"])), lambda v: v["start"])))


def _judged(ws: Column, starts: Column, label: str, template: list[str], keys: list[list[str]], slack: int) -> Column:
    """For each start: label, whether all key phrases stand within `slack` words of their places, and the share of
    the template's words that stand in theirs."""
    t, moves = _text(template), F.sequence(F.lit(-slack), F.lit(slack))
    place = lambda k: next(i for i in range(len(template)) if template[i : i + len(k)] == k)

    def stands(key: list[str], start: Column) -> Column:
        return F.exists(moves, lambda d: _stands(ws, _text(key), start + place(key) + d))

    def one(start: Column) -> Column:
        whole = F.lit(True)
        for key in keys:
            whole = whole & stands(key, start)
        agree = F.filter(F.sequence(F.lit(0), F.lit(len(template) - 1)), lambda a: F.get(ws, F.greatest(start + a, F.lit(0))) == F.get(t, a))
        return F.struct(F.lit(label).alias("label"), whole.alias("whole"), (F.size(agree) / len(template)).alias("share"))

    return F.transform(starts, one)


def licences(docs: DataFrame, base: list[tuple[str, str]] | None = None, templates: list | None = None, rare: int = RARE,
             slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of `docs`.

    `base` has (phrase, label), `templates` (label, key phrases, text).  Base columns are exact.  Labels of templates
    are those with a start on which at least two of the document's `rare` highest-IDF licence words agree, whose key
    phrases stand and of whose words `share` agree; a score is the largest share at any such start (1 for a base
    phrase, 0 for none).  Null and empty texts have no words and no labels; very long texts are scanned whole; repeated
    rows get equal results; of starts with equal shares it does not matter which is taken; an empty table gives an
    empty result; columns beside doc_id and text are ignored.
    """
    base = [(spelled(p), label) for p, label in (BASE if base is None else base)]
    templates = [(label, [spelled(k) for k in keys], spelled(t)) for label, keys, t in (TEMPLATES if templates is None else templates)]
    ship(docs.sparkSession)
    known = [(p, [p]) for p, _ in base] + [(t, keys) for _, keys, t in templates]
    rows = materialize(scanned(docs, known), "licence-words")
    order = by_rarity(rows, sorted({w for t, _ in known for w in t}))
    ranked = {w: i for i, w in enumerate(order)}

    no_base = F.expr("cast(array() as array<struct<start: int, label: string>>)")
    no_more = F.expr("cast(array() as array<struct<label: string, whole: boolean, share: double>>)")

    def base_hits(ws: Column, found: Column, phrase: list[str], label: str) -> Column:
        word = min(phrase, key=ranked.__getitem__)
        at = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.get(ws, i) == word)
        starts = F.filter(F.transform(at, lambda i: i - phrase.index(word)), lambda start: _stands(ws, _text(phrase), start))
        hits = F.transform(starts, lambda start: F.struct(start.alias("start"), F.lit(label).alias("label")))
        return F.when(F.array_contains(found, word), hits).otherwise(no_base)

    def template_hits(ws: Column, found: Column, looked_up: Column, label: str, keys: list[list[str]], template: list[str]) -> Column:
        needed = _text(sorted({w for k in keys for w in k}, key=ranked.__getitem__))
        able = F.forall(needed, lambda w: F.array_contains(found, w))
        judged = _let(_starts(ws, looked_up, template), lambda starts: _judged(ws, starts, label, template, keys, slack))
        return F.when(able, judged).otherwise(no_more)

    def all_hits(ws: Column, found: Column) -> Column:
        chosen = F.slice(F.array_intersect(_text(order), found), 1, rare)
        more = _let(chosen, lambda x: F.concat(no_more, *[template_hits(ws, found, x, *t) for t in templates]))
        return F.struct(F.concat(no_base, *[base_hits(ws, found, *b) for b in base]).alias("base"), more.alias("more"))

    hits = F.when(F.col("ws").isNotNull(), all_hits(F.col("ws"), F.col("found")))
    out = rows.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), hits.alias("h")).select(
        "doc_id", "n_words", F.coalesce("h.base", no_base).alias("base"), F.coalesce("h.more", no_more).alias("more"))
    labels = lambda c: F.transform(c, lambda h: h["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    named = F.filter("more", lambda h: h["whole"] & (h["share"] >= share))
    best = F.array_max(F.concat(F.transform("base", lambda h: F.lit(1.0)), F.transform("more", lambda h: h["share"])))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda h: h["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda h: h["start"])).cast("bigint").alias("last_word"),
        joined(labels("base")).alias("base_labels"), joined(F.concat(labels("base"), labels(named))).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"))


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(read(spark, sf_dir, "documents"))
