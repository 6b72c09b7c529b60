"""License scan by diagonal voting.

All rolling k-gram hashes of a document's words are joined to the positions of the same k-grams in license templates. A meeting
votes for the diagonal (document position less template position). A diagonal with enough votes is a line; a line that
goes on where the one before it ended, on a neighbouring diagonal (they differ by inserted or missing words), is merged with it.
Lines that start the template anew are never merged, so notices that repeat one after the other are told apart.

A merged band gives a window of the document, and the window is verified word by word: its edit distance to the template, in
words, may be at most ``1 - least`` of the template's length, and the words that tell the template from similar ones
(``deciding_words``: those that another template, with three quarters of its words, lacks) must all stand in the window. Of verified
windows that overlap, the one with the most words matched (score times length) stays; at a tie, by score, then label. The score is 1 less the distance over the length.

Templates are a fixed list here or a table of the caller's. Their k-grams are broadcast, at most ``MAX_TEMPLATE_GRAMS`` of them, which
is checked; a bitmap of them (``text.Sieve``) spares a row for windows of words that no template has.

Null and empty texts have no words, no places and score 0. Rows that share an identifier are told apart by their
text; equal rows get equal results. Other columns are not read, so their names don't matter; an empty table gives no rows. A template of
fewer than k words is never found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.llm.text import Sieve, gram_key, letter_words, places_of, row_key
from graphlake.plans.staging import stage

K = 3
MAX_TEMPLATE_GRAMS = 100_000
NEAR = 3  # a line on a diagonal at most this far from the one before goes on with it
VOTES = 0.1  # of a template's k-grams that make a line
LEAST = 0.875  # score of a verified window

#: Public licenses and their usual notices, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-header": """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-text": """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "cc-by-4.0": "licensed under cc by 4.0",
    "cc-by-nc-4.0": "licensed under cc by-nc 4.0",
    "cc-by-nd-4.0": "licensed under cc by-nd 4.0",
    "cc-by-sa-4.0": "licensed under cc by-sa 4.0",
    "gpl": "licensed under the gnu general public license",
    "gpl-2.0": "licensed under the gnu general public license version 2",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2.0",
    "public-domain": "released into the public domain",
    "proprietary": "all rights reserved",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
}
#: Phrases whose every place is reported, with the label each gives.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PHRASE_SCORE = 0.5  # of a document with a phrase but no verified window

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FIRST_CODE = 0xE000  # words of templates become private-use characters for the edit distance


def template_words(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def deciding_words(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    """For each template its words that another one, which holds at least three quarters of its distinct words, lacks."""
    own = {label: set(words) for label, words in templates.items()}
    out = {}
    for label, mine in own.items():
        others = [x for k, x in own.items() if k != label and 4 * len(mine & x) >= 3 * len(mine)]
        out[label] = sorted(set().union(*[mine - x for x in others])) if others else []
    return out


def _codes(words: Column, vocabulary: list[str]) -> Column:
    """A string of one character per word: words of no template share one."""
    known = F.split(F.lit(" ".join(vocabulary)), " ")
    alphabet = "".join(chr(_FIRST_CODE + i + 1) for i in range(len(vocabulary)))
    code = lambda w: F.substring(F.lit(chr(_FIRST_CODE) + alphabet), F.array_position(known, w).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(words, code), "")


def template_table(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """(label, words, length, codes, deciding) of every template, and all their words."""
    words = {label: w for label, text in templates.items() if (w := template_words(text))}
    vocabulary = sorted(set().union(*words.values())) if words else []
    if len(vocabulary) > 6000:
        raise ValueError(f"{len(vocabulary)} different words in the templates; at most 6,000")
    deciding = deciding_words(words)
    number = {w: chr(_FIRST_CODE + i + 1) for i, w in enumerate(vocabulary)}
    rows = [(label, w, len(w), "".join(number[x] for x in w), deciding[label]) for label, w in sorted(words.items())]
    return spark.createDataFrame(rows, "label string, words array<string>, length int, codes string, deciding array<string>"), vocabulary


def template_grams(table: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(hash, label, at, grams) of every template's k-grams, and their number; refuses more than MAX_TEMPLATE_GRAMS."""
    cut = lambda i: F.struct(i.alias("at"), gram_key(F.col("words"), i, k).alias("hash"))
    long = table.where(F.col("length") >= k).select("label", "words", (F.col("length") - k + 1).alias("grams"))
    grams = long.select("label", "grams", F.inline(F.transform(F.sequence(F.lit(0), F.col("grams") - 1), cut)))
    total = grams.count()
    if total > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{total} template k-grams; at most {MAX_TEMPLATE_GRAMS} are broadcast")
    return grams, total


def _read(docs: DataFrame, grams: DataFrame, total: int, phrases: dict[str, str], k: int, votes: float, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_words, places, seen, words) of every document, staged: one pass over the texts; words only of those that can have a line.

    Where a template needs several votes for a line, its grams count only in documents with as many.
    """
    need = F.ceil(F.col("grams") * votes)
    short, long = grams.where(need <= 1), grams.where(need > 1)
    least = long.agg(F.min(need)).first()[0] or 2
    words = F.col("words")
    own = docs.select(F.col(id_col).alias("id"), row_key(F.col(text_col)).alias("key"), letter_words(F.col(text_col)).alias("words"))
    own = own.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    places = F.concat(*[_labelled(_places(words, p), label) for p, label in phrases.items()]) if phrases else F.array().cast("array<struct<label:string,at:bigint>>")
    passing = lambda of: (lambda sieve: places_of(words, k, lambda i: sieve.passes(gram_key(words, i, k))))(Sieve(of.select("hash"), total))
    own = own.select("id", "key", F.size(words).cast("long").alias("n_words"), places.alias("places"), passing(short).alias("few"), passing(long).alias("many"), "words")
    at = F.when(F.size("many") >= int(least), F.array_union("few", "many")).otherwise(F.col("few"))
    seen = F.transform(at, lambda i: F.struct(i.alias("place"), gram_key(words, i, k).alias("hash")))
    own = own.select("id", "key", "n_words", "places", seen.alias("seen"), F.when(F.size(at) > 0, words).alias("words"))
    return stage(own, "license-words")


def _spans(own: DataFrame, table: DataFrame, vocabulary: list[str], grams: DataFrame, k: int, near: int, votes: float, least: float) -> DataFrame:
    """(id, key, found: array of (first_word, last_word, label, score)): verified windows, the best of those that overlap."""
    probe = own.where(F.size("seen") > 0).select("id", "key", F.inline("seen"))
    met = probe.join(F.broadcast(grams), "hash").select("id", "key", "label", "grams", "place", "at", (F.col("place") - F.col("at")).alias("diagonal"))
    lines = met.groupBy("id", "key", "label", "grams", "diagonal").agg(F.count_distinct("at").alias("votes"), F.min("at").alias("from"), F.max("at").alias("to"))
    lines = lines.where(F.col("votes") >= F.col("grams") * votes)
    # in order of their places, a line goes on with the one before if it is near and starts after it in the template
    order = Window.partitionBy("id", "key", "label").orderBy(F.col("diagonal") + F.col("from"), "diagonal")
    before = lambda c: F.lag(c).over(order)
    goes_on = (F.abs(F.col("diagonal") - before("diagonal")) <= near) & (F.col("from") > before("to"))
    lines = lines.withColumn("band", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bands = lines.groupBy("id", "key", "label", "band").agg(F.min_by("diagonal", F.col("diagonal") + F.col("from")).alias("first"), F.max_by("diagonal", F.col("diagonal") + F.col("to")).alias("last"))
    found = bands.join(F.broadcast(table.select("label", "length", "codes", "deciding")), "label")
    texts = own.where(F.size("seen") > 0).select(F.col("id").alias("of"), F.col("key").alias("of_key"), "words", "n_words").dropDuplicates(["of", "of_key"])
    found = found.join(texts, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")))
    found = found.withColumns({"lo": F.greatest("first", F.lit(0)), "hi": F.least(F.col("last") + F.col("length"), F.col("n_words"))}).where("hi > lo")
    found = found.withColumn("window", F.slice("words", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
    found = found.select("id", "key", "label", "lo", "hi", "length", (1 - F.levenshtein(_codes(F.col("window"), vocabulary), F.col("codes")) / F.col("length")).alias("score"), (F.size(F.array_except("deciding", "window")) == 0).alias("decided"))
    found = found.where(F.col("decided") & (F.col("score") >= least))
    # in order of their places, a window is held against the last that stays, if they overlap
    span = F.struct(F.col("lo").cast("long").alias("first_word"), (F.col("hi") - 1).cast("long").alias("last_word"), "label", F.col("score"), "length")
    spans = found.groupBy("id", "key").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    kind = "array<struct<first_word:bigint,last_word:bigint,label:string,score:double,length:int>>"
    last = lambda done: F.element_at(done, -1)
    matched = lambda x: x["score"] * x["length"]
    better = lambda a, b: (matched(a) > matched(b)) | ((matched(a) == matched(b)) & ((a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["label"] < b["label"]))))
    keep = lambda done, x: F.when(F.size(done) == 0, F.array(x)).when(x["first_word"] > last(done)["last_word"], F.concat(done, F.array(x))).when(better(x, last(done)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(x))).otherwise(done).cast(kind)
    best = F.aggregate("spans", F.array().cast(kind), keep)
    shown = lambda x: F.struct(x["first_word"].alias("first_word"), x["last_word"].alias("last_word"), x["label"].alias("label"), x["score"].alias("score"))
    return spans.select("id", "key", F.transform(best, shown).alias("found"))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    here = lambda i: F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase
    # only a document that holds the phrase at all is searched for its places
    return F.when(F.contains(F.col("joined"), F.lit(f" {phrase} ")), places_of(words, len(parts), here)).otherwise(F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = K, near: int = NEAR, votes: float = VOTES, least: float = LEAST) -> DataFrame:
    """One row per document: id, n_words, places (array of (label, at) of phrases), found (array of verified windows: first_word, last_word,
    label, score), score: the best window's, or ``PHRASE_SCORE`` for a phrase alone, or 0."""
    table, vocabulary = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    grams, total = template_grams(table, k)
    own = _read(docs, grams, total, PHRASES if phrases is None else phrases, k, votes, id_col, text_col)
    spans = _spans(own, table, vocabulary, grams, k, near, votes, least).withColumnsRenamed({"id": "of", "key": "of_key"})
    joined = own.drop("seen", "words").join(spans, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    best = F.array_max(F.transform("found", lambda x: x["score"]))
    alone = F.when(F.size("places") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))
    return joined.select(
        "id", "n_words", "places",
        F.coalesce("found", F.array().cast("array<struct<first_word:bigint,last_word:bigint,label:string,score:double>>")).alias("found"),
        F.coalesce(best, alone).alias("score"),
    )
