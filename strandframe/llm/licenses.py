"""License scans: an exact set-similarity join of text blocks with license templates, by DataFrame functions only.

A block is a line with the words after it, one less than the template's notice is long, so whatever stretch of that
length begins in the line lies in its block, however it is wrapped (empty lines included). A block meets a template when
the share of the template's distinct words that it holds is at least the threshold. A line that neither meets the
template by itself nor adds a word to what comes after it is not reported: the block of a later line holds as much.

Words are ordered by how many documents hold them, rarest first. A block that holds `need` of a template's m
words holds one of its first m - need + 1, so blocks and templates join on those words (prefix filter). A block with
fewer than `need` distinct words is out (length filter), and so is one whose first common word stands at such a place
of the template's order that too few words are left from there on (positional filter). What remains is counted exactly.

The templates are a fixed, small table, so they and their frequencies are broadcast whatever the corpus. Documents
that hold `need` words of no template are not taken apart. What a document's blocks meet is put together again by its
doc_id and two hashes of its text, so a task that is run again gives the same rows.

Base phrases are places where a phrase's words stand consecutively; each is a label of its own accord.

Nulls: a null text is an empty one: no words, no labels, score 0. A null doc_id stays null. Repeated rows give a row
each. Empty tables give empty results; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, text_key

#: Words and phrases of the scan.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices by label, in lower case and without marks (fixed values: the wording of the licenses themselves): the lines
#: that stand for a license in texts, the headers of files, and whole texts where they are short.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 "
        "of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with "
        "this program if not see https www gnu org licenses",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any "
        "express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
        "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
        "or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
        "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies",
    ],
}
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(lowered: Column) -> Column:
    """Words of a lower-cased text."""
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def template_table(docs: DataFrame, templates: dict[str, list[str]], threshold: float) -> list[tuple]:
    """(label, words rarest first, need, prefix length, length of the notice) of every template; frequencies are counted over all documents."""
    texts = [(label, sorted(set(t.split())), len(t.split())) for label, notices in templates.items() for t in notices]
    vocabulary = sorted({w for _, words, _ in texts for w in words})
    words = F.array_intersect(F.split(lowered_text(), SEPARATORS), F.array(*map(F.lit, vocabulary)))
    held = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    counts = dict(held.collect())  # a row for each word of the templates
    out = []
    for label, own, length in texts:
        ordered = sorted(own, key=lambda w: (counts.get(w, 0), w))
        need_ = -int(-threshold * len(own) // 1)
        out.append((label, ordered, need_, len(own) - need_ + 1, length))
    return out


def lowered_text() -> Column:
    return F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)


def starts_of(words: Column, phrase: list[str]) -> Column:
    """Places (from 0) where the words of a phrase stand consecutively."""
    places = F.sequence(F.lit(0), F.size(words) - len(phrase))
    at = F.filter(places, lambda i: F.forall(F.array(*(F.get(words, i + k) == F.lit(w) for k, w in enumerate(phrase))), lambda x: x))
    return F.when(F.size(words) >= len(phrase), at).otherwise(F.array().cast("array<int>"))


def labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and blocks: (block, label, containment) of every block that meets a template."""
    need(docs, "doc_id", "text")
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    table = template_table(docs, templates, threshold)
    prefix = sorted({w for _, words, _, n, _ in table for w in words[:n]})
    vocabulary = sorted({w for _, words, *_ in table for w in words})
    after = max((length for *_, length in table), default=1) - 1  # words that a block has besides its line, at most

    key = ["doc_id", "text_h1", "text_h2"]
    rows = docs.select("doc_id", *text_key(), lowered_text().alias("lowered"))
    rows = rows.withColumn("words", words_of(F.col("lowered")))
    last = sorted({p.split()[-1] for p in phrases})
    # few texts hold the last word of a phrase at all
    worth = F.lit(False)
    for w in last:
        worth |= F.contains("lowered", F.lit(w))
    hits = F.concat(*(labelled(starts_of(F.col("words"), p.split()), label) for p, label in phrases.items()))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    rows = rows.withColumn("hits", F.when(worth, hits).otherwise(none))
    # lines with words, and of each the words that follow it; every one of them has a word, so `after` lines hold enough
    held = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    rows = rows.withColumn("held", F.when(F.arrays_overlap("words", F.array(*map(F.lit, prefix))), held).otherwise(F.array().cast("array<string>")))
    some = F.lit(False)
    for _, words, need_, *_ in table:
        some |= F.size(F.array_intersect("held", F.array(*map(F.lit, words)))) >= need_
    lines = F.filter(F.transform(F.split("lowered", "\n"), lambda line, i: F.struct(i.alias("block"), words_of(line).alias("words"))), lambda b: F.size(b["words"]) > 0)
    none = F.array().cast("array<struct<block:int,words:array<string>>>")
    rows = rows.select(*key, F.size("words").cast("long").alias("n_words"), "hits", F.when(some, lines).otherwise(none).alias("lines"))
    following = lambda i: F.slice(F.flatten(F.transform(F.slice("lines", i + 2, after), lambda b: F.slice(b["words"], 1, after))), 1, after)
    joint = F.transform("lines", lambda b, i: F.struct(b["block"].alias("block"), b["words"].alias("own"), following(i).alias("after")))
    # blocks that hold a prefix word; of a line only the distinct words of the templates count, of those after it also the places
    reduced = F.transform(
        F.filter(joint, lambda b: F.arrays_overlap(b["own"], F.array(*map(F.lit, prefix))) | F.arrays_overlap(b["after"], F.array(*map(F.lit, prefix)))),
        lambda b: F.struct(b["block"].alias("block"), F.array_intersect(b["own"], F.array(*map(F.lit, vocabulary))).alias("own"), b["after"].alias("after"), F.size(F.array_union(b["own"], b["after"])).alias("length")),
    )
    rows = rows.select(*key, "n_words", "hits", reduced.alias("found"))

    entries: dict[str, list[tuple]] = {}
    for label, words, need_, n, length in table:
        for place, w in enumerate(words[:n]):
            entries.setdefault(w, []).append((label, words, need_, length - 1, place))
    index = F.broadcast(spark.createDataFrame(list(entries.items()), "word string, entries array<struct<label:string,template:array<string>,need:int,after:int,place:int>>"))
    blocks = rows.select(*key, "n_words", "hits", F.posexplode_outer("found").alias("nth", "b"))
    blocks = blocks.select(*key, "n_words", "hits", "nth", "b", F.posexplode_outer(F.array_intersect(F.concat("b.own", "b.after"), F.array(*map(F.lit, prefix)))).alias("nth_word", "word"))

    def met(e: Column) -> Column:
        # words of the template from the place on, at most, and no word twice
        possible = (F.col("b.length") >= e["need"]) & (F.size(e["template"]) - e["place"] >= e["need"])
        rest = F.slice("b.after", 1, e["after"])
        own, later, common = (F.size(F.array_intersect(e["template"], x)) for x in (F.col("b.own"), rest, F.concat("b.own", rest)))
        begins = (own >= e["need"]) | (common > later)
        return F.when(possible & (common >= e["need"]) & begins, F.struct(F.col("b.block").alias("block"), e["label"].alias("label"), (common / F.size(e["template"])).alias("containment")))

    none = F.array().cast("array<struct<block:int,label:string,containment:double>>")
    found = F.coalesce(F.filter(F.transform("entries", met), lambda x: x.isNotNull()), none)
    joined = blocks.join(index, "word", "left").select(*key, "n_words", "hits", found.alias("met"), ((F.coalesce("nth", F.lit(0)) == 0) & (F.coalesce("nth_word", F.lit(0)) == 0)).alias("begins"))
    # repeated rows of a document are one group, given out as often as they began
    per = joined.groupBy(*key).agg(F.first("n_words").alias("n_words"), F.first("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("met")))).alias("blocks"), F.count_if("begins").alias("copies"))
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    at = F.transform("hits", lambda h: h["at"])
    base = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["label"])))
    labels = F.transform("blocks", lambda b: b["label"])
    score = F.greatest(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)), F.when(F.size("hits") > 0, 1.0).otherwise(0.0))
    return per.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, labels))), ",").alias("labels"), score.alias("score"), "blocks",
    )
