"""License scans by diagonal voting, with DataFrame operations only.

All rolling word k-grams of every text are joined with the positions of the same k-grams in the templates (a
fixed table, so its broadcast is bounded). Each hit votes for the diagonal position - template
position; diagonals of a document and template that lie within ``GAP`` of each other are merged (words put in
or left out shift the diagonal), and a merged group is a span of the template if enough of its distinct
k-grams were hit: all of them in templates of up to ``SHORT``, else a share of ``COVER``. The join compares the k-grams themselves beside their hashes, so a span is verified word by word.

Only hits are shuffled. A common passage makes hits in many documents, each under its own doc_id.

Defined results: a null text is an empty one: no words, no labels, score 0; rows that share doc_id share the labels that the
method adds; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, texts

K, GAP, EDIT = 3, 3, 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

# Texts and notices of public licences by SPDX identifier, as words.
TEMPLATES = (
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "this project is licensed under the terms of the mit license"),
    (
        "MIT",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    (
        "Apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("GPL-3.0", "licensed under the gnu general public license version 3"),
    ("GPL", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (
        "GPL",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
    ),
    ("LGPL", "licensed under the gnu lesser general public license"),
    ("LGPL", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "MPL-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ),
    ("BSD", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "BSD-2-Clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    ("BSD-3-Clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "ISC",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "Zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "3 this notice may not be removed or altered from any source distribution",
    ),
    (
        "Unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
    ),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)


def needed(n_words: int, k: int = K) -> int:
    """k-grams that a template of so many words must have."""
    return max(1, n_words - k + 1 - k * (n_words // EDIT))


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    rows = []
    for n, (label, text) in enumerate(templates):
        words = text.split()
        rows += [(n, label, i, " ".join(words[i : i + k]), len(words) - k + 1, needed(len(words), k)) for i in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, tpos int, gram string, n_grams int, needed int").withColumn("hash", F.xxhash64("gram"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), _BETWEEN), lambda x: x != "")


def spans(docs: DataFrame, k: int = K, gap: int = GAP) -> DataFrame:
    """Verified spans: doc_id, t (the text's hash), template, label, start and end (words, end exclusive), score (share of the template's k-grams)."""
    w = F.col("words")
    grams = F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])))
    rolled = texts(docs).select("doc_id", F.xxhash64("text").alias("t"), words_of(F.col("text")).alias("words")).select("doc_id", "t", F.posexplode(grams).alias("pos", "word_gram"))
    known = F.broadcast(template_grams(docs.sparkSession, k=k))  # fixed values: some two thousand rows
    hits = rolled.withColumn("hash", F.xxhash64("word_gram")).join(known, "hash").where("word_gram = gram")
    of = ["doc_id", "t", "template", "label", "n_grams", "needed"]
    diagonals = hits.groupBy(*of, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("seen"))
    by = Window.partitionBy("doc_id", "t", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= gap, 0).otherwise(1)
    merged = diagonals.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(by))
    found = merged.groupBy(*of, "part").agg(F.min("first").alias("start"), (F.max("last") + k).alias("end"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"))
    return found.where(F.size("seen") >= F.col("needed")).select("doc_id", "t", "template", "label", "start", "end", (F.size("seen") / F.col("n_grams")).alias("score"))


def base(docs: DataFrame) -> DataFrame:
    """Words and the places of the base phrases."""
    all_words = texts(docs).select("doc_id", F.xxhash64("text").alias("t"), words_of(F.col("text")).alias("words"))
    w = F.col("words")
    # Each base phrase has this word; most texts don't.
    named = all_words.select("doc_id", "t", F.size(w).cast("long").alias("n_words"), F.when(F.array_contains(w, "license"), w).otherwise(F.array().cast("array<string>")).alias("words"))

    def places(phrase: tuple[str, ...]) -> Column:
        fits = lambda i: [F.get(w, i + j) == x for j, x in enumerate(phrase)]
        every = F.sequence(F.lit(0), F.size(w) - len(phrase))
        return F.when(F.size(w) >= len(phrase), F.filter(every, lambda i: _all(fits(i)))).otherwise(F.array().cast("array<int>"))

    named = named.select("doc_id", "t", "n_words", *[places(p).alias(label) for p, label in PHRASES])
    labels = [label for _, label in PHRASES]
    every = F.concat(*labels)
    return named.select(
        "doc_id",
        "t",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(x)) for x in labels]))).alias("base_set"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out & x
    return out


def scan(docs: DataFrame) -> DataFrame:
    more = spans(docs).groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    both = base(docs).join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    every = F.array_sort(F.array_union("base_set", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_set").alias("base_labels"), F.concat_ws(",", every).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
