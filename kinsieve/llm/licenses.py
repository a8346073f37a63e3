"""License scans by diagonal voting, in DataFrame operations only.

The rolling k-grams of words of every text are hashed and joined to the (template, position)
table of the same k-grams of license texts. A hit votes for the diagonal position in the
text minus position in the template. Votes are summed by diagonal, diagonals that lie
next to each other are merged (an inserted or lost word moves the rest of a copy to the
next one), and the spans are verified: a hit counts only if its words, not just their hash,
are the template's, and of a merged span COVERAGE of the words must be the template's, so that
scattered hits on neighbouring diagonals are no copy.

Short phrases (the base ones) need all of their k-grams on one diagonal, which then proves
the phrase word by word. Longer templates need COVERAGE of their k-grams on one group of
diagonals.

Defined results for odd input: a null text is the empty one, with no words and no labels;
rows are known by doc_id and text, not by their place, so a repeated task can't mix them up; equal rows
are scanned together and returned as often as they occur; other columns are ignored.
The templates are a constant of bounded size, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import text_of

K = 3
#: Diagonals no further apart than this are merged.
NEIGHBOURS = 3
#: Part of a template's k-grams that must be found.
COVERAGE = 0.5
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values of the task: phrase, label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Opening sentences, notices and whole short texts of public licenses.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2-notice"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("this work is licensed under a creative commons attribution", "cc-notice"),
    ("released under the gnu general public license", "gpl-mention"),
    ("released under the mit license", "mit-mention"),
    ("licensed under the apache license version 2 0", "apache-2-mention"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl-notice"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl-warranty"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib-text"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost-text"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "cc0-deed"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit-whole"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", "bsd-whole"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "isc-whole"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2-header"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense-whole"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2-header"),
)


def words_of(text: Column) -> Column:
    """Lower case for A-Z alone; the Kelvin sign, whose lower case is an ASCII letter, is kept out of it."""
    low = F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))
    return F.filter(F.split(low, SPLIT), lambda w: w != "")


def grams(words: Column) -> Column:
    """The rolling k-grams, in order, joined by blanks."""
    at = lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(K)))
    return F.when(F.size(words) >= K, F.transform(F.sequence(F.lit(0), F.size(words) - K), at)).otherwise(F.array().cast("array<string>"))


def template_grams(spark, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(t_id, label, exact, n_grams, t_pos, t_gram) of all templates, and a row that matches the marker of each text."""
    rows = []
    for t, (text, label) in enumerate((*phrases, *templates)):
        w = text.split(" ")
        n = len(w) - K + 1
        rows += [(t, label, t < len(phrases), n, p, " ".join(w[p : p + K])) for p in range(n)]
    rows.append((-1, "", False, 0, 0, ""))
    return spark.createDataFrame(rows, "t_id int, label string, exact boolean, n_grams int, t_pos int, t_gram string").withColumn("t_hash", F.xxhash64("t_gram"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    text = text_of()
    words = docs.select("doc_id", F.unhex(F.md5(text)).alias("row"), words_of(text).alias("w"))
    # position 0 holds a marker, so that texts without any hit, and their counts of words, come through the join too
    marked = words.select("row", "doc_id", F.size("w").alias("n"), F.concat(F.array(F.lit("")), grams(F.col("w"))).alias("g"))
    # outer, though never empty: else a filter on the size would be pushed below, with all words split again for each gram
    hit = marked.select("row", "doc_id", "n", F.posexplode_outer("g").alias("p", "gram"))
    wanted = F.broadcast(template_grams(docs.sparkSession, phrases, templates))
    votes = hit.join(wanted, F.xxhash64("gram") == F.col("t_hash")).where(F.col("gram") == F.col("t_gram"))  # verified words
    votes = votes.select("row", "doc_id", F.when(F.col("t_id") < 0, F.col("n")).alias("n"), "t_id", "label", "exact", "n_grams", "t_pos", (F.col("p") - 1).alias("pos"), (F.col("p") - 1 - F.col("t_pos")).alias("diagonal"))
    diagonals = votes.groupBy("row", "doc_id", "t_id", "diagonal").agg(
        F.max("n").alias("n"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("n_grams").alias("n_grams"), F.count("*").alias("votes"), F.collect_set("t_pos").alias("at"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
    )
    # neighbouring diagonals of a template, in one text, are one copy
    w = Window.partitionBy("row", "doc_id", "t_id").orderBy("diagonal")
    step = F.when(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(w) > NEIGHBOURS), 1).otherwise(0)
    places = F.flatten(F.transform("at", lambda t: F.sequence(t + F.col("diagonal"), t + F.col("diagonal") + K - 1)))  # of the words that agree
    grouped = diagonals.withColumns({"new": step, "places": places}).withColumn("run", F.sum("new").over(w))
    copies = grouped.groupBy("row", "doc_id", "t_id", "run").agg(
        F.max("n").alias("n"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("n_grams").alias("n_grams"), F.max("votes").alias("votes"), F.min("diagonal").alias("diagonal"),
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("found"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("agreed"), F.min("lo").alias("lo"), (F.max("hi") + K).alias("end"),
    )
    part = F.col("found") / F.col("n_grams")
    whole = F.col("agreed") >= COVERAGE * (F.col("end") - F.col("lo"))
    good = (F.col("t_id") >= 0) & F.when(F.col("exact"), F.col("found") == F.col("n_grams")).otherwise((part >= COVERAGE) & whole)
    base = good & F.col("exact")
    label = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    out = copies.groupBy("row", "doc_id").agg(
        F.max("n").cast("bigint").alias("n_words"), F.count_if(base).cast("bigint").alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("bigint").alias("first_word"), F.max(F.when(base, F.col("diagonal"))).cast("bigint").alias("last_word"),
        label(base).alias("base_labels"), label(good).alias("labels"), F.coalesce(F.max(F.when(good, part)), F.lit(0.0)).alias("score"),
        F.array_join(F.sort_array(F.collect_set(F.when(good, F.concat_ws(":", F.lpad(F.col("lo").cast("string"), 9, "0"), F.col("end"), F.col("label"))))), ",").alias("spans"),
        F.max(F.when(F.col("t_id") < 0, F.col("votes"))).cast("int").alias("times"),
    )
    columns = [c for c in out.columns if c not in ("row", "times")]
    return out.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")
