"""Operator 5: license scans by diagonal voting.

Texts, license templates and phrases are word sequences. Spark joins the hashes of all
rolling grams of every text (``K_WORDS`` words for templates, its whole length for a
phrase) to the template positions, a fixed table that is broadcast; hits are compared
word for word. Votes are counted by offset diagonal (text position - template position).
Diagonals of a template that lie within ``MERGE`` of each other and overlap are merged,
so a few inserted or lost words don't split a match. The span of the merged votes is
verified: at least ``ACCEPT`` of the template's grams, in a span not longer than
``STRETCH`` times it, and all of the template's distinguishing words, which are written
in capitals (the kind of license and its version). Of verified spans of a text only
those count that lie in no other. Phrases (the base) count only as whole grams, which are
exact occurrences.

Labels: those of the phrases, and those of the verified templates. score is the
greatest share of a verified template's grams, 1 for a phrase, else 0.

Cases: null or empty text has no words; overlapping occurrences of phrases all count;
rows are told apart by doc_id and text, so each row has a result of its own, also with
null or shared ids; a text over a megabyte is scanned like any other, in time that grows
with its words; an empty table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.decontaminate import _SEED, _gram, word_rows, words_of
from tracelake.llm.store import table

K_WORDS = 3
MERGE = 3
ACCEPT = 0.7
STRETCH = 1.5

#: Base phrases and their labels (fixed values).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Notices and texts of well-known licenses, by the label that a verified span gives (fixed values).
TEMPLATES = [
    ("cc-by", "licensed under CC BY 4 0"),
    ("cc-by-nc", "licensed under CC BY NC 4 0"),
    ("cc-by-sa", "licensed under CC BY SA 4 0"),
    ("cc-by", "licensed under the creative COMMONS ATTRIBUTION 4 0 INTERNATIONAL license"),
    ("cc-by-nc", "licensed under the creative commons attribution NONCOMMERCIAL 4 0 international license"),
    ("cc-by-sa", "licensed under the creative commons attribution SHAREALIKE 4 0 international license"),
    ("cc0", "to the extent possible under law the author has WAIVED all copyright and related or neighboring rights to this work"),
    ("mit-notice", "RELEASED under the MIT license"),
    (
        "mit-text",
        "PERMISSION is hereby GRANTED free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
        "conditions the above copyright notice and this permission notice shall be INCLUDED in all copies or substantial portions of the software the software is provided as is without warranty of any kind express "
        "or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim "
        "damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc-text",
        "PERMISSION to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice APPEAR in all copies the "
        "software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any "
        "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
    ),
    (
        "bsd-2-text",
        "REDISTRIBUTION and use in source and BINARY forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright "
        "notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
        "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or "
        "consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
        "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "bsd-3-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright "
        "notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution 3 NEITHER the name of the copyright holder nor the names of its contributors may be used to ENDORSE or promote products derived from this software without "
        "specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential "
        "damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
        "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    ("bsd-terms", "REDISTRIBUTION and use in source and BINARY forms with or without modification are permitted provided that the following conditions are met"),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use "
        "this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the ORIGIN of this software must not be MISREPRESENTED you must "
        "not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered "
        "from any source distribution",
    ),
    (
        "unlicense-text",
        "this is free and UNENCUMBERED software released into the PUBLIC DOMAIN anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for "
        "any purpose commercial or non commercial and by any means",
    ),
    (
        "bsl-1-text",
        "permission is hereby granted free of charge to any person or ORGANIZATION obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display "
        "distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    ),
    ("apache-2-notice", "licensed under the APACHE license VERSION 2 0"),
    (
        "apache-2-notice",
        "licensed under the APACHE license VERSION 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless "
        "required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license "
        "for the specific language governing permissions and limitations under the license",
    ),
    ("gpl-2-notice", "licensed under the gnu GENERAL public license VERSION 2"),
    ("gpl-3-notice", "licensed under the gnu GENERAL public license VERSION 3"),
    ("lgpl-notice", "licensed under the gnu LESSER general public license"),
    ("agpl-notice", "licensed under the gnu AFFERO general public license"),
    (
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the GNU GENERAL public license as published by the free software foundation either version of the license or at your "
        "option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
        "gnu general public license for more details",
    ),
    ("mpl-2-text", "this source code form is subject to the terms of the MOZILLA public license V 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
]


def _sequences() -> list[tuple[int, str, bool, list[str], int]]:
    """(number, label, base, words, gram width) of phrases and templates."""
    out = [(label, True, text.split()) for text, label in PHRASES] + [(label, False, text.split()) for label, text in TEMPLATES]
    return [(t, label, base, w, len(w) if base else K_WORDS) for t, (label, base, w) in enumerate(out)]


def _positions() -> list[tuple]:
    """(gram words, template, label, base, t_pos, t_grams, t_words, covers, needed) of all grams: covers are the bits
    of the distinguishing words in the gram, needed those of the whole template."""
    rows = []
    for t, label, base, w, k in _sequences():
        bit = {p: 1 << i for i, p in enumerate(p for p, x in enumerate(w) if x != x.lower())}
        for p in range(len(w) - k + 1):
            rows.append(([x.lower() for x in w[p : p + k]], t, label, base, p, len(w) - k + 1, len(w), sum(bit.get(p + i, 0) for i in range(k)), sum(bit.values())))
    return rows


def template_positions(spark: SparkSession) -> DataFrame:
    """The grams of all templates with their hashes, and a seed of hash 0, which the row of a document itself meets."""
    seed = ([], None, None, False, None, None, None, 0, 0)
    rows = spark.createDataFrame([*_positions(), seed], "gram array<string>, template int, label string, base boolean, t_pos int, t_grams int, t_words int, covers long, needed long")
    h = F.lit(0).cast("long")
    for k in _widths():
        h = F.when(F.size("gram") == k, _gram(F.col("gram"), F.lit(0), k)).otherwise(h)
    return rows.withColumn("h", h)


def _widths() -> list[int]:
    return sorted({k for *_, k in _sequences()})


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), words_of(text).alias("w")).withColumn("n_words", F.greatest(F.size("w"), F.lit(0)))
    doc = ["doc_id", "text_key"]
    hits = word_rows(rows, _widths(), _SEED).join(F.broadcast(template_positions(docs.sparkSession)), "h")
    same = F.col("template").isNull() | (F.slice("w", F.greatest(F.col("pos"), F.lit(0)) + 1, F.greatest(F.size("gram"), F.lit(1))) == F.col("gram"))
    votes = hits.filter(same).select(*doc, "n_words", "template", "label", "base", "t_grams", "t_words", "needed", "t_pos", "covers", "pos", F.size("gram").alias("k"))
    named = [*doc, "template", "label", "base", "t_grams", "t_words", "needed"]
    diagonals = votes.groupBy(*named, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"), F.min("pos").alias("low"), F.max(F.col("pos") + F.col("k") - 1).alias("high"), F.collect_set("t_pos").alias("spots"), F.bit_or("covers").alias("covers")
    )
    line = Window.partitionBy(*doc, "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(line) > MERGE) | (F.col("low") > F.max("high").over(line.rowsBetween(Window.unboundedPreceding, -1)) + MERGE * K_WORDS + 1)
    runs = diagonals.withColumn("cut", F.when(F.coalesce(apart, F.lit(True)) | F.col("base"), 1).otherwise(0)).withColumn("run", F.sum("cut").over(line))
    spans = runs.groupBy(*named, "run").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.size(F.array_distinct(F.flatten(F.collect_list("spots")))).alias("got"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal"), F.bit_or("covers").alias("covers")
    )
    share = F.col("got") / F.col("t_grams")
    near = ~F.col("base") & (share >= ACCEPT) & (F.col("high") - F.col("low") + 1 <= STRETCH * F.col("t_words")) & (F.col("covers") == F.col("needed"))
    spans = spans.withColumn("share", share).withColumn("near", near & F.col("template").isNotNull())
    # verified spans by start, the longer and then the better first: one that ends no later than an earlier one lies in it
    inside = Window.partitionBy(*doc, "near").orderBy("low", F.desc("high"), F.desc("share"), "template", "run").rowsBetween(Window.unboundedPreceding, -1)
    best = F.col("near") & (F.coalesce(F.max("high").over(inside), F.lit(-1)) < F.col("high"))
    spans = spans.withColumn("best", best).withColumn("whole", F.col("base") & F.col("template").isNotNull())
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    told = F.col("whole") | F.col("best")
    out = spans.groupBy(*doc).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if("whole").alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("diagonal"))).cast("long").alias("last_word"),
        join(F.when(F.col("whole"), F.col("label"))).alias("base_labels"),
        join(F.when(told, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(told, F.col("share"))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
    )
    # equal rows voted together; each gets its result
    return out.select(*[c for c in out.columns if c not in ("text_key", "copies")], F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"('{' '.join(g)}', {len(g)}, {t}, '{label}', {str(base).lower()}, {p}, {n}, {words}, {covers}, {needed})" for g, t, label, base, p, n, words, covers, needed in _positions())
ORACLE_SQL = f"""
WITH tg(gram, k, template, label, base, t_pos, t_grams, t_words, covers, needed) AS (VALUES {_VALUES}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT doc_id, k, i AS pos, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS i FROM d, (SELECT DISTINCT k FROM tg))),
g AS (SELECT doc_id, template, label, base, t_grams, t_words, needed, pos - t_pos AS diagonal, min(pos) AS low, max(pos + dg.k - 1) AS high, list(DISTINCT t_pos) AS spots, bit_or(covers) AS covers FROM dg JOIN tg ON tg.gram = dg.gram AND tg.k = dg.k GROUP BY ALL),
r AS (SELECT *, CASE WHEN base OR lag(diagonal) OVER w IS NULL OR diagonal - lag(diagonal) OVER w > {MERGE} OR low > max(high) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {MERGE * K_WORDS + 1} THEN 1 ELSE 0 END AS cut
      FROM g WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM r),
x AS (SELECT doc_id, template, label, base, t_grams, t_words, needed, run, len(list_distinct(flatten(list(spots)))) AS got, min(low) AS low, max(high) AS high, min(diagonal) AS diagonal, bit_or(covers) AS covers FROM s GROUP BY doc_id, template, label, base, t_grams, t_words, needed, run),
y AS (SELECT *, got / t_grams AS share, NOT base AND got / t_grams >= {ACCEPT} AND high - low + 1 <= {STRETCH} * t_words AND covers = needed AS near FROM x),
v AS (SELECT *, near AND coalesce(max(high) OVER (PARTITION BY doc_id, near ORDER BY low, high DESC, share DESC, template, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < high AS best FROM y),
z AS (SELECT doc_id, count_if(base) AS n_base, min(diagonal) FILTER (WHERE base) AS first_word, max(diagonal) FILTER (WHERE base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base OR best) AS labels, max(share) FILTER (WHERE base OR best) AS score FROM v GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN z ON z.doc_id = d.doc_id
"""
