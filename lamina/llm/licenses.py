"""License scans by diagonal voting.

All rolling word k-grams of a document are joined by hash to the positions of the
templates. A hit votes for the diagonal (document position - template position);
votes of a diagonal are gathered as bit sets of template positions, neighbouring
diagonals of one template are merged (words were inserted or dropped), and a merged
span counts if it covers enough of the template and isn't much longer than it. The
join compares the k-gram itself besides its hash, so a hit is always real words.

Base phrases are templates of their own: a diagonal with every position of the phrase
is one place where its words stand consecutively.

Defined results: a null text has no words; repeated rows give repeated output rows
(votes are sets, so copies of a row don't add up); rows that share an id but not the
text are kept apart by a 64-bit hash of the text; an empty table gives an empty result;
other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHOLE, WHOLE_KEY = -1, 4_142_433_123_457_001
#: Positions of a template that one bit set holds; longer templates have several.
SLOT = 62
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Sentences that public licenses and their notices are known by.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
        "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
)


def template_rows(phrases=PHRASES, templates=TEMPLATES, k: int = 3) -> list[tuple]:
    """(template, label, base, k, words, grams, position, gram, hash) of every template position (k-grams; 2-grams for phrases of two words).

    The hash is the one that the SQL function xxhash64 gives for the words.
    """
    rows = []
    for number, (text, label) in enumerate((*phrases, *templates)):
        words = text.split()
        size = min(k, len(words))
        for at in range(len(words) - size + 1):
            h = 42
            for word in words[at : at + size]:
                h = xxhash.xxh64_intdigest(word, h)
            gram = " ".join(words[at : at + size])
            rows.append((number, label, number < len(phrases), size, len(words), len(words) - size + 1, at, gram, h - (h >> 63 << 64)))
    return rows


def template_grams(spark, rows: list[tuple]) -> DataFrame:
    """The same as a table: a few rows per word of the templates, whatever the corpus."""
    # meets the first word of each text and so carries its number of words
    rows = [*rows, (WHOLE, None, False, 0, 0, 1, 0, "", WHOLE_KEY)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, k int, t_words int, t_grams int, t_at int, t_gram string, gram_hash long")


def _lowered(text: Column) -> Column:
    """A-Z lower-cased. Beyond A-Z `lower` changes letters that are word characters before and after, so words keep their bounds; the Kelvin sign, the one that would become a plain letter, is set aside."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def gram_hits(docs: DataFrame, spark_grams: DataFrame, rows: list[tuple]) -> DataFrame:
    """Hits of all rolling k-grams of all texts, one row per document position and template position; docs(_id, _key, _text).

    Each position hashes its k-grams once; those that no template has leave at once, the
    others are joined by hash, and only then the words are put together and compared.
    """
    words = F.regexp_extract_all(_lowered(F.col("_text")), F.lit(WORD), F.lit(0))
    # outer, since the filter that is inferred for an inner one would cut every text into words a second time
    places = docs.select("_id", "_key", words.alias("words")).select("_id", "_key", "words", F.posexplode_outer("words").alias("at", "word"))
    following = lambda n: F.get(F.col("words"), F.col("at") + n)
    sizes = sorted({r[3] for r in rows})
    hashes = {n: F.xxhash64("word", *(following(i) for i in range(1, n))) for n in sizes}
    wanted = {n: sorted({r[8] for r in rows if r[3] == n}) for n in sizes}
    met = F.col("at") == 0
    for n in sizes:
        met = met | hashes[n].isin(wanted[n])
    keys = [F.struct(F.lit(n).alias("size"), hashes[n].alias("hash")) for n in sizes]
    whole = F.struct(F.lit(0).alias("size"), F.lit(WHOLE_KEY).alias("hash"))
    found = places.where(met).select(
        "_id", "_key", "at", F.size("words").cast("long").alias("n_words"), F.slice("words", F.col("at") + 1, max(sizes, default=1)).alias("words"),
        F.explode(F.when(F.col("at") == 0, F.array(whole, *keys)).otherwise(F.array(*keys) if keys else F.array(whole))).alias("gram"),
    )
    gram = F.array_join(F.slice("words", 1, F.col("k")), " ")
    same = (F.col("gram.size") == F.col("k")) & ((F.col("k") == 0) | (F.col("t_gram") == gram))
    small = F.broadcast(spark_grams)  # bounded by the templates, which are parameters
    return found.join(small, (F.col("gram.hash") == F.col("gram_hash")) & same).drop("gram", "gram_hash", "t_gram", "words")


def scan(
    docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, k: int = 3, slack: int = 4, coverage: float = 0.6, stretch: float = 1.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row.

    spans: label, first word, end word and coverage of each verified span of the method.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    grams = template_rows(phrases, templates, k)
    hits = gram_hits(texts, template_grams(docs.sparkSession, grams), grams)
    own = ["_id", "_key", "template", "label", "base", "k", "t_words", "t_grams"]
    slot = F.floor(F.col("t_at") / SLOT).cast("int").alias("slot")
    diagonals = hits.groupBy(*own, (F.col("at") - F.col("t_at")).alias("diagonal"), slot).agg(
        F.bit_or(F.expr(f"shiftleft(1L, t_at % {SLOT})")).alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"), F.max("n_words").alias("n_words")
    )
    along = W.partitionBy("_id", "_key", "template").orderBy("diagonal", "slot")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = F.coalesce((step > F.when(F.col("base"), 0).otherwise(slack)).cast("int"), F.lit(0))
    groups = diagonals.withColumn("apart", apart).withColumn("part", F.sum("apart").over(along))
    voted = groups.groupBy(*own, "part", "slot").agg(F.bit_or("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("n_words").alias("n_words"))
    spans = voted.groupBy(*own, "part").agg(
        F.sum(F.bit_count("votes")).alias("n"), F.min("low").alias("low"), (F.max("high") + F.first("k")).alias("high"), F.max("n_words").alias("n_words")
    )
    spans = spans.withColumn("cover", F.col("n") / F.col("t_grams"))
    whole = F.col("template") == WHOLE
    good = F.when(whole, True).when(F.col("base"), F.col("n") == F.col("t_grams")).otherwise(
        (F.col("cover") >= coverage) & (F.col("high") - F.col("low") <= F.col("t_words") * stretch)
    )
    found = spans.where(good).groupBy("_id", "_key").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("low"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(~whole, F.col("cover"))).alias("score"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(~F.col("base") & ~whole, F.struct("low", "high", "label", "cover")))).alias("spans"),
    )
    every = texts.select("_id", "_key")
    found = found.withColumnsRenamed({"_id": "_found_id", "_key": "_found_key"})
    rows = every.join(found, F.col("_id").eqNullSafe(F.col("_found_id")) & (F.col("_key") == F.col("_found_key")), "left")
    return rows.select(
        F.col("_id").alias("doc_id"), F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
