"""License scans by diagonal voting.

Every rolling hash of GRAM words of a document is joined to the places it has in the templates; a hit votes for the
diagonal (place in the document minus place in the template). Votes are aggregated by diagonal, diagonals within SHIFT
words of each other are merged into one span, and a span is verified on the template: it must hold at least SHARE percent of its
different grams and be no more than twice as long. Beside it, fixed base phrases are looked up word by word.

All on the JVM. The table of templates (a row for each gram) is broadcast while it has at most FEW rows, after a sieve over
leading hash bits has left out most grams that it can't match. Only hits are shuffled.

Defined results: null or empty text has no words, no labels, score 0; equal rows and rows that share a doc_id are one
document (see exchange.unique_documents); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import unique_documents, written
from .quality_rules import let

GRAM, SHIFT, SHARE, SIEVE, FEW = 3, 2, 75, 14, 1 << 18
#: Base phrases and their labels; fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and their labels; fixed values.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3"],
    "gpl-notice": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "agpl": ["licensed under the gnu affero general public license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-4.0": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "proprietary": ["no part of this publication may be reproduced distributed or transmitted in any form without the prior written permission"],
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Only A-Z are lower-cased for good: other letters are in no phrase, but for the Kelvin sign, which lower() would make a k."""
    plain = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= GRAM, let(hashes, lambda h: F.transform(F.slice(h, 1, F.size(h) - (GRAM - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, GRAM)))))).otherwise(F.array().cast("array<bigint>"))


def _phrase(words: Column) -> Column:
    """Structs (place, label) of base phrases."""
    def one(phrase: str, label: str) -> Column:
        first, *rest = phrase.split()

        def place(w: Column, i: Column) -> Column:
            ok = w == first
            for k, x in enumerate(rest):
                ok = ok & F.get(words, i + k + 1).eqNullSafe(F.lit(x))
            return F.when(ok, F.struct(i.cast("bigint").alias("place"), F.lit(label).alias("label")))

        none = F.array().cast("array<struct<place:bigint,label:string>>")
        return F.when(F.array_contains(words, first), F.filter(F.transform(words, place), lambda x: x.isNotNull())).otherwise(none)

    return F.concat(*(one(*x) for x in PHRASES.items()))


def notices(spark: SparkSession) -> DataFrame:
    """(template, label, text) of TEMPLATES."""
    own = [(f"{label}/{i}", label, text) for label, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(own, "template string, label string, text string")


def templates(own: DataFrame) -> DataFrame:
    """(gram, template, label, at, total): a row for each gram of each notice (template, label, text)."""
    grams = own.select("template", "label", _grams(_words(F.coalesce("text", F.lit("")))).alias("grams"))
    return grams.select("template", "label", F.size("grams").alias("total"), F.posexplode("grams").alias("at", "gram"))


def marked(words: Column, grams: DataFrame) -> Column:
    """Structs (pos, gram) of the grams whose leading SIEVE bits some template gram has: all that the join can match."""
    known = {r[0] for r in grams.select(F.shiftrightunsigned("gram", 64 - SIEVE).alias("cell")).distinct().collect()}  # 2^SIEVE at most
    sieve = F.split(F.lit(",".join("1" if i in known else "0" for i in range(1 << SIEVE))), ",").cast("array<int>")
    named = F.transform(_grams(words), lambda g, i: F.when(F.get(sieve, F.shiftrightunsigned(g, 64 - SIEVE).cast("int")) == 1, F.struct(i.alias("pos"), g.alias("gram"))))
    return F.filter(named, lambda x: x.isNotNull())


def spans(own: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc_id, template, label, first, last, matched, total) of verified spans; own: (doc_id, marked)."""
    own = own.select("doc_id", F.inline("marked"))
    hits = own.join(F.broadcast(grams) if grams.count() <= FEW else grams, "gram")
    # on one diagonal a gram of the template votes once, so these sets are as large as a template at most
    votes = hits.groupBy("doc_id", "template", "label", "total", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("voted"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    each = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(each) <= SHIFT).cast("int")
    merged = votes.withColumn("span", F.sum(1 - F.coalesce(new, F.lit(0))).over(each.rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.groupBy("doc_id", "template", "label", "total", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).cast("bigint").alias("matched"), F.min("first").alias("first"), F.max("last").alias("last"))
    return found.where((F.col("matched") * 100 >= SHARE * F.col("total")) & (F.col("last") - F.col("first") < 2 * F.col("total"))).select("doc_id", "template", "label", "first", (F.col("last") + GRAM - 1).alias("last"), "matched", "total")


def scanned(docs: DataFrame, own_notices: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; own_notices: (template, label, text) instead of
    TEMPLATES."""
    grams = templates(notices(docs.sparkSession) if own_notices is None else own_notices)
    words = unique_documents(docs).select("doc_id", _words(F.col("text")).alias("words"))
    own = written(words.select("doc_id", F.size("words").cast("bigint").alias("n_words"), _phrase(F.col("words")).alias("base"), marked(F.col("words"), grams).alias("marked")), "license-hits")
    base = own.drop("marked")
    more = spans(own, grams).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max(F.least(F.lit(1.0), F.col("matched") / F.col("total"))).alias("best"))
    names = F.transform("base", lambda x: x["label"])
    joined = base.join(more, "doc_id", "left")
    every = F.array_sort(F.array_distinct(F.concat(names, F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["place"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["place"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.round(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))), 6).alias("score"),
    )


def _sql() -> str:
    notices = ", ".join(f"('{label}/{i}', '{label}', '{text}')" for label, texts in TEMPLATES.items() for i, text in enumerate(texts))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
b AS (SELECT doc_id, i - 1 AS place, label FROM p, (VALUES {phrases}) AS v(phrase, label, n) WHERE array_to_string(w[i:i+n-1], ' ') = phrase AND i + n - 1 <= len(w)),
bb AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS names FROM b GROUP BY doc_id),
t AS (SELECT template, label, string_split(text, ' ') AS w FROM (VALUES {notices}) AS v(template, label, text)),
tg AS (SELECT template, label, len(w) - {GRAM - 1} AS total, w, unnest(range(1, len(w) - {GRAM - 2})) AS i FROM t),
g AS (SELECT template, label, total, i - 1 AS pos, array_to_string(w[i:i+{GRAM - 1}], ' ') AS gram FROM tg),
h AS (SELECT doc_id, template, label, total, p.i - 1 - g.pos AS diagonal, list(DISTINCT g.pos) AS voted, min(p.i) AS first, max(p.i) AS last FROM p JOIN g ON array_to_string(p.w[p.i:p.i+{GRAM - 1}], ' ') = g.gram WHERE p.i + {GRAM - 1} <= len(p.w) GROUP BY ALL),
s AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {SHIFT} THEN 0 ELSE 1 END AS new FROM h),
m AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM s),
v AS (SELECT doc_id, label, len(list_distinct(flatten(list(voted)))) AS matched, total FROM m GROUP BY doc_id, template, label, total, span HAVING len(list_distinct(flatten(list(voted)))) * 100 >= {SHARE} * total AND max(last) - min(first) < 2 * total),
vv AS (SELECT doc_id, list(DISTINCT label) AS more, max(least(1.0, matched / total)) AS best FROM v GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(names), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), coalesce(more, [])))), ','), '') AS labels,
       CAST(round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END, 6) AS DOUBLE) AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN vv USING (doc_id)
"""


SQL = _sql()
