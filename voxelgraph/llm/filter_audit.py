"""Audit of how five document filters interact, by Walsh-Hadamard sums.

A document's failures are a mask of five bits. For each part (source) and each pair of labels the table is reduced to 32 signed
sums: W(s) is the number of documents with an even number of failures within the set s less that with an odd one. Their exact
inverse, N(m) = sum of (-1)^|s & m| W(s) over s, divided by 32, is the number of documents with mask m; everything else
follows from those 32 numbers: what passes a set of filters is a sum over masks, an order of filters is a chain of such sets, and
a filter's Shapley share, summed over all 120 orders, is 120 / |m| for each document with mask m that fails it, as each of its
failing filters comes first in as many orders.

Four conditions follow from the text alone. The fifth, a copy of a text under a smaller doc_id, holds for every document but the
first of each text. As the sums are linear, each document counts as a copy first, and one correction for each different text (its
first document's sums as no copy less those as a copy) is added: a group of copies is reduced to its least doc_id where it is
read, and nothing is joined back to its members.

Defined results: null and empty texts are empty texts (they fail the word count and are copies of each other); rows without a
doc_id are left out and texts under one doc_id are one document, as in every operator (exchange.unique_documents); labels that
repeat count if any row says so, null labels and rows without a doc_id say nothing; a null source is the part ''; an empty table
has no parts and no rows; further columns are ignored. Nothing grows with the number of documents after the first reduction:
a part is one row of 32 numbers for each of three counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import unique_documents, written

FILTERS = "ABCDE"
MASKS = range(32)
COPY = 1 << FILTERS.index("E")
SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The bits of A to D: under 50 words; under 65 % distinct words; over 5 % capitals; any of #$%&*|."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < 50, 100 * different < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def sign(s: int, mask: Column) -> Column:
    """1 if an even number of the mask's failures are in s, else -1."""
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(s))) % 2)


def signed_sums(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, w0 ... w31): the Walsh-Hadamard sums of every part and pair of labels."""
    own = unique_documents(docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")), "part")
    text = F.col("text")
    own = own.select("doc_id", "part", failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("text_hash"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    own = own.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    own = written(own, "failures")
    first = own.groupBy("text_hash").agg(F.min(F.struct("doc_id", "part", "good", "toxic", "mask")).alias("f")).select("f.*")
    groups = ("part", "good", "toxic")
    copies = own.groupBy(*groups, "mask").agg(F.count("*").alias("n")).select(*groups, (F.col("mask") + COPY).alias("mask"), "n")
    gone = first.groupBy(*groups, "mask").agg(F.count("*").alias("n"))
    moved = gone.select(*groups, F.explode(F.array(F.struct("mask", "n"), F.struct((F.col("mask") + COPY).alias("mask"), (-F.col("n")).alias("n")))).alias("m")).select(*groups, "m.*")
    return copies.unionByName(moved).groupBy(*groups).agg(*(F.sum(sign(s, F.col("mask")) * F.col("n")).alias(f"w{s}") for s in MASKS))


def over_masks(body) -> Column:
    """body(m) for each of the 32 masks, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), body)


def cells(sums: DataFrame) -> DataFrame:
    """(part, cells): for each mask how many documents have it (n), and how many of these are good and toxic, by the exact inverse."""
    weight = F.array(*(F.col(f"w{s}") for s in MASKS))
    inverse = lambda m: F.shiftright(F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"), lambda a, s: a + (1 - 2 * (F.bit_count(s.bitwiseAND(m)) % 2)) * F.get("w", s)), 5)
    own = sums.select("part", "good", "toxic", weight.alias("w")).select("part", "good", "toxic", F.posexplode(over_masks(inverse)).alias("m", "n"))
    counted = own.groupBy("part", "m").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"{c}_n") for c in ("good", "toxic")))
    return counted.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("m", "n", "good_n", "toxic_n"))).alias("cells"))  # 32 each


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part."""
    total = lambda value: F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, x: a + value(x))
    passed = lambda name: over_masks(lambda s: total(lambda x: F.when(x["m"].bitwiseAND(s) == 0, x[name]).otherwise(0)))
    bits = F.array(*(F.lit(1 << i) for i in range(len(FILTERS))))
    wide = cells(signed_sums(docs, labels)).select(
        "part",
        *(passed(c).alias(c) for c in ("n", "good_n", "toxic_n")),
        F.transform(bits, lambda b: total(lambda x: F.when(x["m"] == b, x["n"]).otherwise(0))).alias("alone"),
        F.transform(bits, lambda b: total(lambda x: F.when(x["m"].bitwiseAND(b) > 0, x["n"] * F.floor(F.lit(120) / F.bit_count(x["m"]))).otherwise(0))).alias("shares"),
    )
    orders, places, before = [], [], []
    for order in permutations(FILTERS):
        gone = 0
        for name in order:
            orders.append("".join(order))
            places.append(FILTERS.index(name))
            before.append(gone)
            gone |= 1 << places[-1]
    now = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("k"))
    now = now.withColumns({"filter_order": F.get(F.lit(orders), F.col("k")), "step": F.col("k") % len(FILTERS) + 1, "i": F.get(F.lit(places), F.col("k")), "before": F.get(F.lit(before), F.col("k"))})
    now = now.withColumn("after", F.col("before") + F.expr("shiftleft(1, i)"))
    lost = lambda kind: F.get(kind, F.col("before")) - F.get(kind, F.col("after"))
    fails = F.get("n", F.lit(0)) - F.get("n", F.expr("shiftleft(1, i)"))
    return now.select("part", "filter_order", "step", F.get("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"), F.get("alone", F.col("i")).alias("unique_fails"), lost("good_n").alias("good_lost"), lost("toxic_n").alias("toxic_lost"), F.get("shares", F.col("i")).alias("shapley"))


#: The same rows by counting each document in every order.
SQL = r"""
WITH docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents WHERE doc_id IS NOT NULL),
words AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM words LEFT JOIN known USING (doc_id)),
counted AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM masks GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier FROM orders, range(1, 6) AS r(step)),
states AS (SELECT part, bit, CAST(earlier AS BIGINT) AS earlier,
  sum(CASE WHEN mask & (earlier::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & bit > 0 AND mask & earlier::INT = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & earlier::INT > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & earlier::INT = 0 THEN g ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & bit > 0 AND mask & earlier::INT = 0 THEN t ELSE 0 END) AS toxic_lost
  FROM counted, (SELECT DISTINCT bit, earlier FROM steps) GROUP BY ALL),
told AS (SELECT part, filter_order, step, bit, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM steps s JOIN states t USING (bit, earlier)),
shares AS (SELECT part, bit, sum(removed) AS shapley FROM told GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM told JOIN shares USING (part, bit)
"""
