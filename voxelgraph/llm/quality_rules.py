"""Quality rules: counted rules, then a hashed n-gram log-likelihood ratio between two multinomials.

One multinomial is fitted on the n-grams of trusted documents, one on those of all documents; both hash unigrams and
bigrams of words into BUCKETS cells, with one added to each cell. A document's verdict is the mean over its n-grams of
log(trusted / raw), in thousandths and whole numbers, held against one threshold: the same for every document and run.
Trusted documents are those that pass every counted rule strictly (see trusted()); no label is read.

All on the JVM: the texts are read once and their counts and cells written to the shared folder; one pass over these counts
cells (aggregated before the shuffle, BUCKETS rows after it), one scores. Only the cells' counts reach the driver, of a fixed
number.

Defined results: null text counts as empty; a document without words has no n-gram, fails the base rules and isn't kept;
equal rows and rows that share a doc_id are one document (see exchange.unique_documents); an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import unique_documents, written

BUCKETS = 1 << 14
#: Thousandths of a nat per n-gram: clean prose of any language scores near zero, mark-up and noise far below.
THRESHOLD = -60
SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text, hashes of words, and the counted rules."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.trim(text, F.lit(SPACE))
    of_words = lambda w: F.struct(F.transform(w, lambda x: F.xxhash64(x)).alias("hashes"), F.length(F.array_join(w, "")).alias("chars"))
    words = let(F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")), of_words)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "")
    docs = docs.select("doc_id", text.alias("text"), words.alias("words"))
    hashes = F.col("words.hashes")
    return docs.select(
        "doc_id",
        hashes.alias("hashes"),
        F.size(hashes).cast("bigint").alias("n_words"),
        F.col("words.chars").cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(hashes).alias("n_repeat_words"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("bigint").alias("n_upper"),
    )


def repeated_words(hashes: Column, n: int = 5) -> Column:
    """Words in windows of n words that occur at least twice in the text.

    A window's hash and its place share one bigint (the place takes as many low bits as the text needs), so that windows
    sort as plain numbers and equal ones become neighbours. Those neighbours alone are sorted again by their whole hash,
    as in long texts different windows share what the place leaves of it.
    """
    size = F.size(hashes)
    bits = F.ceil(F.log2(size.cast("double") + 1)).cast("int")
    gram = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n)))

    def of_sorted(s: Column, b: Column) -> Column:
        place = lambda x: F.pmod(x, F.call_function("shiftleft", F.lit(1).cast("bigint"), b))
        head = lambda x: F.call_function("shiftright", x, b)
        near = F.filter(s, lambda x, j: head(F.get(s, j + 1)).eqNullSafe(head(x)) | head(F.get(s, j - 1)).eqNullSafe(head(x)))
        whole = F.sort_array(F.transform(near, lambda x: let(place(x).cast("int"), lambda i: F.struct(gram(i).alias("hash"), i.cast("bigint").alias("place")))))
        return let(whole, of_whole)

    def of_whole(w: Column) -> Column:
        hash_at = lambda j: F.get(w, j)["hash"]
        same = F.filter(w, lambda x, j: hash_at(j + 1).eqNullSafe(x["hash"]) | hash_at(j - 1).eqNullSafe(x["hash"]))
        found = F.array_sort(F.transform(same, lambda x: x["place"]))
        start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("end"))
        step = lambda acc, i: F.struct((acc["total"] + i + n - F.greatest(i, acc["end"])).alias("total"), (i + n).alias("end"))
        return F.when(F.size(same) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(found, start, step, lambda acc: acc["total"]))

    def windows(b: Column) -> Column:
        high = lambda x: F.call_function("shiftleft", F.call_function("shiftright", x, b), b)
        grams = F.transform(F.slice(hashes, 1, size - (n - 1)), lambda x, i: high(F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, n)))) + i)
        return let(F.sort_array(grams), lambda s: of_sorted(s, b))

    return F.when(size <= n, F.lit(0).cast("bigint")).otherwise(let(bits, windows))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def trusted() -> Column:
    """Passes the base rules with at most a symbol in 200 characters, few capitals, and no line twice."""
    return ~base_failed() & (200 * F.col("n_symbols") <= F.col("word_chars")) & (10 * F.col("n_upper") <= F.col("word_chars")) & (F.col("n_dup_lines") == 0) & (F.col("n_repeat_words") == 0)


def cells(buckets: int) -> Column:
    """The cell of every word and of every two neighbours."""
    hashes, shift = F.col("hashes"), 64 - buckets.bit_length() + 1
    kind = "short" if buckets <= 1 << 15 else "int"
    one = F.transform(hashes, lambda x: F.shiftrightunsigned(x, shift).cast(kind))
    two = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, F.get(hashes, i + 1)), shift).cast(kind))
    return F.concat(one, two)


def weights(rules: DataFrame, buckets: int) -> list[int]:
    """Thousandths of log(trusted / raw) of each cell, over every document; rules: (target, cells)."""
    own = rules.select(F.explode("cells").alias("cell"), F.col("target").cast("bigint").alias("good")).groupBy("cell").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    raw, good = [1] * buckets, [1] * buckets
    for r in own.collect():  # at most `buckets` rows
        raw[r["cell"]] += r["raw"]
        good[r["cell"]] += r["good"]
    n, m = sum(raw), sum(good)
    return [round(1000 * math.log(g / m * n / r)) for g, r in zip(good, raw, strict=True)]


def judged(docs: DataFrame, target: Column | None = None, threshold: int = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, the counted rules, base_failed, kept, llr (thousandths of a nat per n-gram; null without n-grams).

    target: the trusted documents, over the columns of counted().
    """
    rules = counted(unique_documents(docs)).withColumn("base_failed", base_failed()).withColumn("target", trusted() if target is None else target)
    # texts are counted once: the cells (a Parquet dictionary of `buckets` numbers, some 14 bits each) are what both passes read
    rules = written(rules.withColumn("cells", cells(buckets)).drop("hashes", "n_upper"), "quality-cells")
    table = F.split(F.lit(",".join(map(str, weights(rules, buckets)))), ",").cast("array<int>")
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda acc, x: acc + F.get(table, x.cast("int")))
    own = rules.withColumn("llr", F.when(F.size("cells") > 0, F.floor(total / F.size("cells"))))
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False))).alias("kept"), "llr")
