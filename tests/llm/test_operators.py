"""Every operator on a small fixture with nulls, ties, copies and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelgraph.llm import decontamination, license_scan, ngram_join, orc_output, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, toxicity
from voxelgraph.llm.components import connected

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, pos string, spans int, bucket string, label string"


def corpus() -> list[tuple[int, str | None]]:
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(5, 160))) for _ in range(40)]
    out: list[str | None] = list(base)
    for t in base[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out += [" ".join(w), t]
    passage = " ".join(rng.choices(words, k=60))
    out += [base[1] + "\n" + passage, passage + " tail " + base[2], passage, "aa " * 150, "x" * 400, "Licensed under CC BY-NC 4.0. All rights reserved.", None, "", " \n\t", "one", "One", "Zürich “quoted” 東京 <|endoftext|> 3.5", "hello <|endoftext|> world <|startoftext|> again"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    own = [(i, t, "en", "s", 1, "a", 1, "b", "c") for i, t in corpus()]
    own += [own[3], own[3], (None, "lost", "en", "s", 1, "a", 1, "b", "c")]
    return spark.createDataFrame(own, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts() -> list[tuple[int, bytes]]:
    return [(i, (t or "").encode()) for i, t in corpus()]


def repeated(units: list[list], window: int) -> list[list[bool]]:
    seen, out = set(), []
    for own in units:
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append(gone)
    return out


def test_substring_dedup(docs, empty):
    own = [(i, WORD.findall(t)) for i, t in texts()]
    want = {i: (len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for (i, w), g in zip(own, repeated([w for _, w in own], 20), strict=True)}
    assert {r[0]: tuple(r[1:]) for r in substring_dedup.digest(docs).collect()} == want
    assert substring_dedup.digest(empty).count() == 0


def test_suffix_dedup(docs, empty):
    own = texts()
    want = {}
    for (i, t), gone in zip(own, repeated([list(t) for _, t in own], 100), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want[i] = (len(t), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.digest(docs).collect()} == want
    assert suffix_dedup.digest(empty).count() == 0


def test_loser_tree_keeps_prefixes():
    rng = random.Random(1)
    for _ in range(100):
        runs = []
        for _ in range(rng.randint(0, 6)):
            keys = sorted(bytes(rng.choices(b"ab", k=rng.randint(1, 7))) for _ in range(rng.randint(0, 9)))
            runs.append(list(zip(keys, suffix_dedup.front_code(keys)[0], range(9), strict=False)))
        got = [(key, n) for key, n, _ in suffix_dedup.merge(iter(x) for x in runs)]
        assert [k for k, _ in got] == sorted(k for run in runs for k, *_ in run)
        assert all(n == suffix_dedup.common(a, b, 0) for (a, _), (b, n) in zip(got, got[1:], strict=False))


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_ngram_join(docs, empty, words, num, den):
    sets = {}
    for i, t in texts():
        w = WORD.findall(t.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs, words, num, den).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    assert ngram_join.linked(empty, words, num, den).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    for few in (1000, 0):
        assert {r.doc_id: r.component_id for r in connected(links, few=few).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_token_output(spark, docs, empty):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = {}, 0
    for i, t in texts():
        ids = [*whole.encode(t.decode(), add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r[1:]) for r in orc_output.digest(docs).collect()} == want
    assert orc_output.digest(empty).count() == 0


def test_packing(docs, empty):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs, capacity=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts():
        ids = np.array([*whole.encode(t.decode(), add_special_tokens=False).ids, 0], "<u4")
        assert sorted(by_doc[i]) == [(k, a, min(64, len(ids) - a), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    for own in by_sequence.values():
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *sorted(own)], sorted(own), strict=False)) and sum(n for _, n in own) <= 64
    gaps: list[int] = []
    for n in sorted((r.length for r in rows), reverse=True):
        best = min((g for g in gaps if g >= n), default=None)
        if best is None:
            gaps.append(64 - n)
        else:
            gaps[gaps.index(best)] = best - n
    assert len(by_sequence) <= len(gaps) + max(1, len(gaps) // 100)  # best-fit decreasing, a piece at a time
    assert packing.pack(empty).count() == 0


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, t in texts():
        text, w = t.decode(), [x.decode() for x in WORD.findall(t)]
        lines = [x for x in text.split("\n") if WORD.search(x.encode())]
        grams: dict[tuple, list[int]] = {}
        for k in range(len(w) - 4):
            grams.setdefault(tuple(w[k : k + 5]), []).append(k)
        covered = {k + j for v in grams.values() if len(v) > 1 for k in v for j in range(5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
    assert quality_rules.judged(empty).count() == 0


def test_license_scan(docs, empty):
    got = {r.doc_id: r for r in license_scan.scanned(docs).collect()}
    r = got[next(i for i, t in corpus() if t and t.startswith("Licensed"))]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (10, 2, 2, 7, "cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved", 1.0)
    assert sum(x.n_base for x in got.values()) == 2 and len(got) == len(corpus())
    assert license_scan.scanned(empty).count() == 0


def test_license_templates_as_a_table(spark):
    notice = "every copy of this text must carry the name of its author and the year"
    own = spark.createDataFrame([("n/0", "named", notice), ("n/1", "none", None), ("n/2", "short", "a b")], "template string, label string, text string")
    words = notice.split()
    apart = [" ".join(words[:5]) + " x y z " * 20 + " ".join(words[5:])]
    rows = [notice.upper(), "before " + notice.replace("name of its", "name of all its") + " after", " ".join(words[:6]), *apart, " ".join(words[:4]) + " " + " ".join(words[:4]) + " " + " ".join(words[:5]), None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id bigint, text string, label string")
    assert [r.labels for r in license_scan.scanned(docs, own).orderBy("doc_id").collect()] == ["named", "named", "", "", "", ""]


def test_license_scan_against_its_sql(spark, docs):
    import duckdb

    rows = [r for r in docs.select("doc_id", "text").distinct().collect() if r.doc_id is not None]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", [tuple(r) for r in rows])
    want = duck.sql(license_scan.SQL)
    names = want.columns
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in license_scan.scanned(docs).select(*names).collect())


def test_orc_files_are_indexed_and_pruned(spark, tmp_path):
    """Stripes carry Bloom filters and run-length coded ids; a read of one document takes few of the rows."""
    path = f"{tmp_path}/ids"
    docs = spark.range(12_000).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    orc_output.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    one = orc_output.read(spark, path).where("doc_id = 35000")
    got = one.collect()
    assert [r.doc_id for r in got] == [35000]
    leaf = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() <= 2 * 1024 + 1000
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = next(f.getPath() for f in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.getPath().getName().endswith(".orc"))
    reader = jvm.org.apache.orc.OrcFile.createReader(where, jvm.org.apache.orc.OrcFile.readerOptions(conf))
    rows = reader.rows()
    footer = rows.readStripeFooter(reader.getStripes().get(0))
    assert any("BLOOM" in str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())) and any("ROW_INDEX" in str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount()))
    assert "DIRECT_V2" in {str(footer.getColumns(i).getKind()) for i in range(footer.getColumnsCount())}
    first, second = orc_output.places(spark, path).orderBy("doc_id").limit(2).collect()
    assert (first.doc_id, first.start, second.doc_id, second.start) == (0, 0, 7, first.n_tokens)


LONG = " ".join(f"w{k * k % 9973}" for k in range(60_000))


def test_very_long_texts(spark):
    """Texts beyond every segment and part, one of them a copy with a few words changed."""
    words = LONG.split()
    other = words.copy()
    other[30_000] = "changed"
    rows = [(1, LONG), (2, " ".join(other)), (3, "x" * 600_000), (4, "tail " + " ".join(words[20_000:20_100])), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    own = [(i, (t or "").encode()) for i, t in rows]
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.digest(docs).collect()}
    split = [(i, WORD.findall(t)) for i, t in own]
    for (i, w), g in zip(split, repeated([w for _, w in split], 20), strict=True):
        assert got[i] == (len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest())
    got = {r[0]: (r.n_bytes, r.n_removed) for r in suffix_dedup.digest(docs).collect()}
    for (i, t), g in zip(own, repeated_bytes([t for _, t in own], 100), strict=True):
        assert got[i] == (len(t), g)
    joined = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs, 3, 90, 100).collect()}
    assert joined[1][1] == joined[2][1] == 1 and joined[3] == (1, 3) and joined[4][1] == 4 and joined[5] == (0, 5)
    assert joined[1][0] == len({tuple(words[k : k + 3]) for k in range(len(words) - 2)})
    assert {r.doc_id: r.n_words for r in quality_rules.judged(docs).collect()} == {r.doc_id: r.n_words for r in license_scan.scanned(docs).collect()} == {i: len(w) for i, w in split}
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in orc_output.digest(docs).collect()} == {i: len(whole.encode(t.decode(), add_special_tokens=False).ids) + 1 for i, t in own}
    item = spark.createDataFrame([(1, " ".join(words[40_000:40_040])), (2, "never there at all in any of these long texts")], "item_id bigint, text string")
    assert {r.doc_id: r["items"] for r in decontamination.judged(docs, item).collect()} == {1: [1], 2: [1], 3: [], 4: [1], 5: []}  # the words repeat after 9973
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.scored(docs, labels).count() == toxicity.scored(docs, labels).count() == 5


def repeated_bytes(texts: list[bytes], window: int) -> list[int]:
    """Bytes covered by an earlier string of `window` bytes, for each text."""
    seen, out = set(), []
    for t in texts:
        gone, end = 0, 0
        for i in range(len(t) - window + 1):
            key = hash(t[i : i + window])
            if key in seen:
                gone += i + window - max(i, end)
                end = i + window
            seen.add(key)
        out.append(gone)
    return out


def labelled(spark, make):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(3, 7))) for _ in range(200)]
    rows = [(i, *make(i, [rng.choice(words) for _ in range(rng.randint(20, 200))])) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (5000, None, None)], "doc_id bigint, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_quality_classifier(spark, empty):
    docs, labels, want = labelled(spark, lambda i, w: (" ".join(f"{x}&&&" if i % 3 == 0 else x for x in w), int(i % 3 != 0)))
    got = quality_classifier.scored(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.95 * len(held)
    assert quality_classifier.scored(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity(spark, empty):
    docs, labels, want = labelled(spark, lambda i, w: (" ".join([*w[:9], "you", "zzstupid", *w[9:]] if i % 3 == 0 else w), int(i % 3 == 0)))
    got = toxicity.scored(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.95 * len(held)
    assert toxicity.scored(empty, labels).count() == 0
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}


def test_decontamination(spark, empty):
    item = "A train leaves the station at 40 km per hour and reaches the old town after 3 hours while Anna waits near the gate."
    again = item.replace("40", "65").replace("3 hours", "7 hours").replace("Anna", "Boris")
    rows = [(1, f"Some words before. {item} And after."), (2, again), (3, "nothing of that kind is in here at all, only plain words that say little"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    benchmark = spark.createDataFrame([(7, item), (8, None), (None, "x")], "item_id bigint, text string")
    got = {r.doc_id: (r.contaminated, r["items"]) for r in decontamination.judged(docs, benchmark).collect()}
    assert got == {1: (True, [7]), 2: (True, [7]), 3: (False, []), 4: (False, []), 5: (False, [])}
    assert [r.doc_id for r in decontamination.stage(docs, benchmark).orderBy("doc_id").collect()] == [3, 4, 5]
    assert decontamination.judged(empty, benchmark).count() == 0


def leaks(spark, texts: list[str], items: list[str]) -> list[list[int]]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return [r["items"] for r in decontamination.judged(docs, benchmark).orderBy("doc_id").collect()]


def test_decontamination_by_occurrence(spark):
    item = "a train leaves the old station at 40 km per hour and reaches the small town by the sea after 3 hours while many people wait near the gate"
    variant = item.replace("40", "65").replace("3 hours", "7 hours")
    twice = "in the year before the war the number of people in the town was 500 and in the year after the war the number of people in the town was 700"
    filler = " nothing else of note was ever said about any of this by them" * 3
    shifted = variant.replace("reaches the", "so then at last it finally reaches the")
    long = "the farmer who lives near the river sells 12 sacks of grain on the first morning of the market then he walks home and counts what is left in the barn before his son brings 9 more from the mill which stands on the other side of the hill and at the end of that day they want to know how many of them are still there"
    parted = long.replace("12", "30").replace("walks", "slowly walks").replace("stands on", "now stands on")
    unlike = "we know that 40 birds came to the lake and that later in that same year some 40 birds left it"
    texts = [item + filler + " " + variant, variant + filler + " " + item.replace("40", "90"), item + filler + " " + " ".join(variant.split()[2:11]), twice, twice.replace("500", "510").replace("700", "720") + filler, shifted + filler + " " + item.replace("40", "12").split(" and ")[0], unlike.replace("40", "50", 1), filler, parted + filler + " " + " ".join(long.split()[4:13])]
    assert leaks(spark, texts, [item, twice, unlike, long]) == [[0], [0], [0], [1], [1], [0], [], [], [3]]
    places = {0: {0: [], 1: [(5, 6)]}, 2: {4: [(5, 6)], 5: []}, 3: {8: [(5, 7)]}, -9: {12: []}}
    assert decontamination.chained(0, places) == {0: 0, 1: 0, 4: 2, 5: 2}


def test_decontamination_of_short_items(spark):
    short, name = "why does old bread go stale", "in what year was Mozart born there"
    texts = ["someone asked us why does old bread go stale and nobody knew what to say", short, "they wondered in what year was Haydn born there and left", "why does bread go stale", "old bread go", "tell me why does old bread go"]
    assert leaks(spark, texts, [short, name]) == [[0], [0], [1], [], [], []]


def test_decontamination_of_copies_without_literal_words(spark):
    items = ["12 km 30 m 5 cm are 1234 m or how many 44 55 66", "Berlin Hamburg Bremen Kiel Rostock Dresden Leipzig Erfurt Mainz Bonn", "what is 7 times 8", "name three rivers", "Rom liegt am Tiber", "?!"]
    before, after = "then they asked about this and", "and so on as it was said"
    texts = [*(f"{before} {x} {after}" for x in items), *items, items[0].replace("30", "31").replace("44", "45").replace("1234", "999"), "Berlin Hamburg Ulm Kiel Trier Dresden Jena Erfurt Celle Bonn", "what is 7 times 9", "name three lakes"]
    assert leaks(spark, texts, items) == [[0], [1], [2], [], [], [], [0], [1], [2], [3], [4], [], [], [], [], []]


def test_decontamination_of_items_of_few_words(spark):
    """Items below five words are held by a line of their own, whatever its signs and case, and by nothing else."""
    texts = ["Yes we can go home now.", "yes", "Q: ready?\nYES!\nand so on", "no\nyes no", "name three rivers of the north", "What now?\n- Name three rivers:\n", "yes yes", "name three\nrivers", "\n\nyes\n"]
    assert leaks(spark, texts, ["Yes", "name three rivers", "no no"]) == [[], [0], [0], [], [], [1], [], [], [0]]


def test_decontamination_windows_against_brute_force(spark):
    """Copies of items inside random texts of their own words, against a plain search for the words in order."""
    rng = random.Random(17)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(25)]
    items = [" ".join(rng.choices(words, k=k)) for k in (1, 2, 4, 5, 6, 7, 8)]
    texts = []
    for _ in range(120):
        own = rng.choices(words, k=rng.randint(0, 25))
        at = rng.randint(0, len(own))
        own[at:at] = rng.choice(items).split() if rng.random() < 0.6 else []
        cut = rng.randint(0, len(own))
        texts.append("\n".join(x for x in (" ".join(own[:cut]), " ".join(own[cut:])) if x))
    want = []
    for t in texts:
        held = []
        for i, item in enumerate(items):
            if len(item.split()) < 5:
                held += [i] * (item in t.split("\n"))
            else:
                held += [i] * (f" {item} " in f" {' '.join(t.split())} ")
        want.append(held)
    got = leaks(spark, texts, items)
    assert got == want and sum(map(len, want)) > 40


def test_repeated_words_of_a_long_text(spark):
    """Two windows that share the 43 bits which a place in a million words leaves of a hash, and one that repeats."""
    own = lambda *x: F.array(*(F.lit(i).cast("bigint") for i in x))
    fill = F.sequence(F.lit(30_000_000).cast("bigint"), F.lit(31_100_000).cast("bigint"))
    hashes = F.concat(own(10148550, -1, -2, -3, -4, 7, 8, 9, 10, 11), fill, own(18314730, -1, -2, -3, -4, 5, 7, 8, 9, 10, 11))
    assert spark.range(1).select(hashes.alias("hashes")).select(quality_rules.repeated_words(F.col("hashes"))).first()[0] == 10
